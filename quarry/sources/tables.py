"""Sources and sinks: raw objects, page JSON, embedding text, coordinates, scraped pages."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quarry import schemas
from quarry.functions.text import decode_bytes, embedding_from_text, embedding_to_text
from quarry.operators.web import saved_pages
from quarry.scratch import materialize
from quarry.sources.versions import Versions


def store(root: str):
    """The file system of ``root`` and the folder in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(root.replace("s3a://", "s3://", 1) if ":" in root else f"file://{root}")


def find_objects(root: str, manifest: DataFrame) -> DataFrame:
    """``manifest(path, generation, metadata)`` with ``file`` and ``size`` of each object below ``root``; null where there is none.

    A generation's own bytes lie under ``{path}#{generation}``; without such a
    file the object has one version only, under its path. Only the named files
    are looked at, none is opened.
    """

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = store(root)
        for batch in batches:
            asked = [f"{base}/{p}{mark}" for p, g in zip(batch.column("path").to_pylist(), batch.column("generation").to_pylist(), strict=True) for mark in (f"#{g}", "")]
            infos = files.get_file_info(asked)
            found = [next((i for i in pair if i.is_file), None) for pair in zip(infos[::2], infos[1::2], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([i and i.path for i in found], pa.string()), pa.array([i and i.size for i in found], pa.int64())], [*batch.schema.names, "file", "size"])

    rows = manifest.select("path", "generation", "metadata")
    return rows.mapInArrow(look, rows.select("*").schema.add("file", "string").add("size", "long"))


def read_pieces(root: str, found: DataFrame, piece_bytes: int = 8 << 20) -> DataFrame:
    """The bytes of :func:`find_objects` rows in ranges: ``path, generation, metadata, size, piece, content``.

    Pieces are dealt to tasks one by one, so a task reads about as much as the
    next however large single objects are. An empty object is one empty piece.
    """
    rows = found.select("*", F.explode(F.sequence(F.lit(0), F.greatest(F.call_function("div", F.col("size") - 1, F.lit(piece_bytes)), F.lit(0)).cast("int"))).alias("piece"))
    rows = rows.repartition(F.xxhash64("path", "generation", "piece"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = store(root)
        for batch in batches:
            for i in range(len(batch)):  # a piece at a time is held
                row = batch.slice(i, 1)
                with files.open_input_file(row.column("file")[0].as_py()) as file:
                    file.seek(row.column("piece")[0].as_py() * piece_bytes)
                    content = file.read(piece_bytes)
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([content], pa.binary())], [*row.schema.names, "content"])

    return rows.mapInArrow(read, rows.select("*").schema.add("content", "binary")).drop("file")


def read_objects(spark: SparkSession, root: str, manifest: DataFrame, *, piece_bytes: int = 8 << 20) -> tuple[DataFrame, DataFrame]:
    """``(objects, rejected)`` of ``manifest(path, generation, metadata)``, paths relative to ``root``.

    Each generation comes with its own ``content`` (see :func:`find_objects`).
    Only files that the manifest names are opened. Bytes go through a shuffle
    for objects of several pieces only. What does not exist is rejected with a
    reason and must not be registered.
    """
    at = materialize(find_objects(root, manifest), "objects-found")
    columns = ["path", "generation", "metadata", "content", F.col("size").alias("length")]
    whole = read_pieces(root, at.where(F.col("size") <= piece_bytes), piece_bytes).select(*columns)
    parts = read_pieces(root, at.where(F.col("size") > piece_bytes), piece_bytes)
    joined = F.aggregate(F.array_sort(F.collect_list(F.struct("piece", "content"))), F.lit(b""), lambda s, p: F.concat(s, p.content))
    long = parts.groupBy("path", "generation").agg(F.first("metadata").alias("metadata"), joined.alias("content"), F.first("size").alias("size"))
    rejected = at.where("size is null").select("path", "generation", "metadata", F.lit("object not found").alias("reason"))
    return whole.unionByName(long.select(*columns)), rejected


def with_text(objects: DataFrame) -> DataFrame:
    return objects.withColumn("text", decode_bytes(F.col("content")))


def write_page_json(pages: DataFrame, path: str) -> None:
    """``doc_id, pages`` as JSON lines; an empty list is written too."""
    pages.select("doc_id", "pages").write.mode("overwrite").option("ignoreNullFields", "true").json(path)


def read_page_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"doc_id string, pages {schemas.PAGE_ARRAY.simpleString()}").json(path)


def embeddings_as_text(rows: DataFrame, vec_col: str = "embedding") -> DataFrame:
    return rows.withColumn(vec_col, embedding_to_text(F.col(vec_col)))


def embeddings_from_text(rows: DataFrame, vec_col: str = "embedding") -> DataFrame:
    return rows.withColumn(vec_col, embedding_from_text(F.col(vec_col)))


def write_coordinates(coords: DataFrame | None, path: str) -> bool:
    """Replace the coordinate table as a whole, in one commit; None keeps the old one. A write that fails leaves the old table readable."""
    if coords is None:
        return False
    Versions(coords.sparkSession, path).replace(coords)
    return True


def read_coordinates(spark: SparkSession, path: str) -> DataFrame:
    return Versions(spark, path).read()


def write_scraped(extracted: DataFrame, path: str) -> None:
    """Successful captures, as a table keyed by url."""
    saved_pages(extracted).write.mode("overwrite").parquet(path)


def touched_bucket(doc_id: Column, buckets: int = 256) -> Column:
    """Bucket of a document for tables whose updates rewrite touched buckets only."""
    return F.pmod(F.xxhash64(doc_id), F.lit(buckets)).cast("int")


def overwrite_touched(chunks: DataFrame, path: str, buckets: int = 256) -> None:
    """Write chunks partitioned by bucket of ``doc_id``, replacing only the buckets that occur."""
    rows = chunks.withColumn("bucket", touched_bucket(F.col("doc_id"), buckets)).repartition("bucket")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
