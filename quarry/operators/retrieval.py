"""Vector search for many queries, thresholds by query type, merged hits, contexts and their quality."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from quarry.functions.arrays import unit

#: Smallest similarity by query type (fixed values); other types take the last.
THRESHOLDS = {"terraform": 0.7, "code_generation": 0.6, "general_qa": 0.5, "documentation": 0.5}
OTHER = 0.5
#: A block of queries, and a slice of chunks, holds about so many values.
BLOCK_VALUES = 4_000_000


def threshold(query_type: Column, by_type: dict[str, float] = THRESHOLDS, other: float = OTHER) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in by_type.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, query_type), F.lit(other))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; null for a vector of zeros."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def _hits(names: np.ndarray, queries: np.ndarray, floor: np.ndarray, frame: pd.DataFrame, limit: int) -> pd.DataFrame:
    """The best ``limit`` rows of ``frame(cid, v)`` for each query, at or above its floor; queries are unit rows."""
    ids, rows, out = frame["cid"].to_numpy(), unit(frame["v"]), []
    for at in range(0, len(queries), 256):
        s = queries[at : at + 256] @ rows.T
        near = np.round(s, 9)
        last = np.partition(near, -limit, axis=1)[:, -limit:][:, :1] if limit < s.shape[1] else -np.inf
        i, j = np.nonzero((near >= last) & (s >= floor[at : at + 256, None]))  # the best with all ties of the last
        order = np.lexsort((ids[j], -near[i, j], i))
        i, j = i[order], j[order]
        top = np.arange(len(i)) - np.searchsorted(i, i) < limit
        i, j = i[top], j[top]
        out.append(pd.DataFrame({"query_id": names[at + i], "cid": ids[j], "similarity": s[i, j]}))
    return pd.concat(out)


def vector_search(queries: DataFrame, chunks: DataFrame, *, limit: int = 10, least: float | Column | None = None, width: int | None = None, id_col: str = "chunk_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id, <id>, similarity, rank``: the ``limit`` most similar chunks at or above each query's threshold (or ``least``, a number or a column of the queries).

    Queries of ``BLOCK_VALUES`` numbers together are sent to every task, which
    passes over its chunks where they are. More queries are dealt to blocks of
    that size, and a block meets a slice of the chunks as one matrix product.
    Only ``limit`` rows for each query and batch are shuffled for the ranking.
    """
    spark = chunks.sparkSession
    first = queries.select(F.size("embedding")).first()
    dim = width or (first[0] if first else 1)
    blocks = max(1, -(-queries.count() * dim // BLOCK_VALUES))
    q = queries.select("query_id", F.col("embedding").alias("q"), (threshold(F.col("query_type")) if least is None else least if isinstance(least, Column) else F.lit(float(least))).alias("least"))
    c = chunks.where(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("cid"), F.col(vec_col).alias("v"))
    kinds = queries.schema["query_id"].dataType.simpleString(), chunks.schema[id_col].dataType.simpleString()
    found = f"query_id {kinds[0]}, cid {kinds[1]}, similarity double"
    if blocks == 1:
        few = q.toPandas()  # BLOCK_VALUES numbers at most
        sent = spark.sparkContext.broadcast((few["query_id"].to_numpy(), unit(few["q"]) if len(few) else np.zeros((0, dim)), few["least"].to_numpy(dtype=float)))

        def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                if len(frame) and len(sent.value[0]):
                    yield _hits(*sent.value, frame, limit)

        met = c.mapInPandas(scan, found)
    else:
        slices = max(spark.sparkContext.defaultParallelism, -(-chunks.count() * dim // BLOCK_VALUES))
        q = q.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))).withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
        c = c.withColumn("slice", F.pmod(F.xxhash64("cid"), F.lit(slices))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

        def tile(qf: pd.DataFrame, cf: pd.DataFrame) -> pd.DataFrame:
            if not len(qf) or not len(cf):
                return pd.DataFrame({"query_id": [], "cid": [], "similarity": []})
            return _hits(qf["query_id"].to_numpy(), unit(qf["q"]), qf["least"].to_numpy(dtype=float), cf, limit)

        met = q.groupBy("block", "slice").cogroup(c.groupBy("block", "slice")).applyInPandas(tile, found)
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("similarity", 9)), "cid")
    return met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select("query_id", F.col("cid").alias(id_col), "similarity", "rank")


def merge_hits(initial: DataFrame, enhanced: DataFrame, *, id_col: str = "chunk_id", limit: int | None = None) -> DataFrame:
    """Hits of both searches, the higher similarity of each (query, chunk), ranked again."""
    both = initial.select("query_id", id_col, "similarity").unionByName(enhanced.select("query_id", id_col, "similarity"))
    best = both.groupBy("query_id", id_col).agg(F.max("similarity").alias("similarity"))
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), id_col)))
    return best if limit is None else best.where(F.col("rank") <= limit)


def contexts(hits: DataFrame, separator: str = "\n\n") -> DataFrame:
    """``query_id, context, sources`` from ``hits(query_id, rank, text, doc_id)``: texts in rank order, distinct documents sorted."""
    rows = F.array_sort(F.collect_list(F.struct("rank", "text")))
    return hits.groupBy("query_id").agg(F.array_join(F.transform(rows, lambda r: r.text), separator).alias("context"), F.array_sort(F.collect_set("doc_id")).alias("sources"))


def quality(hits: DataFrame, enough: int = 3) -> DataFrame:
    """Per query: hits, distinct documents, best and mean similarity, and whether there are ``enough`` hits."""
    return hits.groupBy("query_id").agg(
        F.count("*").alias("hits"), F.count_distinct("doc_id").alias("documents"), F.max("similarity").alias("max_similarity"),
        F.avg("similarity").alias("mean_similarity"), (F.count("*") >= enough).alias("enough_context"),
    )
