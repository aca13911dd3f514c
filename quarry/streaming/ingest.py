"""Streaming ingest: storage events to registry and chunk tables, the same result as in one batch."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarry import schemas
from quarry.operators.ingest import check_events, ingest_loaded, split_known
from quarry.scratch import passing
from quarry.streaming.keylog import KeyedLog
from quarry.streaming.queue import RETENTION, drop_redelivered
from quarry.streaming.state import start


@dataclass
class Tables:
    """What a stream of events leaves below ``root``: the registry, the chunks, and accepted events without an object."""

    registry: KeyedLog
    chunks: KeyedLog
    rejected: KeyedLog

    @classmethod
    def at(cls, spark: SparkSession, root: str, **sizes) -> Tables:
        return cls(
            KeyedLog(spark, f"{root}/registry", schemas.REGISTRY, ["original_path", "generation"], **sizes),
            KeyedLog(spark, f"{root}/chunks", schemas.CHUNKS, ["doc_id"], **sizes),
            KeyedLog(spark, f"{root}/rejected", schemas.REJECTED, ["path", "generation"], **sizes),
        )


def accepted_keys(events: DataFrame, bucket: str) -> DataFrame:
    """``bucket, path, name, generation`` of accepted events."""
    ok = check_events(events, bucket).where("outcome = 'accepted'")
    return ok.select("bucket", F.concat(F.lit("gs://"), F.col("bucket"), F.lit("/"), "name").alias("path"), "name", "generation")


def with_content(keys: DataFrame, objects: DataFrame) -> DataFrame:
    """Keys of objects with what these hold: ``path, generation, metadata, text, pages, failure``."""
    return keys.join(objects, ["name", "generation"]).select("path", "generation", "metadata", "text", "pages", "failure")


def events_with_content(events: DataFrame, objects: DataFrame, bucket: str) -> DataFrame:
    """Accepted events with what their object holds."""
    return with_content(accepted_keys(events, bucket), objects)


def ingest_stream(events: DataFrame, objects: DataFrame, root: str, bucket: str, *, retention: timedelta = RETENTION, every: str | None = None, buckets: int = 64, merge_after: int = 32, **making):
    """Start the query over ``events(value)``, a stream.

    Events are checked first, and only accepted ones count from there on, so
    neither another bucket's event nor a rejected one stands in for a valid one.
    Redeliveries within the retention are dropped by bucket, name and
    generation; everything later meets the registry, of which a batch reads the
    buckets its keys fall in. An event whose object is not there (as of the
    start of the query) is written to ``rejected`` with a reason, leaves no
    registry row and is tried again when it is redelivered. ``making``: how
    chunks and vectors are made, as in a batch.
    """
    spark = objects.sparkSession
    tables = Tables.at(spark, root, buckets=buckets, merge_after=merge_after)

    def each(batch: DataFrame, number: int) -> None:
        for log in (tables.registry, tables.chunks, tables.rejected):
            log.merge(number)
        keys = batch.persist()
        try:
            with passing(spark):  # what the batch writes on its way goes with it
                there = keys.where("not missing")
                # known versions go by their keys, before any content is read
                new, _ = split_known(there, tables.registry.before(number, there, ["path", "generation"]))
                created = F.lit("1970-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(secs=F.lit(number).cast("decimal(18,6)"))
                rows, made, _ = ingest_loaded(with_content(new, objects), created, **making)
                tables.chunks.write(made, number)
                gone = keys.where("missing").dropDuplicates(["path", "generation"])
                tables.rejected.write(gone.select("path", "generation", F.lit("object not found").alias("reason")), number)
                tables.registry.write(rows, number)
        finally:
            keys.unpersist()

    known = objects.select("name", "generation", F.lit(False).alias("missing")).distinct()
    keyed = accepted_keys(events.select("value"), bucket).join(known, ["name", "generation"], "left").withColumn("missing", F.coalesce("missing", F.lit(True)))
    first = drop_redelivered(keyed, keys=("bucket", "name", "generation"), retention=retention, unless="missing")
    w = first.writeStream.foreachBatch(each).option("checkpointLocation", f"{root}/checkpoint")
    return start(w, spark, every)
