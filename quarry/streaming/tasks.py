"""Queue tasks to chunks in one go: envelopes, routes, text messages, web pages and the tasks' status.

The same function serves a batch and each micro-batch of a stream. What a task
has come to is read from the registry, so a redelivered task changes nothing and
reports what it reported before.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarry import schemas
from quarry.operators.ingest import process_messages
from quarry.operators.web import Selector, pages_to_chunks, registry_rows
from quarry.scratch import materialize, passing
from quarry.streaming.keylog import KeyedLog
from quarry.streaming.queue import decode, route
from quarry.streaming.state import start

NO_CAPTURE = "url was not captured"


@dataclass
class TaskTables:
    """What a stream of tasks leaves below ``root``: registry, chunks, and status updates."""

    registry: KeyedLog
    chunks: KeyedLog
    status: KeyedLog

    @classmethod
    def at(cls, spark: SparkSession, root: str, **sizes) -> TaskTables:
        return cls(
            KeyedLog(spark, f"{root}/registry", schemas.REGISTRY, ["original_path", "generation"], **sizes),
            KeyedLog(spark, f"{root}/chunks", schemas.CHUNKS, ["doc_id"], **sizes),
            KeyedLog(spark, f"{root}/status", schemas.STATUS, ["task_id"], **sizes),
        )


def texts(tasks: DataFrame) -> DataFrame:
    """``task_id, title, content, ts`` of text tasks."""
    field = lambda k: F.get_json_object("input_data", f"$.{k}").alias(k)
    return tasks.where("route = 'text'").select("task_id", field("title"), field("content"), "ts")


def urls(tasks: DataFrame) -> DataFrame:
    """``task_id, url``: each url that a task asks for, once."""
    listed = F.from_json(F.get_json_object("input_data", "$.urls"), "array<string>")
    found = tasks.where("route = 'urls'").select("task_id", F.explode(listed).alias("url"))
    return found.select("task_id", F.trim("url").alias("url")).where("url <> ''").distinct()


def paths(tasks: DataFrame) -> DataFrame:
    """``task_id, path, generation``: the registry keys of what tasks bring in."""
    said = tasks.where("route = 'text'").select("task_id", F.concat(F.lit("text://"), "task_id").alias("path"))
    return said.unionByName(urls(tasks).withColumnRenamed("url", "path")).distinct().withColumn("generation", F.lit(0).cast("long"))


def take_in(tasks: DataFrame, captures: DataFrame, sites: dict[str, list[Selector]], registry: DataFrame, **making) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(registry rows, chunks, status updates)`` that come of routed ``tasks(task_id, route, error, input_data, ts)``.

    ``registry`` holds at least the rows under the tasks' keys. Texts and urls
    it knows are not taken in again. A url without a capture leaves no row and
    counts as failed. A task is ``processing`` when it arrives, then
    ``completed`` (of urls: with the counts of processed and failed ones) or
    ``failed`` with the reason; tasks without an id have no status.
    """
    known = registry.where("generation = 0").select(F.col("original_path").alias("path")).distinct()
    new = materialize(paths(tasks).join(known, "path", "left_anti").select("path").distinct(), "new-paths")
    fresh = texts(tasks).withColumn("path", F.concat(F.lit("text://"), "task_id")).join(new, "path", "left_semi").drop("path")
    said, said_chunks = process_messages(fresh, **making)
    asked = captures.join(new.withColumnRenamed("path", "url"), "url", "left_semi")
    pages, page_chunks = pages_to_chunks(asked, sites, **making)
    rows = materialize(said.unionByName(registry_rows(pages, F.current_timestamp())), "task-rows")

    after = registry.unionByName(rows).where("generation = 0").select(F.col("original_path").alias("path"), F.col("status").alias("now"), "error_message").dropDuplicates(["path"])
    come = paths(tasks).join(after, "path", "left").groupBy("task_id").agg(
        F.count_if(F.col("now") == "Ready").alias("processed_count"), F.count_if(~F.col("now").eqNullSafe("Ready")).alias("failed_count"), F.max("error_message").alias("why"))
    done = tasks.select("task_id", "route", "error", "ts").where("task_id is not null").join(come, "task_id", "left")
    text_failed = (F.col("route") == "text") & (F.coalesce("processed_count", F.lit(0)) == 0)
    status = F.when(F.col("error").isNotNull() | text_failed, "failed").otherwise("completed")
    counts = F.to_json(F.struct(F.coalesce("processed_count", F.lit(0)).alias("processed_count"), F.coalesce("failed_count", F.lit(0)).alias("failed_count")))
    ended = done.select("task_id", status.alias("status"), F.coalesce("error", F.when(text_failed, F.col("why"))).alias("error"), F.when(F.col("route") == "urls", counts).alias("result"), "ts", F.lit(1).cast("long").alias("seq"))
    none = F.lit(None).cast("string")
    begun = tasks.where("task_id is not null").select("task_id", F.lit("processing").alias("status"), none.alias("error"), none.alias("result"), "ts", F.lit(0).cast("long").alias("seq"))
    return rows, said_chunks.unionByName(page_chunks), begun.unionByName(ended)


def task_stream(messages: DataFrame, captures: DataFrame, sites: dict[str, list[Selector]], root: str, *, every: str | None = None, buckets: int = 64, merge_after: int = 32, **making):
    """Start the query over queue ``messages(value, ts)``. A batch reads the registry's buckets under its own keys; a repeated batch replaces what it wrote."""
    spark = captures.sparkSession
    tables = TaskTables.at(spark, root, buckets=buckets, merge_after=merge_after)

    def each(batch: DataFrame, number: int) -> None:
        for log in (tables.registry, tables.chunks, tables.status):
            log.merge(number)
        with passing(spark):
            tasks = materialize(route(decode(batch)).select("task_id", "route", "error", "input_data", "ts"), "routed")  # whole texts: written, as executors would hold them in memory
            known = tables.registry.before(number, paths(tasks), ["path", "generation"])
            rows, made, status = take_in(tasks, captures, sites, known, **making)
            tables.chunks.write(made, number)
            tables.status.write(status, number)
            tables.registry.write(rows, number)

    w = messages.select("value", "ts").writeStream.foreachBatch(each).option("checkpointLocation", f"{root}/checkpoint")
    return start(w, spark, every)
