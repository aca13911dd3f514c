"""Task messages of a queue: envelopes, routes, status, redelivery and dead letters.

Every function takes a batch or a streaming DataFrame alike.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from datetime import timedelta

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from quarry.sources.tables import store
from quarry.streaming import state

ATTEMPTS = 5
RETENTION = timedelta(days=7)
ROLL_BYTES = 10 << 20


def decode(messages: DataFrame, value_col: str = "value") -> DataFrame:
    """Adds ``task_id, task_type, input_data, metadata`` (JSON texts), ``attributes`` and ``error``.

    ``message.data`` is base64 of JSON; without ``message`` the value is the body itself.
    """
    raw = F.col(value_col)
    wrapped = F.get_json_object(raw, "$.message").isNotNull()
    data = F.try_to_binary(F.get_json_object(raw, "$.message.data"), F.lit("base64")).cast("string")
    body = F.when(wrapped, data).otherwise(raw)
    m = messages.withColumn("__body", F.when(F.is_valid_utf8(body), body))
    good = F.coalesce(F.try_parse_json("__body").isNotNull() & F.col("__body").rlike(r"^\s*\{"), F.lit(False))
    field = lambda k: F.when(good, F.get_json_object("__body", f"$.{k}"))
    none = F.create_map().cast("map<string,string>")
    attributes = F.coalesce(F.from_json(F.get_json_object(raw, "$.message.attributes"), "map<string,string>"), none)
    out = m.select(
        *messages.columns, field("task_id").alias("task_id"), field("task_type").alias("task_type"), field("input_data").alias("input_data"),
        field("metadata").alias("metadata"), attributes.alias("attributes"), F.when(~good, F.lit("invalid message")).alias("error"),
    )
    return out


def route(tasks: DataFrame) -> DataFrame:
    """Adds ``route`` (urls, text, none) and completes ``error`` for task types that cannot run."""
    kind = F.col("task_type")
    to = F.when(F.col("error").isNotNull(), "none").when(kind == "url_processing", "urls").when(kind == "text_processing", "text").otherwise("none")
    why = F.when(kind == "file_processing", "file_processing is not yet implemented").otherwise(F.concat(F.lit("unknown task type: "), F.coalesce(kind, F.lit(""))))
    return tasks.withColumn("route", to).withColumn("error", F.when((F.col("route") == "none") & F.col("error").isNull(), why).otherwise(F.col("error")))


def current_status(updates: DataFrame, *, task_col: str = "task_id", at: Column | None = None) -> DataFrame:
    """``task_id, status, error, updated_at``: the latest update of each task (``ts``, then ``seq``). In a stream use update mode."""
    order = at if at is not None else F.struct("ts", "seq")
    return updates.groupBy(task_col).agg(F.max_by("status", order).alias("status"), F.max_by("error", order).alias("error"), F.max("ts").alias("updated_at"))


def drop_redelivered(events: DataFrame, *, keys: tuple[str, ...] = ("path", "generation"), retention: timedelta = RETENTION, unless: str | None = None) -> DataFrame:
    """Each key once. Give it checked events only: what is not accepted must not use up a key.

    In a stream a key is known until ``retention`` after it was first seen; a
    later redelivery passes, as does every late event, and meets the registry,
    which is exact. See :func:`quarry.streaming.state.once` for ``unless``.
    """
    if not events.isStreaming:
        return events.dropDuplicates(list(keys))
    return state.once(events, list(keys), retention, unless=unless)


def split_dead(deliveries: DataFrame, *, key: str = "task_id", attempts: int = ATTEMPTS) -> tuple[DataFrame, DataFrame]:
    """``(live, dead)`` keys of a batch with their number of ``attempts``, by failed deliveries (``ok`` false). For streams see :func:`dead_letters`."""
    n = deliveries.groupBy(key).agg(F.count_if(~F.col("ok")).alias("attempts"))
    return n.where(F.col("attempts") < attempts), n.where(F.col("attempts") >= attempts)


def dead_letters(deliveries: DataFrame, *, key: str = "task_id", attempts: int = ATTEMPTS, retention: timedelta = RETENTION) -> DataFrame:
    """``key, attempts`` of the keys whose failed deliveries reach ``attempts``: in a stream once, with that delivery, and forgotten after the retention."""
    if not deliveries.isStreaming:
        return split_dead(deliveries, key=key, attempts=attempts)[1]
    return state.dead_letters(deliveries, key, attempts, retention)


def roll_json(rows: DataFrame, folder: str, name: str, *, suffix: str = ".json", most_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write ``rows`` as JSON lines to files ``{name}-{partition}-{number}{suffix}`` and give ``file, n_rows, n_bytes``.

    A file ends before the line that would take it over ``most_bytes``; only a
    longer line makes a longer file. Files are written under another name and
    moved when they are whole, so a task that is run again replaces its own.
    The rows are written when the result is asked for.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = store(folder)
        files.create_dir(base, recursive=True)
        part, number, sink, size, lines = TaskContext.get().partitionId(), 0, None, 0, 0
        held = f"{base}/.{name}-{part}-{uuid.uuid4().hex}"
        done = []

        def close() -> None:
            nonlocal sink, size, lines, number
            sink.close()
            final = f"{name}-{part:05d}-{number:05d}{suffix}"
            files.move(held, f"{base}/{final}")
            done.append((final, lines, size))
            sink, size, lines, number = None, 0, 0, number + 1

        for batch in batches:
            for line in batch.column("line").to_pylist():
                raw = line.encode() + b"\n"
                if sink is not None and size + len(raw) > most_bytes:
                    close()
                sink = sink or files.open_output_stream(held, compression=None)
                sink.write(raw)
                size, lines = size + len(raw), lines + 1
        if sink is not None:
            close()
        yield pa.RecordBatch.from_pylist([{"file": f, "n_rows": n, "n_bytes": b} for f, n, b in done], schema=pa.schema([("file", pa.string()), ("n_rows", pa.int64()), ("n_bytes", pa.int64())]))

    return rows.select(F.to_json(F.struct("*")).alias("line")).mapInArrow(write, "file string, n_rows long, n_bytes long")


def write_dead_letters(dead: DataFrame, path: str, checkpoint: str, *, every: str | None = "300 seconds", prefix: str = "dead-letters", suffix: str = ".json", most_bytes: int = ROLL_BYTES):
    """Stream dead letters to JSON files of ``most_bytes`` at the utmost, a roll every ``every`` (None: all that is there, then stop). A repeated batch replaces its files."""

    def each(batch: DataFrame, number: int) -> None:
        files, base = store(path)
        files.create_dir(base, recursive=True)
        name = f"{prefix}-{number:010d}"
        for old in files.get_file_info(fs.FileSelector(base)):
            if old.base_name.startswith((f"{name}-", f".{name}-")):
                files.delete_file(old.path)
        roll_json(batch, path, name, suffix=suffix, most_bytes=most_bytes).agg(F.sum("n_rows")).collect()

    return state.start(dead.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint), dead.sparkSession, every)


def run_routes(tasks: DataFrame, handlers: dict[str, Callable[[DataFrame, int], None]], checkpoint: str, *, every: str | None = None):
    """Give each micro-batch's rows of a route to its handler; handlers must stand repeats."""

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for name, handle in handlers.items():
                handle(batch.where(F.col("route") == name), number)
        finally:
            batch.unpersist()

    w = tasks.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return state.start(w, tasks.sparkSession, every)
