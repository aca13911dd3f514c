"""Exact per-key state of streams: redelivered keys, and delivery attempts with dead letters.

State is held by key with a timeout in processing time, so it is bounded by what
arrives within the retention, and no row is dropped for being late.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


_EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"


def _millis(span: timedelta) -> int:
    return max(1, int(span.total_seconds() * 1000))


def _stateful(rows: DataFrame, keys: list[str], run, schema, state: str) -> DataFrame:
    return rows.groupBy(*keys).applyInPandasWithState(run, schema, state, "append", GroupStateTimeout.ProcessingTimeTimeout)


def start(writer, spark: SparkSession, every: str | None):
    """Start a stream with a batch ``every`` so often, or (None) over all that is there, and then it ends.

    A query with timeouts asks for one more batch for ever, so one that is to
    end runs no batches without rows; its timeouts are looked at with the next
    rows.
    """
    if every is not None:
        return writer.trigger(processingTime=every).start()
    before = spark.conf.get(_EMPTY_BATCHES)
    spark.conf.set(_EMPTY_BATCHES, "false")
    try:
        return writer.trigger(availableNow=True).start()  # takes a copy of the settings
    finally:
        spark.conf.set(_EMPTY_BATCHES, before)


def once(events: DataFrame, keys: list[str], retention: timedelta, *, unless: str | None = None) -> DataFrame:
    """The first row of each key in a stream, however late; the key is forgotten ``retention`` after that.

    Rows whose column ``unless`` is true pass and leave no trace: nothing has
    come of them yet, so their redelivery must not be dropped.
    """
    keep = _millis(retention)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = state.getCurrentProcessingTimeMs()
        until = state.get[0] if state.exists and state.get[0] > now else None  # a key with rows is not timed out by Spark
        for frame in frames:
            passes = frame[unless].astype(bool).to_numpy() if unless else pd.Series(False, index=frame.index).to_numpy()
            if until is None and not passes.all():
                until = now + keep
                passes = passes.copy()
                passes[(~passes).argmax()] = True
            yield frame[passes]
        if until is not None:
            state.update((until,))
            state.setTimeoutDuration(max(1, until - now))

    return _stateful(events, keys, run, events.schema, "until long")


def dead_letters(deliveries: DataFrame, key: str, attempts: int, retention: timedelta) -> DataFrame:
    """``key, attempts`` once for each key of a stream, when its failed deliveries (``ok`` not true) reach ``attempts``.

    A key is forgotten ``retention`` after its last delivery.
    """
    keep = _millis(retention)

    def run(of: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = state.getCurrentProcessingTimeMs()
        failures, dead = state.get[:2] if state.exists and state.get[2] > now else (0, False)
        for frame in frames:
            failures += int(frame["__failed"].sum())
        if failures >= attempts and not dead:
            dead = True
            yield pd.DataFrame({key: [of[0]], "attempts": [attempts]})
        state.update((failures, dead, now + keep))
        state.setTimeoutDuration(keep)

    rows = deliveries.select(key, (~F.coalesce("ok", F.lit(False))).alias("__failed"))
    return _stateful(rows, [key], run, rows.select(key, F.lit(0).cast("long").alias("attempts")).schema, "failures long, dead boolean, until long")
