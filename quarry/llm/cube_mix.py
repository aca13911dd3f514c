"""Mixing sources to target weights by balanced sampling with the cube method.

Each document of a source carries the same inclusion probability. The flight
phase moves the probabilities of a few documents at a time along the null space
of two constraints, the number of documents and the number of words, until
nearly all are 0 or 1; both totals stay as they were. It runs in parallel over
blocks of a source, then over what the blocks left undecided, level by level.
The landing problem that remains, a dozen documents of a source at most, is
settled by the combination nearest to both totals.
"""

from __future__ import annotations

import hashlib
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from quarry.spread import hot_parts, with_parts
from quarry.scratch import materialize

BLOCK = 2000
LANDING = 12
_EPS = 1e-9

#: Characters between words: space and \t \n \v \f \r.
WORDS = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Number of words of a whole text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sized: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """``source, source_no, n, source_size, target`` from rows of ``source, size``.

    Sources in code-point order, null last, take the weights in turn. All
    targets sum to ``share`` times all sizes; none exceeds ``most`` times its
    source's size; what a full source cannot take goes to the others by weight.
    """
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    # one row per source from here on
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    by = by.withColumn("source_no", F.row_number().over(order))
    by = by.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("source_no") - 1) % len(weights) + 1).cast("double"))
    by = by.withColumn("cap", most * F.col("source_size"))
    level = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("weight"), "source_no")
    total = share * F.sum("source_size").over(Window.partitionBy(F.lit(0)))
    full = F.coalesce(F.sum("cap").over(level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(level.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    by = by.withColumn("rate", (total - full) / left)
    # the first source, by what it can take per weight, that is not filled sets the rate for all after it
    by = by.withColumn("rate", F.min(F.when(F.col("rate") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "source_no", "rate"))).over(Window.partitionBy(F.lit(0))).rate)
    by = by.withColumn("target", F.coalesce(F.least("cap", F.col("rate") * F.col("weight")), F.col("cap")))
    return by.select("source", "source_no", "n", "source_size", "target")


def fly(size: list[float], p: list[float], draw) -> list[float]:
    """Flight: probabilities after moving along the null space of (1, size), three units at a time."""
    p = list(p)
    held: list[int] = []
    queue = iter(range(len(p)))
    while True:
        while len(held) < 3 and (i := next(queue, None)) is not None:
            if _EPS < p[i] < 1 - _EPS:
                held.append(i)
        x = [size[i] for i in held]
        if len(held) == 3:
            u = [x[2] - x[1], x[0] - x[2], x[1] - x[0]]
            if not any(u):
                u = [1.0, -1.0, 0.0]
        elif len(held) == 2 and x[0] == x[1]:
            u = [1.0, -1.0]
        else:
            return p
        up = min((1 - p[i]) / v if v > 0 else -p[i] / v for i, v in zip(held, u, strict=True) if v)
        down = min(p[i] / v if v > 0 else (p[i] - 1) / v for i, v in zip(held, u, strict=True) if v)
        step = up if draw() * (up + down) < down else -down
        for i, v in zip(held, u, strict=True):
            moved = p[i] + step * v
            p[i] = 0.0 if moved < _EPS else 1.0 if moved > 1 - _EPS else moved
        held = [i for i in held if 0.0 < p[i] < 1.0]


def land(size: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Of all 0/1 choices for a few units, the one nearest to the words, then the documents, expected."""
    n = len(p)
    choice = (np.arange(1 << n)[:, None] >> np.arange(n)) & 1
    off = choice - p
    miss = np.abs(off @ size) + 0.25 * size.mean() * np.abs(off.sum(axis=1))
    return choice[int(miss.argmin())].astype(float)


def _block(last: bool, seed: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("place", "ascending"), ("size", "ascending")])
        digest = hashlib.blake2b(f"{seed} {key}".encode(), digest_size=8).digest()
        draw = np.random.default_rng(int.from_bytes(digest, "big")).random
        size, p = rows.column("size").to_pylist(), rows.column("p").to_pylist()
        if last and len(p) > LANDING:
            head = len(p) - LANDING
            p = fly([*map(float, size)], p, draw)
            if (rest := sum(0 < x < 1 for x in p)) < LANDING and head:
                # keep some of the units open for the landing: fly all but the last ones
                first = fly([*map(float, size[:head])], rows.column("p").to_pylist()[:head], draw)
                p = [*first, *rows.column("p").to_pylist()[head:]]
                rest = sum(0 < x < 1 for x in p)
            while rest > LANDING:  # the flight of the first units leaves two, so two more must fly
                open_ = [i for i, x in enumerate(p) if 0 < x < 1][:3]
                for i, x in zip(open_, fly([float(size[i]) for i in open_], [p[i] for i in open_], draw), strict=True):
                    p[i] = x
                rest = sum(0 < x < 1 for x in p)
        elif not last:
            p = fly([*map(float, size)], p, draw)
        p = np.array(p, dtype=float)
        if last and len(open_ := np.flatnonzero((p > 0) & (p < 1))):
            p[open_] = land(np.array(size, dtype=float)[open_], p[open_])
        return rows.set_column(rows.schema.get_field_index("p"), "p", pa.array(p))

    return run


def mix(docs: DataFrame, *, weights: list[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 7, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Per row: id, ``size`` (words), ``source_size``, ``target`` of its source, ``taken`` (words the mix takes).

    A document is taken whole, ``floor(target / source_size)`` times and once
    more if the sample includes it, so never more than ``most`` times (an
    integer) its size. Results depend on ids, sizes and the seed only, but where
    more than a block of rows share an id (null too): these are dealt to blocks
    by their place in the files. Null texts and texts without words have size 0
    and are not sampled; null sources are one source; rows with a null id and
    repeated rows count and are sampled as any other; an empty table gives no
    rows; further columns are ignored.
    """
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"))
    sized = materialize(sized.withColumn("row", F.monotonically_increasing_id()), "sizes")  # numbered once, as written
    goal = materialize(targets(sized, list(weights), share, most), "targets")
    largest = goal.agg(F.max("n")).first()[0] or 0
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    units = sized.join(goal, sized.source.eqNullSafe(goal.source), "left").select("id", "row", "size", "source_no", "n", "source_size", "target", rate.alias("rate"))
    units = units.withColumn("copies", F.floor(F.col("rate") + _EPS)).withColumn("p", F.greatest(F.lit(0.0), F.col("rate") - F.col("copies")))
    units = with_parts(units, hot_parts(sized.groupBy("id").agg(F.count("*").alias("n")), ["id"], BLOCK), ["id"])
    units = units.withColumn("place", F.xxhash64("id", F.lit(seed), F.pmod("row", "parts"))).drop("row", "parts")
    units = units.withColumn("block", F.pmod("place", F.ceil(F.col("n") / BLOCK).cast("long"))).drop("n", "rate")
    sampled = (F.col("p") > _EPS) & (F.col("size") > 0)
    fixed = units.where(~sampled)
    open_ = units.where(sampled)
    done = []
    blocks = max(1, ceil(largest / BLOCK))
    while True:
        last = blocks == 1
        flown = materialize(open_.groupBy("source_no", "block").applyInArrow(_block(last, seed), open_.schema), "flown")
        undecided = (F.col("p") > 0) & (F.col("p") < 1)
        done.append(flown.where(~undecided))
        if last:
            break
        blocks = ceil(blocks / (BLOCK // 4))
        open_ = flown.where(undecided).withColumn("block", F.pmod("block", F.lit(blocks)))
    out = fixed.withColumn("p", F.lit(0.0))
    for part in done:
        out = out.unionByName(part)
    taken = (F.col("size") * (F.col("copies") + F.col("p"))).cast("long")
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", taken.alias("taken"))
