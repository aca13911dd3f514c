"""Connected components by alternating star contractions, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from quarry.scratch import materialize, release
from quarry.spread import unsent


def _written(edges: DataFrame, tag: str) -> tuple[DataFrame, tuple]:
    """The edges as a written table, and a fingerprint of them that the write itself takes."""
    seen = Observation()
    mark = [F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("hash")]
    table = materialize(edges.observe(seen, *mark), tag)
    return table, (seen.get["n"], seen.get["hash"])


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, component`` (smallest node reachable) for every node of ``edges(a, b)``.

    Each round points a node's larger neighbours, then the node and its smaller
    ones, to its smallest neighbour; rounds grow with the logarithm of the
    longest path. No edges give no rows; self-links and repeats are ignored,
    links with a null end too.
    """
    e, mark = _written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    if mark[0]:
        for _ in range(max_rounds):
            both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
            low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
            large = both.where("b > a").join(unsent(low), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
            least = large.groupBy("a").agg(F.min("b").alias("m"))
            small = large.join(unsent(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
            before, last = e, mark
            e, mark = _written(small.where("a <> b").distinct(), "stars")
            release(before)
            if mark == last:
                break
        else:
            raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
