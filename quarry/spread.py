"""Joins on keys of which some may hold a large share of all rows.

The rows of a hot key are dealt to parts of about ``rows`` rows each, and the
one row they are joined to is copied to each part. What is sent to every task is
a table of bucket numbers of hot keys, at most ``BUCKETS`` of them, however many
rows and keys there are: keys of the same bucket are dealt alike, which costs a
few copies and changes no result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

BUCKETS = 1 << 18


def _bucket(keys: list[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int").alias("__bucket")


def hot_parts(counts: DataFrame, keys: list[str], rows: int = 1024) -> DataFrame:
    """``__bucket, __parts`` of the keys that ``counts(keys, n)`` gives more than ``rows`` rows."""
    hot = counts.where(F.col("n") > rows).groupBy(_bucket(keys)).agg(F.max(F.ceil(F.col("n") / rows)).cast("int").alias("__parts"))
    return F.broadcast(hot)


def with_parts(df: DataFrame, hot: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with ``parts``, in how many its key is dealt."""
    return df.withColumn("__bucket", _bucket(keys)).join(hot, "__bucket", "left").withColumn("parts", F.coalesce("__parts", F.lit(1))).drop("__bucket", "__parts")


def share(by: list[str], n: Column) -> Column:
    """A number from 0 to below ``n`` by a hash of the columns ``by``."""
    return F.pmod(F.xxhash64(*by, F.lit(5)), n).cast("int")


def deal(many: DataFrame, hot: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """``many`` with ``part``: a number below its key's parts, by a hash of the columns ``by``."""
    return with_parts(many, hot, keys).withColumn("part", share(by, F.col("parts"))).drop("parts")


def copied(one: DataFrame, hot: DataFrame, keys: list[str]) -> DataFrame:
    """``one`` with a row for each ``part`` of its key."""
    return with_parts(one, hot, keys).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")


def unsent(df: DataFrame) -> DataFrame:
    """``df`` for a join that is to shuffle it. Spark judges a table by its files, which a few MB of numbers or rows exploded after the reading outgrow many times in the driver."""
    return df.hint("merge")


def listed(many: DataFrame, few: DataFrame, keys: list[str]) -> DataFrame:
    """``many`` without most rows whose key ``few`` lacks, by bucket numbers sent to every task; no shuffle of ``many``."""
    return many.withColumn("__bucket", _bucket(keys)).join(F.broadcast(few.select(_bucket(keys)).distinct()), "__bucket", "left_semi").drop("__bucket")
