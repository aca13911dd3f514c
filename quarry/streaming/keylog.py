"""A growing table of a stream: a folder per micro-batch, its rows in buckets by key, merged now and then."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType
from pyspark.sql.utils import AnalysisException

from quarry.sources.versions import Versions


class KeyedLog:
    """Rows under ``keys``, appended by micro-batch.

    A repeated batch replaces what it wrote. A lookup opens only the buckets its
    keys fall in, so a batch's cost follows its own keys, not the length of the
    stream. After ``merge_after`` batches all of them are written anew as one,
    as a new version of the table: readers see the old files or the new ones,
    never both.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: list[str], *, buckets: int = 64, merge_after: int = 32):
        self.spark, self.path, self.schema, self.keys = spark, path, schema, keys
        self.buckets, self.merge_after = buckets, merge_after
        self.versions = Versions(spark, path)

    def bucket(self, keys: list[str | Column] | None = None) -> Column:
        return F.pmod(F.xxhash64(*(keys or self.keys)), F.lit(self.buckets)).cast("int")

    def _folder(self) -> str:
        return self.versions.current() or f"{self.path}/first"

    def read(self) -> DataFrame:
        """All rows, with ``batch`` and ``bucket``."""
        full = StructType([*self.schema.fields, StructField("batch", LongType()), StructField("bucket", IntegerType())])
        try:
            return self.spark.read.schema(full).parquet(self._folder())
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], full)  # nothing written yet

    def before(self, batch: int, near: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
        """Rows of earlier batches; with ``near``, those of the buckets that its ``keys`` (named as the log's, if not given) fall in."""
        rows = self.read().where(F.col("batch") < batch)
        if near is not None:
            touched = [r[0] for r in near.select(self.bucket(keys)).distinct().collect()]  # as many numbers as buckets at most
            rows = rows.where(F.col("bucket").isin(touched))
        return rows.drop("batch", "bucket")

    def _put(self, rows: DataFrame, folder: str, batch: int) -> None:
        dealt = rows.select(*self.schema.names).withColumn("bucket", self.bucket()).hint("rebalance", "bucket")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/batch={batch}")

    def write(self, rows: DataFrame, batch: int) -> None:
        self._put(rows, self._folder(), batch)

    def merge(self, before: int) -> bool:
        """Merge the batches before this one if there are enough of them; call it ahead of the batch's own write."""
        folder = self._folder()
        held = [n for n in self.versions.names(folder.rsplit("/", 1)[1]) if n.startswith("batch=")]
        if len(held) <= self.merge_after:
            return False
        fresh = self.versions.stage()
        self._put(self.before(before), fresh, before - 1)
        self.versions.commit(fresh)
        self.versions.clear()
        return True
