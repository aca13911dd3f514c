"""Intermediate tables in the folder that the cluster shares.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir``, so a lost
executor never costs more than the stages since the last write, and every
executor can read what another one wrote.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_made: set[str] = set()
_paths: list[str] = []  # in the order in which they were given out
_own: dict[str, str] = {}  # folders of local sessions that name none


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset a temporary one, in local mode only."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        root = _own.get(app) or _own.setdefault(app, "file://" + tempfile.mkdtemp(prefix="spark-shared-"))
    return root.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A fresh path below the shared folder; removed when the Python driver ends."""
    base = f"{shared_dir(spark)}/quarry-{spark.sparkContext.applicationId}"
    if base not in _made:
        _made.add(base)
        atexit.register(_remove, spark, base)
    _paths.append(f"{base}/{tag}-{uuid.uuid4().hex}")
    return _paths[-1]


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once and return the table read back."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete written tables that no result reads any more."""
    for table in tables:
        drop_path(table.sparkSession, table.scratch_path)


def sweep(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished rounds, which else stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are deleted at its end: for jobs that keep nothing but what they write elsewhere."""
    given = len(_paths)
    try:
        yield
    finally:
        for path in _paths[given:]:
            drop_path(spark, path)
        del _paths[given:]


def settle(make: Callable[[], DataFrame], tag: str) -> DataFrame:
    """Write what ``make`` gives, read it back, and delete the tables that were written on the way."""
    given = len(_paths)
    out = materialize(make(), tag)
    for path in _paths[given:]:
        if path != out.scratch_path:
            drop_path(out.sparkSession, path)
    del _paths[given:]
    return out


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch path through Hadoop's file system, wherever it lives."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        drop_path(spark, path)
    except Exception:  # the session may be gone by now
        pass
