"""Tables that are replaced as a whole, in one commit.

Each version lies in a folder of its own. A small file that names the folder is
created last and makes it the current one, so a writer that fails half-way
leaves the table as it was, and a reader never sees half of a version. Any store
will do that creates a file only if it is not there yet.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_LOG = "_versions"


class Versions:
    """The versions of the table at ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def names(self, folder: str = "") -> list[str]:
        """What lies in a folder of the table, in order; nothing if there is no such folder."""
        at = self._at(f"{self.path}/{folder}" if folder else self.path)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def log(self) -> list[tuple[int, str]]:
        """``(number, folder)`` of all versions, oldest first. A pointer whose writer died before it named a folder counts for nothing."""
        out = []
        for name in self.names(_LOG):
            stream = self._fs.open(self._at(f"{self.path}/{_LOG}/{name}"))
            folder = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            stream.close()
            if folder.endswith("\n"):
                out.append((int(name), folder.strip()))
        return out

    def current(self) -> str | None:
        """Path of the current version's folder; None before the first commit."""
        log = self.log()
        return f"{self.path}/{log[-1][1]}" if log else None

    def stage(self) -> str:
        """A fresh folder that no reader looks into before :meth:`commit`."""
        return f"{self.path}/v-{uuid.uuid4().hex}"

    def commit(self, folder: str) -> int:
        """Make ``folder`` the current version. Fails if another writer took the same number first."""
        taken = self.names(_LOG)
        number = int(taken[-1]) + 1 if taken else 0
        out = self._fs.create(self._at(f"{self.path}/{_LOG}/{number:012d}"), False)
        out.write(bytearray(folder.rsplit("/", 1)[1].encode() + b"\n"))
        out.close()
        return number

    def replace(self, rows: DataFrame, *, keep: int = 2) -> int:
        """Write ``rows`` as the new version, then clear all but the last ``keep``."""
        folder = self.stage()
        rows.write.parquet(folder)
        number = self.commit(folder)
        self.clear(keep)
        return number

    def clear(self, keep: int = 2) -> None:
        """Delete versions older than the last ``keep``; readers may still be on those. Folders that were never committed stay: their writer may be at work."""
        for number, folder in self.log()[:-keep]:
            self._fs.delete(self._at(f"{self.path}/{folder}"), True)
            self._fs.delete(self._at(f"{self.path}/{_LOG}/{number:012d}"), False)

    def read(self, schema=None) -> DataFrame:
        """The current version; an empty table of ``schema`` before the first commit."""
        folder = self.current()
        if folder is None:
            if schema is None:
                raise FileNotFoundError(f"no version of {self.path}")
            return self.spark.createDataFrame([], schema)
        return (self.spark.read.schema(schema) if schema is not None else self.spark.read).parquet(folder)
