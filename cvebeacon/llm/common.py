"""Intermediate tables in the shared folder, and broadcasts behind a size check."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cvebeacon.session import shared_folder

#: Most rows of two or three numbers that a join side may have to be broadcast.
BROADCAST_ROWS = 1_000_000

#: Lets go of an execution's shuffle files when it ends, not when the driver next collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The frame with a broadcast hint if its counted rows allow it, else as it is.

    Give it a stored table: counting then reads the footers only.
    """
    return F.broadcast(df) if df.count() <= rows else df


class Scratch:
    """Tables of one operator call below ``spark.checkpoint.dir``.

    A written table cuts the lineage, so a lost executor costs the running stage
    only, and all executors can read it. ``close`` removes all but the tables
    that were kept. The shuffle files behind a table go once it is written: later
    jobs read the table, so none would read them again.
    """

    def __init__(self, spark: SparkSession, purpose: str):
        self.spark = spark
        self.root = shared_folder(spark, purpose)
        self._kept: set[str] = set()
        self._n = 0

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n}-{name}"

    def table(self, df: DataFrame, name: str = "table", keep: bool = False) -> DataFrame:
        return self._write(df, self.path(name), keep)

    def folders(self, df: DataFrame, by: str, name: str = "table") -> DataFrame:
        """As ``table``, with a folder for each value of ``by``: a job reads those that it asks for."""
        return self._write(df, self.path(name), False, by)

    def _write(self, df: DataFrame, path: str, keep: bool, by: str | None = None) -> DataFrame:
        before = self.spark.conf.get(_CLEANUP, "false")
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.parquet(path, partitionBy=by)
        finally:
            self.spark.conf.set(_CLEANUP, before)
        if keep:
            self._kept.add(path)
        stored = self.spark.read.schema(df.schema).parquet(path)
        stored._scratch_path = path
        return stored

    def drop(self, df: DataFrame) -> None:
        self._delete(df._scratch_path)

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        hadoop = jvm.org.apache.hadoop.fs.Path(path)
        fs = hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration())
        fs.delete(hadoop, True)

    def close(self) -> None:
        if not self._kept:
            self._delete(self.root)
            return
        jvm = self.spark._jvm
        hadoop = jvm.org.apache.hadoop.fs.Path(self.root)
        fs = hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(hadoop):
            return
        kept = {p.rsplit("/", 1)[1] for p in self._kept}
        for status in fs.listStatus(hadoop):
            if status.getPath().getName() not in kept:
                fs.delete(status.getPath(), True)


@contextmanager
def scratch(spark: SparkSession, purpose: str) -> Iterator[Scratch]:
    """A Scratch that is closed at the end, also after an error."""
    own = Scratch(spark, purpose)
    try:
        yield own
    finally:
        own.close()
