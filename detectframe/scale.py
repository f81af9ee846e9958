"""Helpers that keep plans safe on a large cluster."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest driver-side table that may be broadcast with a hint (rules, word lists).
MAX_LITERAL_ROWS = 20_000

_LOCAL_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder for lineage cuts: ``spark.checkpoint.dir``; a temporary one only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="detectframe-")
    return _LOCAL_DIRS[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Unlike ``checkpoint()`` this computes the plan a single time, and lost
    executors cost nothing: the files survive them.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Lineage cuts that go when their last reader is done.

    ``with Scratch(spark) as s: a = s.cut(x); return s.keep(y)`` writes ``a`` and the result once each and removes
    ``a`` at the end; the kept result stays in the shared folder.  ``drop`` removes a cut before the end.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.cuts = spark, []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for _, path in self.cuts:
            self._remove(path)
        self.cuts = []

    def _remove(self, path: str) -> None:
        # the folder may be on any file system Spark writes to, so Spark's own file system deletes it
        jvm, jsc = self.spark._jvm, self.spark.sparkContext._jsc
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(jsc.hadoopConfiguration()).delete(where, True)

    def cut(self, df: DataFrame, name: str = "cut") -> DataFrame:
        path = scratch_path(self.spark, name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.cuts.append((out, path))
        return out

    def drop(self, df: DataFrame) -> None:
        for path in [p for frame, p in self.cuts if frame is df]:
            self._remove(path)
        self.cuts = [c for c in self.cuts if c[0] is not df]

    def keep(self, df: DataFrame, name: str = "kept") -> DataFrame:
        return cut(df, name)


def literal_table(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """Broadcastable table of driver-side configuration; its size is known and checked."""
    if len(rows) > MAX_LITERAL_ROWS:
        raise ValueError(f"{len(rows)} rows is too many for a broadcast table")
    return F.broadcast(spark.createDataFrame(rows, schema))


def any_true(parts: list[Column]) -> Column:
    out = F.lit(False)
    for i, p in enumerate(parts):
        out = p if i == 0 else out | p
    return out


def all_true(parts: list[Column]) -> Column:
    out = F.lit(True)
    for i, p in enumerate(parts):
        out = p if i == 0 else out & p
    return out


def first_match(cases: list[tuple[Column, Column]]) -> Column:
    """Ordered CASE: value of the first true condition, else NULL."""
    out = None
    for cond, value in cases:
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out if out is not None else F.lit(None).cast("string")


def fired(cases: list[tuple[Column, Column]]) -> Column:
    """Array of the values whose condition holds (order kept), for one-pass ``explode``."""
    return F.filter(
        F.array(*[F.when(cond, value) for cond, value in cases]), lambda x: x.isNotNull()
    )
