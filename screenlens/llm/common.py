"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable
from typing import ClassVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch, or one row more: bounds what a Python worker holds at once when texts are long.
BATCH_ROWS, BATCH_BYTES = 500, 16 << 20


def tune(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python workers get."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share (spark.checkpoint.dir); a local one only in local sessions where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="screenlens-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Rows of a small table's file, about.
FILE_ROWS = 500_000


def narrow(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Few tasks, and so few files, for tables much smaller than the documents: two for each core of the cluster at most, and one for each FILE_ROWS of `rows`, the number that it has at most or about."""
    most = 2 * df.sparkSession.sparkContext.defaultParallelism
    return df.coalesce(most if rows is None else max(1, min(most, -(-rows // FILE_ROWS))))


class Scratch:
    """Tables stored within are removed at the end, but for those that the result reads; an outer one sees to these."""

    open: ClassVar[list[Scratch]] = []

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        Scratch.open.append(self)
        return self

    def __exit__(self, *error) -> None:
        Scratch.open.remove(self)
        self.drop(list(self.paths))

    def drop(self, paths: list[str]) -> None:
        for path in paths:
            remove(self.spark, path)
            self.paths.remove(path)

    def result(self, df: DataFrame) -> DataFrame:
        """df, whose tables stay."""
        files = df.inputFiles()
        read = [p for p in self.paths if any(p.rsplit("/", 1)[1] in f for f in files)]
        self.paths = [p for p in self.paths if p not in read]
        if len(Scratch.open) > 1:
            Scratch.open[-2].paths += read
        return df


def tidied(f: Callable) -> Callable:
    """A function (spark, ...) to a DataFrame that leaves no tables behind but those its result reads."""

    @functools.wraps(f)
    def call(spark: SparkSession, *args, **more) -> DataFrame:
        with Scratch(spark) as s:
            return s.result(f(spark, *args, **more))

    return call


def stored(df: DataFrame, name: str, options: dict | None = None) -> DataFrame:
    """Cut the lineage: write a table to the shared folder, with options of the writer, and read it again."""
    path = scratch(df.sparkSession, name)
    if Scratch.open:
        Scratch.open[-1].paths.append(path)
    df.write.options(**options or {}).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder through Spark's file systems."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def known_small(df: DataFrame, rows: int) -> tuple[DataFrame, bool]:
    """A table written to the shared folder, and whether it has at most so many rows: only then may it be broadcast.

    It is written by as many tasks as compute it; few read it only once it is known to be small.
    """
    df = stored(df, "side")
    small = df.limit(rows + 1).count() <= rows
    return (narrow(df, rows) if small else df), small


#: A key with more than one in so many rows is hot; fewer than that many keys can be.
SHARE = 2048


def by_key(rows: DataFrame, label: DataFrame, *key: str, count: str = "count") -> DataFrame:
    """rows joined with label (key, count: rows that have it, ...), whose every key is once in it.

    Hot keys are fewer than SHARE, whatever the size: their labels are broadcast, so that their rows stay
    where they are. The others meet by shuffle, and none has more than one in SHARE rows.
    """
    label, on = stored(label, "label"), list(key)
    total = label.agg(F.sum(count)).first()[0] or 0
    hot = label.where(F.col(count) * SHARE > total)
    rest = rows.join(F.broadcast(hot.select(*key)), on, "left_anti").join(label.where(F.col(count) * SHARE <= total), on)
    return rows.join(F.broadcast(hot), on).unionByName(rest)


def release() -> None:
    """Give memory that is free back to the system; workers live on and serve other stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


#: Functions that empty what a worker keeps for one operator.
CACHES: list[Callable] = []


def forget() -> None:
    """Empty what the worker kept for other operators."""
    for empty in CACHES:
        empty()


def tidy(run: Callable) -> Callable:
    """A function of batches that releases memory when it ends, and before it begins what the worker kept for other operators."""

    def inner(batches):
        forget()
        try:
            yield from run(batches)
        finally:
            release()

    return inner


def fresh(columns: list[str], name: str) -> str:
    """A column name that is not taken, whatever the letter case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The integers of all [start, start+length) one after another."""
    lengths = np.asarray(lengths, dtype=np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(starts, dtype=np.int64) - (ends - lengths), lengths)
