"""Cutting lineage in the folder that all executors share.

A table written there survives the loss of any executor; a block cached on one
machine does not. The folder is the session's ``spark.checkpoint.dir``, or the one
given to ``setCheckpointDir``; only where neither is set and the master is local
(tests on one machine) a temporary folder is made.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps
from typing import NamedTuple
from weakref import WeakKeyDictionary

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_BITS = 1 << 28
BATCH_BYTES = 4 << 20
_written: dict[str, list[str]] = {}
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_fallback: list[str] = []
_scope: ContextVar[str] = ContextVar("scope", default="query")


@contextmanager
def scoped(name: str) -> Iterator[None]:
    """Tables written inside belong to this group."""
    token = _scope.set(name)
    try:
        yield
    finally:
        _scope.reset(token)


def fresh(name: str, columns: Iterable[str]) -> str:
    """``name``, or with underscores before it, so that no column is called that."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; on a local master without one, a temporary folder of the process."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _fallback:
        _fallback.append("file://" + tempfile.mkdtemp(prefix="sonarlake-"))
    return _fallback[0]


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and return a DataFrame that reads the copy.

    :func:`release` deletes it, by the group named in :func:`scoped`, or :func:`discard`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sonarlake/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "snappy").parquet(path)
    if not _written:
        atexit.register(_release_all, spark)
    _written.setdefault(_scope.get(), []).append(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more; other DataFrames are let be."""
    for t in tables:
        if path := _paths.pop(t, None):
            _delete(t.sparkSession, [path])
            for group in _written.values():
                if path in group:
                    group.remove(path)


def release(spark: SparkSession, scope: str = "query") -> int:
    """Delete what was written under ``scope``; DataFrames over it end with it."""
    paths = _written.pop(scope, [])
    _delete(spark, paths)
    return len(paths)


def _release_all(spark: SparkSession) -> None:
    if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
        for scope in list(_written):
            release(spark, scope)


def small_batches(spark: SparkSession) -> None:
    """Let an Arrow batch hold about ``BATCH_BYTES`` (or one row, if that is more), whatever the texts' lengths."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def tidy(name: str, query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query with its stored tables in a group of its own, deleted when it is next asked for or the process ends."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        small_batches(spark)
        release(spark, name)
        with scoped(name):
            return query(spark, sf_dir)

    return run


class Bits(NamedTuple):
    """A set of 64-bit hashes of bounded size: never without one that was put in."""

    words: np.ndarray

    def has(self, h: np.ndarray) -> np.ndarray:
        x = h.view(np.uint64)
        size = np.uint64(64 * len(self.words) - 1)
        out = np.ones(len(x), bool)
        for at in (x & size, (x >> np.uint64(32)) & size):
            out &= (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0
        return out


def fold_bits(hashes: DataFrame, most: int = MOST_BITS) -> Bits:
    """About ten bits a hash (h), ``most`` (32 MB) at most: as it fills up more others pass, no right one is lost.

    Bits are set on the executors; the driver gets ``most / 64`` words at the utmost.
    """
    size, n = 1 << 12, 10 * hashes.count()
    while size < min(most, n):
        size *= 2
    at = hashes.select(F.explode(F.array(F.col("h").bitwiseAND(size - 1), F.shiftrightunsigned("h", 32).bitwiseAND(size - 1))).alias("at"))
    word = at.select(F.shiftright("at", 6).cast("int").alias("i"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("v"))
    got = word.groupBy("i").agg(F.bit_or("v").alias("v")).toArrow()
    words = np.zeros(size // 64, np.uint64)
    words[got["i"].to_numpy()] = got["v"].to_numpy().view(np.uint64)
    return Bits(words)
