"""Tables between steps: written to the cluster's shared folder, so that a plan used twice is computed once."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own: list[str] = []
_written: list[str] = []
_on_release: list[Callable[[], None]] = []


def scratch_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder if all executors are on this machine, else an error."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _own:
        folder = tempfile.mkdtemp(prefix="sparkloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _own.append("file://" + folder)
    return _own[0]


def scratch(df: DataFrame, tag: str) -> DataFrame:
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(_FREED, None)
    spark.conf.set(_FREED, "true")  # the shuffles of a write end with it
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_FREED) if before is None else spark.conf.set(_FREED, before)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def on_release(forget: Callable[[], None]) -> None:
    """forget is called when tables go, by those who keep frames over them."""
    _on_release.append(forget)


def drop(spark: SparkSession, *paths: str) -> int:
    """Removes tables that nothing will read again; their number."""
    conf, done = spark._jsc.hadoopConfiguration(), 0
    for path in map(spark._jvm.org.apache.hadoop.fs.Path, paths):
        done += bool(path.getFileSystem(conf).delete(path, True))
    return done


@contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables written inside go at the end, but for those written by the function it gives."""
    start, kept = len(_written), []

    def keep(df: DataFrame, tag: str) -> DataFrame:
        out = scratch(df, tag)
        kept.append(_written.pop())
        return out

    try:
        yield keep
    finally:
        gone = _written[start:]
        _written[start:] = kept
        drop(spark, *gone)


def release(spark: SparkSession) -> int:
    """Removes the tables written so far; results that were not read yet cannot be read any more. Their number."""
    for forget in _on_release:
        forget()
    gone = _written[:]
    _written.clear()
    return drop(spark, *gone)
