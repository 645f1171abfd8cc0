"""Tables between steps: written to the shared folder that spark.checkpoint.dir names, so that a lost executor costs no step before."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import functools
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table of a few values a row is broadcast.
BROADCAST_ROWS = 500_000
#: Pairs whose texts are joined at a time.
SHARE_ROWS = 4_000_000
#: Spark's own switch for deleting shuffled files at a query's end.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Where the paths of staged tables go: a list for the driver's life, or one of a caller that drops them; threads have their own.
_paths: list[str] = []
_kept_in: contextvars.ContextVar[list[str]] = contextvars.ContextVar("kept_in", default=_paths)


@functools.cache
def _own_folder() -> str:
    folder = tempfile.mkdtemp(prefix="ligature-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def folder(spark: SparkSession) -> str:
    """The shared folder; in local mode, where it may be unset, one of this process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return named.rstrip("/") if named else _own_folder()


def _drop(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@atexit.register
def _clear() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        _drop(spark, _paths)


@contextlib.contextmanager
def dropped(spark: SparkSession) -> Iterator[None]:
    """Tables staged within are deleted at its end, not at the driver's: for work that repeats, such as the batches of a stream."""
    own: list[str] = []
    token = _kept_in.set(own)
    try:
        yield
    finally:
        _kept_in.reset(token)
        _drop(spark, own)


@contextlib.contextmanager
def _letting_go(spark: SparkSession) -> Iterator[None]:
    """What queries within have shuffled goes from the disks when each ends, not when the driver's memory is next cleared."""
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEAN_UP)
        else:
            spark.conf.set(CLEAN_UP, before)


def staged(df: DataFrame, name: str) -> DataFrame:
    """df, written and read again; the table goes when the driver ends, what was shuffled for it at once."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _kept_in.get().append(path)
    with _letting_go(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_shares(pairs: DataFrame, work: Callable[[DataFrame], DataFrame], rows: int | None = None) -> DataFrame:
    """work's rows for all pairs (s1, ...), made and written for a share of the entities after the other, of some `rows` pairs: what is joined
    to pairs, such as their texts, lies on the disks for one share at a time. All pairs of an entity are in one share."""
    pairs = staged(pairs, "pairs")
    shares = max(1, -(-pairs.count() // (rows or SHARE_ROWS)))
    share = F.pmod(F.xxhash64("s1"), F.lit(shares))
    return functools.reduce(DataFrame.unionByName, [staged(work(pairs.where(share == i)), "share") for i in range(shares)])


def if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, to be broadcast if it has no more rows than that."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
