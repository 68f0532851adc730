"""Materialised intermediates in the folder that all executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_FALLBACK: dict[str, str] = {}
#: What this process has written: paths, and tables of the catalog.
_PATHS: list[str] = []
_TABLES: list[str] = []
#: What the passing() around removes at its end, the innermost last: paths and tables.
_OWN: ContextVar[tuple[tuple[list[str], list[str]], ...]] = ContextVar("own", default=())


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a temporary folder only where it is unset and Spark runs in one process."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _FALLBACK:
        _FALLBACK[app] = tempfile.mkdtemp(prefix="wavedeck-")
    return _FALLBACK[app]


def stored(df: DataFrame | Iterator[DataFrame], name: str, *partition: str, lasting: bool = False) -> DataFrame:
    """Write df, or several one after the other, as Parquet in the shared folder and read it back: the lineage ends there, so a lost
    executor costs no more than the tasks that read the files. lasting: passing() leaves it to
    the passing() around, if there is one."""
    frames = iter([df]) if isinstance(df, DataFrame) else df
    df = next(frames)
    path = f"{shared_dir(df.sparkSession)}/wavedeck/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    _PATHS.append(path)
    if own := _OWN.get()[: -1 if lasting else None]:
        own[-1][0].append(path)
    spark = df.sparkSession
    while df is not None:
        df.write.mode("append").option("compression", "zstd").partitionBy(*partition).parquet(path)
        df = next(frames, None)
    return spark.read.schema(schema).parquet(path)


def in_turns(df: DataFrame, name: str, turn: Column, n: int) -> Iterator[DataFrame]:
    """Write df by `turn`, 0 to n - 1, and give the parts one after the other. A part, and what was shuffled for it, goes as the
    next one is asked for: by then what was made of it must be written."""
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/wavedeck/{name}-{uuid.uuid4().hex}"
    kept(path)
    dealt = df.withColumn("turn", turn.cast("int"))
    dealt.write.option("compression", "none").partitionBy("turn").parquet(path)
    release_shuffles(spark)
    every = spark.read.schema(dealt.schema).parquet(path)
    for k in range(n):
        yield every.where(F.col("turn") == k).drop("turn")
        _delete(spark, f"{path}/turn={k}")
        release_shuffles(spark)


def kept(path: str, table: str | None = None) -> None:
    """Note what drop_scratch() is to remove."""
    _PATHS.append(path)
    own = _OWN.get()
    if own:
        own[-1][0].append(path)
    if table:
        _TABLES.append(table)
        if own:
            own[-1][1].append(table)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """At its end, intermediates written meanwhile go, but for lasting ones, and so do finished shuffles. Nothing that is
    used later may read them."""
    own: tuple[list[str], list[str]] = [], []
    token = _OWN.set((*_OWN.get(), own))
    try:
        yield
    finally:
        _OWN.reset(token)
        for table in own[1]:
            spark.sql(f"drop table if exists {table}")
            _TABLES.remove(table)
        for path in own[0]:
            _delete(spark, path)
            _PATHS.remove(path)
        release_shuffles(spark)


def _delete(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_scratch(spark: SparkSession) -> None:
    """Remove the intermediates of all operators so far. Their results read them, so write the results first."""
    while _TABLES:
        spark.sql(f"drop table if exists {_TABLES.pop()}")
    while _PATHS:
        _delete(spark, _PATHS.pop())


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of steps whose results are written. It does when the driver collects what
    refers to them, which may be long after an operator with many steps has filled the disks."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def bytes_of(spark: SparkSession, path: str) -> bytes:
    """A vocabulary file's bytes; a local path first, else any store that Spark reads."""
    try:
        with open(path, "rb") as f:
            return f.read()
    except OSError:
        return bytes(spark.read.format("binaryFile").load(path).select("content").head()[0])
