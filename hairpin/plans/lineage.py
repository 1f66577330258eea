"""Cutting lineage in a folder that the driver and all executors share."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting that deletes the shuffle files of an execution when it ends; by default they stay until the driver's garbage collection.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset (one machine, as in tests) a folder in the warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        sc = spark.sparkContext
        found = sc.getCheckpointDir()
        if not found:
            sc.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir')}/hairpin-checkpoints")
            found = sc.getCheckpointDir()
    return found.rstrip("/")


@contextmanager
def _shuffled_once(df: DataFrame) -> Iterator[DataFrame]:
    """``df`` as a plan of its own whose shuffle files go once it is written: what is read from then on is the written table."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        yield df.select("*")
    finally:
        conf.set(CLEANUP, before)


def cut(df: DataFrame) -> DataFrame:
    """``df`` as computed now: later jobs read it from the shared folder, also when executors are lost."""
    shared_folder(df.sparkSession)
    with _shuffled_once(df) as own:
        done = own.checkpoint(eager=True)
    # a plan made under the session's own setting
    return done.select("*")


def store(df: DataFrame) -> DataFrame:
    """Like :func:`cut`, as a Parquet table: smaller, and read column by column. It goes with the :func:`scratch` that is open."""
    path = f"{shared_folder(df.sparkSession)}/hairpin-{uuid.uuid4().hex}"
    with _shuffled_once(df) as own:
        own.write.parquet(path)
    for paths in _open()[-1:]:
        paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_threads = threading.local()


def _open() -> list[list[str]]:
    """Of this thread, the tables that each open :func:`scratch` has."""
    if not hasattr(_threads, "open"):
        _threads.open = []
    return _threads.open


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes at its end what was stored inside, but what the function that it gives has stored: that is read from then on, and all else that is
    made inside isn't."""
    kept: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        done = store(df)
        kept.append(_open()[-1].pop())
        return done

    _open().append([])
    try:
        yield keep
    finally:
        _deleted(spark, _open().pop())
        for paths in _open()[-1:]:
            paths += kept


def in_tasks(df: DataFrame, rows: float, each: int) -> DataFrame:
    """``df`` in as many tasks as ``rows`` rows of it need, ``each`` to a task, where the session deals it out to more; nothing is moved for it."""
    return df.coalesce(max(1, int(-(-rows // each))))


def discard(*stored: DataFrame) -> None:
    """Deletes tables of :func:`store` that nothing will read any more."""
    for df in stored:
        _deleted(df.sparkSession, {file.rpartition("/")[0] for file in df.inputFiles()})


def _deleted(spark: SparkSession, paths: Iterable[str]) -> None:
    for name in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(name)
        if target.getName().startswith("hairpin-"):
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
