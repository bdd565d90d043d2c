"""Pieces that several corpus operators share."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Hashable

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACES = r"[\x20\x09-\x0D]+"

#: A table of at most so many rows may be sent to every executor.
SMALL_ROWS = 20_000
#: A key with more than one HOT-th of all rows, and more than LEAST_HOT, is hot.
HOT, LEAST_HOT = 2_000, 1_000


#: What this Python worker has loaded, by name; what the task at hand has used of it; that task.
_models: dict[Hashable, object] = {}
_used: set[Hashable] = set()
_task: int | None = None


def give_back() -> None:
    """Return what Arrow and the C library hold of freed memory to the system."""
    pa.default_memory_pool().release_unused()
    if hasattr(c := ctypes.CDLL(None), "malloc_trim"):
        c.malloc_trim(0)


def tidy() -> None:
    """Python functions call this on each batch, so that a worker lets the models of other stages go.

    Workers outlive stages, and an executor's memory holds the idle ones too.  So a new task drops what the worker's task
    before it has not used, and gives the memory back.  On the driver, outside tasks, everything stays.
    """
    global _task
    task = (context := TaskContext.get()) and context.taskAttemptId()
    if task == _task:
        return
    _task, idle = task, _models.keys() - _used
    _used.clear()
    for name in idle:
        del _models[name]
    if idle:
        give_back()


def shared(name: Hashable, load: Callable[[], object]):
    """A model that a worker loads once for tasks in a row that use it."""
    tidy()
    _used.add(name)
    if name not in _models:
        _models[name] = load()
    return _models[name]


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder and go on from there.

    The folder comes from ``spark.checkpoint.dir`` (Spark reads it at start).  Only a local session without one, as in
    tests, gets a temporary folder; on a cluster executors would not see that, so it is an error.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="quadriver-checkpoint-"))
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write the rows as Parquet below the shared checkpoint folder; the table and its path."""
    cut(df.sparkSession.range(0))  # sets the folder where it is unset
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Hint a broadcast if the (counted) table has at most SMALL_ROWS rows; beyond that Spark joins by shuffle."""
    rows = df.count() if rows is None else rows
    return F.broadcast(df) if rows <= SMALL_ROWS else df


def heat(side: DataFrame, copies: str) -> tuple[int, int | None]:
    """How many rows side has, and the least number of copies that makes a key hot (None: no key is)."""
    rows, total, most = side.agg(F.count("*"), F.sum(copies), F.max(copies)).first()
    limit = max(LEAST_HOT, (total or 0) // HOT)
    return rows, limit if (most or 0) > limit else None


def joined_by(df: DataFrame, side: DataFrame, keys: list[str], copies: str, how: str = "inner", known: tuple[int, int | None] | None = None) -> DataFrame:
    """df joined (inner or left) with side, whose keys are unique and whose column copies tells how many rows of df have them (at most).

    Keys with more than a HOT-th of all rows, fewer than HOT of them, are broadcast, as is a side of no more rows than
    that; the rest is shuffled, so that no task gets more than such a share for one key.  Side should be stored; known is
    what heat() said of it.
    """
    rows, limit = known or heat(side, copies)
    if rows <= HOT:
        return df.join(F.broadcast(side), keys, how)
    if limit is None:
        return df.join(side, keys, how)
    hot = side.where(F.col(copies) > limit)
    others = df.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(side.where(F.col(copies) <= limit), keys, how)
    return df.join(F.broadcast(hot), keys).unionByName(others)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def col(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def words(text: Column) -> Column:
    """The words of a text; null counts as an empty text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def id_key(ident: Column, seed: str = "") -> Column:
    """A hash-random key below 2**60 that depends on the id (and seed) alone, the same in any engine with MD5."""
    named = F.concat(F.lit(seed), F.coalesce(ident.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(named), 1, 15), 16, 10).cast("long")
