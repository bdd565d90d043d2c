"""Fetch: the newest values of series, whole, sampled or aggregated.

The order of work matters: range, then the limit per series, then any test on value, sequence number or index.  So
"the latest value equals x" and "the latest of the values that equal x" are different plans.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import DEFAULT_CONTEXT, KEY, TIME_MAX, VALUES, num

OPS = ("min", "max", "avg", "sum", "first")


def newest() -> list[Column]:
    return [F.col("time").desc(), F.col("seqNr").desc()]


def series() -> Window:
    return Window.partitionBy(*KEY).orderBy(*newest())


def aligned_week(time: Column) -> Column:
    """Week of the year that begins on January 1st (UTC), from milliseconds."""
    return F.ceil(F.dayofyear(F.timestamp_millis(time)) / 7).cast("int")


def _year_week(ms: int) -> tuple[int, int]:
    day = datetime.datetime(1970, 1, 1) + datetime.timedelta(milliseconds=ms)
    return day.year, -(-day.timetuple().tm_yday // 7)


def in_range(df: DataFrame, begin: int | None = None, end: int | None = None) -> DataFrame:
    """Both ends count.  On an archive (columns year, week) the range also prunes partitions."""
    if begin:
        df = df.where(F.col("time") >= begin)
        if "week" in df.columns:
            y, w = _year_week(begin)
            df = df.where((F.col("year") > y) | ((F.col("year") == y) & (F.col("week") >= w)))
    if end is not None and end < TIME_MAX:
        df = df.where(F.col("time") <= end)
        if "week" in df.columns:
            y, w = _year_week(end)
            df = df.where((F.col("year") < y) | ((F.col("year") == y) & (F.col("week") <= w)))
    return df


def of_keys(df: DataFrame, column: str, keys: str | Iterable[str] | DataFrame | None) -> DataFrame:
    """Rows whose column is one of the keys; a table of keys is joined, an empty choice means all."""
    if keys is None:
        return df
    if isinstance(keys, DataFrame):
        return df.join(keys.select(F.col(keys.columns[0]).alias(column)).distinct(), column, "left_semi")
    keys = [keys] if isinstance(keys, str) else list(keys)
    return df.where(F.col(column).isin(keys)) if keys else df


def newest_of_series(df: DataFrame, limit: int) -> DataFrame:
    """The limit newest rows of each series; Spark cuts each task's rows before the exchange."""
    return df.withColumn("_n", F.row_number().over(series())).where(F.col("_n") <= limit).drop("_n") if limit > 0 else df


def fetch(df: DataFrame, items=None, properties=None, context: str | None = None, end: int | None = None, begin: int | None = None, limit: int = 0, interval: int = 0, op: str | None = None) -> DataFrame:
    """Values of the items' properties in [begin, end]: the limit newest, or one for each interval.

    limit 0: all.  op with interval 0: one value for the whole range.  interval without op: the newest of each interval.
    """
    df = in_range(df.where(F.col("context") == (context or DEFAULT_CONTEXT)), begin, end)
    df = of_keys(of_keys(df, "item", items), "property", properties)
    if op:
        return aggregate(df, op, interval, limit)
    return sample(df, interval, limit) if interval > 0 else newest_of_series(df, limit)


def at_time(df: DataFrame, time: int) -> DataFrame:
    """All sequence numbers of one time: a limit does not apply."""
    return in_range(df, time, time)


def with_index(df: DataFrame) -> DataFrame:
    """idx: place within the series, the newest is 0."""
    return df.withColumn("idx", (F.row_number().over(series()) - 1).cast("long"))


def bucket(interval: int | Column) -> Column:
    if isinstance(interval, Column):
        return F.when(interval > 0, F.col("time") - F.col("time") % interval).otherwise(0)
    return F.expr(f"time - time % {int(interval)}") if interval > 0 else F.lit(0).cast("long")


def aggregate(df: DataFrame, op: str, interval: int | Column = 0, limit: int | Column = 0, by: tuple[str, ...] = ()) -> DataFrame:
    """One row per series and interval: time is the interval's start, seqNr counts from 1, the newest first.

    avg is a double; sum of integers is an integer; min and max of values that are no numbers compare their texts;
    first is the newest value, whatever its type.  limit counts intervals.  With further columns by, each of their values is
    a series of its own, and interval and limit may be columns that depend on them.
    """
    op = op.strip().lower()
    if op not in OPS:
        raise ValueError(f"unknown op {op!r}: one of {', '.join(OPS)}")
    keys = [*KEY, *by]
    grouped = df.groupBy(*keys, bucket(interval).alias("time"))
    if op == "first":
        held = F.max_by(F.struct(*VALUES), F.struct("time", "seqNr"))
        out = grouped.agg(held.alias("v")).select(*keys, "time", "v.*")
    else:
        number = getattr(F, op)(num())
        whole = F.count(F.when(F.col("v_long").isNull(), 1)) == 0
        long = F.when(whole, F.sum("v_long")) if op == "sum" else F.lit(None)
        text = getattr(F, op)(F.when(num().isNull(), F.col("v_string"))) if op in ("min", "max") else F.lit(None)
        out = grouped.agg(number.alias("x"), long.cast("long").alias("v_long"), text.cast("string").alias("s"))
        out = out.withColumn("v_double", F.when(F.col("v_long").isNull(), F.col("x"))).withColumn("v_string", F.when(F.col("x").isNull(), F.col("s")))
        kind = F.when(F.col("v_long").isNotNull(), "long").when(F.col("v_double").isNotNull(), "double").otherwise("string")
        out = out.select(*keys, "time", kind.alias("v_type"), "v_long", "v_double", F.lit(None).cast("decimal(38,18)").alias("v_decimal"), "v_string", F.lit(None).cast("boolean").alias("v_bool"), F.lit(None).cast("string").alias("v_json"))
    order = Window.partitionBy(*keys).orderBy(F.col("time").desc())
    out = out.withColumn("seqNr", F.row_number().over(order))
    if isinstance(limit, Column):
        out = out.where((limit <= 0) | (F.col("seqNr") <= limit))
    elif limit > 0:
        out = out.where(F.col("seqNr") <= limit)
    return out.select(*keys, "time", "seqNr", *VALUES)


def sample(df: DataFrame, interval: int, limit: int = 0) -> DataFrame:
    """The newest value of each interval, at the interval's start."""
    return aggregate(df, "first", interval, limit)


def in_contexts(df: DataFrame, contexts: list[str]) -> DataFrame:
    """For each item and property the values of the first context, in the given order, that has any."""
    rank = F.coalesce(*[F.when(F.col("context") == c, i) for i, c in enumerate(contexts)])
    df = df.where(F.col("context").isin(contexts)).withColumn("_rank", rank)
    least = df.groupBy("item", "property").agg(F.min("_rank").alias("_rank"))
    return df.join(least, ["item", "property", "_rank"], "left_semi").select(*[c for c in df.columns if c != "_rank"])
