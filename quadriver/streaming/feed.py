"""Streams of values: new items, subscriptions, intervals, and feeds without late values."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.fetch import fetch
from ..schema import KEY, TUPLE, num


def changes(spark: SparkSession, path: str) -> DataFrame:
    """The values added to a Parquet table, as a stream."""
    return spark.readStream.schema(TUPLE).parquet(path)


def wanted(patterns: list[str], properties: list[str] | None = None) -> Column:
    """Items named plainly, or by a prefix and ``/**``; optionally only some properties."""
    test = F.lit(False)
    for p in patterns:
        test = test | (F.col("item").startswith(p[:-2]) if p.endswith("/**") else F.col("item") == p)
    return test & F.col("property").isin(properties) if properties else test


def subscribe(stream: DataFrame, patterns: list[str], properties: list[str] | None = None) -> DataFrame:
    return stream.where(wanted(patterns, properties))


def snapshot(df: DataFrame, patterns: list[str], properties: list[str] | None = None, limit: int = 100) -> DataFrame:
    """What a subscriber gets first: the newest values of what it asked for."""
    return fetch(df.where(wanted(patterns, properties)), limit=limit)


def new_items(stream: DataFrame) -> DataFrame:
    """Each item once, when it is first seen."""
    return stream.select("item").dropDuplicates(["item"])


def intervals(stream: DataFrame, interval: int, lateness: str = "1 minute") -> DataFrame:
    """min, max, avg, sum and number of each series' values in intervals, written when the watermark has passed."""
    timed = stream.withColumn("ts", F.timestamp_millis("time")).withWatermark("ts", lateness)
    by = timed.groupBy(*KEY, F.window("ts", f"{interval} milliseconds"))
    out = by.agg(*[getattr(F, f)(num()).alias(f) for f in ("min", "max", "avg", "sum")], F.count(num()).alias("n"))
    return out.select(*KEY, F.unix_millis("window.start").alias("time"), "min", "max", "avg", "sum", "n")


def in_order(stream: DataFrame) -> DataFrame:
    """Values not older than any delivered before of their series; late ones are dropped."""
    columns = [f.name for f in TUPLE]

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark = state.get[0] if state.exists else None
        top = mark
        for frame in frames:
            new = frame if mark is None else frame[frame["time"] >= mark]
            if len(new):
                top = max(int(new["time"].max()) + 1, top or 0)
                yield new[columns]
        if top is not None:
            state.update((top,))

    return stream.groupBy(*KEY).applyInPandasWithState(step, TUPLE, "mark long", "append", GroupStateTimeout.NoTimeout)


def updates(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, seconds: float = 1, limit: int = 100, once: bool = False) -> StreamingQuery:
    """Call sink(rows, number) for each batch of changes, with at most limit newest values of each series."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: sink(fetch(df, limit=limit), n))
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds")
    return writer.start()
