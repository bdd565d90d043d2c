"""Results of graph patterns as typed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def typed(df: DataFrame) -> DataFrame:
    """Text columns as the type that all of their texts are written in: whole numbers, numbers, truth values, or text.

    Only a text that its typed value is written as again counts, so that 007 and 1.50 stay text.  One pass over the rows;
    a column without any value stays text.
    """
    x = {n: F.col(f"`{n}`") for n, kind in df.dtypes if kind == "string"}
    if not x:
        return df
    as_whole = lambda c: c.try_cast("bigint").cast("string") == c
    as_number = lambda c: (c.try_cast("double").cast("string") == c) | as_whole(c)
    tests = {"bigint": as_whole, "double": as_number, "boolean": lambda c: c.isin("true", "false")}
    every = [F.min(F.coalesce(test(c), F.lit(False)) | c.isNull()).alias(f"{n}_{kind}") for n, (c) in enumerate(x.values()) for kind, test in tests.items()]
    any_ = [F.max(c.isNotNull()).alias(f"{n}_any") for n, c in enumerate(x.values())]
    found = df.agg(*every, *any_).first().asDict()
    for n, name in enumerate(x):
        if found[f"{n}_any"] and (kind := next((k for k in tests if found[f"{n}_{k}"]), None)):
            df = df.withColumn(name, x[name].cast(kind))
    return df


def write(df: DataFrame, path: str) -> None:
    """A result as Parquet with typed columns."""
    from ..store import checkpointed

    typed(checkpointed(df)).write.mode("overwrite").parquet(path)
