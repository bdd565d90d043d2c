"""Wide CSV: a column of times, an optional column seqNr, and one column per series, headed item@property or property."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import number_in
from ..schema import COLUMNS, DEFAULT_CONTEXT, text


def _series(header: str, base: str) -> tuple[str, str]:
    """Item and property of a column's header."""
    m = re.fullmatch(r"\s*<?([^<>@]*)>?\s*@\s*<?([^<>]*)>?\s*", header)
    item, prop = (m[1], m[2]) if m else (base, header.strip().strip("<>"))
    full = lambda x: x if re.match(r"^[A-Za-z][A-Za-z0-9+.-]*:", x) else base + x.replace(" ", "%20")
    return full(item) if item != base else base, full(prop)


def typed_rows(long: DataFrame, raw: str) -> DataFrame:
    """The value columns of texts: quoted text, truth value, number (whole ones without a point are longs) or text."""
    t = F.trim(F.coalesce(F.col(raw), F.lit("")))
    quoted = t.rlike("""^(".*"|'.*')$""")
    truth = F.lower(t).isin("true", "false") & ~quoted
    number = F.when(~quoted & ~truth, number_in(t))
    whole = number.isNotNull() & ~t.contains(".") & (F.abs(number) < 9e15) & (number == F.floor(number))
    kind = F.when(truth, "bool").when(whole, "long").when(number.isNotNull(), "double").otherwise("string")
    null = F.lit(None)
    return long.select(
        *COLUMNS[:5], kind.alias("v_type"),
        F.when(whole, number.cast("long")).alias("v_long"),
        F.when(number.isNotNull() & ~whole, number).alias("v_double"),
        null.cast("decimal(38,18)").alias("v_decimal"),
        F.when(kind == "string", F.when(quoted, F.substr(t, F.lit(2), F.length(t) - 2)).otherwise(t)).alias("v_string"),
        F.when(truth, F.lower(t).try_cast("boolean")).alias("v_bool"),
        null.cast("string").alias("v_json"),
    )


def read(spark: SparkSession, path: str, base: str, separator: str = ",", context: str | None = None) -> DataFrame:
    """Double quotes are stripped before typing; a bad time or seqNr fails the job."""
    wide = spark.read.csv(path, sep=separator, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    names = wide.columns
    plain = wide.toDF(*[f"c{i}" for i in range(len(names))])
    seq = next((i for i, n in enumerate(names) if n.strip() == "seqNr"), None)
    data = [i for i in range(1, len(names)) if i != seq]
    number = F.col(f"c{seq}").cast("int") if seq is not None else F.lit(0)
    plain = plain.select(F.col("c0").cast("long").alias("time"), number.alias("seqNr"), *[F.col(f"c{i}") for i in data])
    long = plain.unpivot(["time", "seqNr"], [f"c{i}" for i in data], "column", "raw")
    of = {f"c{i}": _series(names[i], base) for i in data}
    item, prop = (F.create_map(*[F.lit(x) for k, v in of.items() for x in (k, v[j])])[F.col("column")] for j in (0, 1))
    return typed_rows(long.select(F.lit(context or DEFAULT_CONTEXT).alias("context"), item.alias("item"), prop.alias("property"), "time", "seqNr", "raw"), "raw")


def pivoted(df: DataFrame, columns: list[str] | None = None, pattern: str | None = None, offset_minutes: int = 0) -> DataFrame:
    """time, seqNr and a column <item>@<property> for each series, newest first."""
    from ..functions.values import format_time

    named = df.select("time", "seqNr", F.concat(F.lit("<"), "item", F.lit(">@<"), "property", F.lit(">")).alias("column"), text().alias("x"))
    wide = named.groupBy("time", "seqNr").pivot("column", columns).agg(F.first("x")).orderBy(F.desc("time"), F.desc("seqNr"))
    return wide if pattern is None else wide.withColumn("time", format_time(F.col("time"), pattern, offset_minutes))
