"""Joins between series: by time, by place, as of a time, within a range, and with a limit per row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import KEY
from .fetch import series


def shared_join(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on the columns that both have (a cross product if none): inner, left, left_semi or left_anti."""
    shared = [c for c in left.columns if c in right.columns]
    return left.join(right, shared, how) if shared else left.crossJoin(right)


def _as(df: DataFrame, prefix: str, keep: list[str]) -> DataFrame:
    return df.select(*keep, *[F.col(c).alias(prefix + c) for c in df.columns if c not in keep])


def time_join(left: DataFrame, right: DataFrame, how: str = "inner", by: tuple[str, ...] = ()) -> DataFrame:
    """Rows of equal time (and equal columns of by); other columns get l_ and r_."""
    on = ["time", *by]
    return _as(left, "l_", on).join(_as(right, "r_", on), on, how)


def index_join(left: DataFrame, right: DataFrame, by: tuple[str, ...] = ("item", "time")) -> DataFrame:
    """Rows of equal place within their series, as with_index() numbers them."""
    on = [*by, "idx"]
    return _as(left, "l_", on).join(_as(right, "r_", on), on)


def asof_join(left: DataFrame, right: DataFrame, by: list[str], values: list[str], how: str = "inner", span: int = 0) -> DataFrame:
    """To each left row the newest right row of the same keys at or before its time (highest seqNr of equal times).

    One exchange: both sides are stacked, and a running last value is taken.  span (milliseconds) splits long series,
    hot ones above all: the running value is taken within each span, and each span gets what the spans before it ended
    with.  right's columns get r_.
    """
    cell = F.expr(f"time - pmod(time, {int(span)})") if span > 0 else F.lit(0).cast("long")
    value = F.struct("time", *values)
    a = left.select("*", F.lit(1).alias("_side"), F.lit(None).cast(right.select(value.alias("v")).schema["v"].dataType).alias("_v"))
    seq = F.col("seqNr") if "seqNr" in right.columns else F.lit(0)
    b = right.select(*by, "time", F.lit(0).alias("_side"), value.alias("_v"), seq.alias("_seq"))
    both = a.unionByName(b, allowMissingColumns=True).withColumn("_cell", cell)
    upto = Window.partitionBy(*by, "_cell").orderBy("time", "_side", F.col("_seq").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_last", F.last("_v", ignorenulls=True).over(upto)).where("_side = 1")
    if span > 0:
        ends = right.withColumn("_cell", cell).groupBy(*by, "_cell").agg(F.max_by(value, F.struct("time", seq)).alias("_end"))
        cells = ends.unionByName(left.select(*by, cell.alias("_cell")).distinct(), allowMissingColumns=True).groupBy(*by, "_cell").agg(F.first("_end", ignorenulls=True).alias("_end"))
        before = Window.partitionBy(*by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
        cells = cells.withColumn("_before", F.last("_end", ignorenulls=True).over(before)).drop("_end")
        both = both.join(cells, [*by, "_cell"], "left").withColumn("_last", F.coalesce("_last", "_before"))
    if how == "inner":
        both = both.where(F.col("_last").isNotNull())
    return both.select(*left.columns, *[F.col("_last")[c].alias(f"r_{c}") for c in ("time", *values)])


def range_join(left: DataFrame, right: DataFrame, by: list[str], begin: str = "begin", end: str = "end", span: int = 86_400_000) -> DataFrame:
    """Right rows whose time lies in [begin, end] of a left row with the same keys; right's other columns get r_.

    Ranges are cut at multiples of span, so that range and row meet on a key; rows without a begin or end find nothing.
    """
    cells = F.explode(F.expr(f"sequence(`{begin}` div {span}, `{end}` div {span})"))
    a = left.where(F.col(begin) <= F.col(end)).withColumn("_cell", cells)
    b = _as(right, "r_", by).withColumn("_cell", F.expr(f"r_time div {span}"))
    return a.join(b, [*by, "_cell"]).where(F.col("r_time").between(F.col(begin), F.col(end))).drop("_cell")


def limit_join(params: DataFrame, df: DataFrame, on: list[str], limit: str = "limit") -> DataFrame:
    """For each row of params the newest values of the series it names, as many as its limit says (0: all)."""
    ranked = df.join(params.select(*on).distinct(), on, "left_semi").withColumn("_n", F.row_number().over(series()))
    return params.join(ranked, on).where((F.col(limit) <= 0) | (F.col("_n") <= F.col(limit))).drop("_n")


def exists(df: DataFrame) -> bool:
    """Whether there is any row."""
    return not df.isEmpty()


def structure_join(triples: DataFrame, df: DataFrame, predicate: str) -> DataFrame:
    """Values of the objects of a predicate: s, and the columns of df for item = o."""
    return triples.where(F.col("p") == predicate).select("s", F.col("o").alias("item")).join(df, "item").select("s", *KEY, *[c for c in df.columns if c not in KEY])
