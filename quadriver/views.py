"""Tuple views over relational tables: the given benchmark tables as series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .schema import tuples


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _millis(c: str):
    return F.unix_millis(F.col(c).cast("timestamp"))


def events(spark: SparkSession, sf_dir: str, kind: str | None = None, begin: int | None = None, end: int | None = None) -> DataFrame:
    """urn:user:<id>, urn:event:<type>: the event's value; the event's number tells equal times apart.

    kind, begin and end (milliseconds) are tests on the file's own columns, so they reach the scan.
    """
    e = table(spark, sf_dir, "events")
    at = lambda ms: F.timestamp_millis(F.lit(ms)).cast("timestamp_ntz")
    if kind is not None:
        e = e.where(F.col("event_type") == kind)
    if begin is not None:
        e = e.where(F.col("ts") >= at(begin))
    if end is not None:
        e = e.where(F.col("ts") < at(end + 1))
    return tuples(e, F.concat(F.lit("urn:user:"), "user_id"), F.concat(F.lit("urn:event:"), "event_type"), _millis("ts"), F.pmod("event_id", F.lit(2**31 - 1)), "double", F.col("value"))


def event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """urn:user:<id>, urn:props: the event's properties, a record."""
    e = table(spark, sf_dir, "events").select("user_id", _millis("ts").alias("t"), "event_id", "props")
    return tuples(e, F.concat(F.lit("urn:user:"), "user_id"), F.lit("urn:props"), F.col("t"), F.col("event_id"), "record", F.col("props"))


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    c = c.join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return c.select("c_custkey", F.concat(F.lit("http://ex/"), "r_name", F.lit("/"), "n_name", F.lit("/c"), "c_custkey").alias("item"))


def customer_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customers(spark, sf_dir).select("item")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """http://ex/<region>/<nation>/c<key>: totalprice (double) and status (string), many at equal times."""
    o = table(spark, sf_dir, "orders").join(_customers(spark, sf_dir), F.col("o_custkey") == F.col("c_custkey"))
    o = o.select("item", _millis("o_orderdate").alias("t"), "o_orderkey", "o_totalprice", "o_orderstatus")
    o = o.withColumn("n", F.row_number().over(Window.partitionBy("item", "t").orderBy("o_orderkey")) - 1)
    price = tuples(o, F.col("item"), F.lit("http://ex/p/totalprice"), F.col("t"), F.col("n"), "double", F.col("o_totalprice"))
    return price.unionByName(tuples(o, F.col("item"), F.lit("http://ex/p/status"), F.col("t"), F.col("n"), "string", F.col("o_orderstatus")))


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """urn:part:<key>: quantity, extendedprice and discount, from wide rows."""
    wide = table(spark, sf_dir, "lineitem").select("l_partkey", _millis("l_shipdate").alias("t"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("n"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("extendedprice"), F.col("l_discount").alias("discount"))
    long = wide.unpivot(["l_partkey", "t", "n"], ["quantity", "extendedprice", "discount"], "name", "x")
    return tuples(long, F.concat(F.lit("urn:part:"), "l_partkey"), F.concat(F.lit("urn:"), "name"), F.col("t"), F.col("n"), "double", F.col("x"))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """urn:vec:<id>, urn:embedding: an array."""
    e = table(spark, sf_dir, "embeddings")
    return tuples(e, F.concat(F.lit("urn:vec:"), "vec_id"), F.lit("urn:embedding"), F.lit(0), F.lit(0), "array", F.to_json("embedding"))
