"""Shards by jump consistent hashing: no ring table, and a new shard takes rows only into itself.

The law is ``key``: an id and the number of shards decide the shard.  Slots number the rows of a shard without gaps;
they are counted in two levels (buckets of a shard, then rows of a bucket), so that no task holds a whole shard.

Null text: size 1 and the checksum of no bytes.  Null id: the key of the text "null".  Repeated rows: each gets a slot.
Empty table: empty result.  Other columns of the input are left alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import col, cut, id_key, small

#: Rows of one bucket of a shard, on average.
BUCKET_ROWS = 10_000


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Jump consistent hash of unsigned 64-bit keys into 0 .. shards - 1."""
    key = keys.astype(np.uint64)
    at, to = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
    open_ = np.arange(len(key))
    while len(open_):
        at[open_] = to[open_]
        key[open_] = key[open_] * np.uint64(2862933555777941757) + np.uint64(1)
        drawn = (key[open_] >> np.uint64(33)).astype(np.float64) + 1.0
        to[open_] = np.floor((at[open_] + 1) * (2147483648.0 / drawn)).astype(np.int64)
        open_ = open_[to[open_] < shards]
    return at


def shard_of(key: Column, shards: int) -> Column:
    @F.arrow_udf("int")
    def of(keys: pa.Array) -> pa.Array:
        return pa.array(jump(keys.to_numpy(zero_copy_only=False), shards).astype(np.int32))

    return of(key)


def shard_documents(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: one row for each row of docs."""
    text = F.encode(F.coalesce(col(text_col), F.lit("")), "UTF-8")
    rows = docs.select(col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")).withColumn("key", id_key(F.col("doc_id")))
    rows = cut(rows.withColumn("shard", shard_of(F.col("key"), shards)).withColumn("grown_shard", shard_of(F.col("key"), shards + 1)))
    buckets = -(-rows.count() // (shards * BUCKET_ROWS)) or 1
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("key", "size", "text_crc32"), F.lit(buckets)))
    before = Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(F.col("shard").alias("s"), F.col("bucket").alias("b")).agg(F.count("*").alias("n"))
    sums = sums.select("s", "b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("shard", "bucket").orderBy("key", "doc_id", "text_crc32", "size")
    rows = rows.withColumn("place", F.row_number().over(within) - 1).join(small(sums, buckets * shards), (F.col("shard") == F.col("s")) & (F.col("bucket") == F.col("b")))
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("place") + F.col("offset")).alias("slot"), "grown_shard")
