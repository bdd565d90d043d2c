"""Deterministic series for tests and benches: items x properties x values, one clock over all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import tuples


def generate(spark: SparkSession, items: int, properties: int, values: int, start: int = 0, step: int = 10, item: str = "http://example.org/item", prop: str = "http://example.org/p", v_type: str = "double", seed: int = 200) -> DataFrame:
    """Item i, property p, value v: number ((i * properties) + p) * values + v is at start + number * step.

    v_type is any type of value.
    """
    n = spark.range(items * properties * values)
    series = F.expr(f"id div {values}")
    i, p = (series / properties).cast("long") + 1, series % properties + 1
    random = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1_000_000))
    whole, part, name = random.cast("string"), (random / 2000).cast("string"), F.concat(F.lit("s"), random)
    kinds = {
        "int": random,
        "long": F.xxhash64(F.lit(seed), "id"),
        "float": (random / 2000).cast("float"),
        "double": random / 2000,
        "decimal": (random / 1000).cast("decimal(38,18)"),
        "string": name,
        "uri": F.concat(F.lit(item), F.lit("/"), name),
        "bool": random % 2 == 0,
        "record": F.concat(F.lit('{"' + prop + '/n":'), whole, F.lit(',"' + prop + '/x":'), part, F.lit("}")),
        "array": F.concat(F.lit("["), whole, F.lit(","), part, F.lit("]")),
    }
    if v_type not in kinds:
        raise ValueError(f"unknown type {v_type!r}: one of {', '.join(kinds)}")
    x = kinds[v_type]
    return tuples(n, F.concat(F.lit(item), i), F.concat(F.lit(prop), p), F.lit(start) + F.col("id") * step, F.lit(0), v_type, x)
