"""The canonical long table of values, and the constants of its data model.

One row holds one value.  Values are typed per row: ``v_type`` says which of the sparse columns holds it.  Records and
arrays are JSON text (order and repeated keys survive), URIs inside them are ``{"@id": uri}``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NAMESPACE = "ts:"
DEFAULT_CONTEXT = NAMESPACE + "nil"
TIME_MAX = 2**47
KEY = ["context", "item", "property"]
VALUES = ["v_type", "v_long", "v_double", "v_decimal", "v_string", "v_bool", "v_json"]
COLUMNS = [*KEY, "time", "seqNr", *VALUES]

TUPLE = T.StructType([
    T.StructField("context", T.StringType(), False),
    T.StructField("item", T.StringType(), False),
    T.StructField("property", T.StringType(), False),
    T.StructField("time", T.LongType(), False),
    T.StructField("seqNr", T.IntegerType(), False),
    T.StructField("v_type", T.StringType(), False),
    T.StructField("v_long", T.LongType()),
    T.StructField("v_double", T.DoubleType()),
    T.StructField("v_decimal", T.DecimalType(38, 18)),
    T.StructField("v_string", T.StringType()),
    T.StructField("v_bool", T.BooleanType()),
    T.StructField("v_json", T.StringType()),
])

#: v_type and the column that holds it; integers of any width are longs, floats of either width doubles.
HELD = {
    "int": "v_long", "long": "v_long", "float": "v_double", "double": "v_double", "decimal": "v_decimal",
    "string": "v_string", "uri": "v_string", "bool": "v_bool", "record": "v_json", "array": "v_json",
}
_OF = {"v_long": "bigint", "v_double": "double", "v_decimal": "decimal(38,18)", "v_string": "string", "v_bool": "boolean", "v_json": "string"}


def value(v_type: str, x: Column) -> list[Column]:
    """The value columns of a row whose value is x."""
    return [F.lit(v_type).alias("v_type"), *[(x if HELD[v_type] == c else F.lit(None)).cast(kind).alias(c) for c, kind in _OF.items()]]


def tuples(df: DataFrame, item: Column, property_: Column, time: Column, seq_nr: Column, v_type: str, x: Column, context: str | None = None) -> DataFrame:
    """Rows of the canonical table from any table."""
    return df.select(F.lit(context or DEFAULT_CONTEXT).alias("context"), item.alias("item"), property_.alias("property"), time.cast("long").alias("time"), seq_nr.cast("int").alias("seqNr"), *value(v_type, x))


def num() -> Column:
    """The numeric view of a value; null if it is none."""
    return F.coalesce(F.col("v_double"), F.col("v_long").cast("double"), F.col("v_decimal").cast("double"))


def text() -> Column:
    """The value as text: scalars plainly, records and arrays as JSON."""
    return F.coalesce(F.col("v_string"), F.col("v_json"), F.col("v_long").cast("string"), F.col("v_double").cast("string"), F.col("v_decimal").cast("string"), F.col("v_bool").cast("string"))


def value_key() -> Column:
    """Text that is equal for equal values of the same class of type (numbers, text, truth values, URIs, JSON)."""
    kind = F.when(F.col("v_type").isin("int", "long", "float", "double", "decimal"), "n").otherwise(F.substring("v_type", 1, 1))
    return F.concat(kind, F.lit(":"), F.coalesce(num().cast("string"), text()))
