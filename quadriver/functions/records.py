"""Records and arrays: fields, elements and list operations.

A record value is JSON text.  For list operations on records in memory it is an array of (p, v) structs, which keeps
order and repeated properties.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _step(name: str) -> str:
    return "['" + name.replace("'", "\\'") + "']"


def field(record: Column, *properties: str) -> Column:
    """The first value of a property, and of properties of that; a string plainly, else JSON."""
    return F.get_json_object(record, "$" + "".join(map(_step, properties)))


def element(array: Column, n: int, *properties: str) -> Column:
    """The n-th element, from 1; null beyond the end."""
    return F.get_json_object(array, f"$[{n - 1}]" + "".join(map(_step, properties)))


def elements(df: DataFrame, array: str, kind: str = "string") -> DataFrame:
    """One row per element of a JSON array: position (from 1) and element."""
    return df.select("*", F.posexplode(F.from_json(array, f"array<{kind}>")).alias("position", "element")).withColumn("position", (F.col("position") + 1).cast("long"))


def entries(df: DataFrame, record: str, keep_repeats: bool = False) -> DataFrame:
    """One row per property of a JSON record: p and v.  Repeated properties survive only on the slower path."""
    if not keep_repeats:
        return df.select("*", F.explode(F.from_json(record, "map<string,string>")).alias("p", "v"))

    @F.arrow_udf("array<struct<p:string,v:string>>")
    def pairs(column: pa.Array) -> pa.Array:
        plain = lambda v: v if isinstance(v, str) else json.dumps(v)
        out = [None if x.as_py() is None else [{"p": p, "v": plain(v)} for p, v in ordered(x.as_py())] for x in column]
        return pa.array(out, pa.list_(pa.struct([("p", pa.string()), ("v", pa.string())])))

    return df.select("*", F.inline(pairs(F.col(record))))


class Pairs(list):
    """A decoded object as a list of pairs; unlike a dict it may repeat a key."""


def ordered(record: str) -> Iterator[tuple[str, object]]:
    """Properties of a JSON record in order, repeats included; inner records are plain dicts."""
    plain = lambda x: {k: plain(v) for k, v in x} if isinstance(x, Pairs) else [*map(plain, x)] if isinstance(x, list) else x
    yield from ((k, plain(v)) for k, v in json.loads(record, object_pairs_hook=Pairs))


def append(record: Column, p: str, v: Column) -> Column:
    return F.concat(record, F.array(F.struct(F.lit(p).alias("p"), v.alias("v"))))


def first(record: Column, p: str) -> Column:
    return F.try_element_at(F.filter(record, lambda x: x["p"] == p), F.lit(1))["v"]


def remove_first(record: Column, p: str) -> Column:
    """The record without the first pair of a property."""
    at = F.array_position(F.transform(record, lambda x: x["p"]), p)
    return F.filter(record, lambda x, i: (at == 0) | (i + 1 != at))


def rest(record: Column) -> Column:
    return F.slice(record, F.lit(2), F.greatest(F.size(record) - 1, F.lit(0)))


def size(record: Column) -> Column:
    return F.size(record)
