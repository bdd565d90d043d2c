"""JSON of the form {item: {property: [{"time": t, "seqNr": n, "value": v}]}}.

An @context (or several, later ones first) expands prefixed names; names without a scheme resolve against a base; times
may be ISO texts; ``t`` and ``v`` are short for time and value; a value may stand alone.  Values of one property
without time and seqNr share the time of reading and count up.  A missing value, an empty name and white space in one
are errors.
"""

from __future__ import annotations

import datetime
import json
import re
import time as clock
from collections.abc import Iterator
from urllib.parse import urljoin

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import COLUMNS
from .values import parsed, row

SCHEME = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*:")


class Names:
    def __init__(self, base: str = "", prefixes: dict[str, str] | None = None):
        self.base, self.prefixes = base, dict(prefixes or {})

    def under(self, context: object) -> Names:
        inner = Names(self.base, self.prefixes)
        for c in context if isinstance(context, list) else [context]:
            if not isinstance(c, dict):
                raise ValueError("@context must be an object")
            for k, v in c.items():
                inner.prefixes[k] = inner.full(v)
        return inner

    def full(self, name: str) -> str:
        if not name or any(c.isspace() for c in name):
            raise ValueError(f"invalid URI: {name!r}")
        head, colon, tail = name.partition(":")
        if colon and head in self.prefixes:
            return self.prefixes[head] + tail
        return name if SCHEME.match(name) or not self.base else urljoin(self.base, name)


def _value(x: object, names: Names) -> object:
    if isinstance(x, dict):
        inner = names.under(x["@context"]) if "@context" in x else names
        if list(x) == ["@id"]:
            return {"@id": inner.full(x["@id"])}
        return {(k if k.startswith("@") else inner.full(k)): _value(v, inner) for k, v in x.items() if k != "@context"}
    return [_value(v, names) for v in x] if isinstance(x, list) else x


def _time(t: object) -> int:
    if isinstance(t, str):
        when = datetime.datetime.fromisoformat(t)
        return round((when if when.tzinfo else when.replace(tzinfo=datetime.timezone.utc)).timestamp() * 1000)
    return int(t)


def parse(text: str, base: str = "", prefixes: dict[str, str] | None = None, context: str | None = None) -> Iterator[tuple]:
    names, now = Names(base, prefixes), int(clock.time() * 1000)
    top = json.loads(text)
    if not isinstance(top, dict):
        raise ValueError("an object of items is expected")
    if "@context" in top:
        names = names.under(top["@context"])
    for item, properties in top.items():
        if item == "@context":
            continue
        inner = names.under(properties["@context"]) if "@context" in properties else names
        item = inner.full(item)
        item = item.rstrip("/") if base else item
        for prop, values in properties.items():
            if prop == "@context":
                continue
            prop, auto = inner.full(prop), 0
            for v in values if isinstance(values, list) else [values]:
                short = {"t": "time", "v": "value"}
                v = {short.get(k, k): x for k, x in v.items()} if isinstance(v, dict) and ({"value", "v", "time", "t"} & v.keys()) else {"value": v} if not isinstance(v, dict) or "@id" in v else v
                if v.get("value") is None:
                    raise ValueError(f"{item} {prop}: a value is missing")
                if "time" in v or "seqNr" in v:
                    seq = int(v.get("seqNr", 0))
                else:
                    seq, auto = auto, auto + 1
                yield row(item, prop, _time(v["time"]) if "time" in v else now, seq, _value(v["value"], inner), context)


def read(spark: SparkSession, path: str, **options) -> DataFrame:
    """Files of such JSON, one document a file."""
    return parsed(spark.read.text(path, wholetext=True), lambda text: parse(text, **options))


def quoted(name: str) -> Column:
    """A text column as a JSON string."""
    return F.expr(f"substring(to_json(array({name})), 2, length(to_json(array({name}))) - 2)")


def _json_value() -> Column:
    uri = F.concat(F.lit('{"@id":'), quoted("v_string"), F.lit("}"))
    return F.when(F.col("v_json").isNotNull(), F.col("v_json")).when(F.col("v_type") == "uri", uri).when(F.col("v_string").isNotNull(), quoted("v_string")).otherwise(F.coalesce(F.col("v_long").cast("string"), F.col("v_double").cast("string"), F.regexp_replace(F.col("v_decimal").cast("string"), r"\.?0+$", ""), F.col("v_bool").cast("string")))


def written(df: DataFrame) -> DataFrame:
    """item, json: for each item its document; newest values first, seqNr only above 0."""
    one = F.concat(F.lit('{"time":'), "time", F.when(F.col("seqNr") > 0, F.concat(F.lit(',"seqNr":'), "seqNr")).otherwise(""), F.lit(',"value":'), _json_value(), F.lit("}"))
    by = df.select(*COLUMNS).withColumn("one", F.struct((-F.col("time")).alias("t"), (-F.col("seqNr")).alias("s"), one.alias("j")))
    props = by.groupBy("item", "property").agg(F.sort_array(F.collect_list("one")).alias("all"))
    props = props.select("item", F.concat(quoted("property"), F.lit(":["), F.array_join(F.transform("all", lambda x: x["j"]), ","), F.lit("]")).alias("p"))
    return props.groupBy("item").agg(F.array_join(F.sort_array(F.collect_list("p")), ",").alias("p")).select("item", F.concat(F.lit("{"), quoted("item"), F.lit(":{"), "p", F.lit("}}")).alias("json"))
