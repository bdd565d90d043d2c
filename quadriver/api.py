"""The parameter interface: the same names as the service's query string, answered by DataFrames.

The caller sends JSON, CSV or rows on; no server is part of this library.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .operators import catalog
from .operators.fetch import fetch
from .schema import TIME_MAX
from .sources import csv_wide, lf_json, line_protocol
from .sources.values import parsed
from .store import Store

LIMIT, MOST = 10_000, 500_000


class LimitTooLarge(ValueError):
    pass


def _names(text: str | None) -> list[str]:
    """Names separated by white space; those that are no URIs are passed over."""
    return [n for n in (text or "").split() if ":" in n]


def get_values(df: DataFrame, params: dict[str, str]) -> DataFrame:
    """item(s), property or properties, from, to, limit, interval (a fraction is cut off), op, model."""
    limit = int(params.get("limit") or LIMIT)
    limit = LIMIT if limit <= 0 else limit
    if limit > MOST:
        raise LimitTooLarge(f"the limit is at most {MOST}")
    items, properties = (_names(params.get(a) or params.get(b)) for a, b in (("item", "items"), ("property", "properties")))
    whole = lambda k, other: int(float(params[k])) if params.get(k) else other
    return fetch(df, items, properties, params.get("model"), whole("to", TIME_MAX), whole("from", 0), limit, whole("interval", 0), params.get("op"))


def values_json(df: DataFrame, params: dict[str, str]) -> DataFrame:
    return lf_json.written(get_values(df, params))


def values_csv(df: DataFrame, params: dict[str, str]) -> DataFrame:
    return csv_wide.pivoted(get_values(df, params), None, params.get("dateformat"), int(params.get("timezoneoffset") or 0))


def get_properties(df: DataFrame, params: dict[str, str]) -> DataFrame:
    return catalog.properties(df, (_names(params.get("item")) or [None])[0], params.get("model"))


def get_descendants(df: DataFrame, path: str, params: dict[str, str]) -> DataFrame:
    """All items of the root, else those strictly below a path."""
    root = path.rstrip("/").count("/") <= 2
    return catalog.descendants(df, path, params.get("model"), int(params.get("limit") or 0), strict=not root)


def post_values(spark: SparkSession, store: Store, body: str, content_type: str = "application/json", base: str = "", params: dict[str, str] | None = None) -> None:
    """Store values from JSON, line protocol, or the path of a CSV file."""
    params = params or {}
    if content_type.startswith("text/csv"):
        rows = csv_wide.read(spark, body, base, params.get("separator", ","), params.get("model"))
    else:
        context = params.get("model")
        reader = (lambda t: line_protocol.parse(t, context)) if content_type.startswith("application/influxdb-line") else (lambda t: lf_json.parse(t, base, context=context))
        rows = parsed(spark.createDataFrame([(body,)], "text string"), reader)
    store.put(rows)


def delete_values(store: Store, params: dict[str, str]) -> dict[str, int]:
    whole = lambda k: int(params[k]) if params.get(k) else None
    total = 0
    for item in _names(params.get("item") or params.get("items")):
        for prop in _names(params.get("property") or params.get("properties")) or [None]:
            total += store.delete(item, prop, params.get("model"), whole("from"), whole("to"))
    return {"deleted": total}
