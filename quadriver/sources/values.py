"""Rows of the canonical table from plain Python values."""

from __future__ import annotations

import json
import time as clock
from collections.abc import Callable, Iterable, Iterator
from decimal import Decimal
from itertools import chain, islice

from pyspark.sql import DataFrame
from pyspark.sql.types import Row

from ..schema import COLUMNS, DEFAULT_CONTEXT, TIME_MAX, TUPLE

LONG = 2**63
#: Parsed rows that leave a task together.
BATCH = 10_000


def typed(x: object) -> tuple:
    """v_type and the value columns of a value; a dict of one @id is a URI, other dicts records, lists arrays."""
    none: list = [None] * 6
    if isinstance(x, bool):
        none[4], kind = x, "bool"
    elif isinstance(x, int) and -LONG <= x < LONG:
        none[0], kind = x, "long" if abs(x) >= 2**31 else "int"
    elif isinstance(x, (int, Decimal)):
        none[2], kind = Decimal(x), "decimal"
    elif isinstance(x, float):
        none[1], kind = x, "double"
    elif isinstance(x, str):
        none[3], kind = x, "string"
    elif isinstance(x, dict) and list(x) == ["@id"]:
        none[3], kind = x["@id"], "uri"
    elif isinstance(x, dict):
        none[5], kind = json.dumps(x, ensure_ascii=False), "record"
    elif isinstance(x, list):
        none[5], kind = json.dumps(x, ensure_ascii=False), "array"
    else:
        raise ValueError(f"no value: {x!r}")
    return (kind, *none)


def row(item: str, prop: str, time: int | None, seq: int, x: object, context: str | None = None) -> tuple:
    for name in (item, prop):
        if not name or any(c.isspace() for c in name):
            raise ValueError(f"invalid URI: {name!r}")
    time = int(clock.time() * 1000) if time is None else time
    if time > TIME_MAX:
        raise ValueError(f"time out of range: {time}")
    return (context or DEFAULT_CONTEXT, item, prop, time, seq, *typed(x))


def parsed(texts: DataFrame, parse: Callable[[str], Iterable[tuple]]) -> DataFrame:
    """Rows from a table with one text column; each text is parsed by itself, a bad one fails the job.  Rows leave a task in batches, of however many texts."""

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        rows = chain.from_iterable(parse(text) for frame in frames for text in frame.iloc[:, 0])
        while part := list(islice(rows, BATCH)):
            yield pd.DataFrame({c: pd.Series([r[i] for r in part], dtype=object) for i, c in enumerate(COLUMNS)})

    return texts.mapInPandas(run, TUPLE)


def created(spark, rows: Iterable[tuple]) -> DataFrame:
    return spark.createDataFrame([Row(*r) for r in rows], TUPLE)
