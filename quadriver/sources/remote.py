"""Values behind an HTTP endpoint, as a batch data source, and messages of topics.

``spark.dataSource.register(RemoteValues)``, then ``spark.read.format("remote_values").option("url", ...)`` with options
items and properties (separated by blanks), from, to, limit, interval, op and model.  Each item is a partition.  A long query is
posted as a form; 404 means no values, any other failure fails the task.
"""

from __future__ import annotations

import json
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schema import DEFAULT_CONTEXT, TUPLE
from .lf_json import parse
from .values import parsed

#: Longer URLs are posted.
LONGEST_URL = 6000
PASSED = ("from", "to", "limit", "interval", "op", "model")


class Items(InputPartition):
    def __init__(self, item: str | None):
        self.item = item


def fetch_text(url: str, query: dict[str, str], timeout: float = 60) -> str | None:
    form = urllib.parse.urlencode(query)
    if len(url) + len(form) > LONGEST_URL:
        request = urllib.request.Request(url, form.encode(), {"Content-Type": "application/x-www-form-urlencoded"})
    else:
        request = urllib.request.Request(f"{url}?{form}" if form else url)
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return answer.read().decode()
    except urllib.error.HTTPError as e:
        if e.code == 404:
            return None
        raise


def asked(items: DataFrame, url: str, query: dict[str, str]) -> DataFrame:
    """Values of each item of a table (column item); the tasks that hold the items ask for them, a request an item."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for item in batch["item"].dropna():
                if text := fetch_text(url, {**query, "item": item}):
                    yield pd.DataFrame({"value": [text]})

    return parsed(items.select("item").mapInPandas(ask, "value string"), partial(parse, context=query.get("model")))


class RemoteReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = dict(options)

    def partitions(self) -> list[Items]:
        return [Items(i) for i in self.options.get("items", "").split()] or [Items(None)]

    def read(self, partition: Items) -> Iterator[tuple]:
        query = {k: self.options[k] for k in PASSED if k in self.options}
        if partition.item:
            query["item"] = partition.item
        if self.options.get("properties"):
            query["properties"] = self.options["properties"]
        text = fetch_text(self.options["url"], query)
        if text:
            yield from parse(text, context=self.options.get("model"))


class RemoteValues(DataSource):
    @classmethod
    def name(cls) -> str:
        return "remote_values"

    def schema(self):
        return TUPLE

    def reader(self, schema) -> RemoteReader:
        return RemoteReader(self.options)


def put(df: DataFrame, url: str, batch: int = 10_000) -> int:
    """Post values to an endpoint, in documents of at most batch values; how many.

    A task that runs again posts its values again, which replace themselves.  A context other than the default one is
    named as model.  Any failure fails the task.
    """
    from .lf_json import _json_value

    one = F.concat(F.lit('{"time":'), "time", F.lit(',"seqNr":'), "seqNr", F.lit(',"value":'), _json_value(), F.lit("}"))

    def send(context: str, part: pd.DataFrame) -> None:
        held: dict[str, dict[str, list[str]]] = {}
        for item, prop, text in zip(part["item"], part["property"], part["one"], strict=True):
            held.setdefault(item, {}).setdefault(prop, []).append(text)
        of = lambda props: ",".join(f"{json.dumps(p)}:[{','.join(xs)}]" for p, xs in props.items())
        body = "{" + ",".join(f"{json.dumps(i)}:{{{of(props)}}}" for i, props in held.items()) + "}"
        where = url if context == DEFAULT_CONTEXT else f"{url}?{urllib.parse.urlencode({'model': context})}"
        urllib.request.urlopen(urllib.request.Request(where, body.encode(), {"Content-Type": "application/json"}), timeout=60).close()

    def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for context, part in rows.groupby("context", sort=False):
                for at in range(0, len(part), batch):
                    send(context, part.iloc[at : at + batch])
            yield pd.DataFrame({"n": [len(rows)]})

    rows = df.select(F.coalesce("context", F.lit(DEFAULT_CONTEXT)).alias("context"), "item", "property", one.alias("one"))
    return rows.mapInPandas(post, "n long").agg(F.sum("n")).first()[0] or 0


def topic_item(topic: Column) -> Column:
    """Item of a topic LF/<sender>/<authority>/<path>; null for other topics."""
    pattern = r"^LF/[^/]+/([^/]+)/(.*)"
    return F.when(topic.rlike(pattern), F.concat(F.lit("http://"), F.regexp_extract(topic, pattern, 1), F.lit("/"), F.regexp_extract(topic, pattern, 2)))


def messages(df: DataFrame, own: list[str] = ()) -> DataFrame:
    """Values of messages (topic, payload), batch or stream: the payload is an object of properties; own authorities are passed over."""
    of = df.withColumn("item", topic_item(F.col("topic"))).where(F.col("item").isNotNull())
    for authority in own:
        of = of.where(~F.col("item").startswith(f"http://{authority}/"))
    key = F.expr("substring(to_json(array(item)), 2, length(to_json(array(item))) - 2)")
    return parsed(of.select(F.concat(F.lit("{"), key, F.lit(":"), "payload", F.lit("}"))), parse)


def published(df: DataFrame, sender: str, pattern: str | None = None) -> DataFrame:
    """topic, payload of values, one message a value; with a pattern only of items that match it."""
    from .lf_json import _json_value, quoted

    df = df if pattern is None else df.where(F.col("item").rlike(pattern))
    path = F.regexp_replace("item", "^https?://", "")
    payload = F.concat(F.lit("{"), quoted("property"), F.lit(':[{"time":'), "time", F.lit(',"value":'), _json_value(), F.lit("}]}"))
    return df.select(F.concat(F.lit(f"LF/{sender}/"), path).alias("topic"), payload.alias("payload"))
