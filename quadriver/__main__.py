"""python -m quadriver STORE COMMAND ...: descendants, properties, fetch, copy, query."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from . import api
from .operators import catalog
from .plans.compiler import Engine
from .schema import NAMESPACE
from .store import Store


def arguments() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quadriver", description=__doc__)
    top.add_argument("store")
    commands = top.add_subparsers(dest="command", required=True)
    for name, names in (("descendants", ["item"]), ("properties", ["item"]), ("fetch", ["item"]), ("copy", ["item", "sink"]), ("query", ["text"])):
        c = commands.add_parser(name)
        for n in names:
            c.add_argument(n)
        if name in ("fetch", "copy"):
            for n in ("property", "from", "to", "limit", "interval", "op", "model"):
                c.add_argument(f"--{n}")
    return top


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    given = vars(arguments().parse_args(args))
    spark = spark or SparkSession.builder.appName("quadriver").getOrCreate()
    store, command = Store(spark, given["store"]), given["command"]
    if command == "copy":
        whole = lambda k: int(given[k]) if given[k] else None
        store.copy_to(Store(spark, given["sink"]), given["item"], given["property"], whole("from"), whole("to"), given["model"], whole("limit") or 0, whole("interval") or 0, given["op"])
        return
    rows = store.read()
    if command == "descendants":
        out = catalog.descendants(rows, given["item"]).orderBy("item")
    elif command == "properties":
        out = api.get_properties(rows, {"item": given["item"]}).orderBy("property")
    elif command == "query":
        out = Engine(spark, {NAMESPACE: rows}).query(given["text"])
    else:
        out = api.values_json(rows, {k: v for k, v in given.items() if v}).select("json")
    for row in out.toLocalIterator():
        print("\t".join(str(x) for x in row))


if __name__ == "__main__":
    main()
