"""Administration shells behind a REST endpoint as triples (s, p, o, o_type).

A list comes in pages, each naming the cursor of the next one; one task reads a list page by page.  The submodels that
shells refer to are asked for by many tasks, a request a submodel.  404 means nothing, any other failure fails the task.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..store import checkpointed
from .documents import AAS, aas_triples, resolved, shell_uri
from .remote import fetch_text

API = "aas-api:"
TRIPLE = "s string, p string, o string, o_type string"


def pages(url: str, path: str) -> Iterator[list[dict]]:
    """What lies at a path, page by page; a single document is a page of its own."""
    query: dict[str, str] = {}
    while text := fetch_text(f"{url.rstrip('/')}/{path}", query):
        node = json.loads(text)
        if not isinstance(node, dict) or not isinstance(node.get("result"), list):
            yield [node]
            return
        yield node["result"]
        cursor = (node.get("paging_metadata") or {}).get("cursor")
        if not cursor or query.get("cursor") == str(cursor):
            return
        query = {"cursor": str(cursor)}


def documents(paths: DataFrame, url: str) -> DataFrame:
    """The documents (column text) at each path of a table (column path)."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                for page in pages(url, path):
                    yield pd.DataFrame({"text": [json.dumps(node) for node in page]}, dtype=object)

    return paths.select("path").mapInPandas(ask, "text string")


def listed(spark: SparkSession, url: str, path: str) -> DataFrame:
    """The documents at one path: shells, submodels, shells/<id>, submodels/<id>; ids in URL-safe base64."""
    return documents(spark.createDataFrame([(path,)], "path string"), url)


def triples_of(docs: DataFrame) -> DataFrame:
    """Triples of documents; a shell's submodels are named by the submodels' own URIs, and shells by the endpoint."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for text in batch["text"]:
                found, node = list(aas_triples(text)), json.loads(text)
                if node.get("modelType") != "Submodel" and "id" in node:
                    shell = shell_uri(node["id"])
                    found.append((API + "endpoint", API + "shells", shell, "uri"))
                    found += [(shell, AAS + "submodels", s, "uri") for s in map(resolved, node.get("submodels") or []) if s]
                yield pd.DataFrame(found, columns=["s", "p", "o", "o_type"])

    return docs.select("text").mapInPandas(run, TRIPLE)


def read(spark: SparkSession, url: str) -> DataFrame:
    """Triples of all shells of an endpoint and of the submodels that they refer to; each document is asked for once."""
    shells = checkpointed(listed(spark, url, "shells"))
    reference = "array<struct<keys:array<struct<type:string,value:string>>>>"
    refs = shells.select(F.explode(F.from_json(F.get_json_object("text", "$.submodels"), reference)).alias("r"))
    ids = refs.select(F.col("r.keys")[0].alias("k")).where("k.type = 'Submodel' and k.value is not null").select(F.col("k.value").alias("id")).distinct()
    code = F.regexp_replace(F.translate(F.base64(F.encode("id", "UTF-8")), "+/", "-_"), r"[=\s]+", "")
    return checkpointed(triples_of(shells.unionByName(documents(ids.select(F.concat(F.lit("submodels/"), code).alias("path")), url))))
