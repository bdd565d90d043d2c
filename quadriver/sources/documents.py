"""Administration shells and information-model files as triples (s, p, o, o_type)."""

from __future__ import annotations

import base64
import json
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

AAS = "urn:aas-model:"
TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
UA = "{http://opcfoundation.org/UA/2011/03/UANodeSet.xsd}"
Triple = tuple[str, str, str, str]
#: Lists whose order matters: their members carry an index.
ORDERED = ("keys", "value")


def shell_uri(identifier: str) -> str:
    return "urn:aas:" + base64.urlsafe_b64encode(identifier.encode()).decode().rstrip("=")


def aas_triples(text: str) -> Iterator[Triple]:
    """A shell, a submodel, or a list of them; nested elements are named by the path of their idShort (or place)."""

    def walk(node: dict, name: str) -> Iterator[Triple]:
        if "modelType" in node:
            yield name, TYPE, AAS + str(node["modelType"]), "uri"
        for key, value in node.items():
            for n, v in enumerate(value if isinstance(value, list) else [value]):
                if isinstance(v, dict):
                    child = f"{name}/{v.get('idShort') or f'{key}/{n}'}"
                    yield name, AAS + key, child, "uri"
                    if isinstance(value, list) and key in ORDERED:
                        yield child, AAS + "index", str(n), "long"
                    yield from walk(v, child)
                elif v is not None:
                    kind = "bool" if isinstance(v, bool) else "long" if isinstance(v, int) else "double" if isinstance(v, float) else "string"
                    yield name, AAS + key, str(v).lower() if kind == "bool" else str(v), kind

    top = json.loads(text)
    for node in top.get("result", [top]) if isinstance(top, dict) else top:
        yield from walk(node, shell_uri(node["id"]) if "id" in node else "urn:aas:unnamed")


def resolved(reference: dict) -> str | None:
    """URI of the submodel that a reference's first key names."""
    key = (reference.get("keys") or [{}])[0]
    return shell_uri(key["value"]) if key.get("type") == "Submodel" and "value" in key else None


def nodeset_triples(text: str) -> Iterator[Triple]:
    """Nodes, attributes and references of an OPC UA NodeSet file."""
    top = ET.fromstring(text)
    spaces = ["http://opcfoundation.org/UA/"] + [e.text or "" for e in top.iterfind(f"{UA}NamespaceUris/{UA}Uri")]
    alias = {e.get("Alias"): e.text for e in top.iterfind(f"{UA}Aliases/{UA}Alias")}

    def uri(node: str) -> str:
        node = alias.get(node) or node
        n, rest = (node[3:].split(";", 1) if node.startswith("ns=") else ("0", node))
        space = spaces[int(n)] if int(n) < len(spaces) else f"urn:ns:{n}"
        return space.rstrip("/#") + "#" + rest

    for e in top:
        if (node := e.get("NodeId")) is None:
            continue
        s = uri(node)
        yield s, TYPE, spaces[0] + e.tag.removeprefix(UA + "UA"), "uri"
        yield s, spaces[0] + "browseName", e.get("BrowseName") or "", "string"
        for name in ("DisplayName", "Description"):
            if (t := e.find(UA + name)) is not None and t.text:
                yield s, spaces[0] + name[0].lower() + name[1:], t.text, "string"
        for r in e.iterfind(f"{UA}References/{UA}Reference"):
            a, b = s, uri((r.text or "").strip())
            if r.get("IsForward", "true") == "false":
                a, b = b, a
            yield a, uri(r.get("ReferenceType") or ""), b, "uri"


def read_triples(spark: SparkSession, path: str, parse: Callable[[str], Iterator[Triple]]) -> DataFrame:
    """s, p, o, o_type of all files, each parsed by itself."""

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        for frame in frames:
            for text in frame.iloc[:, 0]:
                yield pd.DataFrame(list(parse(text)), columns=["s", "p", "o", "o_type"])

    return spark.read.text(path, wholetext=True).mapInPandas(run, "s string, p string, o string, o_type string")
