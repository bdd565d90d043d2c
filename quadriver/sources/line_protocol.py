"""Line protocol: measurement,item=<uri>[,tags] value=<v>[,fields] [nanoseconds].

The measurement is the property, the tag ``item`` the item and the field ``value`` the value: a quoted text, a whole
number ending in i, a truth value or a number.  Blanks or tabs part
them; blanks, commas and equal signs may be escaped by a backslash.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from .values import parsed, row

TRUTH = {**dict.fromkeys(("t", "T", "true", "True", "TRUE"), True), **dict.fromkeys(("f", "F", "false", "False", "FALSE"), False)}


def _split(line: str, at: str) -> list[str]:
    """Pieces between separators (any of the given characters) that are neither escaped nor inside quotes."""
    out, piece, quoted, i = [], "", False, 0
    while i < len(line):
        c = line[i]
        if c == "\\" and i + 1 < len(line):
            piece += line[i : i + 2]
            i += 2
            continue
        quoted ^= c == '"'
        if c in at and not quoted:
            out.append(piece)
            piece = ""
        else:
            piece += c
        i += 1
    return [*out, piece]


def _plain(s: str) -> str:
    out, i = "", 0
    while i < len(s):
        if s[i] == "\\" and i + 1 < len(s) and s[i + 1] in ' ,="\\':
            i += 1
        out += s[i]
        i += 1
    return out


def _value(s: str) -> object:
    if len(s) >= 2 and s[0] == s[-1] == '"':
        return _plain(s[1:-1])
    if s in TRUTH:
        return TRUTH[s]
    return int(s[:-1]) if s.endswith("i") else float(s)


def parse(text: str, context: str | None = None) -> Iterator[tuple]:
    for line in text.splitlines():
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        parts = [p for p in _split(line.strip(), " \t") if p]
        if len(parts) not in (2, 3):
            raise ValueError(f"bad line: {line}")
        head = _split(parts[0], ",")
        pairs = [_split(t, "=") for t in head[1:]], [_split(f, "=") for f in _split(parts[1], ",")]
        if any(len(x) != 2 for part in pairs for x in part):
            raise ValueError(f"bad line: {line}")
        tags, fields = map(dict, pairs)
        if "item" not in tags or "value" not in fields:
            raise ValueError(f"no item or value: {line}")
        yield row(_plain(tags["item"]), _plain(head[0]), int(parts[2]) // 1_000_000 if len(parts) == 3 else None, 0, _value(fields["value"]), context)


def read(spark: SparkSession, path: str, context: str | None = None) -> DataFrame:
    return parsed(spark.read.text(path), lambda text: parse(text, context))
