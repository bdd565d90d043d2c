"""Secrets in texts: fixed patterns, and random strings that a tokenizer finds incompressible.

Words and identifiers split into few, long tokens of a byte-pair vocabulary; a random string splits into many short
ones.  Runs of 20 or more key characters with a letter are tokenised; one with fewer than ``max_ratio`` characters a
token is a secret (kind ``random``) unless it is a known digest (hexadecimal of a digest's length, or a UUID) or an
identifier (each of its parts a word or a number).  Assignments are cut out of a run before; a run of which the other
fixed patterns cover all but words and numbers is not reported again.

Null text: empty.  Very long texts: time grows in proportion.  Repeated rows: each is scanned.  Equal starts: kinds as listed in KINDS.  Empty table: empty result.
Other columns of the input are left alone.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, shared

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
NAMES = ("passw", "secret", "token", "api")
#: Maximal runs, so the same spans as a search for any length that drops the short ones.
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
LETTER = re.compile(r"[A-Za-z]")
DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}|[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12})", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
#: Longer runs are tokenised in pieces of so many characters, as merging takes more than linear time.
PIECE = 4096
SEPARATOR = re.compile(r"[+/_=-]+")


def encoder(path: str):
    return shared(("encoder", path), lambda: vocabulary_of(path))


def vocabulary_of(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[int, int, str]]:
    low, found = text.lower(), []
    if any(w in low for w in NAMES):
        found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return found


def identifier(run: str) -> bool:
    """Parts of an identifier are words of three or more letters, or numbers; few of them change class within."""
    parts = [p for p in SEPARATOR.split(run) if p]
    words = [w for p in parts for w in PART.findall(p)]
    return len(words) <= len(run) / 4 and all(w.isdigit() or len(w) >= 3 for w in words)


def outside(start: int, end: int, spans: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """The parts of a range that no span covers."""
    parts = []
    for a, b, _ in sorted(spans):
        if b <= start or a >= end:
            continue
        if a > start:
            parts.append((start, a))
        start = b
    return [*parts, (start, end)] if start < end else parts


def random_spans(text: str, taken: list[tuple[int, int, str]], max_ratio: float, path: str) -> list[tuple[int, int, str]]:
    found, spans = [], [sorted(x for x in taken if x[2] == k) for k in KINDS]
    place = [0] * len(spans)
    for m in RUN.finditer(text):
        near = []
        for n, of_kind in enumerate(spans):  # runs and the spans of a kind both come in order, without overlaps
            while place[n] < len(of_kind) and of_kind[place[n]][1] <= m.start():
                place[n] += 1
            at = place[n]
            while at < len(of_kind) and of_kind[at][0] < m.end():
                near.append(of_kind[at])
                at += 1
        for a, b in outside(*m.span(), [x for x in near if x[2] == "assign"]) if near else [m.span()]:
            run = text[a:b]
            if len(run) < 20 or not LETTER.search(run) or DIGEST.fullmatch(run) or identifier(run):
                continue
            if near and all(w.isdigit() or len(w) >= 3 for i, j in outside(a, b, near) for w in PART.findall(text[i:j])):
                continue
            if len(run) < max_ratio * sum(len(encoder(path).encode_ordinary(run[i : i + PIECE])) for i in range(0, len(run), PIECE)):
                found.append((a, b, "random"))
    return found


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]), x[1])))


def find_secrets(text: Column, max_ratio: float = 2.0, vocabulary: str = VOCABULARY) -> Column:
    """A struct: n_assign, n_access, n_hex, base_sha256, spans."""
    kind = pa.struct([("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])

    @F.arrow_udf("struct<n_assign:bigint,n_access:bigint,n_hex:bigint,base_sha256:string,spans:string>")
    def scan(column: pa.Array) -> pa.Array:
        out = []
        for x in column:
            t = x.as_py() or ""
            base = base_spans(t)
            more = random_spans(t, base, max_ratio, vocabulary)
            n = [k for _, _, k in base]
            out.append({"n_assign": n.count("assign"), "n_access": n.count("access"), "n_hex": n.count("hex"), "base_sha256": hashlib.sha256(joined(base).encode()).hexdigest(), "spans": joined(base + more)})
        return pa.array(out, kind)

    return scan(text)


def redact(text: Column, max_ratio: float = 2.0, vocabulary: str = VOCABULARY, mark: str = "[secret]") -> Column:
    """The text with each secret (overlapping ones together) replaced by the mark; null stays null."""

    @F.arrow_udf("string")
    def clean(column: pa.Array) -> pa.Array:
        out = []
        for x in column:
            if (t := x.as_py()) is None:
                out.append(None)
                continue
            base = base_spans(t)
            parts, at = [], 0
            for a, b, _ in sorted(base + random_spans(t, base, max_ratio, vocabulary)):
                if a >= at:
                    parts += [t[at:a], mark]
                at = max(at, b)
            out.append("".join([*parts, t[at:]]))
        return pa.array(out, pa.string())

    return clean(text)


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans: one row for each row of docs."""
    found = docs.select(col(id_col).alias("doc_id"), find_secrets(col(text_col), **options).alias("s"))
    return found.select("doc_id", "s.n_assign", "s.n_access", "s.n_hex", "s.base_sha256", "s.spans")
