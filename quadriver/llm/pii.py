"""Personal data in texts, also where it is disguised.

Plain identifiers are found in the text as it is.  Disguised ones are found by two transducers that keep offsets: the
first maps look-alike characters to ASCII, one for one; the second rewrites spelled digits (two in a row, or one beside a
figure or a plus), "(at)" and "(dot)" forms and drops invisible characters, and remembers for each character it writes the
source characters it stands for.  The same patterns run over the result, and what they find is mapped back to source
offsets.  A found span that lies within a plain span of its kind is not reported again; one that reaches further is.
A bare "at" before a dotted name counts only after a word that prose does not have (with a point, figure, _, + or %).

Null text: empty.  Very long texts: time grows in proportion.  Repeated rows: each is scanned.  Empty table: empty result.  Other columns of the input are left
alone.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, str]

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: Possessive and begun at the start of a run of digits: the same matches, in linear time.
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
IP_RUN = re.compile(r"[0-9][0-9.]{6,}")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
CARD_RUN = re.compile(r"[0-9][0-9\x20-]{15,}")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = sum(int(c) for c in digits[-1::-2]) + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """Leftmost matches of local part, @ and dotted domain: the local part is the run of its characters before the @."""
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            found.append((start, m.end(), "email"))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return found


def numbers(text: str) -> list[Span]:
    found = []
    for run in IP_RUN.finditer(text):
        for m in IP.finditer(text, *run.span()):
            if all(len(p := x.lstrip("0")) <= 3 and int(p or "0") <= 255 for x in m.groups()):
                found.append((m.start(), m.end(), "ip"))
    for run in CARD_RUN.finditer(text):
        for m in CARD.finditer(text, *run.span()):
            if 16 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                found.append((m.start(), m.end(), "card"))
    if "+" in text:
        found += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return found


def plain_spans(text: str) -> list[Span]:
    return emails(text) + numbers(text)


# Letters of other scripts that look like Latin ones.
LOOK_ALIKE = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "І": "I", "Ѕ": "S",
    "ο": "o", "ν": "v", "α": "a", "ι": "i", "κ": "k", "ρ": "p", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I",
    "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ı": "i", "․": ".", "。": ".", "‐": "-", "‑": "-", "–": "-",
}
DIGITS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")
INVISIBLE = "­​‌‍⁠﻿"


@lru_cache(maxsize=1)
def look_alikes() -> dict[int, str]:
    """Each look-alike and its one ASCII character: the list above and all compatibility forms."""
    forms = {i: n for i in range(0x80, 0x20000) if len(n := unicodedata.normalize("NFKC", chr(i))) == 1 and "!" <= n <= "~"}
    return forms | {ord(k): v for k, v in LOOK_ALIKE.items()}


@lru_cache(maxsize=1)
def odd() -> np.ndarray:
    """For each code point whether it is rewritten or dropped."""
    made = np.zeros(0x110000, bool)
    made[[*look_alikes(), *map(ord, INVISIBLE)]] = True
    return made


_WORD = "|".join(DIGITS)
#: Two spelled digits in a row, or one beside a figure or a plus.
NEAR_FIGURE = re.compile(rf"(?:[0-9+]|\b(?:plus|{_WORD}))[\x20-]+(?:{_WORD})\b|\b(?:plus|{_WORD})[\x20-]+[0-9]", re.I)
#: Runs of white space are entered at their first character alone and never given back, so time stays linear.
REWRITE = re.compile(
    rf"""(?P<digits>(?:\bplus[\x20-]++)?\b(?:{_WORD})(?:[\x20-]++(?:{_WORD}))+\b
        |\bplus[\x20-]++(?:(?:{_WORD})\b|(?=[0-9]))|(?<=[0-9+][\x20-])(?:{_WORD})\b|(?<=[+])(?:{_WORD})\b|\b(?:{_WORD})(?=[\x20-][0-9]))
    |(?P<at>(?<!\s)\s*+(?:\(\s{{0,3}}(?:at|@)\s{{0,3}}\)|\[\s{{0,3}}(?:at|@)\s{{0,3}}\]|\{{\s{{0,3}}(?:at|@)\s{{0,3}}\}}|<\s{{0,3}}(?:at|@)\s{{0,3}}>)\s*+|\x20at\x20(?=[a-z0-9-]++\x20dot\x20[a-z]))
    |(?P<bare>\x20at\x20(?=[a-z0-9-]++\.[a-z0-9]))
    |(?P<dot>(?<!\s)\s*+(?:\(\s{{0,3}}(?:dot|\.)\s{{0,3}}\)|\[\s{{0,3}}(?:dot|\.)\s{{0,3}}\]|\{{\s{{0,3}}(?:dot|\.)\s{{0,3}}\}}|<\s{{0,3}}dot\s{{0,3}}>)\s*+|(?<=[a-z0-9])\x20dot\x20(?=[a-z0-9]))
    |(?P<gone>[{INVISIBLE}])""",
    re.I | re.X,
)
ONE_DIGIT = re.compile(rf"plus|{_WORD}", re.I)
MARKED = re.compile(r"[(\[{<]\s{0,3}(?:at|@|dot|\.)\s{0,3}[)\]}>]|\x20dot\x20|\x20at\x20[a-z0-9-]++\.[a-z0-9]")


def disguised(text: str) -> bool:
    """A quick test: nothing is rewritten in other texts."""
    if not text.isascii() and odd()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].any():
        return True
    low = text.lower()
    if MARKED.search(low):
        return True
    return any(w in low for w in DIGITS) and NEAR_FIGURE.search(low) is not None


class Normalised:
    """A rewritten text in pieces: copied ones, whose characters stand for themselves, and written ones for a source range."""

    def __init__(self):
        self.out: list[str] = []
        self.at: list[int] = []  # where each piece begins in the rewritten text
        self.source: list[tuple[int, int, bool]] = []  # its source range; whether it is copied
        self.size = 0

    def write(self, s: str, start: int, end: int, copied: bool) -> None:
        if s:
            self.out.append(s)
            self.at.append(self.size)
            self.source.append((start, end, copied))
            self.size += len(s)

    @property
    def text(self) -> str:
        return "".join(self.out)

    def of(self, i: int) -> tuple[int, int]:
        """Source range of the i-th character."""
        n = bisect_right(self.at, i) - 1
        start, end, copied = self.source[n]
        return (start + i - self.at[n], start + i - self.at[n] + 1) if copied else (start, end)


def told_apart(text: str, end: int, after: int) -> bool:
    """Whether the word before a bare "at" looks like a mail box, not like prose: it holds a point, a figure, _, + or %."""
    start = end
    while start > after and text[start - 1] in LOCAL:
        start -= 1
    return any(not c.isalpha() and c != "-" for c in text[start:end])


def normalise(text: str) -> Normalised:
    even = text.translate(look_alikes())
    out, at = Normalised(), 0
    for m in REWRITE.finditer(even):
        a, b = m.span()
        if m["bare"] and not told_apart(even, a, at):
            continue
        out.write(even[at:a], at, a, True)
        if m["digits"]:
            for w in ONE_DIGIT.finditer(even, a, b):
                out.write("+" if w[0].lower() == "plus" else str(DIGITS.index(w[0].lower())), *w.span(), False)
        elif not m["gone"]:
            out.write("." if m["dot"] else "@", a, b, False)
        at = b
    out.write(even[at:], at, len(even), True)
    return out


def mapped_spans(text: str) -> set[Span]:
    """What the patterns find in the rewritten text, as source offsets."""
    if not disguised(text):
        return set()
    norm = normalise(text)
    return {(norm.of(a)[0], norm.of(b - 1)[1], k) for a, b, k in plain_spans(norm.text)}


def hidden_spans(text: str, taken: list[Span]) -> list[Span]:
    """Disguised identifiers that no plain span of their kind covers; those of a kind do not overlap, so one look-up tells."""
    found = mapped_spans(text)
    if not found:
        return []
    by = {k: sorted(x[:2] for x in taken if x[2] == k) for k in KINDS}

    def covered(a: int, b: int, k: str) -> bool:
        n = bisect_right(by[k], (a, len(text) + 1)) - 1
        return n >= 0 and b <= by[k][n][1]

    return [x for x in found if not covered(*x)]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda x: (KINDS.index(x[2]), x[0], x[1])))


def find_pii(text: Column) -> Column:
    """A struct: n_email, n_ip, n_card, n_phone (plain spans), base_sha256, spans."""
    kind = pa.struct([*((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string())])

    @F.arrow_udf("struct<n_email:bigint,n_ip:bigint,n_card:bigint,n_phone:bigint,base_sha256:string,spans:string>")
    def scan(column: pa.Array) -> pa.Array:
        out = []
        for x in column:
            t = x.as_py() or ""
            base = plain_spans(t)
            n = [k for _, _, k in base]
            out.append({f"n_{k}": n.count(k) for k in KINDS} | {"base_sha256": hashlib.sha256(joined(base).encode()).hexdigest(), "spans": joined(base + hidden_spans(t, base))})
        return pa.array(out, kind)

    return scan(text)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans: one row for each row of docs."""
    found = docs.select(col(id_col).alias("doc_id"), find_pii(col(text_col)).alias("s"))
    return found.select("doc_id", *[f"s.n_{k}" for k in KINDS], "s.base_sha256", "s.spans")
