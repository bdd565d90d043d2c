"""Language of a text: multinomial naive Bayes over hashed character n-grams.

Letters are lower-cased, all else is a word boundary, and the 1- to 3-grams of the result are hashed into a fixed number
of buckets.  The model is fitted on a bounded sample of labelled rows: of each language about ``rows_per_lang`` rows,
drawn by a hash of the id.  Every language is learned.  Languages go in groups of at most GROUP; each group's
log-probability matrix (languages x buckets, so bounded) is broadcast by itself, and the groups' best scores and sums are
merged by column functions.  Texts are scored in batches of numpy arrays, long texts in pieces that overlap by two
characters.

Null text, or one without letters: ``und``, score 0.  No labelled rows: all ``und``.  Null id: never learned from, not
held out.  Ties: the language that sorts first.  Very long texts: pieces add up to the whole text's n-grams.  Repeated
rows: each is scored.  Empty table: empty result.  Other columns of the input are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col

BUCKETS = 1 << 16
#: Code points that are scored at once.
BLOCK = 1 << 19
#: Languages of one matrix.
GROUP = 64

#: Languages in order, log-probabilities (language x bucket) and log-priors over all languages.
Model = tuple[list[str], np.ndarray, np.ndarray]

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point its lower-case letter, or 0."""
    if not _letters:
        made = np.zeros(0x110000, np.uint32)
        for i in range(0x110000):
            if (c := chr(i)).isalpha():
                made[i] = ord(low) if len(low := c.lower()) == 1 else i
        _letters.append(made)
    return _letters[0]


def grams(text: str) -> Iterator[np.ndarray]:
    """Buckets of a text's n-grams, in blocks; a block begins with the last two characters of the one before it."""
    kept = np.zeros(1, np.uint32)
    for at in range(0, len(text), BLOCK):
        c = letters()[np.frombuffer(text[at : at + BLOCK].encode("utf-32-le", "surrogatepass"), np.uint32)]
        c = np.concatenate((kept, c, np.zeros(int(at + BLOCK >= len(text)), np.uint32)))
        c = c[np.concatenate(([True], (c[1:] != 0) | (c[:-1] != 0)))]
        new, kept = len(kept), c[-2:]
        c = c.astype(np.uint64)
        one = c[new:]
        one = one[one != 0] * np.uint64(0x9E3779B97F4A7C15)
        two = c[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + c[1:] * np.uint64(0x165667B19E3779F9)
        three = two[:-1] + c[2:] * np.uint64(0x27D4EB2F165667C5)
        x = np.concatenate((one, two[max(0, new - 1) :], three[max(0, new - 2) :]))
        if len(x):
            x ^= x >> np.uint64(29)
            yield ((x * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(48)).astype(np.int64)


def batches(texts: Iterator[str | None]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Of several texts at a time: their numbers, all their buckets, and where each one's begin."""
    rows, parts, size = [], [], 0
    for i, text in enumerate(texts):
        for h in grams(text or ""):
            rows.append(i)
            parts.append(h)
            size += len(h)
            if size >= BLOCK:
                yield rows, np.concatenate(parts), np.cumsum([0, *map(len, parts[:-1])])
                rows, parts, size = [], [], 0
    if parts:
        yield rows, np.concatenate(parts), np.cumsum([0, *map(len, parts[:-1])])


def fit(labelled: DataFrame, rows_per_lang: int = 4000, smoothing: float = 0.05) -> list[Model]:
    """A model for each group of languages, from rows of (doc_id, text, lang).  The driver holds one count a language."""
    counts = sorted((r["lang"], r["count"]) for r in labelled.groupBy("lang").count().collect())
    rows = sum(n for _, n in counts)
    return [fit_group(labelled, counts[at : at + GROUP], rows, rows_per_lang, smoothing) for at in range(0, len(counts), GROUP)]


def fit_group(labelled: DataFrame, counts: list[tuple[str, int]], rows: int, rows_per_lang: int, smoothing: float) -> Model:
    langs = [x for x, _ in counts]
    pairs = [x for i, (lang, n) in enumerate(counts) for x in (F.lit(lang), F.struct(F.lit(i).alias("i"), F.lit(min(1.0, rows_per_lang / n)).alias("rate")))]
    chosen = labelled.withColumn("of", F.try_element_at(F.create_map(*pairs), F.col("lang")))
    chosen = chosen.where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30)) < F.col("of.rate") * (1 << 30)).select("text", F.col("of.i").alias("i"))

    def count(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(len(langs) * BUCKETS, np.int64)
        for frame in frames:
            lang = frame.column(1).to_numpy(zero_copy_only=False)
            for rows, h, starts in batches(x.as_py() for x in frame.column(0)):
                each = np.diff(np.append(starts, len(h)))
                seen += np.bincount(h + np.repeat(lang[rows], each) * BUCKETS, minlength=len(seen))
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["at", "n"])

    total = np.zeros(len(langs) * BUCKETS)
    found = chosen.mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    total[found.column("at").to_numpy()] = found.column("n").to_numpy()
    total = total.reshape(len(langs), BUCKETS) + smoothing
    return langs, np.log(total / total.sum(axis=1, keepdims=True)).astype(np.float32), np.log(np.array([n for _, n in counts], float) / rows)


def scored(text: Column, docs: DataFrame, model: Model) -> Column:
    """A struct for one group: top (its best joint log-probability; null without letters), lang, and rest (of all sum(exp(x - top)))."""
    sent = docs.sparkSession.sparkContext.broadcast((model[0], np.ascontiguousarray(model[1]), model[2]))

    @F.arrow_udf("struct<top:double,lang:string,rest:double>")
    def score(column: pa.Array) -> pa.Array:
        langs, logs, prior = sent.value
        sums, any_ = np.zeros((len(column), len(langs))), np.zeros(len(column), bool)
        for rows, h, starts in batches(x.as_py() for x in column):
            any_[rows] = True
            for k in range(len(langs)):
                np.add.at(sums[:, k], rows, np.add.reduceat(logs[k][h], starts, dtype=np.float64))
        sums += prior
        top = sums.max(axis=1)
        rest = np.exp(sums - top[:, None]).sum(axis=1)
        names = pa.array(langs, pa.string()).take(pa.array(sums.argmax(axis=1)))
        return pa.StructArray.from_arrays([pa.array(top, mask=~any_), names, pa.array(rest)], ["top", "lang", "rest"])

    return score(text)


def identify(docs: DataFrame, models: list[Model], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score: one row for each row of docs."""
    if not models:
        return docs.select(col(id_col).alias("doc_id"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    groups = [f"g{n}" for n in range(len(models))]
    found = docs.select(col(id_col).alias("doc_id"), *[scored(col(text_col), docs, m).alias(g) for g, m in zip(groups, models, strict=True)])
    # groups are in order of languages, so that of equal scores the first group's wins
    best = reduce(lambda a, b: F.when(b["top"] > a["top"], b).otherwise(a), map(F.col, groups))
    found = found.select("doc_id", best.alias("best"), *groups)
    whole = reduce(Column.__add__, [F.col(g)["rest"] * F.exp(F.col(g)["top"] - F.col("best.top")) for g in groups])
    known = F.col("best.top").isNotNull()
    return found.select("doc_id", F.when(known, F.col("best.lang")).otherwise("und").alias("lang_pred"), F.when(known, 1 / whole).otherwise(0.0).alias("score"))


def held_out(docs: DataFrame, id_col: str = "doc_id"):
    """Column: the row is kept from the fit."""
    return F.coalesce(F.crc32(col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def predict_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **limits: float) -> DataFrame:
    """doc_id, held_out, lang_pred, score: fitted on the labelled rows that are not held out."""
    known = docs.where(~held_out(docs, id_col) & col(id_col).isNotNull() & col(lang_col).isNotNull() & col(text_col).isNotNull())
    models = fit(known.select(col(id_col).alias("doc_id"), col(text_col).alias("text"), col(lang_col).alias("lang")), **limits)
    found = identify(docs, models, id_col, text_col)
    return found.select("doc_id", held_out(found).alias("held_out"), "lang_pred", "score")
