"""Quality rules whose thresholds follow the data of each language and source.

Fixed cutoffs misjudge sources whose habits differ, so only two of them stay (too few words, too much repetition).
All other limits come from quantile sketches: each measure of a document falls into one of a bounded number of bins,
a sketch is the counts by bin, and sketches merge by addition - map side first, then by (language, source), then by
language, then over everything.  A group of fewer than ``min_docs`` documents uses the merged sketch of its language,
or of all.  A document is rejected if a measure lies beyond the quartiles by more than ``reach`` interquartile ranges
(a range narrower than the measure's least spread counts as that).  Only built-in column functions run.

Null text: no words, so the document fails.  Null language or source: a group of its own.  Repeated rows: each row is
judged.  Empty table: empty result.  Other columns of the input are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import col, cut, small, words

#: Measures and their least spread: symbols and repeated words per thousand, repeated lines per thousand lines, hundredths of characters a word.
SPREAD = {"symbols": 10, "repeats": 100, "lines": 100, "length": 80}
WITH_WORD = r"[^\x20\x09-\x0D]"


def held(x: Column) -> Column:
    """The same value, computed in its own projection: later expressions, lambdas above all, must not repeat its work."""
    return F.when(F.monotonically_increasing_id() >= 0, x)


def bin_of(v: Column) -> Column:
    """Bin of a whole number from 0: exact below 32, then 16 bins for each doubling."""
    bits = F.length(F.bin(v))
    high = F.expr("shiftright(v, cast(length(bin(v)) - 5 as int))")
    return F.when(v < 32, v).otherwise(bits.cast("long") * 16 + high)


def bin_low(b: Column) -> Column:
    """The least number of a bin."""
    return F.when(b < 32, b).otherwise(F.expr("shiftleft(16L + b % 16, cast(b div 16 - 6 as int))"))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", carry: bool = False) -> DataFrame:
    """doc_id, lang, source and the counts of each text; with carry also row, all columns of docs."""
    text = F.coalesce(col(text_col), F.lit(""))
    row = ["row"] if carry else []
    split = docs.select(
        *[F.struct(*map(col, docs.columns)).alias("row") for _ in row],
        col(id_col).alias("doc_id"),
        col(lang_col).alias("lang"),
        col(source_col).alias("source"),
        held(words(text)).alias("w"),
        F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WITH_WORD)).alias("lines"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
    )
    windows = F.transform(
        F.slice(F.col("w"), 1, F.greatest(F.size("w") - 2, F.lit(0))),
        lambda x, i: F.struct(F.xxhash64(x, F.col("w")[i + 1], F.col("w")[i + 2]).alias("h"), i.alias("i")),
    )
    counted = split.select(
        *row, "doc_id", "lang", "source", "n_symbols",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        held(F.sort_array(windows)).alias("s"),
    )
    rest = F.greatest(F.size("s") - 1, F.lit(0))
    pairs = F.zip_with(F.slice(F.col("s"), 1, rest), F.slice(F.col("s"), 2, rest), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    twice = F.array_distinct(F.flatten(F.filter(pairs, lambda x: x.isNotNull())))
    return counted.select(
        *row, "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines",
        F.size(F.array_distinct(F.flatten(F.transform(twice, lambda p: F.array(p, p + 1, p + 2))))).cast("long").alias("n_repeat_words"),
    )


def _measures() -> dict[str, Column]:
    return {
        "symbols": F.expr("1000 * n_symbols div greatest(word_chars, 1)"),
        "repeats": F.expr("1000 * n_repeat_words div greatest(n_words, 1)"),
        "lines": F.expr("1000 * n_dup_lines div greatest(n_lines, 1)"),
        "length": F.expr("100 * word_chars div greatest(n_words, 1)"),
    }


def sketches(counts: DataFrame) -> DataFrame:
    """lang, source, measure, b (bin), c (documents)."""
    long = counts.where("not base_failed").select("lang", "source", F.explode(F.create_map(*[x for k, v in _measures().items() for x in (F.lit(k), v)])).alias("measure", "v"))
    return long.select("lang", "source", "measure", bin_of(F.col("v")).alias("b")).groupBy("lang", "source", "measure", "b").agg(F.count("*").alias("c"))


def fences(sketch: DataFrame, keys: list[str], reach: int) -> DataFrame:
    """keys, n and for each measure its upper (and, of the length, lower) fence."""
    merged = sketch.groupBy(*keys, "measure", "b").agg(F.sum("c").alias("c"))
    of = Window.partitionBy(*keys, "measure")
    ranked = merged.withColumn("upto", F.sum("c").over(of.orderBy("b"))).withColumn("n", F.sum("c").over(of)).withColumn("low", bin_low(F.col("b")))
    quart = ranked.groupBy(*keys, "measure").agg(
        F.max("n").alias("n"),
        F.min(F.when(F.col("upto") * 4 >= F.col("n"), F.col("low"))).alias("q1"),
        F.min(F.when(F.col("upto") * 4 >= F.col("n") * 3, F.col("low"))).alias("q3"),
    )
    spread = F.greatest(F.col("q3") - F.col("q1"), F.create_map(*[F.lit(x) for kv in SPREAD.items() for x in kv])[F.col("measure")].cast("long"))
    edge = quart.select(*keys, "n", "measure", (F.col("q3") + reach * spread).alias("hi"), (F.col("q1") - reach * spread).alias("lo"))
    return edge.groupBy(*keys).agg(
        F.max("n").alias("n"),
        *[F.max(F.when(F.col("measure") == k, F.col("hi"))).alias(f"hi_{k}") for k in SPREAD],
        F.max(F.when(F.col("measure") == "length", F.col("lo"))).alias("lo_length"),
    )


def failed(min_words: int, max_repeat_percent: int) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))


LIMITS = [f"hi_{k}" for k in SPREAD] + ["lo_length"]


def thresholds(counts: DataFrame, min_docs: int, reach: int) -> DataFrame:
    """g_lang, g_source and the limits of that group, its language or everything."""
    sketch = cut(sketches(counts))
    everything = fences(sketch.withColumn("all", F.lit(1)), ["all"], reach).select(*LIMITS).collect()
    overall = everything[0] if everything else dict.fromkeys(LIMITS, 0)
    fine, by_lang = fences(sketch, ["lang", "source"], reach), fences(sketch, ["lang"], reach)
    coarse = by_lang.select(F.col("lang").alias("l"), F.col("n").alias("m"), *[F.col(x).alias(f"lang_{x}") for x in LIMITS])
    both = fine.join(coarse, F.col("lang").eqNullSafe(F.col("l")), "left")
    chosen = [F.when(F.col("n") >= min_docs, F.col(x)).when(F.col("m") >= min_docs, F.col(f"lang_{x}")).otherwise(F.lit(overall[x])).alias(x) for x in LIMITS]
    return cut(both.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), *chosen))


def judged(counts: DataFrame, limits: DataFrame) -> DataFrame:
    """counts with the column kept."""
    joined = counts.join(small(limits), F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")), "left")
    m = _measures()
    within = m["length"] >= F.col("lo_length")
    for k in SPREAD:
        within = within & (m[k] <= F.col(f"hi_{k}"))
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce(within, F.lit(True)))


def quality_rules(docs: DataFrame, min_words: int = 50, max_repeat_percent: int = 50, min_docs: int = 200, reach: int = 4, **columns: str) -> DataFrame:
    """doc_id, the counts, base_failed and kept, one row for each row of docs."""
    counts = cut(measured(docs, **columns).withColumn("base_failed", failed(min_words, max_repeat_percent)))
    found = judged(counts, thresholds(counts, min_docs, reach))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep_good(docs: DataFrame, min_words: int = 50, max_repeat_percent: int = 50, min_docs: int = 200, reach: int = 4, **columns: str) -> DataFrame:
    """The rows of docs that quality_rules() keeps.  Rows are stored with their measures, so each text is measured once."""
    counts = cut(measured(docs, carry=True, **columns).withColumn("base_failed", failed(min_words, max_repeat_percent)))
    return judged(counts, thresholds(counts, min_docs, reach)).where("kept").select("row.*")
