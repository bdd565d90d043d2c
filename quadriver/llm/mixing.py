"""Mix sources to target weights, to the exact word.

Sizes are summed by source; the budget (all words) is shared by weight, no source above ``max_epochs`` times its own
size, the excess shared again by weight.  Each document gets a hash-random key.  Within a source the keys are cut into
equal ranges, so that a source with a third of all rows is sorted by many tasks; the ranges' sums, added up in key
order, give each range its offset, and offset plus running sum is the document's place among the source's words.  Whole
epochs count for every document; in the last, broken epoch the budget cuts at the exact word.  Reruns agree: keys
depend on the id alone.

Sources are ranked by ranges too, and ranges are summed in two levels, so neither many sources nor many ranges meet in one
task.

Null text: size 0, never taken.  Null source: a source of its own, last in order.  Null id: the key of the text
"null".  Ids of any type that has an order.  Repeated rows: each row is a document.  Ties of keys: by id, then size, then
the text's hash.  No words at all: all targets are 0.
Other columns of the input are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACES, col, cut, id_key, small, words

#: Rows of a source in one key range, on average; ranges that are summed in one task.
RANGE_ROWS, RANGES = 1_000, 1_000


def ranked(by: DataFrame, name: str) -> DataFrame:
    """rank (from 1) of each row in the order of a column of unique values, null last, by ranges of them."""
    apart = cut(by.repartitionByRange(F.col(name).asc_nulls_last()).withColumn("part", F.spark_partition_id()))
    sizes = sorted((r["part"], r["count"]) for r in apart.groupBy("part").count().collect())  # one row a partition
    before, starts = 0, []
    for part, n in sizes:
        starts += [F.lit(part), F.lit(before)]
        before += n
    start = F.element_at(F.create_map(*starts), F.col("part")) if starts else F.lit(0)
    within = F.row_number().over(Window.partitionBy("part").orderBy(F.col(name).asc_nulls_last()))
    return apart.withColumn("rank", start + within).drop("part")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """source, source_size, source_rows, target, from rows of (source, size)."""
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    # a rank over the sources, not over the rows; sources go by code point, null last
    weight = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("rank") - 1) % len(weights) + 1).cast("long")
    by = cut(ranked(by, "source").withColumn("weight", weight))
    total = by.agg(F.sum("source_size")).first()[0] or 0
    # capped sources only grow in number, so this ends after a few rounds
    level, capped = (0, 1), -1
    while True:
        wide = lambda x: x.cast("decimal(19,0)")
        full = wide(max_epochs * F.col("source_size")) * wide(F.lit(level[1])) <= wide(F.col("weight")) * wide(F.lit(level[0])) if capped >= 0 else F.lit(False)
        n, taken, open_weight = by.agg(F.count(F.when(full, 1)), F.sum(F.when(full, max_epochs * F.col("source_size"))), F.sum(F.when(~full, F.col("weight")))).first()
        if n == capped or not open_weight:
            break
        capped, level = n, (total - (taken or 0), open_weight)
    share = (F.col("weight") * F.lit(level[0])).cast("double") / F.lit(float(level[1]))
    ceiling = (max_epochs * F.col("source_size")).cast("double")
    target = F.when(F.lit(open_weight is None), ceiling).otherwise(F.least(ceiling, share))
    return by.select("source", "source_size", "source_rows", target.alias("target"))


def placed(docs: DataFrame, seed: str, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """of (source), doc_id, key, size, t (the text's hash), source_size, target, whole (epochs) and part (words of the broken epoch)."""
    size = F.size(words(col(text_col))).cast("long")
    sized = cut(docs.select(col(id_col).alias("doc_id"), col(source_col).alias("source"), size.alias("size"), F.xxhash64(col(text_col)).alias("t")).withColumn("key", id_key(F.col("doc_id"), seed)))
    targets = cut(source_targets(sized, weights, max_epochs))
    targets = targets.select(F.col("source").alias("of"), "source_size", "target", F.ceil(F.col("source_rows") / RANGE_ROWS).cast("long").alias("ranges"))
    rows = sized.join(small(targets), F.col("source").eqNullSafe(F.col("of")))
    rows = rows.withColumn("range", F.expr("shiftright(key, 30) * ranges div 1073741824"))
    places = ["of", "range"]
    sums = rows.groupBy(*places).agg(F.sum("size").alias("range_size"))
    sums = cut(sums.withColumn("span", F.expr(f"range div {RANGES}")))
    before = lambda keys, order: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    spans = sums.groupBy("of", "span").agg(F.sum("range_size").alias("span_size"))
    spans = cut(spans.select(F.col("of").alias("p"), F.col("span").alias("s"), F.coalesce(F.sum("span_size").over(before(["of"], "span")), F.lit(0)).alias("start")))
    sums = sums.withColumn("within", F.coalesce(F.sum("range_size").over(before(["of", "span"], "range")), F.lit(0)))
    sums = sums.join(small(spans), F.col("of").eqNullSafe(F.col("p")) & (F.col("span") == F.col("s")))
    sums = cut(sums.select(F.col("of").alias("o"), F.col("range").alias("r"), (F.col("start") + F.col("within")).alias("offset")))
    rows = rows.join(small(sums), F.col("of").eqNullSafe(F.col("o")) & (F.col("range") == F.col("r")))
    upto = Window.partitionBy(*places).orderBy("key", "doc_id", "size", "t").rowsBetween(Window.unboundedPreceding, -1)
    place = F.col("offset") + F.coalesce(F.sum("size").over(upto), F.lit(0))
    budget = F.round("target").cast("long")
    whole = F.least(F.lit(max_epochs), F.coalesce(F.expr("try_divide(budget, source_size)").cast("long"), F.lit(0)))
    rows = rows.withColumn("place", place).withColumn("budget", budget).withColumn("whole", whole)
    rest = F.col("budget") - F.col("whole") * F.col("source_size") - F.col("place")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest))
    return rows.select("of", "doc_id", "key", "size", "t", "source_size", "target", "whole", part.alias("part"))


def mix(docs: DataFrame, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """doc_id, size, source_size, target, taken: one row for each row of docs."""
    rows = placed(docs, seed, id_col, text_col, source_col, weights, max_epochs)
    return rows.select("doc_id", "size", "source_size", "target", (F.col("whole") * F.col("size") + F.col("part")).cast("long").alias("taken"))


def first_words(text: Column, n: Column) -> Column:
    """The text up to its n-th word, white space between them as it is."""
    parts = F.split(F.regexp_replace(text, "^" + SPACES, ""), r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    return F.regexp_replace(F.array_join(F.slice(parts, F.lit(1), n.cast("int")), ""), SPACES + "$", "")


def mixed_rows(docs: DataFrame, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """The rows of the mix: each row of docs as often as it is taken, the last one of a source cut at the exact word.

    Per source the last row taken in the broken epoch tells what of the others is taken, so texts are not moved.  Rows
    that agree with the last one in id and text are told apart by a hash of all columns; copies of a row meet before they
    are numbered.
    """
    rows = cut(placed(docs, seed, id_col, text_col, source_col, weights, max_epochs))
    ident = lambda c: F.struct(c.isNotNull().alias("is"), c.alias("id"))
    last = F.struct("key", ident(F.col("doc_id")).alias("id"), "size", "t")
    ends = rows.groupBy("of").agg(F.max("whole").alias("whole"), F.max(F.when(F.col("part") > 0, last)).alias("last"))
    ends = cut(ends)
    # of the rows equal to the last one: how many are taken whole, and the words of the one that is cut
    twins = rows.drop("whole").join(small(ends.withColumnRenamed("of", "o")), F.col("of").eqNullSafe(F.col("o")) & (last == F.col("last")))
    cuts = twins.groupBy("of", "whole", "last").agg(F.count("*").alias("twins"), F.count(F.when(F.col("part") == F.col("size"), 1)).alias("full"), F.max(F.when(F.col("part") < F.col("size"), F.col("part"))).alias("rest"))
    none = ends.where("last is null").select("of", "whole", "last", F.lit(0).cast("long").alias("twins"), F.lit(0).cast("long").alias("full"), F.lit(0).cast("long").alias("rest"))
    cuts = cut(cuts.withColumn("rest", F.coalesce("rest", F.lit(0).cast("long"))).unionByName(none))
    size, key = F.size(words(col(text_col))).cast("long"), id_key(col(id_col), seed)
    me = F.struct(key.alias("key"), ident(col(id_col)).alias("id"), size.alias("size"), F.xxhash64(col(text_col)).alias("t"))
    own = docs.select(F.struct(*map(col, docs.columns)).alias("row"), col(source_col).alias("source"), me.alias("me"))
    joined = own.join(small(cuts), F.col("source").eqNullSafe(F.col("of")))
    text = F.col("row").getField(text_col)

    def taken(joined: DataFrame, part: Column) -> DataFrame:
        full = (F.col("whole") + F.when(part == F.col("me.size"), 1).otherwise(0)).cast("int")
        cut_off = F.when((part > 0) & (part < F.col("me.size")), F.array(first_words(text, part))).otherwise(F.array().cast("array<string>"))
        texts = F.when(F.col("me.size") > 0, F.concat(F.array_repeat(text, full), cut_off)).otherwise(F.array().cast("array<string>"))
        out = joined.select("row", F.explode(texts).alias("taken_text"))
        return out.select(*[F.col("taken_text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])

    number = lambda n: F.when(n <= F.col("full"), F.col("me.size")).when(n == F.col("full") + 1, F.col("rest")).otherwise(0)
    several = (F.col("twins") > 1) & F.coalesce(F.col("me") == F.col("last"), F.lit(False))
    part = F.when(F.col("last").isNull() | (F.col("me") > F.col("last")), 0).when(F.col("me") == F.col("last"), number(F.lit(1))).otherwise(F.col("me.size"))
    out = taken(joined.where(~several), part)
    if cuts.where("twins > 1").isEmpty():
        return out
    hashed = F.xxhash64(F.lit(0), *[F.col("row").getField(c) for c, kind in docs.dtypes if "map<" not in kind])
    alike = joined.where(several).groupBy("source", hashed.alias("h")).agg(F.any_value("row").alias("row"), F.any_value("me").alias("me"), F.count("*").alias("copies"), *[F.any_value(c).alias(c) for c in ("whole", "full", "rest")])
    before = F.coalesce(F.sum("copies").over(Window.partitionBy("source").orderBy("h").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    each = alike.withColumn("before", before).withColumn("n", F.explode(F.expr("sequence(before + 1, before + copies)")))
    return out.unionByName(taken(each, number(F.col("n"))))
