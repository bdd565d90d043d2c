"""What there is: properties, items below an item, the hierarchy in URIs, and paths over triples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import DEFAULT_CONTEXT

CONTAINS = "urn:contains"


def properties(df: DataFrame, item: str | None = None, context: str | None = None) -> DataFrame:
    df = df.where(F.col("context") == (context or DEFAULT_CONTEXT))
    return (df if item is None else df.where(F.col("item") == item)).select("property").distinct()


def descendants(df: DataFrame, prefix: str, context: str | None = None, limit: int = 0, strict: bool = False) -> DataFrame:
    """Items that begin with the prefix and have a value in the context, in byte order; strict: only below it."""
    prefix = prefix.rstrip("/") + "/" if strict else prefix
    found = df.where((F.col("context") == (context or DEFAULT_CONTEXT)) & F.col("item").startswith(prefix)).select("item").distinct()
    return found.orderBy("item").limit(limit) if limit > 0 else found


def path_steps(item: Column) -> Column:
    """The segments of a URI after its scheme and authority."""
    return F.filter(F.split(F.regexp_replace(item, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?/?", ""), "/"), lambda x: x != "")


def hierarchy_edges(items: DataFrame) -> DataFrame:
    """parent, child for each step of each item's path, up to its first segment."""
    head = F.regexp_extract("item", r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?/?", 0)
    paths = items.select("item").distinct().select(head.alias("h"), path_steps(F.col("item")).alias("s"))
    at = F.explode(F.when(F.size("s") > 1, F.sequence(F.lit(2), F.size("s"))).otherwise(F.array().cast("array<int>"))).alias("n")
    upto = lambda n: F.concat("h", F.array_join(F.slice("s", F.lit(1), n), "/"))
    return paths.select("h", "s", at).select(upto(F.col("n") - 1).alias("parent"), upto(F.col("n")).alias("child")).distinct()


def closure(edges: DataFrame, source: str = "s", target: str = "o", zero: bool = False, most_rounds: int = 200) -> DataFrame:
    """Pairs joined by one or more edges; zero: also each node with itself.

    Paths double in length every round, and only the pairs that the last round found are extended: a shortest path of
    more than n and at most 2 n edges begins with one of n edges, which was new when paths of n edges were found.
    """
    from ..store import checkpointed

    reach = new = checkpointed(edges.select(F.col(source).alias("s"), F.col(target).alias("o")).distinct())
    for _ in range(most_rounds):
        longer = new.alias("a").join(reach.alias("b"), F.col("a.o") == F.col("b.s")).select("a.s", "b.o").distinct()
        new = checkpointed(longer.join(reach, ["s", "o"], "left_anti"))
        if new.isEmpty():
            break
        reach = reach.union(new)
    else:
        raise ValueError(f"the closure is not complete after {most_rounds} rounds")
    if zero:
        nodes = edges.select(F.explode(F.array(source, target)).alias("s")).distinct()
        reach = reach.union(nodes.select("s", F.col("s").alias("o"))).distinct()
    return reach


def path(triples: DataFrame, *predicates: str) -> DataFrame:
    """s, o of a sequence of predicates."""
    steps = [triples.where(F.col("p") == p).select("s", "o") for p in predicates]
    out = steps[0]
    for step in steps[1:]:
        out = out.alias("a").join(step.alias("b"), F.col("a.o") == F.col("b.s")).select("a.s", "b.o")
    return out
