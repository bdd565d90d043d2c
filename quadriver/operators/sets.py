"""Union, difference, intersection, and the merge in which the last write wins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import COLUMNS

PRIMARY = ["context", "item", "property", "time", "seqNr"]


def union(*frames: DataFrame) -> DataFrame:
    """All rows of all frames; a column that one lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def minus(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left rows that agree with no right row in the shared columns; all if they share none."""
    shared = [c for c in left.columns if c in right.columns]
    return left.join(right.select(*shared).distinct(), shared, "left_anti") if shared else left


def intersection(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.select(*right.columns).intersect(right)


def last_write_wins(df: DataFrame, version: str = "ingest_ts") -> DataFrame:
    """One row per primary key, that of the highest version.  An aggregate, so copies meet before the exchange."""
    rest = [c for c in df.columns if c not in PRIMARY]
    return df.groupBy(*PRIMARY).agg(F.max_by(F.struct(*rest), F.col(version)).alias("_row")).select(*PRIMARY, "_row.*")


def merged(*stores: DataFrame) -> DataFrame:
    """Several stores as one, the first named winning over later ones of the same key."""
    ranked = [s.select(*COLUMNS, F.lit(-i).alias("ingest_ts")) for i, s in enumerate(stores)]
    return last_write_wins(union(*ranked)).drop("ingest_ts")
