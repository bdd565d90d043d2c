"""A store of values as week-partitioned Parquet: append, last write wins, delete, compaction, retention, expiry.

Files lie under year=/week=, week counted in sevens of days from January 1st (UTC), sorted by series, newest first.  An
upsert is an append with a higher ingest_ts; reads merge by key before anything else.  Deletes are rows that hide: a
tombstone has v_type ``deleted``.

Every change is a transaction: its files are staged aside, a manifest of the files to move in and to remove is put in
place by one rename, and then carried out.  Whoever opens the store next finishes what a lost writer left; a staged
folder without a manifest is never read.  Versions are marker files, made without overwriting, so that no two writers
draw the same.  One compaction at a time.
"""

from __future__ import annotations

import json
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.fetch import _year_week, aggregate, aligned_week, in_range, newest_of_series, sample
from .operators.sets import last_write_wins
from .schema import COLUMNS, KEY, TUPLE, VALUES

#: Milliseconds of each unit of an expiry.
UNITS = {"ns": 1e-6, "us": 1e-3, "ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000}


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with rows in the shared checkpoint folder (spark.checkpoint.dir; only a local session may do without, and gets a temporary one)."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="quadriver-"))
    return df.checkpoint(eager=True)


def expiry_ms(item: str) -> float | None:
    """The expiry that an item's URI asks for (?ttl=5d), in milliseconds."""
    m = re.search(r"\?ttl=(\d+)(ns|us|ms|s|m|h|d)$", item)
    return int(m[1]) * UNITS[m[2]] if m else None


def expiry(item: Column) -> Column:
    """expiry_ms() as a column."""
    number, unit = (F.regexp_extract(item, r"\?ttl=(\d+)(ns|us|ms|s|m|h|d)$", i) for i in (1, 2))
    return number.try_cast("double") * F.create_map(*[F.lit(x) for k, v in UNITS.items() for x in (k, float(v))])[F.nullif(unit, F.lit(""))]


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def raw(self, strict: bool = False) -> DataFrame:
        """All versions, with ingest_ts, year and week; a missing or broken file is passed over, unless strict."""
        schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in TUPLE)}, ingest_ts bigint, year int, week int"
        self._recover()
        if not self._exists(self.path):
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.schema(schema).option("ignoreMissingFiles", not strict).option("ignoreCorruptFiles", not strict)
        return reader.parquet(self.path)

    def read(self, begin: int | None = None, end: int | None = None) -> DataFrame:
        """Current values in [begin, end], with year and week."""
        return last_write_wins(in_range(self.raw(), begin, end)).where("v_type <> 'deleted'").select(*COLUMNS, "year", "week")

    def _version(self) -> int:
        """A version that no other writer has."""
        fs, top = self._fs(f"{self.path}/_versions")
        if fs.exists(top):
            last = max((int(f.getPath().getName()) for f in fs.listStatus(top)), default=0)
        else:  # a store from before there were markers
            last = self.raw().agg(F.max("ingest_ts")).first()[0] or 0
            fs.mkdirs(top)
        while True:
            last += 1
            if fs.createNewFile(self._fs(f"{self.path}/_versions/{last}")[1]):
                for f in fs.listStatus(top):  # only the newest markers are needed
                    if int(f.getPath().getName()) < last - 100:
                        fs.delete(f.getPath(), False)
                return last

    def _write(self, rows: DataFrame, remove: list[str] = ()) -> None:
        """Add files of the rows, and remove others, as one transaction."""
        staged = f"{self.path}/_staged-{uuid.uuid4().hex}"
        stamped = rows.withColumn("year", F.year(F.timestamp_millis("time"))).withColumn("week", aligned_week(F.col("time")))
        order = ["year", "week", *KEY, F.col("time").desc(), F.col("seqNr").desc()]
        stamped.repartition("year", "week", F.pmod(F.hash("item"), F.lit(16))).sortWithinPartitions(*order).write.partitionBy("year", "week").parquet(staged)
        self._finish(self._commit(staged, remove))

    def _commit(self, staged: str, remove: list[str] = ()) -> str:
        """Put the manifest in place: from then on the change holds."""
        moves = [[f"{staged}/{part}/{name}", f"{self.path}/{part}/{name}"] for part, name in self._files(staged)]
        manifest = f"{self.path}/_tx-{uuid.uuid4().hex}"
        fs, new = self._fs(manifest + ".tmp")
        out = fs.create(new)
        out.write(bytearray(json.dumps({"staged": staged, "moves": moves, "remove": list(remove)}).encode()))
        out.close()
        if not fs.rename(new, self._fs(manifest + ".json")[1]):
            raise OSError(f"cannot commit {manifest}")
        return manifest + ".json"

    def _finish(self, manifest: str) -> None:
        """Carry a manifest out; doing so again, or from where another stopped, does no harm."""
        fs, where = self._fs(manifest)
        stream = fs.open(where)
        todo = json.loads(bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        stream.close()
        for old, new in todo["moves"]:
            if fs.exists(self._fs(old)[1]):
                fs.mkdirs(self._fs(new)[1].getParent())
                fs.rename(self._fs(old)[1], self._fs(new)[1])
        for gone in todo["remove"]:
            fs.delete(self._fs(gone)[1], True)
        fs.delete(self._fs(todo["staged"])[1], True)
        fs.delete(where, False)

    def _recover(self) -> None:
        fs, top = self._fs(self.path)
        for f in fs.listStatus(top) if fs.exists(top) else []:
            if re.fullmatch(r"_tx-\w+\.json", f.getPath().getName()):
                self._finish(f"{self.path}/{f.getPath().getName()}")

    def _files(self, path: str) -> list[tuple[str, str]]:
        """Partition (year=/week=) and name of each data file below a path."""
        found = []
        fs, top = self._fs(path)
        for y in fs.listStatus(top) if fs.exists(top) else []:
            if (year := y.getPath().getName()).startswith("year="):
                for w in fs.listStatus(y.getPath()):
                    if (week := w.getPath().getName()).startswith("week="):
                        found += [(f"{year}/{week}", name) for f in fs.listStatus(w.getPath()) if (name := f.getPath().getName()).endswith(".parquet")]
        return found

    def put(self, rows: DataFrame) -> None:
        """Add or replace values."""
        self._write(rows.select(*COLUMNS).withColumn("ingest_ts", F.lit(self._version()).cast("long")))

    def delete(self, item: str | None = None, property: str | None = None, context: str | None = None, begin: int | None = None, end: int | None = None, below: bool = False) -> int:
        """Hide the values that match all that is given; how many there were.  below: also those of items below the item."""
        gone = self.read(begin, end)
        for name, x in (("item", item), ("property", property), ("context", context)):
            if x is not None:
                gone = gone.where((F.col(name) == x) | F.col(name).startswith(x.rstrip("/") + "/") if below and name == "item" else F.col(name) == x)
        gone = checkpointed(gone)
        if n := gone.count():
            none = [F.lit("deleted").alias("v_type"), *[F.lit(None).cast(TUPLE[c].dataType).alias(c) for c in VALUES[1:]]]
            self._write(gone.select("context", "item", "property", "time", "seqNr", *none).withColumn("ingest_ts", F.lit(self._version()).cast("long")))
        return n

    def _fs(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _exists(self, path: str) -> bool:
        fs, where = self._fs(path)
        return fs.exists(where)

    def weeks(self) -> list[tuple[int, int, int]]:
        """year, week and number of data files of each partition, from the folder listing."""
        self._recover()
        counts: dict[tuple[int, int], int] = {}
        for part, _ in self._files(self.path):
            year, week = (int(x.partition("=")[2]) for x in part.split("/"))
            counts[year, week] = counts.get((year, week), 0) + 1
        return sorted((y, w, n) for (y, w), n in counts.items())

    def compact(self, least_files: int = 3) -> int:
        """Rewrite partitions of many files: one version of each value, no tombstones.  How many were rewritten.

        A file that cannot be read is an error here, as the files that were read go.
        """
        busy = [(y, w) for y, w, n in self.weeks() if n >= least_files]
        if busy:
            parts = {f"year={y}/week={w}" for y, w in busy}
            old = [f"{self.path}/{part}/{name}" for part, name in self._files(self.path) if part in parts]
            chosen = F.array(*[F.lit(y * 100 + w) for y, w in busy])
            rows = self.raw(strict=True).where(F.array_contains(chosen, F.col("year") * 100 + F.col("week")))
            self._write(last_write_wins(rows).where("v_type <> 'deleted'").select(*COLUMNS, "ingest_ts"), old)
        return len(busy)

    def _drop(self, year: int, week: int) -> None:
        fs, where = self._fs(f"{self.path}/year={year}/week={week}")
        fs.delete(where, True)

    def retain(self, now: int, period: int) -> int:
        """Drop the weeks that end before now - period (milliseconds).  How many were dropped."""
        limit = _year_week(now - period)
        old = [(y, w) for y, w, _ in self.weeks() if (y, w) < limit]
        for y, w in old:
            self._drop(y, w)
        return len(old)

    def expire(self, now: int) -> int:
        """Hide values older than their item's URI allows.  How many there were."""
        old = checkpointed(self.read().where(F.col("time") < F.lit(now) - expiry(F.col("item"))))
        if n := old.count():
            none = [F.lit("deleted").alias("v_type"), *[F.lit(None).cast(TUPLE[c].dataType).alias(c) for c in VALUES[1:]]]
            self._write(old.select("context", "item", "property", "time", "seqNr", *none).withColumn("ingest_ts", F.lit(self._version()).cast("long")))
        return n

    def archive_to(self, cold: Store, before: int) -> int:
        """Move values older than a time to another store; how many."""
        rows = checkpointed(self.read(end=before - 1).select(*COLUMNS))
        if n := rows.count():
            cold.put(rows)
            self.delete(end=before - 1)
        return n

    def copy_to(self, other: Store, item: str | None = None, property: str | None = None, begin: int | None = None, end: int | None = None, context: str | None = None, limit: int = 0, interval: int = 0, op: str | None = None) -> None:
        """Copy values, of all contexts unless one is named; limit, interval and op as in a fetch, for each series."""
        rows = self.read(begin, end)
        for name, x in (("item", None if item == "*" else item), ("property", property), ("context", context)):
            rows = rows if x is None else rows.where(F.col(name) == x)
        rows = aggregate(rows, op, interval, limit) if op else sample(rows, interval, limit) if interval > 0 else newest_of_series(rows, limit)
        other.put(rows)
