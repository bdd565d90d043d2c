"""Near-duplicate documents by a chosen-path set similarity join.

A document's set holds the hashes of its distinct five-word shingles; equal sets stand together from the start.  Every
set has a signature of minwise tokens.  Trees: at a tree's root each set follows one token of its signature; a node with
more than ``leaf`` sets sends each on to children by further tokens, chosen by the node, until nodes are small or
``depth`` is reached.  Small nodes are compared exhaustively by signature.  So are large ones whose members are alike
(copies of each other, which no token parts), but in blocks: first a few leaders meet every block; the members that the
leaders join into one component need no comparison among themselves; only the rest meets all blocks.  A task writes a
spanning forest of what it found, never all pairs.  With similarity s a tree finds a pair with probability of about s;
``trees`` independent ones leave 1 - (1 - s) ** trees.

The components of these likely pairs are the classes to confirm: their full sets meet in the same way, pairs already
joined are skipped, and the others' intersections are counted exactly (sets that share none of the tokens that a pair at
the similarity must share are passed over without loss).  Components of the confirmed links are the result.  Components
are found by contraction: every class joins its neighbour of least random rank, round after round.

Copies of a set that hold more than a 2000th of all rows (so fewer than 2000 sets) get their class by broadcast, others
by shuffle; the light joins by node and component leave hot keys to adaptive execution.  A group of m sets of which r are not joined by leaders takes m + r * m / block rows.

Null or wordless text: an empty set, linked with nothing.  Fewer than five words: the whole sequence is the one shingle.
Ids of any type that has an order.  Rows without an id are kept and linked with nothing.  Rows that repeat an id each
have their own set and its class; an id does not link its rows.  Very long texts: a set must fit into a task.  Ties: of
equal rows any survives, of rows equal in id and text the one whose other columns hash lowest.  Empty table: empty
result.  Other columns of the input are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, cut, joined_by, tidy

#: Tokens of a signature; of pairs just at the similarity at most this share may agree in too few of them to be likely.
TOKENS, MISSED = 32, 4e-6
#: Members of a large group, on average, that meet all its blocks first.
LEADERS = 32
#: A large node is compared in blocks, not branched, if two of its members share a token with this chance.
COHERENT = 0.4
#: Words that are hashed at once.
WORDS = 1 << 18
ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingles(text: bytes | None, size: int) -> np.ndarray:
    """The sorted hashes of the distinct shingles; bytes split at just the word rule's white space, and lower only A-Z."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashed = np.concatenate([pd.util.hash_array(np.array(words[i : i + WORDS], object), categorize=False) for i in range(0, len(words), WORDS)])
    n = max(1, len(words) - size + 1)
    total = np.full(n, np.uint64(min(len(words), size)))
    for k in range(min(size, len(words))):
        total = mixed(total * ODD + hashed[k : k + n])
    return np.unique(total)


def hashes(items: np.ndarray) -> tuple[int, int]:
    """Two hashes of a set, 0 for the empty one."""
    return tuple(int(x.sum(dtype=np.uint64).view(np.int64)) for x in (mixed(items + ODD), mixed(items ^ ODD) * ODD))


_ROUNDS = [np.uint64((2 * k + 1) * 0xC2B2AE3D27D4EB4F % 2**64) for k in range(TOKENS)]


def signature(items: np.ndarray) -> np.ndarray:
    """The low half of each minwise token."""
    out = np.empty(TOKENS, np.uint32)
    for k, odd in enumerate(_ROUNDS):
        x = items * odd
        x ^= x >> np.uint64(32)
        out[k] = (x * ODD).min() >> np.uint64(32)
    return out


def sets(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """doc_id, t (a hash of the text), n, a, b (a hash of the set) and sig (its signature), one row for each row of docs."""
    kind = "struct<n:int,a:bigint,b:bigint,sig:binary>"

    @F.arrow_udf(kind)
    def summed(column: pa.Array) -> pa.Array:
        tidy()
        n, a, b, sig = [], [], [], []
        for x in column:
            s = shingles(x.as_py(), size)
            n.append(len(s))
            for out, h in zip((a, b), hashes(s), strict=True):
                out.append(h)
            sig.append(signature(s).tobytes() if len(s) else None)
        return pa.StructArray.from_arrays([pa.array(n, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sig, pa.binary())], ["n", "a", "b", "sig"])

    found = docs.select(col(id_col).alias("doc_id"), F.xxhash64(col(text_col)).alias("t"), summed(col(text_col).cast("binary")).alias("s"))
    return found.select("doc_id", "t", "s.n", "s.a", "s.b", "s.sig")


class Joined:
    """Components of the members of one group; each is named by its first member."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def join(self, members: np.ndarray) -> None:
        if len(members) > 1 and len(names := np.unique(self.of[members])) > 1:
            self.of[np.isin(self.of, names)] = names[0]

    def links(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each member of a component and its first."""
        at = np.flatnonzero(self.of != np.arange(len(self.of)))
        return ids[at], ids[self.of[at]]


@lru_cache
def agreeing(percent: int) -> int:
    """How many tokens must agree for a pair to be likely: at 85 percent 17, at 80 percent 14."""
    p, missed = percent / 100, 0.0
    for k in range(TOKENS):
        missed += comb(TOKENS, k) * p**k * (1 - p) ** (TOKENS - k)
        if missed > MISSED:
            return k
    return TOKENS


class Signatures:
    """Members of a group by signature: linked if enough tokens agree and the sizes allow the similarity."""

    AT_ONCE = 1 << 30

    def __init__(self, t: pa.Table, percent: int):
        self.sizes, self.percent, self.agreeing = t.column("n").to_numpy().astype(np.int64), percent, agreeing(percent)
        self.sigs = np.frombuffer(b"".join(t.column("data").to_pylist()), np.uint32).reshape(-1, TOKENS)

    def candidates(self, i: int, among: np.ndarray) -> np.ndarray:
        """Those of among that may be linked with member i."""
        small, large = np.minimum(self.sizes[among], self.sizes[i]), np.maximum(self.sizes[among], self.sizes[i])
        among = among[100 * small >= self.percent * large]
        return among[(self.sigs[among] == self.sigs[i]).sum(axis=1) >= self.agreeing]

    def linked(self, i: int, among: np.ndarray) -> np.ndarray:
        return np.ones(len(among), bool)


class Sets:
    """Members of a group by full set.

    In the common order of hashes, two sets that reach the similarity share one of the first n - ceil(n * percent / 100)
    + 1 items of each; only such pairs are counted.
    """

    AT_ONCE = 64

    def __init__(self, t: pa.Table, percent: int):
        self.percent = percent
        self.held = [np.frombuffer(x, np.uint64) for x in t.column("data").to_pylist()]
        self.sizes = np.array([len(x) for x in self.held], np.int64)
        first = [x[: len(x) + (-percent * len(x) // 100) + 1] for x in self.held]
        items, owner = np.concatenate(first), np.repeat(np.arange(len(first)), [len(x) for x in first])
        order = np.argsort(items, kind="stable")
        self.first, self.items, self.owner = first, items[order], owner[order]

    def candidates(self, i: int, among: np.ndarray) -> np.ndarray:
        begin, end = (np.searchsorted(self.items, self.first[i], side) for side in ("left", "right"))
        meets = np.zeros(len(self.held), bool)
        for a, b in zip(begin, end, strict=True):
            meets[self.owner[a:b]] = True
        among = among[meets[among]]
        return among[100 * np.minimum(self.sizes[among], self.sizes[i]) >= self.percent * np.maximum(self.sizes[among], self.sizes[i])]

    def linked(self, i: int, among: np.ndarray) -> np.ndarray:
        items = np.concatenate([self.held[j] for j in among])
        at = np.minimum(np.searchsorted(self.held[i], items), len(self.held[i]) - 1)
        starts = np.cumsum([0, *self.sizes[among[:-1]]])
        common = np.add.reduceat(self.held[i][at] == items, starts, dtype=np.int64)
        return 100 * common >= self.percent * (self.sizes[i] + self.sizes[among] - common)


def meet(of: Signatures | Sets, joined: Joined, i: int, among: np.ndarray) -> None:
    """Join member i with those that it is linked with; pairs that are joined already are skipped."""
    among = of.candidates(i, among[joined.of[among] != joined.of[i]])
    while len(among := among[joined.of[among] != joined.of[i]]):
        now, among = among[: of.AT_ONCE], among[of.AT_ONCE :]
        joined.join(np.append(now[of.linked(i, now)], i))


def by_group(frames: Iterator[pa.RecordBatch], group: list[str]) -> Iterator[pa.Table]:
    """The consecutive rows that agree in the group's columns."""
    tidy()
    held: list[pa.RecordBatch] = []
    last = None
    for frame in frames:
        if not len(frame):
            continue
        keys = np.stack([frame.column(frame.schema.get_field_index(g)).to_numpy(zero_copy_only=False) for g in group])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), len(frame)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if held and tuple(keys[:, a]) != last:
                yield pa.Table.from_batches(held)
                held = []
            last = tuple(keys[:, a])
            held.append(frame.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def found_by(kind: type, percent: int, group: list[str], rows: DataFrame, run) -> DataFrame:
    """u, v: a forest of the links that run(members, joined, table) makes within each group."""

    def task(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_group(frames, group):
            joined = Joined(len(t))
            run(kind(t, percent), joined, t)
            ids = t.column("rep").to_numpy()
            u, v = joined.links(ids)
            if (apart := u != v).any():
                yield pa.RecordBatch.from_arrays([pa.array(u[apart], pa.int64()), pa.array(v[apart], pa.int64())], ["u", "v"])

    return rows.mapInArrow(task, "u long, v long")


def sorted_groups(rows: DataFrame, group: list[str], *within) -> DataFrame:
    return rows.repartition(*group).sortWithinPartitions(*group, *within)


def whole(rows: DataFrame, kind: type, percent: int, group: str) -> DataFrame:
    """u, v: links within groups that one task compares exhaustively."""

    def run(of: Signatures | Sets, joined: Joined, t: pa.Table) -> None:
        for i in range(len(t) - 1):
            meet(of, joined, i, np.arange(i + 1, len(t)))

    return found_by(kind, percent, [group], sorted_groups(rows, [group], "rep"), run)


def in_blocks(rows: DataFrame, kind: type, percent: int, group: str, block: int, block_items: int) -> list[DataFrame]:
    """u, v: links within large groups (group, rep, n, data, members, items of the group), in blocks of bounded size."""
    number = lambda members, items: F.ceil(F.greatest(F.col(members) / block, F.col(items) / block_items)).cast("long")
    deal = lambda count: F.pmod(F.xxhash64("rep"), F.col(count))
    every = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))
    rows = rows.withColumn("blocks", number("members", "items"))
    leaders = F.least(F.lit(float(LEADERS)), F.greatest(F.lit(4.0), F.lit(float(block_items)) * F.col("members") / F.col("items")))
    leads = rows.where(F.pmod(F.xxhash64(F.lit("leader"), "rep"), F.col("members")) < leaders)
    first = rows.select(group, "rep", "n", "data", deal("blocks").alias("block"), F.lit(0).alias("role"))
    first = first.unionByName(leads.select(group, "rep", "n", "data", every("blocks").alias("block"), F.lit(1).alias("role")))
    keys = [group, "block"]

    def lead(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_group(frames, keys):
            of, joined, ids = kind(t, percent), Joined(len(t)), t.column("rep").to_numpy()
            leading = int(t.column("role").to_numpy().sum())
            for i in range(leading):
                meet(of, joined, i, np.arange(i + 1, len(t)))
            led = joined.of < leading
            yield pa.RecordBatch.from_arrays([pa.array(t.column(group).to_numpy()), pa.array(ids), pa.array(ids[joined.of], mask=~led), pa.array(np.arange(len(t)) >= leading)], [group, "u", "v", "member"])

    met = cut(sorted_groups(first, keys, F.desc("role"), "rep").mapInArrow(lead, f"`{group}` long, u long, v long, member boolean"))
    members = met.where("member")
    size = rows.select(group, "members").distinct()
    most = members.where("v is not null").groupBy(group, "v").agg(F.count("*").alias("c")).groupBy(group).agg(F.max_by("v", F.struct("c", "v")).alias("settled"))
    most = cut(size.join(most, group, "left").select(F.col(group).alias("_g"), "members", "settled"))
    members = joined_by(members.withColumnRenamed(group, "_g"), most, ["_g"], "members")
    rest = cut(members.where("v is null or v <> settled").select("_g", F.col("u").alias("rep"), F.lit(True).alias("apart")))
    left = rest.groupBy("_g").agg(F.count("*").alias("rest"))
    out = [met.where("v is not null and u <> v").select("u", "v")]
    if rest.isEmpty():
        return out
    left = cut(left.join(size.withColumnRenamed(group, "_g"), "_g"))
    rows = joined_by(rows.drop("members").withColumn("_g", F.col(group)), left, ["_g"], "members").join(rest, ["_g", "rep"], "left")
    # a group's sets are of about one size, so its rest has its share of the items
    rows = cut(rows.withColumn("rests", F.ceil(F.col("blocks") * F.col("rest") / F.col("members")).cast("long")).select(group, "rep", "n", "data", "blocks", "rests", F.coalesce("apart", F.lit(False)).alias("apart")))
    second = rows.select(group, "rep", "n", "data", "apart", deal("blocks").alias("block"), every("rests").alias("other"), F.lit(0).alias("role"))
    asked = rows.where("apart").select(group, "rep", "n", "data", "apart", deal("rests").alias("other"), "blocks").select(group, "rep", "n", "data", "apart", every("blocks").alias("block"), "other", F.lit(1).alias("role"))

    def ask(of: Signatures | Sets, joined: Joined, t: pa.Table) -> None:
        asking = int(t.column("role").to_numpy().sum())
        joined.join(np.flatnonzero(~t.column("apart").to_numpy(zero_copy_only=False)))
        for i in range(asking):
            meet(of, joined, i, np.arange(asking, len(t)))

    keys = [group, "block", "other"]
    out.append(found_by(kind, percent, keys, sorted_groups(second.unionByName(asked), keys, F.desc("role"), "rep"), ask))
    return out


def token(sig: Column, k: Column) -> Column:
    """The k-th token of a signature, as four bytes."""
    return F.substring(sig, k * 4 + 1, F.lit(4)) if isinstance(k, Column) else F.substring(sig, k * 4 + 1, 4)


def chosen_paths(reps: DataFrame, trees: int, leaf: int, depth: int, block: int, percent: int) -> DataFrame:
    """u, v: likely pairs of reps (rep, n, sig), as forests."""
    roots = [F.xxhash64(F.lit(t), token(F.col("sig"), F.lit(t % TOKENS))) for t in range(trees)]
    level = reps.select("rep", "n", F.col("sig").alias("data"), F.explode(F.array(*roots)).alias("node"))
    found = []
    for d in range(depth + 1):
        counts = level.groupBy("node").agg(F.count("*").alias("members")).where(F.col("members") > 1)
        level = cut(level.join(counts, "node"))
        few = level.where(F.col("members") <= leaf)
        level = level.where(F.col("members") > leaf)
        if level.isEmpty():
            found.append(whole(few, Signatures, percent, "node"))
            break
        picks = [F.pmod(F.xxhash64("node", F.lit(d), F.lit(b)), F.lit(TOKENS)).cast("int") for b in range(2)]
        children = F.array(*[F.xxhash64("node", F.lit(b), token(F.col("data"), p)) for b, p in enumerate(picks)])
        # the chance that two members share a child: where it is high, further levels would only repeat the node
        sizes = level.select("node", "members", F.explode(children).alias("child")).groupBy("node", "members", "child").agg(F.count("*").alias("c"))
        alike = F.sum(F.col("c") * F.col("c")) / (len(picks) * F.max(F.col("members") * F.col("members")))
        stays = F.coalesce((alike >= COHERENT) | F.lit(d == depth), F.lit(True))
        nodes = sizes.groupBy("node").agg(stays.alias("stays"))
        level = cut(level.join(nodes, "node"))
        found.append(whole(few.unionByName(level.where(F.col("stays") & (F.col("members") <= block)).select(*few.columns)), Signatures, percent, "node"))
        large = level.where(F.col("stays") & (F.col("members") > block)).withColumn("items", F.col("members"))
        if not large.isEmpty():
            found += in_blocks(large, Signatures, percent, "node", block, block)
        level = level.where(~F.col("stays")).select("rep", "n", "data", F.explode(children).alias("node"))
    return reduce(DataFrame.unionByName, found).distinct()


def components(links: DataFrame) -> DataFrame:
    """rep, comp (the smallest rep it is connected to, itself included) of each end of a link.

    A hub has many rows of one key here; the joins' other sides are unique by it, so adaptive execution splits them.
    """
    ranked = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))
    edges = cut(links.select(ranked("u").alias("u"), ranked("v").alias("v")))
    label = edges.select(F.explode(F.array("u", "v")).alias("x")).distinct().select("x", F.col("x").alias("to"))
    while not edges.isEmpty():
        both = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.col("v").alias("y")), F.struct(F.col("v").alias("x"), F.col("u").alias("y")))).alias("e")).select("e.*")
        parent = cut(both.groupBy("x").agg(F.min("y").alias("y")).select(F.col("x").alias("c"), F.least("x", "y").alias("p")))
        up = lambda df, c: df.join(parent, F.col(c) == F.col("c"), "left").withColumn(c, F.coalesce("p", c)).drop("c", "p")
        label = up(label, "to")
        edges = cut(up(up(edges, "u"), "v").where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    least = label.groupBy("to").agg(F.min("x.id").alias("comp"))
    return label.join(least, "to").select(F.col("x.id").alias("rep"), "comp")


#: Bits of the filter that spares texts outside the likely classes the exchange; its size does not grow.
BITS = 1 << 25


def might_be(docs: DataFrame, members: DataFrame, id_col: str) -> DataFrame:
    """The rows of docs whose id may be a member's (first_id): all of those, and a few others (more, the more members there are)."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(BITS))
    at = members.select((place(F.col("first_id")) + 1).alias("x"))
    maps = at.groupBy(F.bitmap_bucket_number("x").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("map")).collect()
    bits = np.zeros(BITS, bool)
    for r in maps:
        found = np.unpackbits(np.frombuffer(r["map"], np.uint8), bitorder="little")
        start = (r["bucket"] - 1) * 32768
        bits[start : start + len(found)] = found[: BITS - start]
    sent = docs.sparkSession.sparkContext.broadcast(np.packbits(bits))

    @F.arrow_udf("boolean")
    def test(places: pa.Array) -> pa.Array:
        tidy()
        p = places.to_numpy(zero_copy_only=False).astype(np.int64)
        return pa.array((sent.value[p >> 3] >> (7 - (p & 7)) & 1).astype(bool))

    return docs.where(col(id_col).isNotNull()).where(test(place(col(id_col))))


def confirm(docs: DataFrame, members: DataFrame, id_col: str, text_col: str, size: int, percent: int, block: int, block_items: int) -> DataFrame:
    """u, v: links of members (rep, comp, n, a, b, first_id, first_t) whose full sets reach the similarity, as forests."""
    total = members.groupBy("comp").agg(F.count("*").alias("members"), F.sum("n").alias("items"))
    members = members.join(total, "comp")
    texts = might_be(docs, members, id_col).select(col(id_col).alias("id"), F.xxhash64(col(text_col)).alias("t"), col(text_col).cast("binary").alias("text"))
    # copies of a row meet before the exchange
    texts = texts.groupBy("id", "t").agg(F.any_value("text").alias("text"))

    @F.arrow_udf("binary")
    def full(column: pa.Array) -> pa.Array:
        tidy()
        return pa.array([shingles(x.as_py(), size).tobytes() for x in column], pa.binary())

    held = members.join(texts, (F.col("first_id") == F.col("id")) & (F.col("first_t") == F.col("t")))
    held = cut(held.select("rep", "comp", "n", "members", "items", full("text").alias("data")))
    one = (F.col("members") <= block) & (F.col("items") <= block_items)
    found = whole(held.where(one), Sets, percent, "comp")
    large = held.where(~one)
    return reduce(DataFrame.unionByName, [found] if large.isEmpty() else [found, *in_blocks(large, Sets, percent, "comp", block, block_items)])


def classed(docs: DataFrame, percent: int, size: int, trees: int, leaf: int, depth: int, block: int, block_items: int, node_block: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, t, n_shingles, component_id, kept, and stays (kept, and of texts that share this id the one with the least hash)."""
    rows = cut(sets(docs, id_col, text_col, size))
    named = rows.where("doc_id is not null and n > 0")
    first = F.min(F.struct("doc_id", "t"))
    reps = named.groupBy("n", "a", "b").agg(first.alias("f"), F.first("sig").alias("sig"), F.count("*").alias("copies"))
    reps = cut(reps.select("n", "a", "b", F.col("f.doc_id").alias("first_id"), F.col("f.t").alias("first_t"), "sig", "copies", F.monotonically_increasing_id().alias("rep")))
    found = components(chosen_paths(reps, trees, leaf, depth, node_block, percent))
    members = cut(reps.select("rep", "n", "first_id", "first_t").join(found, "rep"))
    links = cut(confirm(docs, members, id_col, text_col, size, percent, block, block_items).distinct())
    confirmed = cut(reps.select("rep", "n", "a", "b", "first_id", "first_t", "copies").join(components(links), "rep"))
    least = confirmed.groupBy("comp").agg(F.min(F.struct("first_id", "first_t")).alias("least"))
    linked = confirmed.join(least, "comp").select("n", "a", "b", "least.*", "copies")
    alone = reps.join(confirmed.select("rep"), "rep", "left_anti").where("copies > 1").select("n", "a", "b", "first_id", "first_t", "copies")
    classes = cut(linked.toDF(*alone.columns).unionByName(alone))
    with_set = (F.col("doc_id").isNotNull()) & (F.col("n") > 0)
    none = rows.where(~with_set).select("doc_id", "t", "n", F.col("doc_id").alias("first_id"), F.lit(None).cast("long").alias("first_t"))
    out = joined_by(rows.where(with_set), classes, ["n", "a", "b"], "copies", "left").select(*none.columns).unionByName(none)
    own = F.coalesce("first_id", "doc_id").eqNullSafe(F.col("doc_id"))
    return out.select("doc_id", "t", F.col("n").cast("long").alias("n_shingles"), F.coalesce("first_id", "doc_id").alias("component_id"), own.alias("kept"), (own & (F.coalesce("first_t", "t") == F.col("t"))).alias("stays"))


def near_duplicates(docs: DataFrame, percent: int = 85, size: int = 5, trees: int = 10, leaf: int = 256, depth: int = 5, block: int = 512, block_items: int = 1_000_000, node_block: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of docs."""
    return classed(docs, percent, size, trees, leaf, depth, block, block_items, node_block, id_col, text_col).drop("t", "stays")


def drop_near_duplicates(docs: DataFrame, percent: int = 85, size: int = 5, trees: int = 10, leaf: int = 256, depth: int = 5, block: int = 512, block_items: int = 1_000_000, node_block: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without those of other ids' classes and without repeats of a row's id and text."""
    found = classed(docs, percent, size, trees, leaf, depth, block, block_items, node_block, id_col, text_col)
    found = found.where("doc_id is not null").groupBy("doc_id", "t").agg(F.count("*").alias("copies"), F.bool_and("stays").alias("stays"))
    found = cut(found.where("copies > 1 or not stays").select(F.col("doc_id").alias("_id"), F.col("t").alias("_t"), "copies", "stays"))
    rows = docs.where(col(id_col).isNotNull()).select(F.struct(*map(col, docs.columns)).alias("row"), col(id_col).alias("_id"), F.xxhash64(col(text_col)).alias("_t"))
    rows = joined_by(rows, found, ["_id", "_t"], "copies", "left")
    # most rows stand alone; of a repeated one the copies meet before the exchange
    order = F.xxhash64(F.lit(0), *[F.col("row").getField(c) for c, kind in docs.dtypes if "map<" not in kind])
    once = rows.where("stays").groupBy("_id", "_t").agg(F.min_by("row", order).alias("row")).select("row.*")
    return docs.where(col(id_col).isNull()).unionByName(rows.where("stays is null").select("row.*")).unionByName(once)
