"""Exact top-k search by inner product over vector-approximation files.

Equal vectors stand together, with their smallest k + 1 ids: no other id of theirs can be in a result.  The distinct
vectors are dealt to clusters (the nearest of at most PIVOTS vectors that a hash picks), a cluster to blocks of a bounded
size.  A block's task quantises its vectors into cells (a grid of equal whole number steps in each dimension).  For a
query the cells give a lower and an upper bound of every score in the block; vectors whose upper bound is under the k-th
score known so far are out, the others' exact vectors are read from the highest upper bound down until the k-th score is
certain.

Two passes.  In the first a query passes by one block, of its own cluster: its k-th score there bounds the result from
below.  In the second it goes, with that bound, to the other blocks of those clusters whose centre and radius allow such a
score at all; the clusters' table has at most PIVOTS rows, so it alone is broadcast.  Blocks return only what reaches the
bound.  Where clusters do not part the vectors (no structure in many dimensions) every query still passes by every block.

Vectors that are null, or hold a null or a number that is not finite (also after scaling), take no part, nor do rows
without an id.  Vectors of different length have no score.  Components of 2**52 and beyond are whole numbers of any size:
their vectors are compared exactly, without bounds.  Repeated rows of an id count once, with its smallest vector.  Equal
scores: the smaller id first.  Fewer than k candidates: all.  Scores beyond 64 bits are cut to its range.  Empty table:
empty result.  Other columns of the input are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import col, cut

#: Components of a block's vectors, on average; queries that a task bounds at once; exact vectors that it reads at once.
BLOCK_ITEMS, QUERIES, READ = 1 << 19, 128, 16
#: Vectors that may become the centre of a cluster; there are no more clusters than blocks are needed.
PIVOTS = 64
#: Doubles hold whole components below this exactly.
LARGEST = 2.0**52
#: Relative slack of bounds that are computed in doubles.
SLACK = 1e-9


def prepared(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """vec_id, v of each row that takes part: floor(scale * x) of each component, as whole doubles."""
    whole = lambda y: F.when(F.abs(y) < LARGEST, F.floor(y).cast("double")).otherwise(y)
    v = F.transform(col(vector_col), lambda x: whole(x.cast("double") * scale))
    bad = F.exists(col(vector_col), lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double") * scale) == float("inf")))
    return vectors.where(col(id_col).isNotNull() & col(vector_col).isNotNull() & ~F.coalesce(bad, F.lit(True))).select(col(id_col).cast("long").alias("vec_id"), v.alias("v"))


def product(a: list[float], b: list[float]) -> int:
    """The inner product of whole numbers of any size, cut to 64 bits."""
    return max(-(2**63), min(2**63 - 1, sum(int(x) * int(y) for x, y in zip(a, b, strict=True))))


class Block:
    """The vectors of one block and length: ids, exact vectors, and cells; wide ones (beyond LARGEST) by themselves."""

    def __init__(self, ids: list[list[int]], vectors: list[np.ndarray], bits: int):
        wide = [bool((np.abs(v) >= LARGEST).any()) for v in vectors]
        self.wide = [(i, v) for i, v, w in zip(ids, vectors, wide, strict=True) if w]
        self.ids = [i for i, w in zip(ids, wide, strict=True) if not w]
        held = [v for v, w in zip(vectors, wide, strict=True) if not w]
        self.exact = np.array(held, np.float64).reshape(len(held), len(vectors[0])).astype(np.int64)
        if held:
            low = self.exact.min(axis=0)
            self.step = (self.exact.max(axis=0) - low) // (1 << bits) + 1
            self.cells = ((self.exact - low) // self.step).astype(np.uint8 if bits <= 8 else np.uint16)
            self.low, self.half = low.astype(float), (self.step - 1) / 2
        self.most = float(np.abs(self.exact).max(initial=0))

    def best(self, queries: list[np.ndarray], own: list[int], known: list[float], k: int) -> Iterator[tuple[int, int, int]]:
        """(query id, vector id, score) of each query's k best here that reach its known k-th score."""
        q = np.array(queries)
        if len(self.ids):
            middle = (q * self.step) @ self.cells.T.astype(float) + (q @ (self.low + self.half))[:, None]
            reach = np.abs(q) @ self.half + np.abs(q).sum(axis=1) * (self.most + 1) * SLACK  # the grid's half step, and rounding
        mine = {i: n for n, ids in enumerate(self.ids) for i in ids}
        for r, (query, name, bound) in enumerate(zip(queries, own, known, strict=True)):
            found = [(-product(v, query), i) for ids, v in self.wide for i in ids if i != name]
            wide = bool((np.abs(query) >= LARGEST).any())
            if len(self.ids) and wide:
                found += [(-product(v, query), i) for ids, v in zip(self.ids, self.exact.tolist(), strict=True) for i in ids if i != name]
            found = sorted(found)[:k]
            if len(self.ids) and not wide:
                whole = query.astype(np.int64)
                safe = self.most * float(np.abs(query).max(initial=0)) * max(1, len(query)) < 2**62
                upper, others = middle[r] + reach[r], middle[r] - reach[r]
                if (n := mine.get(name)) is not None:
                    others[n] = -np.inf
                floor = max(bound, np.partition(others, -k)[-k] if len(others) >= k else -np.inf)
                order = np.flatnonzero(upper >= floor)
                order = order[np.argsort(-upper[order], kind="stable")]
                for at in range(0, len(order), READ):
                    if len(found) >= k and -found[k - 1][0] > upper[order[at]]:
                        break
                    near = order[at : at + READ]
                    scores = self.exact[near] @ whole if safe else [product(x, query) for x in self.exact[near].tolist()]
                    found += [(-int(s), i) for n, s in zip(near, scores, strict=True) for i in self.ids[n] if i != name]
                    found = sorted(found)[:k]
            yield from ((name, i, -s) for s, i in found if -s >= bound)


def searched(data: DataFrame, asked: DataFrame, blocks: int, k: int, bits: int) -> DataFrame:
    """query_id, vec_id, score: the best of each block for each query (block, dim, query_id, known, v) sent to it."""
    sent = asked.select("block", "dim", F.lit(1).alias("kind"), F.array("query_id").alias("ids"), "known", "v")
    rows = data.select("block", "dim", F.lit(0).alias("kind"), "ids", F.lit(0.0).alias("known"), "v").unionByName(sent)
    dealt = rows.repartition(blocks, "block").sortWithinPartitions("block", "dim", "kind", "ids")

    def scan(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, held, block, asking = None, [], [], None, []

        def answered() -> Iterator[pa.RecordBatch]:
            out = list(block.best([v for *_, v in asking], [i for i, _, _ in asking], [b for _, b, _ in asking], k)) if block and asking else []
            asking.clear()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["query_id", "vec_id", "score"])

        for frame in frames:
            lists = frame.column(5)
            flat, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            columns = [frame.column(i).to_pylist() for i in range(5)]
            for n, (b, dim, kind, names, known) in enumerate(zip(*columns, strict=True)):
                v = flat[ends[n] : ends[n + 1]]
                if (b, dim) != at:
                    yield from answered()
                    at, ids, held, block = (b, dim), [], [], None
                if kind == 0:
                    ids.append(names)
                    held.append(np.array(v))
                    continue
                if block is None and held:
                    block = Block(ids, held, bits)
                    held = []
                asking.append((names[0], known, np.array(v)))
                if len(asking) >= QUERIES:
                    yield from answered()
        yield from answered()

    return dealt.mapInArrow(scan, "query_id long, vec_id long, score long")


def nearest(pivots: list[np.ndarray]) -> Column:
    """A struct of a vector v: cluster (the nearest pivot of its length; -1 where there is none or v is wide), its distance and v's norm."""

    @F.arrow_udf("struct<cluster:int,distance:double,norm:double>")
    def of(column: pa.Array) -> pa.Array:
        flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
        by = {}
        for n, p in enumerate(pivots):
            by.setdefault(len(p), []).append(n)
        centres = {d: np.array([pivots[n] for n in at]).reshape(len(at), d) for d, at in by.items()}
        cluster, distance, norm = np.full(len(column), -1, np.int32), np.zeros(len(column)), np.zeros(len(column))
        lengths = np.diff(ends)
        for d in set(lengths.tolist()) & by.keys():
            rows = np.flatnonzero(lengths == d)
            x = flat[ends[rows][:, None] + np.arange(d)].reshape(len(rows), d)
            fits = (np.abs(x) < LARGEST).all(axis=1)
            rows, x = rows[fits], x[fits]
            best = ((centres[d] ** 2).sum(axis=1) - 2 * x @ centres[d].T).argmin(axis=1)
            cluster[rows] = np.array(by[d], np.int32)[best]
            distance[rows] = np.sqrt(((x - centres[d][best]) ** 2).sum(axis=1)) * (1 + SLACK)
            norm[rows] = np.sqrt((x * x).sum(axis=1)) * (1 + SLACK)
        return pa.StructArray.from_arrays([pa.array(cluster), pa.array(distance), pa.array(norm)], ["cluster", "distance", "norm"])

    return of("v")


def reachable(pivots: list[np.ndarray], radius: dict[int, float], blocks: dict[int, tuple[int, int]]) -> Column:
    """The blocks, but the one it has seen, that may hold a score that a query (v, norm, cluster, known, seen) needs; blocks: first and number by cluster."""

    @F.arrow_udf("array<int>")
    def of(column: pa.Array, norm: pa.Array, cluster: pa.Array, known: pa.Array, seen: pa.Array) -> pa.Array:
        flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
        out = []
        for n, (size, own, bound, past) in enumerate(zip(norm.to_pylist(), cluster.to_pylist(), known.to_pylist(), seen.to_pylist(), strict=True)):
            v, to = flat[ends[n] : ends[n + 1]], []
            for c, (first, count) in blocks.items():
                if c >= 0 and own >= 0 and len(pivots[c]) == len(v):
                    centre = float(pivots[c] @ v)
                    if centre + size * radius[c] + SLACK * (abs(centre) + size * float(np.abs(pivots[c]).sum()) + 1) < bound:
                        continue
                elif c >= 0 and len(pivots[c]) != len(v):
                    continue
                to += [b for b in range(first, first + count) if b != past]
            out.append(to)
        return pa.array(out, pa.list_(pa.int32()))

    return of("v", "norm", "cluster", "known", "seen")


def top_k(vectors: DataFrame, k: int = 5, query_every: int = 50, scale: int = 256, bits: int = 6, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k highest scores of each row whose id is divisible by query_every."""
    rows = prepared(vectors, id_col, vector_col, scale)
    first = vectors.select(col(id_col), col(vector_col)).orderBy(F.xxhash64(F.lit("pivot"), col(id_col)), col(id_col)).limit(PIVOTS)
    picked = prepared(first, id_col, vector_col, scale).collect()
    # all rows count here, so repeated ones only make for smaller blocks
    needed = -(-(vectors.agg(F.sum(F.size(col(vector_col)).cast("long"))).first()[0] or 0) // BLOCK_ITEMS)
    pivots = [p for p in (np.array(r["v"], float) for r in picked[: max(1, needed)]) if (np.abs(p) < LARGEST).all()]
    placed = cut(rows.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("near", nearest(pivots)).select("vec_id", "v", "near.*"))
    items = F.sum(F.size("v").cast("long") + 1)
    clusters = placed.groupBy("cluster").agg(items.alias("items"), F.max("distance").alias("radius")).collect()  # at most PIVOTS + 1 rows
    blocks, radius, total = {}, {}, 0
    for r in sorted(clusters, key=lambda r: r["cluster"]):
        blocks[r["cluster"]] = total, -(-r["items"] // BLOCK_ITEMS)
        radius[r["cluster"]] = r["radius"]
        total += blocks[r["cluster"]][1]
    total = max(1, total)
    pairs = F.create_map(*[x for c, (first, n) in blocks.items() for x in (F.lit(c), F.struct(F.lit(first).alias("first"), F.lit(n).alias("n")))]) if blocks else F.lit(None).cast("map<int,struct<first:int,n:int>>")
    place = F.try_element_at(pairs, F.col("cluster"))
    block = (place["first"] + F.pmod(F.xxhash64("v"), place["n"])).cast("int")
    same = Window.partitionBy("h", "v").orderBy("vec_id")  # the hash makes comparisons short
    few = placed.withColumn("h", F.xxhash64("v")).withColumn("n", F.row_number().over(same)).where(F.col("n") <= k + 1)
    data = few.groupBy("h", "v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.first("cluster").alias("cluster"))
    data = cut(data.select(block.alias("block"), F.size("v").alias("dim"), "ids", "v"))
    asked = placed.where(F.col("vec_id") % query_every == 0).select(F.col("vec_id").alias("query_id"), F.size("v").alias("dim"), "v", "cluster", "norm", block.alias("seen"))
    first = cut(searched(data, asked.select(F.col("seen").alias("block"), "dim", "query_id", F.lit(float("-inf")).alias("known"), "v"), total, k, bits))
    reached = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("least"))
    asked = asked.join(reached, "query_id", "left").withColumn("known", F.when(F.col("n") >= k, F.col("least") - F.abs("least") * SLACK).otherwise(float("-inf")))
    second = asked.select("query_id", "dim", "known", "v", F.explode(reachable(pivots, radius, blocks)).alias("block"))
    found = first.unionByName(searched(data, second, total, k, bits))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
