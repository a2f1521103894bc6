"""Approximate nearest neighbours by a hash-prefix forest.

Each tree gives every vector a long string of sign bits of random projections, and keeps the vectors sorted by it. A
query first descends, in some of the trees, to the vectors that share its longest prefix, and ascends in each until it
has a few more than it asks for. Their k-th best score tells how far to go: two vectors at an angle share a bit with a
known chance, so it gives the longest prefix under which some tree holds any better vector, but for a chance of MISS.
To that length all trees ascend together, and what they hold is ranked by exact inner products. Where vectors lie in
clusters that is deep and few are touched; where they lie anywhere, as shallow as it must be.

The sorted array of a tree is cut into segments of bounded size, by counts of short prefixes, so that segments are
searched apart; a prefix that very many vectors share is counted and cut by its further bits, and by hash only where all
bits are the same. Each query goes to all segments that hold its prefix. For inner products, vectors are hashed with one more component that makes all norms equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.llm.common import written

TREES, BITS, COUNTED = 32, 40, 12
#: Bits by which the prefixes of crowded cells are counted further.
MORE = 6
#: Trees of the first descent, and candidates a tree for each neighbour that is asked for.
FIRST, ENOUGH = 8, 3
#: Chance that a vector as near as the k-th of the first descent shares no prefix with the query that is searched.
MISS = 0.1
#: Vectors of a segment.
SEGMENT = 32_768
_ENTRY = "tree int, segment int, key long, depth int, vec_id long, vector binary"
_FOUND = "query_id long, vec_id long, score double"


def usable(column: str = "embedding") -> Column:
    return F.expr(f"size({column}) > 0 and forall({column}, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists({column}, x -> x <> 0)")


class Forest:
    """Projections, and where the counted prefixes of each tree lie."""

    def __init__(self, dim: int, longest: float, trees: int, kind: str = "f8"):
        self.dim, self.longest, self.trees, self.kind = dim, longest, trees, kind
        #: Cells of each tree in order: their least key, the bits of their prefix, and their vectors.
        self.starts = [np.arange(1 << COUNTED, dtype=np.int64) << (BITS - COUNTED) for _ in range(trees)]
        self.bits = [np.full(1 << COUNTED, COUNTED) for _ in range(trees)]
        self.counts = [np.zeros(1 << COUNTED, np.int64) for _ in range(trees)]

    def planes(self) -> np.ndarray:
        return np.random.default_rng(11).normal(size=(self.dim + 1, self.trees * BITS)).astype(np.float32)

    def keys(self, x: np.ndarray, planes: np.ndarray, query: bool) -> np.ndarray:
        """Rows by trees."""
        x = x.astype(np.float64)
        if query:
            more = np.zeros(len(x))
        else:
            more = np.sqrt(np.maximum(self.longest**2 - (x * x).sum(axis=1), 0))
        out = np.empty((len(x), self.trees), np.int64)
        bits = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
        for at in range(0, len(x), 4096):
            part = np.column_stack([x[at : at + 4096], more[at : at + 4096]]).astype(np.float32) @ planes > 0
            out[at : at + 4096] = part.reshape(len(part), self.trees, BITS).astype(np.float64) @ bits.astype(np.float64)
        return out

    def crowded(self, bits: int) -> list[np.ndarray]:
        """Of each tree, where the cells of so many bits are that hold too many vectors."""
        return [np.flatnonzero((b == bits) & (n > SEGMENT)) for b, n in zip(self.bits, self.counts, strict=True)]

    def split(self, t: int, hot: np.ndarray, bits: int, low: np.ndarray, n: np.ndarray) -> None:
        """Cells hot of tree t give way to those of `bits` bits, of which those from low on hold n."""
        step = 1 << (BITS - bits)
        span = 1 << (bits - int(self.bits[t][hot[0]]))
        new = (self.starts[t][hot][:, None] + np.arange(span) * step).ravel()
        held = np.zeros(len(new), np.int64)
        held[np.searchsorted(new, low)] = n
        starts = np.concatenate([np.delete(self.starts[t], hot), new])
        order = np.argsort(starts)
        self.starts[t] = starts[order]
        self.bits[t] = np.concatenate([np.delete(self.bits[t], hot), np.full(len(new), bits)])[order]
        self.counts[t] = np.concatenate([np.delete(self.counts[t], hot), held])[order]

    def cut(self) -> None:
        """Segments of each tree: the first of each cell, and how many a cell has that is crowded to its last bit."""
        self.salts = [np.maximum(-(-n // SEGMENT), 1) for n in self.counts]
        self.first = []
        for t in range(self.trees):
            segment, held, first = 0, 0, np.zeros(len(self.counts[t]), np.int64)
            for c, n in enumerate(self.counts[t].tolist()):
                if held and held + n > SEGMENT:
                    segment, held = segment + 1, 0
                first[c] = segment
                held += n
                if self.salts[t][c] > 1:
                    segment, held = segment + self.salts[t][c], 0
            self.first.append(first)

    def cells(self, t: int, keys: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts[t], keys, "right") - 1

    def depths(self, x: np.ndarray, kth: np.ndarray) -> np.ndarray:
        """The longest prefixes that some tree shares, but for a chance of MISS, between queries x and any vector whose inner product is kth or more; nan: no such length."""
        cosine = kth / np.maximum(np.sqrt((x.astype(np.float64) ** 2).sum(axis=1)) * self.longest, 1e-300)
        same = 1 - np.arccos(np.clip(cosine, -1, 1)) / np.pi
        length = np.log(1 - MISS ** (1 / self.trees)) / np.log(np.clip(same, 1e-12, 1 - 1e-12))
        return np.where(np.isnan(kth), 0, np.minimum(length, BITS)).astype(np.int32)


def _counted(rows: DataFrame, forest: Forest) -> None:
    size = 1 << COUNTED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes, counts = forest.planes(), np.zeros(forest.trees * size, np.int64)
        for batch in batches:
            cells = forest.keys(_rows(batch["embedding"], forest.dim), planes, False) >> (BITS - COUNTED)
            counts += np.bincount((cells + np.arange(forest.trees) * size).ravel(), minlength=len(counts))
        at = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(at), pa.array(counts[at])], names=["cell", "n"])

    got = rows.select("embedding").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # trees x cells at most
    counts = np.zeros(forest.trees * size, np.int64)
    counts[got["cell"].to_numpy()] = got["n"].to_numpy()
    forest.counts = list(counts.reshape(forest.trees, size))
    for bits in range(COUNTED, BITS, MORE):
        _recounted(rows, forest, bits, min(bits + MORE, BITS))
    forest.cut()


def _recounted(rows: DataFrame, forest: Forest, bits: int, more: int) -> None:
    """Cells of `bits` bits that are crowded are counted by `more` bits."""
    hot = forest.crowded(bits)
    if not any(len(h) for h in hot):
        return
    lows = [forest.starts[t][h] for t, h in enumerate(hot)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = forest.planes()
        for batch in batches:
            keys = forest.keys(_rows(batch["embedding"], forest.dim), planes, False)
            for t, own in enumerate(lows):
                if len(own):
                    key = keys[np.isin(keys[:, t] >> (BITS - bits) << (BITS - bits), own), t]
                    low, n = np.unique(key >> (BITS - more) << (BITS - more), return_counts=True)
                    yield pa.record_batch([pa.array(np.full(len(low), t, np.int32)), pa.array(low), pa.array(n.astype(np.int64))], names=["tree", "low", "n"])

    counted = rows.select("embedding").mapInArrow(run, "tree int, low long, n long").groupBy("tree", "low").agg(F.sum("n").alias("n"))
    got = counted.toArrow()  # 2^MORE times the crowded cells at most, which are n / SEGMENT a tree at most
    tree, low, n = (got[c].to_numpy() for c in ("tree", "low", "n"))
    for t, h in enumerate(hot):
        if len(h):
            forest.split(t, h, more, low[tree == t], n[tree == t])


def _rows(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _entries(forest: Forest, trees: int, again: bool):
    """Indexed vectors in their segments of the first trees, and queries in theirs: in one segment a tree, with depth BITS, or again in all those of the prefix that kth tells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = forest.planes()
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                x, ids, kth = _rows(batch["embedding"], forest.dim), batch["vec_id"].to_numpy(), batch["kth"].to_numpy(zero_copy_only=False).astype(float)
                raw = np.array([v.tobytes() for v in x.astype(forest.kind)], object)
                for query, chosen in ((False, batch["indexed"]), (True, batch["asks"])):
                    own = np.flatnonzero(chosen.to_numpy(zero_copy_only=False))
                    keys = forest.keys(x[own], planes, query)
                    if query and again:
                        yield from _asked(keys, ids[own], raw[own], forest.depths(x[own], kth[own]))
                        continue
                    for t in range(trees):
                        cells = forest.cells(t, keys[:, t])
                        salt = (ids[own].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % forest.salts[t][cells]
                        yield out(np.full(len(own), t), forest.first[t][cells] + salt, keys[:, t], np.full(len(own), BITS if query else -1), ids[own], raw[own])

    def _asked(keys: np.ndarray, ids: np.ndarray, raw: np.ndarray, depth: np.ndarray) -> Iterator[pa.RecordBatch]:
        span = np.int64(1) << (BITS - depth).astype(np.int64)
        for t in range(trees):
            low = keys[:, t] // span * span
            a, b = forest.cells(t, low), forest.cells(t, low + span - 1)
            first = forest.first[t][a]
            n = forest.first[t][b] + forest.salts[t][b] - first
            rows = np.repeat(np.arange(len(ids)), n)
            each = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
            yield out(np.full(len(rows), t), first[rows] + each, keys[rows, t], depth[rows], ids[rows], raw[rows])

    def out(tree, segment, key, depth, ids, raw):
        return pa.record_batch([pa.array(tree.astype(np.int32)), pa.array(segment.astype(np.int32)), pa.array(key), pa.array(depth.astype(np.int32)), pa.array(ids), pa.array(raw.tolist(), pa.binary())], names=["tree", "segment", "key", "depth", "vec_id", "vector"])

    return run


def nearest_of(q: np.ndarray, own: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its k best rows of x by inner product, ties to the smaller id, never a row of its own id."""
    for at in range(0, len(q), 128):
        scores = q[at : at + 128] @ x.T
        for i, row in enumerate(scores):
            take = min(len(ids), k + 1 + int((ids == own[at + i]).sum()))
            least = np.partition(row, len(row) - take)[len(row) - take] - 1e-9
            near = np.flatnonzero(row >= least)
            near = near[ids[near] != own[at + i]]
            exact = (x[near] * q[at + i]).sum(axis=1)  # the same sum for equal vectors, wherever they stand
            best = np.lexsort((ids[near], -exact))[:k]
            yield at + i, ids[near[best]], exact[best]


def descended(keys: np.ndarray, own: np.ndarray, depth: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Where in the sorted keys those lie that share a prefix with own: its first `depth` bits, or fewer, until there are `least` of them."""
    a, b, depth, left = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64), depth.astype(np.int64), np.arange(len(own))
    while len(left):
        span = np.int64(1) << (BITS - depth[left])
        low = own[left] // span * span
        a[left], b[left] = np.searchsorted(keys, low), np.searchsorted(keys, low + span)
        left = left[(b[left] - a[left] < least) & (depth[left] > 0)]
        depth[left] -= 1
    return a, b


def _searched(forest: Forest, k: int, least: int):
    """The k best of each query in its segment, among those that share its prefix or, if they are fewer than `least`, a shorter one."""

    def run(group: pa.Table) -> pa.Table:
        depth, key, ids = (group[c].to_numpy() for c in ("depth", "key", "vec_id"))
        x = np.frombuffer(b"".join(group["vector"].to_pylist()), forest.kind).reshape(-1, forest.dim)
        entry = np.flatnonzero(depth < 0)
        entry = entry[np.argsort(key[entry], kind="stable")]
        ask = np.flatnonzero(depth >= 0)
        a, b = descended(key[entry], key[ask], depth[ask], least)
        queries, found, scores = [], [], []
        order = np.lexsort((b, a))
        new = np.flatnonzero(np.concatenate([[True], (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])])) if len(order) else order
        for rows in np.split(order, new[1:]) if len(order) else []:
            near = entry[a[rows[0]] : b[rows[0]]]
            if not len(near):
                continue
            for i, got, score in nearest_of(x[ask[rows]].astype(np.float64), ids[ask[rows]], x[near].astype(np.float64), ids[near], k):
                queries.append(np.full(len(got), ids[ask[rows[i]]]))
                found.append(got)
                scores.append(score)
        none = np.zeros(0, np.int64)
        return pa.table({"query_id": np.concatenate([none, *queries]), "vec_id": np.concatenate([none, *found]), "score": np.concatenate([np.zeros(0), *scores])})

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    best = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.distinct().withColumn("rank", best).where(F.col("rank") <= k)


def nearest(vectors: DataFrame, asks: Column, k: int = 20, trees: int = TREES) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: the k rows found of largest inner product with each row that asks.

    vectors: vec_id and embedding. Rows without vec_id, and vectors that are null, empty, zero or hold null or
    non-finite components take no part, nor do those of another length than most. A row is not its own neighbour, nor
    are other rows of its vec_id. Scores are exact, in double precision; ties go to the smaller vec_id. Of equal vectors
    only the k + 1 smallest ids are indexed: the others can't be among the k nearest of any query.
    """
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & usable())
    sizes = own.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n"), F.max(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x)).alias("longest"))
    kind = "f4" if own.schema["embedding"].dataType.simpleString() == "array<float>" else "f8"  # as they are
    top = sizes.orderBy(F.desc("n"), F.desc("dim")).first()
    shape = "query_id long, rank int, vec_id long, score double"
    if top is None:
        return vectors.sparkSession.createDataFrame([], shape)
    copy = F.row_number().over(W.partitionBy("embedding").orderBy("vec_id"))
    same = own.where(F.size("embedding") == top["dim"])
    first = same.withColumn("copy", copy).where(F.col("copy") <= k + 1).select("vec_id", "embedding", F.lit(True).alias("indexed"), F.lit(False).alias("asks"))
    rows = written(first.unionByName(same.where(asks).select("vec_id", "embedding", F.lit(False).alias("indexed"), F.lit(True).alias("asks"))))
    forest = Forest(top["dim"], float(top["longest"]) ** 0.5, trees, kind)
    _counted(rows.where("indexed"), forest)
    group = ["tree", "segment"]
    near = rows.withColumn("kth", F.lit(None).cast("double")).mapInArrow(_entries(forest, min(FIRST, trees), False), _ENTRY)
    near = written(_best(near.groupBy(*group).applyInArrow(_searched(forest, k, ENOUGH * k), _FOUND), k))
    kth = near.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("kth"))
    routed = rows.where("indexed").withColumn("kth", F.lit(None).cast("double")).unionByName(rows.where("asks").join(kth, "vec_id", "left").select(*rows.columns, "kth"))
    found = routed.mapInArrow(_entries(forest, trees, True), _ENTRY).groupBy(*group).applyInArrow(_searched(forest, k, 0), _FOUND)
    return _best(found.unionByName(near.select("query_id", "vec_id", "score")), k).select("query_id", "rank", "vec_id", "score")


def by_modulus(n: int) -> Column:
    return F.col("vec_id") % n == 0
