"""SimHash near-dedup by the generalised pigeonhole principle.

Fingerprints within `radius` bits are linked. The 64 bits are grouped into parts of bits that go together; a row that
looks for its partners gives part i a threshold t_i >= -1 with sum(t) = radius - parts + 1, so that every partner
differs in at most t_i bits of some part i. The thresholds are unequal and the row's own: dynamic programming makes the
candidates least, by counts of part values over all fingerprints. Rows stand in an index under each part's exact value,
probe the values within their thresholds, and what meets is verified by its full distance.

Fingerprints of 64 bits are majorities over the shingles' hashes. near_pairs() also takes wider ones, whose radius is too
wide for a guarantee to be worth its candidates: there it finds pairs with a chance only, by parts that go by the number
of rows. one_of_each() needs every pair at a similarity of shingle sets, at every size: sets that are so similar share
items among any so many of each, in whatever order (prefix filtering), so those say what is compared.

Equal fingerprints are one node from the start. A value that very many nodes share is salted: nodes within the radius
of its most copied fingerprint, its pivot, are linked to that and need no comparison among each other; only the others
probe all salts. Buckets give spanning forests, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import binary, binary_array, blob, fmix, hashed, input_bytes, trimmed, unblob, word_chunks, written
from sparkloom.llm.components import components

SHINGLE, RADIUS, SEED = 4, 4, 42
#: Nodes under one value of a part beyond which it is salted, and values at most that are: those with over a share of all.
CROWD, HOT_VALUES = 4096, 1 << 19
#: Parts beyond which each is asked for its own value only: trading thresholds takes time and memory by the square of the parts.
MANY = 40
#: Bits by which values are counted for the estimates.
FOLD = 12
#: Costs of a probing row and of a verified candidate, in microseconds.
PROBE, VERIFY = 2.0, 0.01
#: Bits of a wide fingerprint.
WIDE = 512
#: Rows of a block of sets that are compared.
BLOCK = 256
#: Share of a set's items by which it is told whether it may have partners.
FIRST = 0.3
#: Stands for the doc_id of fingerprints whose rows have none.
NAMELESS = 1 << 62


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Bits set in over half the XXH64 of the lower-cased text's word shingles; no words: 0."""
    ones, n, rest, digest = np.zeros(64, np.int64), 0, [], xxhash.xxh64_intdigest
    for part in word_chunks(text.lower()):
        words = rest + part
        if len(words) >= shingle:
            line = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            starts = [0, *(ends[: len(words) - shingle] + 1).tolist()]
            h = np.fromiter((digest(line[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)), np.uint64, len(words) - shingle + 1)
            for at in range(0, len(h), 1 << 16):
                ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
            n += len(h)
        rest = words[len(words) - shingle + 1 :] if len(words) >= shingle else words
    if not n and rest:
        h, n = digest(b" ".join(rest), seed), 1
        ones = np.array([h >> i & 1 for i in range(64)])
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id and fp, the fingerprint as eight bytes, highest first, of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(x.as_py(), shingle, seed).to_bytes(8, "big") for x in batch["text"]]
            yield pa.record_batch([batch["doc_id"], pa.array(fps, pa.binary())], names=["doc_id", "fp"])

    return binary(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(trimmed(run), "doc_id long, fp binary")


def shingles(text: bytes, shingle: int) -> np.ndarray:
    """Hashes of the set of shingles of the lower-cased text; fewer words are one shingle, none is none."""
    rest, out, any_words = [], [], False
    for part in word_chunks(text.lower()):
        words = rest + part
        if len(words) >= shingle:
            h, n = hashed(words), len(words) - shingle + 1
            own = np.zeros(n, np.uint64)
            for i in range(shingle):
                own = fmix(own * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
            out.append(np.unique(own))
            any_words = True
        rest = words[len(words) - shingle + 1 :] if len(words) >= shingle else words
    if not any_words and rest:
        out.append(fmix(np.bitwise_xor.reduce(fmix(hashed(rest) + np.arange(len(rest), dtype=np.uint64)), keepdims=True)))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def prefix(size: int, similarity: float) -> int:
    """Sets of that Jaccard similarity or more share one of their first so many items, in any order that all sets are sorted by."""
    return size - int(np.ceil(similarity * size - 1e-9)) + 1 if size else 0


def first(size: int, similarity: float) -> int:
    """Items by which it is decided whether a set has partners at all: a share of them, its prefix at least."""
    return max(prefix(size, similarity), int(np.ceil(FIRST * size)))


def least_shared(size: int, similarity: float) -> int:
    """How many of a set's first items are at least first items of each partner, too.

    Of the overlap, which is s / (1 + s) of both sizes or more, the i-th item is the (i + size - overlap)-th of a set at
    most. With partners of s to 1 / s times the size, FIRST - 1 + s of the size are among the first of both.
    """
    return max(1, int(np.floor((FIRST - 1 + similarity) * size - 1e-9)))


def first_shingles(docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """doc_id, own (SHA-256 of the text), node (a hash of the shingle set), size of the set and items, its first by hash, of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                sets = [shingles(x.as_py(), shingle) for x in batch["text"]]
                node = [xxhash.xxh64_intdigest(h.tobytes(), SEED) >> 1 for h in sets]
                items = [h[: first(len(h), similarity)].tobytes() for h in sets]
                yield pa.record_batch([batch["doc_id"], batch["own"], pa.array(node, pa.int64()), pa.array([len(h) for h in sets], pa.int32()), pa.array(items, pa.binary())], names=["doc_id", "own", "node", "size", "items"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _digest().alias("own"))
    return binary(own).mapInArrow(trimmed(run), "doc_id long, own binary, node long, size int, items binary")


def _digest() -> F.Column:
    return F.unhex(F.sha2(F.coalesce(F.col("text").cast("binary"), F.lit(b"").cast("binary")), 256))


def _fps(column: pa.Array) -> np.ndarray:
    """Fingerprints as rows of 64-bit words."""
    n = len(column)
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, np.uint64).reshape(n, -1) if n else np.zeros((0, 1), np.uint64)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


def _bits(fps: np.ndarray, width: int) -> np.ndarray:
    return np.unpackbits(fps[:, : -(-width // 64)].copy().view(np.uint8), axis=1, bitorder="little")


def correlated_parts(ones: np.ndarray, pairs: np.ndarray, n: int, m: int, bits: int) -> list[list[int]]:
    """m parts of nearly equal width that share the first `bits` bits: each grows from a free bit by the bit that correlates most with those it has."""
    p = ones / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(pairs / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd)
    np.fill_diagonal(corr, 0)
    free, parts = list(range(bits)), []
    for i in range(m):
        width = bits // m + (i < bits % m)
        seed = max(free, key=lambda b: (corr[b, free].max(), -b))
        part = [seed]
        free.remove(seed)
        while len(part) < width:
            best = max(free, key=lambda b: (corr[b, part].mean(), -b))
            part.append(best)
            free.remove(best)
        parts.append(sorted(part))
    return parts


def _flips(width: int, t: int) -> np.ndarray:
    return np.array([sum(1 << i for i in c) for c in combinations(range(width), t)], np.int64)


def _fold(v: np.ndarray) -> np.ndarray:
    """Values as FOLD bits; a flipped bit of the value flips one bit of the fold."""
    out = v & ((1 << FOLD) - 1)
    for s in range(FOLD, 64, FOLD):
        out = out ^ (v >> s & ((1 << FOLD) - 1))
    return out


class Plan:
    """Parts, their thresholds' sum, counts of their values, and crowded values: what a task needs to place fingerprints."""

    def __init__(self, parts: list[list[int]], total: int, radius: int):
        self.parts, self.radius, self.total = parts, radius, total
        self.most = min(total + len(parts) - 1, 4 if len(parts) < 6 else 1)
        self.bits = 1 + max(max(p) for p in parts)
        self.weights = [1 << np.arange(len(p), dtype=np.int64) for p in parts]
        self.flips = [[_flips(len(p), t) for t in range(self.most + 1)] for p in parts]
        self.counts = np.zeros((len(parts), 1 << FOLD))
        self.hot: list[tuple] = [(np.zeros(0, np.int64),) * 4] * len(parts)

    def values(self, fps: np.ndarray) -> list[np.ndarray]:
        bits = _bits(fps, self.bits)
        return [bits[:, p].astype(np.int64) @ w for p, w in zip(self.parts, self.weights, strict=True)]

    def thresholds(self, values: list[np.ndarray]) -> np.ndarray:
        """For each row the thresholds of least cost whose sum is total, by dynamic programming over the parts."""
        n, m, most = len(values[0]), len(self.parts), self.most
        if m > MANY and self.total == 0:
            return np.zeros((m, n), np.int64)
        costs = np.zeros((m, most + 2, n))  # of thresholds -1, 0, 1, ...
        for i, v in enumerate(values):
            thin = 2.0 ** max(0, len(self.parts[i]) - FOLD)
            fold = _fold(v)
            for t in range(most + 1):
                masks = self.flips[i][t]
                near = sum(self.counts[i][fold ^ f] for f in _fold(masks)) if len(masks) <= 600 else len(masks) * self.counts[i].mean()
                costs[i, t + 1] = costs[i, t] + PROBE * len(masks) + VERIFY * near / thin
        span = most + 2
        best = np.full((m + 1, m * span, n), np.inf)
        best[0, 0] = 0
        pick = np.zeros((m + 1, m * span, n), np.int8)
        for i in range(m):
            for s in range(i * (span - 1) + 1):
                for t in range(span):
                    if s + t < best.shape[1]:
                        c = best[i, s] + costs[i, t]
                        less = c < best[i + 1, s + t]
                        best[i + 1, s + t][less] = c[less]
                        pick[i + 1, s + t][less] = t
        out, s, rows = np.zeros((m, n), np.int64), np.full(n, self.total + m), np.arange(n)
        for i in range(m, 0, -1):
            t = pick[i, s, rows].astype(np.int64)
            out[i - 1] = t - 1
            s = s - t
        return out


def _choose(n: int, radius: int) -> int:
    """The number of parts of 64 bits whose probes and candidates cost least, if values were spread evenly."""

    def cost(m: int) -> float:
        base, over = divmod(radius - m + 1, m)
        probes = sum(sum(len(_flips(64 // m, t)) for t in range(base + (i < over) + 1)) for i in range(m))
        return (PROBE + VERIFY * n / 2.0 ** (64 // m)) * (probes + m)

    return min(range(min(3, radius + 1), radius + 2), key=cost)


def _wide_parts(n: int, radius: int, width: int) -> tuple[int, int]:
    """Parts and bits of each: a value has a few dozen rows, and some part is equal in 95 % of pairs at the radius, for every n."""
    w = min(max(10, int(np.ceil(np.log2(max(n, 1) / 64 + 1)))), width - radius)
    equal = np.prod([(width - radius - i) / (width - i) for i in range(w)])
    return int(np.ceil(np.log(0.05) / np.log1p(-equal))), w


def more_parts(m: int, w: int, width: int) -> list[list[int]]:
    """m parts of w bits: random orders of all bits are cut, so that parts of one order are disjoint and those of several overlap.

    A pair's differing bits leave each part free with the same chance, and parts of an order rather others than each
    other: m parts find as many pairs as independent ones, or more.
    """
    rng, parts = np.random.default_rng(29), []
    while len(parts) < m:
        order = rng.permutation(width)
        parts += [sorted(order[i : i + w].tolist()) for i in range(0, width // w * w, w)]
    return parts[:m]


def _counted(nodes: DataFrame, plan: Plan) -> None:
    m, size = len(plan.parts), 1 << FOLD

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(m * size, np.int64)
        for batch in batches:
            for i, v in enumerate(plan.values(_fps(batch["fp"]))):
                counts[i * size : (i + 1) * size] += np.bincount(_fold(v), minlength=size)
        at = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(at), pa.array(counts[at])], names=["cell", "n"])

    for cell, n in nodes.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # parts x 2^FOLD rows at most
        plan.counts[cell // size, cell % size] = n


def _parts(nodes: DataFrame, m: int, width: int) -> list[list[int]]:
    """Bits by correlation over all fingerprints; width x width sums come to the driver, width being some hundreds at most."""
    words = -(-width // 64)
    size = 64 * words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n = np.zeros((size, size), np.int64), 0
        for batch in batches:
            bits = _bits(_fps(batch["fp"]), size).astype(np.float32)
            pairs += (bits.T @ bits).astype(np.int64)
            n += len(bits)
        yield pa.record_batch([pa.array(np.arange(size * size + 1)), pa.array(np.append(pairs.ravel(), n))], names=["cell", "n"])

    got = nodes.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    sums = np.zeros(size * size + 1)
    sums[got["cell"].to_numpy()] = got["n"].to_numpy()
    pairs = sums[:-1].reshape(size, size)[:width, :width]
    return correlated_parts(np.diag(pairs), pairs, int(sums[-1]), m, width)


def _crowded(nodes: DataFrame, plan: Plan, n: int) -> None:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, v in enumerate(plan.values(_fps(batch["fp"]))):
                yield pa.record_batch([pa.array(np.full(len(v), i, np.int32)), pa.array(v), batch["fp"], batch["node"], batch["copies"]], names=["part", "value", "fp", "node", "copies"])

    least = max(CROWD, n * len(plan.parts) // HOT_VALUES)
    values = nodes.mapInArrow(run, "part int, value long, fp binary, node long, copies long")
    most = F.max(F.struct("copies", -F.col("node"), "fp")).alias("most")
    rows = values.groupBy("part", "value").agg(F.count("*").alias("n"), most).where(F.col("n") > least).select("part", "value", "n", "most.fp", F.col("most.col2").alias("node")).toArrow().sort_by([("part", "ascending"), ("value", "ascending")])  # HOT_VALUES at most
    part, fps = rows["part"].to_numpy(), _fps(rows["fp"])
    columns = [x.astype(np.int64) for x in (rows["value"].to_numpy(), -(-rows["n"].to_numpy() // least), -rows["node"].to_numpy())]
    for i in range(len(plan.parts)):
        own = part == i
        if own.any():
            plan.hot[i] = (*(x[own] for x in columns), fps[own])


def _placed(plan: Plan):
    """Rows part, value, salt, fp, node; part -1: a link that is certain, of node and value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1 << 14):
                batch = whole.slice(at, 1 << 14)
                fp, node = _fps(batch["fp"]), batch["node"].to_numpy()
                values = plan.values(fp)
                t = plan.thresholds(values)
                for i, v in enumerate(values):
                    hot, salts, pivot_node, pivot = plan.hot[i]
                    for radius in range(int(max(t[i].max(initial=0), 0)) + 1):
                        own = np.arange(len(v)) if radius == 0 else np.flatnonzero(t[i] >= radius)
                        masks = plan.flips[i][radius]
                        rows = np.repeat(own, len(masks))
                        key = v[rows] ^ np.tile(masks, len(own))
                        yield from _salted(i, rows, key, radius == 0, t[i] >= 0, fp, node, hot, salts, pivot, pivot_node, plan.radius)

    def _salted(i, rows, key, indexes, probes, fp, node, hot, salts, pivot, pivot_node, most):
        salt = np.zeros(len(rows), np.int64)
        if len(hot):
            at = np.minimum(np.searchsorted(hot, key), len(hot) - 1)
            crowd = hot[at] == key
            near = crowd & (_apart(fp[rows], pivot[at]) <= most)
            salt = np.where(crowd, (fmix(fp[rows, 0]) % np.maximum(salts[at], 1).astype(np.uint64)).astype(np.int64), 0)
            if near.any():
                yield out(np.full(near.sum(), -1), pivot_node[at][near], salt[near], fp[rows][near], node[rows][near])
            ask = np.flatnonzero(crowd & ~near & (probes[rows] if indexes else True))
            each = np.repeat(ask, salts[at][ask])
            turn = np.arange(len(each)) - np.repeat(np.cumsum(salts[at][ask]) - salts[at][ask], salts[at][ask])
            yield out(np.full(len(each), i), key[each], turn, fp[rows][each], node[rows][each])
            stay = (indexes & crowd) | ~crowd
            rows, key, salt = rows[stay], key[stay], salt[stay]
        yield out(np.full(len(rows), i), key, salt, fp[rows], node[rows])

    def out(part, key, salt, fp, node):
        return pa.record_batch([pa.array(part.astype(np.int32)), pa.array(key), pa.array(salt.astype(np.int32)), binary_array(np.ascontiguousarray(fp).tobytes(), np.arange(len(fp) + 1) * 8 * fp.shape[1]), pa.array(node)], names=["part", "value", "salt", "fp", "node"])

    return run


def _forest(fp: np.ndarray, node: np.ndarray, radius: int, out: list) -> None:
    """Spanning forest of the links in one bucket: what a tree has is not compared again."""
    left = np.arange(len(fp))
    while len(left):
        grow, left = [left[0]], left[1:]
        while grow and len(left):
            p = grow.pop()
            near = _apart(fp[left], fp[p]) <= radius
            if near.any():
                new = left[near]
                out.append((np.full(len(new), node[p]), node[new]))
                grow += new.tolist()
                left = left[~near]


def _verified(radius: int, small: int = 256):
    def links(group: np.ndarray, fp: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        sizes = np.diff(np.concatenate([starts, [len(group)]]))
        size = np.repeat(sizes, sizes)
        linked = size > small
        for o in range(1, min(small, int(sizes.max(initial=1)))):
            at = np.flatnonzero((group[o:] == group[:-o]) & (size[o:] <= small))
            at = at[_apart(fp[at], fp[at + o]) <= radius]
            linked[at] = linked[at + o] = True
        at = np.flatnonzero(linked)
        cuts = np.flatnonzero(np.concatenate([[True], group[at][1:] != group[at][:-1], [True]])) if len(at) else np.zeros(1, int)
        out: list = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            rows = at[a:b]
            _forest(fp[rows], node[rows], radius, out)
        a, b = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 2
        return pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            part, value, salt, node = (batch[c].to_numpy() for c in ("part", "value", "salt", "node"))
            fp = _fps(batch["fp"])
            sure = part < 0
            if sure.any():
                yield pa.record_batch([pa.array(node[sure]), pa.array(value[sure])], names=["a", "b"])
            held.append((part[~sure], value[~sure], salt[~sure], fp[~sure], node[~sure]))
            if sum(len(x[0]) for x in held) >= 1 << 16:
                part, value, salt, fp, node = (np.concatenate(x) for x in zip(*held, strict=True))
                new = np.flatnonzero((part[1:] != part[:-1]) | (value[1:] != value[:-1]) | (salt[1:] != salt[:-1])) + 1
                if len(new):
                    cut = new[-1]
                    group = np.zeros(cut, np.int64)
                    group[new[:-1]] = 1
                    yield links(np.cumsum(group), fp[:cut], node[:cut])
                    held = [(part[cut:], value[cut:], salt[cut:], fp[cut:], node[cut:])]
                else:
                    held = [(part, value, salt, fp, node)]
        if held and sum(len(x[0]) for x in held):
            part, value, salt, fp, node = (np.concatenate(x) for x in zip(*held, strict=True))
            group = np.concatenate([[0], np.cumsum((part[1:] != part[:-1]) | (value[1:] != value[:-1]) | (salt[1:] != salt[:-1]))])
            yield links(group, fp, node)

    return run


def near_pairs(nodes: DataFrame, radius: int = RADIUS, width: int = 64, parts: int | None = None, reach: int | None = None) -> DataFrame:
    """Links a, b that connect what is within radius bits: nodes has distinct fp (binary), node and copies (longs).

    Fingerprints of 64 bits: every link within the radius. Wider ones: each link with a chance of 95 % or more, and those
    up to reach bits as they are met.
    """
    n, reach = nodes.count(), reach or radius
    if width == 64:
        m = parts or _choose(n, radius)
        plan = Plan(_parts(nodes, m, 64), radius - m + 1, radius)
    else:
        m, w = _wide_parts(n, radius, width)
        first = min(m, width // w)
        parts_of = _parts(nodes, first, first * w) + more_parts(m - first, w, width)
        plan = Plan(parts_of, 0, reach)
    _counted(nodes, plan)
    _crowded(nodes, plan, n)
    placed = nodes.select("fp", "node").mapInArrow(trimmed(_placed(plan)), "part int, value long, salt int, fp binary, node long")
    keys = ["part", "value", "salt"]
    # links that are certain meet by their node, not by the value they share
    spread = F.when(F.col("part") < 0, F.col("node")).otherwise(F.xxhash64(*keys)).alias("spread")
    return placed.withColumn("spread", spread).repartition("spread").sortWithinPartitions(*keys).drop("spread").mapInArrow(trimmed(_verified(reach)), "a long, b long")


def _components(rows: DataFrame, radius: int, width: int) -> DataFrame:
    """fp and component_id of every fingerprint in rows (doc_id, fp), as a written table."""
    own = rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    nodes = written(own.select("fp", "least", F.coalesce("least", F.lit(NAMELESS) + F.pmod(F.xxhash64("fp"), F.lit(1 << 61))).alias("node"), "copies"))
    roots = written(components(near_pairs(nodes, radius, width)))
    of = nodes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("root"))
    return written(of.select("fp", F.when(F.col("root") < NAMELESS, F.col("root")).alias("component_id")))


def simhash_components(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the smallest doc_id reachable by links) of every row.

    Null or wordless texts have fingerprint zero and link like any other. Repeated doc_ids stay rows of their own.
    Rows without a doc_id link too; a component of only such rows has a null component_id. Other columns are ignored.
    """
    rows = written(fingerprints(docs, shingle, seed))
    return rows.join(_components(rows, radius, 64), "fp").select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def bits_apart(similarity: float, width: int = WIDE, slack: float = 1.2) -> int:
    """Bits in which wide fingerprints of that Jaccard similarity differ, and so many standard deviations more."""
    share = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(width * share + slack * (width * share * (1 - share)) ** 0.5)


def _sent(many: int, by: str, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows bucket and data, of items and their nodes (and more columns), by the hash of either."""
    key = fmix(columns[0 if by == "item" else 1].astype(np.uint64)) % np.uint64(many)
    order = np.argsort(key, kind="stable")
    key, columns = key[order], tuple(c[order] for c in columns)
    cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])) if len(key) else np.zeros(1, int)
    if len(cuts) > 1:
        data = [blob(*(c[a:b] for c in columns)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        yield pa.record_batch([pa.array(key[cuts[:-1]].astype(np.int64)), pa.array(data, pa.binary())], names=["bucket", "data"])


def _by_item(many: int):
    """The items of rows node, size and items, sent to where they meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, n, seen = [], 0, set()
            for node, size, x in zip(batch["node"].to_pylist(), batch["size"].to_pylist(), batch["items"], strict=True):
                if node in seen:  # a copy
                    continue
                seen.add(node)
                h = np.frombuffer(x.as_py(), np.uint64)
                held.append((h, np.full(len(h), node), np.full(len(h), size, np.int32)))
                n += len(h)
                if n >= 1 << 19:
                    yield from _sent(many, "item", *(np.concatenate(c) for c in zip(*held, strict=True)))
                    held, n = [], 0
            if held:
                yield from _sent(many, "item", *(np.concatenate(c) for c in zip(*held, strict=True)))

    return run


def _met(work, *kinds: type):
    """work on all that was sent to a bucket; a partition has whole buckets, one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((b, x) for batch in batches for b, x in zip(batch["bucket"].to_pylist(), batch["data"], strict=True))
        for _, own in groupby(rows, key=itemgetter(0)):
            yield from work(*(np.concatenate(c) for c in zip(*(unblob(x.as_py(), *kinds) for _, x in own), strict=True)))

    return trimmed(run)


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order by keys, the last one first, where its values begin there, and how often each stands."""
    order = np.lexsort(keys)
    last = keys[-1][order]
    starts = np.flatnonzero(np.concatenate([[True], last[1:] != last[:-1]]))
    return order, starts, np.diff(np.append(starts, len(last)))


def _shared_counted(similarity: float):
    """Nodes with how many of their items others have too, and how many each must have that has a partner; rows may repeat."""

    def work(item: np.ndarray, node: np.ndarray, size: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((node, item))
        item, node, size = item[order], node[order], size[order]
        own = np.concatenate([[True], (item[1:] != item[:-1]) | (node[1:] != node[:-1])])
        item, node, size = item[own], node[own], size[own]
        _, _, n = _runs(item)
        many = np.repeat(n, n) > 1
        nodes, at, shared = np.unique(node[many], return_index=True, return_counts=True)
        least = [least_shared(s, similarity) for s in size[many][at].tolist()]
        yield pa.record_batch([pa.array(nodes), pa.array(shared.astype(np.int64)), pa.array(least, pa.int64())], names=["node", "n", "least"])

    return work


def _counted_back(many: int):
    """Items that several nodes have, and how many, sent to their nodes."""

    def work(item: np.ndarray, node: np.ndarray, size: np.ndarray) -> Iterator[pa.RecordBatch]:
        order, _, n = _runs(item)
        n = np.repeat(n, n)
        order, n = order[n > 1], n[n > 1]
        yield from _sent(many, "node", item[order], node[order], size[order], n.astype(np.int32))

    return work


def _rarest(many: int, similarity: float):
    """Of each node the items among its rarest, as many as its prefix has, that others have too, sent to where they meet."""

    def work(item: np.ndarray, node: np.ndarray, size: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        order, starts, shared = _runs(item, n, node)
        # items that no other node has are the rarest
        take = np.array([prefix(s, similarity) for s in size[order[starts]].tolist()]) - (size[order[starts]] - shared)
        order = order[np.arange(len(order)) - np.repeat(starts, shared) < np.repeat(take, shared)]
        yield from _sent(many, "item", item[order], node[order])

    return work


def _stars(item: np.ndarray, node: np.ndarray) -> Iterator[pa.RecordBatch]:
    order, starts, n = _runs(node, item)
    a, b = node[order], np.repeat(node[order[starts]], n)
    yield pa.record_batch([pa.array(a[a != b]), pa.array(b[a != b])], names=["a", "b"])


def _many(sets: DataFrame) -> int:
    """Buckets by bytes alone: each task sends a row to each, so they must not grow with the tasks."""
    return max(64, input_bytes(sets) // (4 << 20))


def _at_buckets(sent: DataFrame) -> DataFrame:
    return sent.repartition("bucket").sortWithinPartitions("bucket")


def sharing(firsts: DataFrame, similarity: float) -> DataFrame:
    """node of the sets in firsts (node, size and items, its first by hash; rows may repeat) that may have a partner of that Jaccard similarity: so many of those items others have."""
    sent = firsts.mapInArrow(trimmed(_by_item(_many(firsts))), "bucket long, data binary")
    shared = _at_buckets(sent).mapInArrow(_met(_shared_counted(similarity), np.uint64, np.int64, np.int32), "node long, n long, least long")
    return shared.groupBy("node").agg(F.sum("n").alias("n"), F.first("least").alias("least")).where("n >= least").select("node")


def candidates(sets: DataFrame, similarity: float) -> DataFrame:
    """Links a, b that connect all of that Jaccard similarity or more, and others: sets (written) has node, size and items, whole sets.

    Two such sets share one of their rarest items, as many as their prefixes have. So a node most of whose items no other
    node has is left out, and passages that many texts share connect only what consists of little else.
    """
    many, sent = _many(sets), "bucket long, data binary"
    back = _at_buckets(sets.mapInArrow(trimmed(_by_item(many)), sent)).mapInArrow(_met(_counted_back(many), np.uint64, np.int64, np.int32), sent)
    rare = _at_buckets(back).mapInArrow(_met(_rarest(many, similarity), np.uint64, np.int64, np.int32, np.int32), sent)
    return _at_buckets(rare).mapInArrow(_met(_stars, np.uint64, np.int64), "a long, b long")


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    """own and items, the sorted shingle hashes, of docs (own, text as bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch["own"], pa.array([shingles(x.as_py(), shingle).tobytes() for x in batch["text"]], pa.binary())], names=["own", "items"])

    return docs.select("own", "text").mapInArrow(trimmed(run), "own binary, items binary")


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets have that Jaccard similarity or more; two empty ones have."""
    small, large = min(len(a), len(b)), max(len(a), len(b))
    if small < similarity * large:
        return False
    both = small + large - len(np.union1d(a, b))
    return both >= similarity * (small + large - both)


def _to_pivot(similarity: float):
    """node, pivot and whether they are alike, of rows that have both sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [alike(np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64), similarity) for a, b in zip(batch["items"], batch["most"], strict=True)]
            yield pa.record_batch([batch["node"], batch["pivot"], pa.array(near, pa.bool_())], names=["node", "pivot", "near"])

    return run


def _compared(similarity: float):
    """Spanning links between the asking rows of a group and the others; rows that are linked already are not compared."""

    def links(group: pa.Table) -> pa.Table:
        node, ask = group["node"].to_numpy(), group["ask"].to_numpy(zero_copy_only=False)
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in group["items"]]
        others, root, out = np.flatnonzero(~ask), {int(n): int(n) for n in node}, []

        def top(n: int) -> int:
            while root[n] != n:
                root[n] = n = root[root[n]]
            return n

        # those that their pivot has linked are one from the start
        for n, p in zip(node.tolist(), group["pivot"].to_pylist(), strict=True):
            if p is not None:
                root.setdefault(p, p)
                root[top(n)] = top(p)
        for i in np.flatnonzero(ask).tolist():
            for j in others.tolist():
                a, b = top(int(node[i])), top(int(node[j]))
                if a != b and alike(sets[i], sets[j], similarity):
                    root[a] = b
                    out.append((int(node[i]), int(node[j])))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([x for _, x in out], pa.int64())})

    return links


def verified_links(near: DataFrame, similarity: float) -> DataFrame:
    """Links a, b that connect what has that Jaccard similarity or more: near (written) has node, root and items, and only rows of one root are compared.

    Roots of over BLOCK nodes have a pivot: nodes that are alike to it are linked to it, and only the others, which
    open, are compared with all, block by block. So what a group of near copies takes grows with its size.
    """
    many = near.groupBy("root").agg(F.count("*").alias("n"), F.min("node").alias("pivot")).where(F.col("n") > BLOCK)
    pivots = written(many.join(near.select(F.col("node").alias("pivot"), F.col("items").alias("most")), "pivot").select("root", "pivot", "most"))
    told = written(near.join(F.broadcast(pivots), "root").mapInArrow(trimmed(_to_pivot(similarity)), "node long, pivot long, near boolean"))
    own = near.join(told.where("near").select("node", "pivot"), "node", "left")
    sizes = own.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"), F.ceil(F.count(F.when(F.col("pivot").isNull(), 1)) / BLOCK).alias("opens"))
    own = own.join(F.broadcast(written(sizes.where("blocks > 1"))), "root", "left").na.fill(1, ["blocks", "opens"])
    block = F.pmod(F.xxhash64("node"), F.col("blocks"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    asks = own.where(F.col("pivot").isNull()).select("root", F.pmod(F.xxhash64("node"), F.col("opens")).alias("i"), every("blocks").alias("j"), "node", "pivot", "items", F.lit(True).alias("ask"))
    has = own.where("opens > 0").select("root", every("opens").alias("i"), block.alias("j"), "node", "pivot", "items", F.lit(False).alias("ask"))
    open_links = asks.unionByName(has).groupBy("root", "i", "j").applyInArrow(_compared(similarity), "a long, b long")
    return open_links.unionByName(told.where("near").select(F.col("node").alias("a"), F.col("pivot").alias("b")))


def one_of_each(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs, whole, that stand for their group of near-duplicates: the row of the group's smallest doc_id (and text hash).

    Groups are components of all pairs of rows whose sets of shingles (64-bit hashes) have that Jaccard similarity or more,
    whatever else is in docs. Shared items only say which rows are compared, and leave out no such pair. Rows are
    decided each for itself: rows that repeat a doc_id stay if their texts are of different groups; those of one text are
    one. Rows without a doc_id stay. Texts without words are copies of each other.
    """
    rows = written(first_shingles(docs, shingle, similarity))
    nodes = written(rows.groupBy("node").agg(F.min("own").alias("own"), F.first("size").alias("size")))
    some = written(sharing(rows.select("node", "size", "items"), similarity))
    texts = binary(docs.select("text", _digest().alias("own")))
    wanted = written(nodes.join(some, "node"))
    sets = _sets(texts.dropDuplicates(["own"]).join(wanted.select("own"), "own", "left_semi"), shingle)  # copies fall together before they are sent
    whole = written(wanted.join(sets, "own").select("node", "size", "items"))
    reached = written(components(candidates(whole, similarity)))
    near = written(whole.join(reached, "node").select("node", "root", "items"))
    roots = written(components(verified_links(near, similarity)))
    found = rows.join(roots, "node", "left").select("doc_id", "own", F.coalesce("root", "node").alias("root"))
    kept = written(found.where(F.col("doc_id").isNotNull()).groupBy("root").agg(F.min(F.struct("doc_id", "own")).alias("least")).select("least.doc_id", "least.own").distinct())
    name, digest = "_sparkloom_id", "_sparkloom_own"
    named = docs.withColumn(name, F.col("doc_id").cast("long")).withColumn(digest, _digest())
    chosen = named.join(kept.select(F.col("doc_id").alias(name), F.col("own").alias(digest)), [name, digest], "left_semi").dropDuplicates([name, digest]).drop(name, digest)
    return chosen.unionByName(docs.where(F.col("doc_id").isNull()))
