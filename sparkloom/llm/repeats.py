"""Repeated word windows across documents: seeds that meet by their words, extended both ways.

Every window of W words belongs to one seed inside it: of the grams that start in its first `span` + 1 places, the one
of least hash, the first of equals (a minimiser; equal windows choose the same). Windows that share a seed are one entry:
the hash of the seed's first W - span words, its key, and the words left and right of those that its windows hold. Entries
come together by key. There those of one key are sorted by their words to the right, and neighbours are compared: the
lengths of their common prefixes tell which entries agree on how many words; the same to the left. Windows agree where
both extensions together leave none of their words out, and what overlaps is merged to maximal repeats. A window
takes part exactly once, and no pair of documents is ever made: a group of copies costs its own length, however large.

Skew: before the shuffle each task compares its own entries. Of those it has seen in several documents it sends only
that of the smallest doc_id, and settles the others on the spot, so that a passage which a third of all documents share
sends one entry a task. A key that very many entries share among different words is no key: its windows go out one by
one, each under the hash of all its words. Which keys those are is told by counts over one document in SHARE; it decides
where windows meet, never whether.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.common import binary, binary_array, blob, buckets, fmix, hashed, trimmed, unblob, word_chunks

#: Words that are compared within a task before anything is sent.
FLUSH = 1 << 20
#: Words that are hashed at a time.
STEP = 1 << 17
#: Entries under a key beyond which its windows go one by one; documents of which one is counted for that; keys at most that are.
CROWD, SHARE, KEYS = 1 << 18, 16, 1 << 20
#: Stands for the length to the right of an entry that is one whole window.
WHOLE = 255
_BASE = np.uint64(0x9E3779B97F4A7C15)
_LONE = np.uint64(0xD6E8FEB86659FD93)
_SEALED = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("data", T.BinaryType())])
_FLAGS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("flags", T.BinaryType())])
#: An entry: key, doc_id, tag of its row, place of its key, words it has left and right of that, hash of all; and how many words follow in the list of words.
_KINDS = (np.uint64, np.int64, np.uint16, np.uint32, np.uint8, np.uint8, np.uint64)


class _Powers:
    """Powers of an odd base modulo 2^64 and their inverses."""

    def __init__(self, n: int):
        self.up, self.down = (np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, b, np.uint64))]) for b in (_BASE, np.uint64(pow(int(_BASE), -1, 1 << 64))))

    def grams(self, sums: np.ndarray, k: int) -> np.ndarray:
        """Hashes of all k-grams, from the sums of hash times power."""
        n = len(sums) - k
        return fmix((sums[k:] - sums[:n]) * self.down[:n]) if n > 0 else np.zeros(0, np.uint64)


class _Entries:
    """Collects the entries of texts."""

    def __init__(self, window: int, k: int, span: int, hot: np.ndarray):
        self.window, self.k, self.span, self.hot, self.powers = window, k, span, hot, _Powers(STEP + 2 * window)
        self.rows: list[tuple[np.ndarray, ...]] = []
        self.held = 0
        self.clear()

    def clear(self) -> None:
        self.h, self.d, self.t, self.s, self.n = [], [], [], [], 0

    def add(self, doc_id: int, tag: int, text: bytes) -> None:
        start, rest = 0, np.zeros(0, np.uint64)
        for words in word_chunks(text):
            h = np.concatenate([rest, hashed(words)])
            while len(h) >= self.window:
                part = h[: STEP]
                self.h.append(part)
                self.d.append(doc_id)
                self.t.append(tag)
                self.s.append(start)
                self.n += len(part)
                if self.n >= STEP:
                    self.step()
                step = len(part) - self.window + 1
                h, start = h[step:], start + step
            rest = h

    def step(self) -> None:
        """Entries of what was added; a part's windows lie inside it."""
        at = 0
        while at < len(self.h):
            n, to = 0, at
            while to < len(self.h) and (to == at or n + len(self.h[to]) <= STEP):
                n += len(self.h[to])
                to += 1
            self._found(self.h[at:to], self.d[at:to], self.t[at:to], self.s[at:to])
            at = to
        self.clear()

    def _found(self, parts: list, docs: list, tags: list, starts: list) -> None:
        h, w, span = np.concatenate(parts), self.window, self.span
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * self.powers.up[: len(h)], dtype=np.uint64)])
        lengths = np.array([len(p) for p in parts])
        first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        part = np.repeat(np.arange(len(parts)), lengths - w + 1)
        at = np.arange(len(part)) + np.repeat(first - np.concatenate([[0], np.cumsum(lengths - w + 1)[:-1]]), lengths - w + 1)
        grams = self.powers.grams(sums, self.k)
        seed = at + _least(grams, span + 1)[at]
        new = np.flatnonzero(np.concatenate([[True], (seed[1:] != seed[:-1]) | (part[1:] != part[:-1])]))
        seed, lo, hi, part = seed[new], at[new], at[np.concatenate([new[1:], [len(at)]]) - 1], part[new]
        key = self.powers.grams(sums, w - span)[seed]
        left, right = seed - lo, hi + span - seed
        if len(self.hot) and (crowd := np.isin(key, self.hot)).any():  # a window alone has no words besides its key
            n = (hi - lo + 1)[crowd]
            alone = np.repeat(lo[crowd], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            own = np.repeat(part[crowd], n)
            stay = ~crowd
            key = np.concatenate([key[stay], fmix(self.powers.grams(sums, w)[alone] + _LONE)])
            seed, lo, hi, part = (np.concatenate([x[stay], y]) for x, y in ((seed, alone), (lo, alone), (hi, alone), (part, own)))
            left, right = (np.concatenate([x[stay], np.full(len(alone), y)]) for x, y in ((left, 0), (right, WHOLE)))
        whole = fmix((sums[hi + w] - sums[lo]) * self.powers.down[lo] + (left * 256 + right).astype(np.uint64))
        more = np.where(right == WHOLE, 0, right)
        before, after = _runs(seed - 1, left, -1), _runs(seed + w - span, more, 1)
        place = np.concatenate([np.repeat(np.cumsum(left + more) - more - left, left) + _counts(left), np.repeat(np.cumsum(left + more) - more, more) + _counts(more)])
        words = np.empty(len(place), np.uint32)
        words[place] = (h[np.concatenate([before, after])] >> np.uint64(32)).astype(np.uint32)
        columns = (key, np.array(docs, np.int64)[part], np.array(tags, np.uint16)[part], np.array(starts, np.int64)[part] + seed - first[part], left, right, whole)
        self.rows.append((*(c.astype(k) for c, k in zip(columns, _KINDS, strict=True)), words))
        self.held += len(at)

    def take(self) -> list[np.ndarray]:
        self.step()
        out = [np.concatenate(x) for x in zip(*self.rows, strict=True)] if self.rows else []
        self.rows, self.held = [], 0
        return out


def _counts(n: np.ndarray) -> np.ndarray:
    """0 to n - 1 for each n."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _runs(start: np.ndarray, n: np.ndarray, step: int) -> np.ndarray:
    return np.repeat(start, n) + step * _counts(n)


def _least(grams: np.ndarray, w: int) -> np.ndarray:
    """The place of the first least value in each w values: by doubling, in the logarithm of w passes."""
    best = np.arange(len(grams))
    span = 1
    while span < w:
        step = min(span, w - span)
        left, right = best[: len(best) - step], best[step:]
        best = np.where(grams[right] < grams[left], right, left)
        span += step
    return best - np.arange(len(best))


def _picked(x: list[np.ndarray], rows: np.ndarray) -> list[np.ndarray]:
    """Those rows of entries, with their words."""
    left, right = x[4].astype(int), np.where(x[5] == WHOLE, 0, x[5]).astype(int)
    n = left + right
    start = np.cumsum(n) - n
    return [*(c[rows] for c in x[:7]), x[7][_runs(start[rows], n[rows], 1)], *x[8:]]


def _meet(key: np.ndarray, doc: np.ndarray, several: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row, whether a smaller doc_id has its key, and whether any other has; several: rows known to be shared."""
    if not len(key):
        return np.zeros(0, bool), np.zeros(0, bool)
    order = np.lexsort((doc, key))
    k, d = key[order], doc[order]
    new = np.concatenate([[True], k[1:] != k[:-1]])
    group = np.cumsum(new) - 1
    starts = np.flatnonzero(new)
    least, most = d[starts], d[np.concatenate([starts[1:], [len(d)]]) - 1]
    shared = (least != most) | np.maximum.reduceat(several[order], starts)
    later, other = np.empty(len(key), bool), np.empty(len(key), bool)
    later[order], other[order] = d > least[group], shared[group]
    return later, other


def _ranges(doc: np.ndarray, tag: np.ndarray, start: np.ndarray, later: np.ndarray, window: int, end: np.ndarray) -> pa.RecordBatch:
    """Repeated words from start to end, merged, by document: first of all the copies (0), or a later copy (1)."""
    order = np.lexsort((end, start, later, tag, doc))
    doc, tag, start, later, end = doc[order], tag[order], start[order], later[order], end[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]) | (later[1:] != later[:-1]) | (start[1:] > end[:-1])]) if len(doc) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    end = np.maximum.reduceat(end, at) if len(at) else at
    rows = np.stack([start[at], end, later[at].astype(np.int64) + 2 * tag[at].astype(np.int64)], axis=1).astype(np.uint32)
    docs = doc[at]
    own = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]])) if len(docs) else at
    return pa.record_batch([pa.array(docs[own]), binary_array(rows.tobytes(), np.concatenate([own, [len(docs)]]) * 12)], names=["doc_id", "flags"])


def _seal(x: list[np.ndarray], window: int, span: int, n: int) -> pa.RecordBatch:
    """What a task sends: its entries by bucket of their key, and under negative buckets what it has settled."""
    later, other = _meet(x[6], x[1], np.zeros(len(x[0]), bool))
    gone = _picked(x, np.flatnonzero(later))
    first, after = gone[3].astype(np.int64) - gone[4], np.where(gone[5] == WHOLE, span, gone[5])
    settled = _ranges(gone[1], gone[2], first, np.ones(len(first), bool), window, gone[3] + np.int64(window - span) + after)
    bucket = (x[0] % np.uint64(n)).astype(np.int64)
    order = np.lexsort((x[3], x[2], x[1], bucket))
    order = order[~later[order]]
    x, other, bucket = _picked(x, order), other[order], bucket[order]
    sizes = np.concatenate([[0], np.cumsum(x[4].astype(int) + np.where(x[5] == WHOLE, 0, x[5]))])
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(bucket) else np.zeros(1, int)
    names, data = [], []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        names.append(int(bucket[a]))
        data.append(blob(x[0][a:b], np.diff(x[1][a:b], prepend=0), x[2][a:b], x[3][a:b], x[4][a:b], x[5][a:b], other[a:b].astype(np.uint8), x[7][sizes[a] : sizes[b]]))
    for d, f in zip(settled["doc_id"].to_pylist(), settled["flags"].to_pylist(), strict=True):
        names.append(-1 - d if d >= 0 else -(1 << 62) - d)
        data.append(np.int64(d).tobytes() + f)
    return pa.record_batch([pa.array(names, pa.int64()), pa.array(data, pa.binary())], names=["bucket", "data"])


def _collected(batches: Iterator[pa.RecordBatch], found: _Entries) -> Iterator[list[np.ndarray]]:
    for batch in batches:
        for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
            if doc_id is not None:
                raw = text.as_py()
                found.add(doc_id, tag_of(raw), raw)
            if found.held >= FLUSH:
                yield found.take()
    if rest := found.take():
        yield rest


def _sent(window: int, k: int, span: int, hot: np.ndarray, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _collected(batches, _Entries(window, k, span, hot)):
            yield _seal(x, window, span, n)

    return run


def crowded(own: DataFrame, window: int, k: int, span: int) -> np.ndarray:
    """Keys of over CROWD different entries, in order, as counted over one document in SHARE; of more than KEYS the fullest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _collected(batches, _Entries(window, k, span, np.zeros(0, np.uint64))):
            every = np.unique(np.stack([x[0], x[6]], axis=1), axis=0)[:, 0]
            key, n = np.unique(every, return_counts=True)
            yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(n)], names=["key", "n"])

    some = own.where(F.pmod(F.xxhash64("doc_id", "text", F.lit("share")), F.lit(SHARE)) == 0)
    counts = some.mapInArrow(trimmed(run), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    full = counts.where(F.col("n") > CROWD // SHARE).orderBy(F.desc("n"), "key").limit(KEYS).select("key").toArrow()  # KEYS numbers at most
    return np.sort(full["key"].to_numpy().astype(np.int64).view(np.uint64))


def tag_of(text: bytes) -> int:
    """Tells rows of one doc_id apart."""
    return xxhash.xxh64_intdigest(text) & 0xFFFF


def sorted_neighbours(key: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in the order of their keys and words, and how many words each shares with the one before it; -1: not the key."""
    n, width = words.shape
    raw = np.empty((n, 8 + 4 * width), np.uint8)
    raw[:, :8], raw[:, 8:] = key.astype(">u8")[:, None].view(np.uint8), np.ascontiguousarray(words.astype(">u4")).view(np.uint8).reshape(n, 4 * width)
    order = np.argsort(raw.view(f"S{raw.shape[1]}").ravel(), kind="stable")
    key, words = key[order], words[order]
    apart = np.concatenate([words[1:] != words[:-1], np.ones((max(n - 1, 0), 1), bool)], axis=1)
    common = np.where(key[1:] == key[:-1], apart.argmax(axis=1), -1)
    return order, np.concatenate([[-1], common]) if n else common


def _classes(key: np.ndarray, words: np.ndarray) -> Iterator[np.ndarray]:
    """For 0, 1, 2, ... words: numbers that are equal where keys and so many words are."""
    order, common = sorted_neighbours(key, words)
    for depth in range(words.shape[1] + 1):
        out = np.empty(len(key), np.int64)
        out[order] = np.cumsum(common < depth)
        yield out


def _extended(window: int, span: int):
    def settle(blobs: list[bytes]) -> pa.RecordBatch:
        parts = [unblob(x, *_KINDS[:6], np.uint8, np.uint32) for x in blobs]
        for p in parts:
            p[1] = np.cumsum(p[1])
        key, doc, tag, at, left, right, several, words = (np.concatenate(x) for x in zip(*parts, strict=True))
        _, other = _meet(key, doc, several.astype(bool))
        key, doc, tag, at, left, right, several, words = _picked([key, doc, tag, at, left, right, several, words], np.flatnonzero(other))
        left, lone = left.astype(int), right == WHOLE
        right = np.where(lone, 0, right).astype(int)
        rows, start = np.arange(len(key)), np.cumsum(left + right) - left - right
        before, after = np.zeros((len(key), span), np.uint32), np.zeros((len(key), span), np.uint32)
        before[np.repeat(rows, left), _counts(left)] = words[_runs(start, left, 1)]
        after[np.repeat(rows, right), _counts(right)] = words[_runs(start + left, right, 1)]
        to_left = list(_classes(key, before))
        to_right = list(_classes(key, after))
        # windows that begin so many words left of the key: equal if they agree on those and on the rest to the right
        own = [np.flatnonzero((left >= t) & (right >= span - t) & ~lone) for t in range(span + 1)] + [np.flatnonzero(lone)]
        size = len(key) + 1
        met = [(t * size + to_left[t][i]) * size + to_right[span - t][i] for t, i in enumerate(own[:-1])] + [(span + 1) * size * size + to_left[0][own[-1]]]
        of, t = np.concatenate(own), np.repeat(np.append(np.arange(span + 1), 0), [len(i) for i in own])
        later, shared = _meet(np.concatenate(met), doc[of], several[of].astype(bool))
        of, t, later = of[shared], t[shared], later[shared]
        first = at[of].astype(np.int64) - t
        return _ranges(doc[of], tag[of], first, later, window, first + window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, blobs = None, []
        for batch in batches:
            docs, flags = [], []
            for b, data in zip(batch["bucket"].to_pylist(), batch["data"].to_pylist(), strict=True):
                if b < 0:
                    docs.append(int.from_bytes(data[:8], "little", signed=True))
                    flags.append(data[8:])
                    continue
                if b != bucket and blobs:
                    yield settle(blobs)
                    blobs = []
                bucket = b
                blobs.append(data)
            if docs:
                yield pa.record_batch([pa.array(docs, pa.int64()), pa.array(flags, pa.binary())], names=["doc_id", "flags"])
        if blobs:
            yield settle(blobs)

    return run


def repeats(docs: DataFrame, window: int, k: int, span: int) -> DataFrame:
    """doc_id and flags, a list of blobs, for the documents that hold a window which another document holds too.

    told() reads the blobs: first word and end of words that repeated windows cover, 1 if a smaller doc_id
    holds them too, else 0, and the row's tag_of(). Rows of null doc_id take no part. The windows of one document
    are not compared with each other. Seeds are k-grams that start in a window's first span + 1 places; a key is told by 64
    bits of hash, each further word by 32.
    """
    if not 1 <= k <= window - span < window <= 250:
        raise ValueError("a seed must lie in the window's first words, and windows have 250 words at most")
    own, n = binary(docs.select("doc_id", "text")), buckets(docs)
    hot = crowded(own, window, k, span)
    sealed = own.mapInArrow(trimmed(_sent(window, k, span, hot, n)), _SEALED)
    met = sealed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(trimmed(_extended(window, span)), _FLAGS)
    return met.groupBy("doc_id").agg(F.collect_list("flags").alias("flags"))


def told(flags: list[bytes] | None) -> np.ndarray:
    """Rows of four numbers from one document's blobs."""
    rows = np.frombuffer(b"".join(flags or ()), np.uint32).reshape(-1, 3).astype(np.int64)
    return np.column_stack([rows[:, :2], rows[:, 2] & 1, rows[:, 2] >> 1])


def covered(flags: list[bytes] | None, tag: int) -> np.ndarray:
    """The rows of one document's blobs that are its own."""
    rows = told(flags)
    return rows[rows[:, 3] == tag]


def merged(rows: np.ndarray) -> list[tuple[int, int]]:
    """Overlapping or touching ranges of words as maximal ones."""
    out: list[list[int]] = []
    for a, b in sorted((int(r[0]), int(r[1])) for r in rows):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]
