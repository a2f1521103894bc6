"""LM scoring by a gated recurrent language model: truncated backpropagation in numpy, class-factored softmax.

Word counts, the vocabulary, the classes and the open-vocabulary tail come from all training documents. The network is
fitted on all of them too, each once, in shards: each starts from the common parameters, and what the shards learned is
averaged after every round. Learning and scoring both run over whole documents: the state is carried from window to
window, so a score is the complete document's log-likelihood. Texts are read twice, by Arrow's kernels: once for the
counts, once for the numbers of their words, from which documents are learned and scored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import groupby, islice
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import binary, binary_array, trimmed, written

#: Words with a vector of their own (two places are for unknown words and the end), words in a class, and the state's width.
VOCABULARY, CLASS, WIDTH = 4096, 64, 24
#: Words whose counts every task knows; rarer ones are looked up by a join.
COMMON = 300_000
UNKNOWN, END = 0, 1
#: Rounds that training documents are dealt to, each to one; steps that are backpropagated through; Adagrad's rate.
ROUNDS, WINDOW, RATE = 2, 32, 0.12
#: Tokens of a shard; lanes that learn together: as many as leave a shard UPDATES steps a round, within bounds.
SHARD, LANES, LEAST_LANES, UPDATES = 4_000_000, 256, 8, 100
FOLDS, HELD_OUT = 7, 2
#: Lanes of a scoring batch, its tokens, and states that meet the softmax together.
SCORE_LANES, BATCH, TOGETHER = 256, 4_000_000, 32_768
#: Words that a task counts before it sends them on, and bytes of text that are split into words at a time.
_COUNTER, _PIECE = 500_000, 1 << 24
_FLOATS = 1 << 14
#: Rows whose logits are held at a time, and rows of a word from which on they are summed by themselves.
_BLOCK, _LONG = 2048, 8
#: Rows up to which classes are learned from together, and how many of them.
_FEW, _STACK = 256, 8


class Gru:
    """Parameters: input vectors already multiplied by the gates' weights, recurrent weights, classes, words by class."""

    def __init__(self, params: dict[str, np.ndarray]):
        self.p = params

    @classmethod
    def fresh(cls, mass: np.ndarray) -> Gru:
        """Starts as the unigram model of the masses."""
        rng, v, h, c = np.random.default_rng(7), len(mass), WIDTH, len(mass) // CLASS
        by = mass.reshape(c, CLASS)
        own = by.sum(axis=1)
        f = np.float32
        return cls({
            "wx": rng.normal(0, 0.3, (v, 3 * h)).astype(f), "bx": np.zeros(3 * h, f), "u": rng.normal(0, h**-0.5, (h, 3 * h)).astype(f),
            "wc": rng.normal(0, 0.05, (h, c)).astype(f), "bc": np.log(own / own.sum()).astype(f),
            "wo": rng.normal(0, 0.02, (c, CLASS, h)).astype(f), "bo": np.log(by / own[:, None]).astype(f),
        })

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in sorted(self.p)])

    def load(self, flat: np.ndarray) -> Gru:
        out, at = {}, 0
        for k in sorted(self.p):
            n = self.p[k].size
            out[k] = np.array(flat[at : at + n].reshape(self.p[k].shape), np.float32)  # a copy: flat may be a broadcast that others start from
            at += n
        return Gru(out)

    def run(self, x: np.ndarray, fresh: np.ndarray, h: np.ndarray, keep: bool = False) -> tuple:
        """States of a window: x the words before, fresh where a document starts, h the state carried in; kept for
        backpropagation: of all steps the state before, gates and candidate, and the candidate's recurrent part.

        Inside, a lane is a column, so that gates are whole blocks of memory.
        """
        p, w = self.p, WIDTH
        steps, bias = np.ascontiguousarray(p["wx"].take(x, axis=0).transpose(0, 2, 1)), p["bx"][:, None]
        np.subtract(-bias[: 2 * w], steps[:, : 2 * w], out=steps[:, : 2 * w])
        steps[:, 2 * w :] += bias[2 * w :]
        hs, ut, h = np.empty((len(x), w, x.shape[1]), steps.dtype), np.ascontiguousarray(p["u"].T), np.ascontiguousarray(h.T)
        before, recurrent = (np.empty_like(hs), np.empty_like(hs)) if keep else (None, None)
        starts = fresh.any(axis=1).tolist()
        for t, step in enumerate(steps):
            if starts[t]:
                h = np.where(fresh[t], 0, h).astype(steps.dtype, copy=False)
            hu = ut @ h
            zr, n, hn = step[: 2 * w], step[2 * w :], hu[2 * w :]
            zr -= hu[: 2 * w]
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            if keep:
                before[t], recurrent[t] = h, hn
            hn = hn * zr[w:]
            n += hn
            n += n  # tanh as 1 - 2 / (exp(2 n) + 1): numpy's own takes twice the time of its exp
            np.exp(n, out=n)
            n += 1
            np.divide(-2, n, out=n)
            n += 1
            h = np.subtract(h, n, out=hs[t])
            h *= zr[:w]
            h += n
        return hs.transpose(0, 2, 1), np.ascontiguousarray(h.T), (before, steps, recurrent)

    def losses(self, hs: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Natural log-probabilities of words y after states hs (rows)."""
        p = self.p
        c = (y // CLASS).astype(np.int16)  # short numbers are sorted by radix
        order = np.argsort(c, kind="stable")
        hs, y, c = hs.take(order, axis=0), y[order], c[order]
        sure, sums = _chances(hs, p["wc"], p["bc"], c)
        within = y % CLASS
        for k, a, b in _runs(c):
            own, total = _chances(hs[a:b], p["wo"][k].T, p["bo"][k], within[a:b])
            sure[a:b] += own
            sums[a:b] *= total
        out = np.empty(len(y), np.float32)
        out[order] = sure - np.log(sums)
        return out

    def gradients(self, x: np.ndarray, y: np.ndarray, valid: np.ndarray, fresh: np.ndarray, h: np.ndarray) -> tuple:
        """Backpropagation through one window: the mean loss's gradients, those of words by row, and the state to carry."""
        p, w = self.p, WIDTH
        hs, last, (before, gates, recurrent) = self.run(x, fresh, h, True)
        at = np.flatnonzero(valid.ravel())
        c = (y.ravel()[at] // CLASS).astype(np.int16)
        turn = np.argsort(c, kind="stable")  # so that each class is a slice
        order, c = at[turn], c[turn]
        flat, within, scale = hs.reshape(-1, w).take(order, axis=0), y.ravel()[order] % CLASS, np.float32(1 / max(len(at), 1))
        g = {"wo": np.zeros_like(p["wo"]), "bo": np.zeros_like(p["bo"])}
        g["wc"], g["bc"], dflat = _slopes(flat, p["wc"], p["bc"], c, scale)
        few = []
        for k, a, b in _runs(c):
            if b - a <= _FEW:
                few.append((b - a, a, k))
                continue
            own, g["bo"][k], more = _slopes(flat[a:b], p["wo"][k].T, p["bo"][k], within[a:b], scale)
            g["wo"][k] = own.T
            dflat[a:b] += more
        few.sort()
        for i in range(0, len(few), _STACK):
            n, a, k = np.array(few[i : i + _STACK]).T
            rows, there, g["wo"][k], g["bo"][k], more = _stacked(flat, a, n, p["wo"][k], p["bo"][k], within, scale)
            dflat[rows] += more[there]
        dhs = np.zeros((x.size, w), hs.dtype)
        dhs[order] = dflat
        dhs = np.ascontiguousarray(dhs.reshape(*x.shape, w).transpose(0, 2, 1))
        z, r, n = gates[:, :w], gates[:, w : 2 * w], gates[:, 2 * w :]
        to_z, to_n, to_r = (before - n) * z * (1 - z), (1 - z) * (1 - n * n), recurrent * r * (1 - r)
        # some lanes more than there are: rows a power of two apart would share their lines of the cache when turned
        dx = np.empty((*gates.shape[:2], gates.shape[2] + 16), gates.dtype)[:, :, : gates.shape[2]]
        du, carry = np.empty_like(gates), np.zeros_like(dhs[0])
        starts = fresh.any(axis=1).tolist()
        for t in range(len(x) - 1, -1, -1):
            dh, own, back = dhs[t], dx[t], du[t]
            dh += carry
            np.multiply(dh, to_z[t], out=own[:w])
            dn = np.multiply(dh, to_n[t], out=own[2 * w :])
            np.multiply(dn, to_r[t], out=own[w : 2 * w])
            back[: 2 * w] = own[: 2 * w]
            np.multiply(dn, r[t], out=back[2 * w :])
            carry = p["u"] @ back
            dh *= z[t]
            carry += dh
            if starts[t]:
                carry[:, fresh[t]] = 0
        rows = np.ascontiguousarray(dx.transpose(0, 2, 1)).reshape(-1, 3 * w)
        g["u"], g["bx"] = np.matmul(before, du.transpose(0, 2, 1)).sum(axis=0), np.ones(len(rows), rows.dtype) @ rows
        word = x.ravel().astype(np.int16)
        order = np.argsort(word, kind="stable")
        word = word[order]
        words, starts, ends = (np.array(a) for a in zip(*_runs(word), strict=True))
        return g, words, _summed(rows.take(order, axis=0), starts, ends), last


def _runs(x: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Value, start and end of each run of equal numbers."""
    cuts = np.flatnonzero(x[1:] != x[:-1]) + 1
    starts = [0, *cuts.tolist()] if len(x) else []
    return zip(x[starts].tolist() if starts else [], starts, [*starts[1:], len(x)], strict=False)


def _summed(rows: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of runs of rows: long runs one by one, the others together, a row of each at a time."""
    out, n, ones = rows.take(starts, axis=0), ends - starts, np.ones(len(rows), rows.dtype)
    for i in np.flatnonzero(n > _LONG).tolist():
        np.matmul(ones[: n[i]], rows[starts[i] : ends[i]], out=out[i])
    rest, k = np.flatnonzero((n > 1) & (n <= _LONG)), 1
    while len(rest):
        out[rest] += rows.take(starts[rest] + k, axis=0)
        k += 1
        rest = rest[n[rest] > k]
    return out


def _chances(hs: np.ndarray, w: np.ndarray, b: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's own logit and the sum of the exponentials of all, a block at a time, which stays in the cache."""
    sure, sums, ones, at = np.empty(len(hs), hs.dtype), np.empty(len(hs), hs.dtype), np.ones(len(b), hs.dtype), np.arange(min(len(hs), _BLOCK))
    for i in range(0, len(hs), _BLOCK):
        x = hs[i : i + _BLOCK] @ w
        x += b
        sure[i : i + _BLOCK] = x[at[: len(x)], own[i : i + _BLOCK]]
        if x.max() > 80:
            np.minimum(x, 80, out=x)
        np.exp(x, out=x)
        sums[i : i + _BLOCK] = x @ ones
    return sure, sums


def _stacked(hs: np.ndarray, starts: np.ndarray, n: np.ndarray, w: np.ndarray, b: np.ndarray, own: np.ndarray, scale: np.float32) -> tuple:
    """_slopes() of several classes of few rows each, a layer a class; the last row fills up those that are shorter and counts once."""
    at = np.arange(n[-1])
    there, rows = at < n[:, None], starts[:, None] + np.minimum(at, n[:, None] - 1)
    h = hs.take(rows, axis=0)
    x = h @ w.transpose(0, 2, 1)
    x += b[:, None]
    if x.max() > 80:
        x -= x.max(axis=2, keepdims=True)
    np.exp(x, out=x)
    sums = x @ np.ones(x.shape[2], x.dtype)
    x.reshape(-1, x.shape[2])[np.arange(rows.size), own[rows].ravel()] -= sums.ravel()
    part = (scale / sums * there).astype(x.dtype, copy=False)
    dhs = x @ w
    dhs *= part[:, :, None]
    h *= part[:, :, None]
    return rows[there], there, x.transpose(0, 2, 1) @ h, (part[:, None] @ x)[:, 0], dhs


def _slopes(hs: np.ndarray, w: np.ndarray, b: np.ndarray, own: np.ndarray, scale: np.float32) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of weights, biases and states: errors are the softmax less one where the row's own is, times scale.

    Rows are scaled where they are short: errors are kept as exponentials, less their sum where the row's own is.
    """
    dw, db, dhs, ones, at = np.zeros_like(w, order="C"), np.zeros_like(b), np.empty_like(hs), np.ones(len(b), hs.dtype), np.arange(min(len(hs), _BLOCK))
    for i in range(0, len(hs), _BLOCK):
        h = hs[i : i + _BLOCK]
        x = h @ w
        x += b
        if x.max() > 80:
            x -= x.max(axis=1, keepdims=True)
        np.exp(x, out=x)
        sums = x @ ones
        x[at[: len(x)], own[i : i + _BLOCK]] -= sums
        part = scale / sums
        db += part @ x
        part = part[:, None]
        dw += (h * part).T @ x
        np.multiply(x @ w.T, part, out=dhs[i : i + _BLOCK])
    return dw, db, dhs


def lanes(lengths: list[int], most: int) -> list[list[int]]:
    """Documents dealt over at most `most` lanes of nearly equal length: the longest first, each to the shortest lane."""
    out: list[list[int]] = [[] for _ in range(max(1, min(most, len(lengths))))]
    heap = [(0, i) for i in range(len(out))]
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        n, i = heapq.heappop(heap)
        out[i].append(k)
        heapq.heappush(heap, (n + lengths[k], i))
    return out


def windows(docs: list[np.ndarray], most: int, window: int) -> Iterator[tuple[np.ndarray, ...]]:
    """x, y, document (-1: none) and fresh, a window of steps at a time; lanes run through their documents one after another."""
    dealt = lanes([len(d) for d in docs], most)
    steps = max(sum(len(docs[k]) for k in lane) for lane in dealt)
    shape, at = (window, len(dealt)), [(0, 0)] * len(dealt)  # of each lane the document and its next word
    for _ in range(0, steps, window):
        x, y, own, fresh = np.full(shape, END, np.int16), np.full(shape, END, np.int16), np.full(shape, -1, np.int32), np.zeros(shape, bool)
        for i, lane in enumerate(dealt):
            (turn, a), t = at[i], 0
            while t < window and turn < len(lane):
                doc = docs[lane[turn]]
                n = min(window - t, len(doc) - a)
                y[t : t + n, i], own[t : t + n, i] = doc[a : a + n], lane[turn]
                if a:
                    x[t : t + n, i] = doc[a - 1 : a + n - 1]
                else:
                    fresh[t, i], x[t + 1 : t + n, i] = True, doc[: n - 1]
                t, a = t + n, a + n
                if a == len(doc):
                    turn, a = turn + 1, 0
            at[i] = turn, a
        yield x, y, own, fresh


def streamed(docs: Iterator[np.ndarray], most: int, window: int) -> Iterator[tuple[np.ndarray, ...]]:
    """x, y, valid, fresh and which lanes go on, a window of steps at a time; a lane whose document ends takes the next one.

    No more than a document a lane is held. Where documents run out, lanes that have ended are left out.
    """
    held = list(islice(docs, most))
    at, live = [0] * len(held), np.arange(len(held))
    while held:
        shape = (window, len(held))
        x, y, valid, fresh = np.full(shape, END, np.int32), np.full(shape, END, np.int32), np.zeros(shape, bool), np.zeros(shape, bool)
        for i, doc in enumerate(held):
            t = 0
            while doc is not None and t < window:
                a = at[i]
                n = min(window - t, len(doc) - a)
                y[t : t + n, i], valid[t : t + n, i] = doc[a : a + n], True
                if a:
                    x[t : t + n, i] = doc[a - 1 : a + n - 1]
                else:
                    fresh[t, i], x[t + 1 : t + n, i] = True, doc[: n - 1]
                t, at[i] = t + n, a + n
                if at[i] == len(doc):
                    doc, at[i] = next(docs, None), 0
            held[i] = doc
        yield x, y, valid, fresh, live
        live = np.array([i for i, doc in enumerate(held) if doc is not None], int)
        if len(live) < len(held):
            held, at = [held[i] for i in live], [at[i] for i in live]


def train(model: Gru, docs: Iterator[np.ndarray], most: int) -> tuple[Gru, int]:
    """One walk over docs, a step of Adagrad a window; and the tokens learned from."""
    squares = {k: np.full_like(v, 1e-4 if k in ("wx", "wo", "bo") else 1e-3) for k, v in model.p.items()}
    h, tokens = None, 0
    for x, y, valid, fresh, live in streamed(docs, most, WINDOW):
        h = np.zeros((x.shape[1], WIDTH), np.float32) if h is None else h if len(live) == len(h) else h[live]
        g, words, rows, h = model.gradients(x, y, valid, fresh, h)
        tokens += int(valid.sum())
        for k, v in g.items():
            squares[k] += v * v
            v /= np.sqrt(squares[k])
            v *= RATE
            model.p[k] -= v
        squares["wx"][words] += rows * rows
        model.p["wx"][words] -= RATE * rows / np.sqrt(squares["wx"][words])
    return model, tokens


def score(model: Gru, docs: list[np.ndarray]) -> np.ndarray:
    """Natural log-probability of each whole document, its end included."""
    total, h, held, n = np.zeros(len(docs)), None, [], 0

    def settle() -> None:
        hs, y, own = (np.concatenate(p) for p in zip(*held, strict=True))
        total.__iadd__(np.bincount(own, model.losses(hs, y), len(docs)))
        held.clear()

    for x, y, own, fresh in windows(docs, SCORE_LANES, 64):
        h = np.zeros((x.shape[1], WIDTH), np.float32) if h is None else h
        live = (own >= 0).any(axis=0)
        if not live.all():  # lanes that have ended stay ended
            x, y, own, fresh, part = x[:, live], y[:, live], own[:, live], fresh[:, live], h[live]
            hs, h[live], _ = model.run(x, fresh, part)
        else:
            hs, h, _ = model.run(x, fresh, h)
        at = np.flatnonzero(own.ravel() >= 0)
        held.append((hs.reshape(-1, WIDTH)[at], y.ravel()[at], own.ravel()[at]))
        n += len(at)
        if n >= TOGETHER:  # so that each class has many rows
            settle()
            n = 0
    if held:
        settle()
    return total


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in order, in batches of some _PIECE bytes of text; a longer text stands alone."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch["text"]).to_numpy(zero_copy_only=False), dtype=np.int64)
        a = done = 0
        while a < len(batch):
            b = max(int(np.searchsorted(ends, done + _PIECE - size, "right")), a + (not held))
            if b > a:
                held.append(batch.slice(a, b - a))
                size, done, a = size + int(ends[b - 1]) - done, int(ends[b - 1]), b
            if a < len(batch):
                yield _joined(held)
                held, size = [], 0
    if held:
        yield _joined(held)


def _joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The lower-cased words [^\\x20\\x09-\\x0D]+ of all texts in order, and how many each text has."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts.view(pa.string())))
    words, cuts = split.flatten().view(pa.binary()), split.offsets.to_numpy().astype(np.int64)
    real = pc.greater(pc.binary_length(words), 0)  # text that starts or ends with a space has an empty word there
    there = real.to_numpy(zero_copy_only=False)
    if not there.all():
        words, cuts = words.filter(real), np.concatenate([[0], np.cumsum(there)])[cuts - cuts[0]]
    return words, np.diff(cuts)


def _together(tables: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(tables).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"])


def word_counts(docs: DataFrame) -> DataFrame:
    """word and n over all rows of docs (text as bytes); the empty word is the end, once a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for piece in _pieces(batches):
            told = _words(piece["text"])[0].value_counts()
            held += [pa.table([told.field(0), told.field(1)], names=["word", "n"]), pa.table([pa.array([b""], pa.binary()), pa.array([len(piece)], pa.int64())], names=["word", "n"])]
            size += len(told)
            if size > 2 * _COUNTER:
                held = [_together(held)]
                if (size := len(held[0])) > _COUNTER:
                    yield from held.pop().to_batches()
                    size = 0
        if held:
            yield from _together(held).to_batches()

    return docs.select("text").mapInArrow(trimmed(run), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Lexicon:
    """Counts of common words, and places in the network's vocabulary, which are the first of them."""

    def __init__(self, words: pa.Array | list[bytes], n: np.ndarray, total: int, kinds: int, end: int):
        self.words, self.n, self.total, self.kinds, self.end = pa.array(words, pa.binary()), n, total, kinds, end
        self.own = min(VOCABULARY - 2, len(words))
        mass = np.full(VOCABULARY, 0.5)  # places without a word
        mass[UNKNOWN], mass[END] = max(total - end - n[: self.own].sum(), 1), max(end, 1)
        mass[2 : 2 + self.own] = n[: self.own]
        self.mass = mass
        #: What words outside the vocabulary share: each its count and one, and one for all that are new.
        self.tail = float(total - end - n[: self.own].sum() + kinds - bool(end) - self.own + 1)
        self.log = np.append(np.log10(n + 1.0), 0.0)

    def vocabulary(self) -> Lexicon:
        """Only the words of the network's vocabulary: all that learning has to know, some hundredth of the whole."""
        return Lexicon(self.words[: self.own], self.n[: self.own], self.total, self.kinds, self.end)

    def look_up(self, words: pa.Array) -> np.ndarray:
        """Places of words; -1: not among the common ones."""
        return pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy()

    def ids(self, at: np.ndarray) -> np.ndarray:
        return np.where((at >= 0) & (at < self.own), at + 2, UNKNOWN).astype(np.int16)


def lexicon(counts: DataFrame) -> Lexicon:
    """COMMON words at most come to the driver, and three sums."""
    total, kinds, end = counts.agg(F.sum("n"), F.count("*"), F.sum(F.when(F.octet_length("word") == 0, F.col("n")))).first()
    top = counts.where(F.octet_length("word") > 0).orderBy(F.desc("n"), "word").limit(COMMON).toArrow()
    return Lexicon(top["word"].combine_chunks(), top["n"].to_numpy(), total or 0, kinds or 0, end or 0)


def _learner(start, most: int):
    """What each shard learns from its documents: the parameters in parts, and their weight, its tokens. A partition has whole shards, one after another."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((shard, x) for batch in batches for shard, x in zip(batch["shard"].to_pylist(), batch["ids"], strict=True))
        for _, own in groupby(rows, key=itemgetter(0)):
            model, tokens = train(Gru.fresh(np.ones(VOCABULARY)).load(start.value), (np.frombuffer(x.as_py(), np.int16) for _, x in own), most)
            flat = model.flat()
            cuts = range(0, len(flat), _FLOATS)
            yield pa.record_batch([pa.array(range(len(cuts)), pa.int32()), pa.array([float(tokens)] * len(cuts)), pa.array([flat[i : i + _FLOATS].tobytes() for i in cuts], pa.binary())], names=["part", "weight", "data"])

    return trimmed(learn)


def _averaged(group: pa.Table) -> pa.Table:
    weights = group["weight"].to_pylist()
    data = sum(w * np.frombuffer(x.as_py(), np.float32).astype(np.float64) for w, x in zip(weights, group["data"], strict=True)) / sum(weights)
    return pa.table({"part": group["part"].slice(0, 1), "weight": pa.array([sum(weights)]), "data": pa.array([data.astype(np.float32).tobytes()], pa.binary())})


def _per_text(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of x over texts that have n words each."""
    out, some = np.zeros(len(n), np.float64 if x.dtype.kind == "f" else np.int64), n > 0
    if some.any():
        out[some] = np.add.reduceat(x, (np.cumsum(n) - n)[some], dtype=out.dtype)
    return out


def _told(sent):
    """A row a document with the numbers of its words and what its common ones give; words that only the join can count stand in rare and times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, row, task = sent.value, 0, TaskContext.get().partitionId()
        for piece in _pieces(batches):
            words, n = _words(piece["text"])
            at = lex.look_up(words)
            ids, logs, there = lex.ids(at), lex.log[at], at >= 0
            out, ends = ids == UNKNOWN, np.cumsum(n + 1)
            whole, inner = np.full(ends[-1], END, np.int16), np.ones(ends[-1], bool)
            inner[ends - 1] = False
            whole[inner] = ids
            missing = np.flatnonzero(~there)
            code = words.take(pa.array(missing)).dictionary_encode()
            kinds = max(len(code.dictionary), 1)
            pairs, times = np.unique(np.searchsorted(np.cumsum(n), missing, "right") * kinds + code.indices.to_numpy(), return_counts=True)
            cuts = pa.array(np.searchsorted(pairs, np.arange(len(n) + 1) * kinds), pa.int32())
            yield pa.record_batch({
                "turn": piece["turn"], "slot": piece["slot"], "row": np.arange(row, row + len(n)) + (task << 40), "doc_id": piece["doc_id"], "n": n + 1,
                "ids": binary_array(whole.tobytes(), np.concatenate([[0], ends * 2])), "n_known": _per_text(there, n) + int(lex.end > 0),
                "base": _per_text(logs, n) + np.log10(lex.end + 1), "of_tail": _per_text(np.where(out, logs, 0), n), "unknown": _per_text(out, n),
                "rare": pa.ListArray.from_arrays(cuts, code.dictionary.take(pa.array(pairs % kinds))), "times": pa.ListArray.from_arrays(cuts, pa.array(times, pa.int64())),
            })
            row += len(n)

    return run


def lessons(docs: DataFrame, lex: Lexicon, learn: F.Column | None = None) -> DataFrame:
    """A row for every row of docs, as a written table: turn (the round that learns from it, ROUNDS for rows without learn),
    slot (a hash that deals it to a shard), n and ids of its tokens, and of _told() what its score takes."""
    sent = docs.sparkSession.sparkContext.broadcast(lex)
    # by text too: rows of one id, or of none, are dealt apart
    slot = F.xxhash64("doc_id", "text", F.lit("fit"))
    turn = F.when(F.lit(True) if learn is None else learn, F.pmod(slot, F.lit(ROUNDS))).otherwise(ROUNDS).cast("int")
    shape = "turn int, slot long, row long, doc_id long, n long, ids binary, n_known long, base double, of_tail double, unknown long, rare array<binary>, times array<long>"
    return written(docs.select(turn.alias("turn"), slot.alias("slot"), F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(trimmed(_told(sent)), shape), "turn")


def fit(dealt: DataFrame, lex: Lexicon) -> Gru:
    """Averaged shards of SHARD tokens; dealt is a table of lessons(), and all its rows that have a turn are learned from.

    A shard streams through its documents, the longest first, so that its lanes end together; it holds one a lane.
    """
    spark, model = dealt.sparkSession, Gru.fresh(lex.mass)
    shards = max(1, round(lex.total / SHARD))
    most = min(max(int(lex.total / (shards * ROUNDS * WINDOW * UPDATES)), LEAST_LANES), LANES)
    for turn in range(ROUNDS):
        start = spark.sparkContext.broadcast(model.flat())
        shape = "part int, weight double, data binary"
        shard = F.pmod(F.shiftright("slot", 8), F.lit(shards)).alias("shard")
        own = dealt.where(F.col("turn") == turn).select(shard, "n", "slot", "ids").repartition(shards, "shard").sortWithinPartitions("shard", F.desc("n"), "slot")
        learned = own.select("shard", "ids").mapInArrow(_learner(start, most), shape)
        some = learned.groupBy("part", F.floor(F.rand(1) * max(1, int(shards**0.5))).alias("salt"))
        parts = some.applyInArrow(_averaged, shape).groupBy("part").applyInArrow(_averaged, shape).toArrow().sort_by("part").to_pylist()
        if parts:
            model = model.load(np.concatenate([np.frombuffer(x["data"], np.float32) for x in parts]))
    return model


def _scored(model: Gru, tail: float):
    """base and score, of the words that every task knows, of rows of lessons()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, held, size = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal size
            own = _joined(held)
            logs = score(model, docs) / np.log(10) + own["of_tail"].to_numpy() - own["unknown"].to_numpy() * np.log10(tail)
            docs.clear()
            held.clear()
            size = 0
            return pa.record_batch([own["row"], own["doc_id"], own["n"], own["n_known"], own["base"], pa.array(logs)], names=["row", "doc_id", "n_tokens", "n_known", "base", "score"])

        for batch in batches:
            docs += [np.frombuffer(x.as_py(), np.int16) for x in batch["ids"]]
            held.append(batch.drop_columns(["ids"]))
            size += int(pc.sum(batch["n"]).as_py() or 0)
            if size >= BATCH:
                yield flush()
        if docs:
            yield flush()

    return run


def lm_scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    Tokens: lower-cased words, then one end. base_score: log10 of add-one unigrams of the training rows (remainder not
    HELD_OUT). score: the network's log10 probability of the whole text; a word outside its vocabulary counts as an
    unknown word times its add-one share among all such. Null or empty texts are the end alone; rows of null doc_id are
    training rows; repeated ids are rows of their own; without training rows all counts are zero. Other columns are ignored.
    """
    own = binary(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    counts = written(word_counts(own.where(~held_out())))
    lex = lexicon(counts)
    told = lessons(own, lex, ~held_out())
    model = fit(told, lex)
    shape = "row long, doc_id long, n_tokens long, n_known long, base double, score double"
    rows = written(told.select("row", "doc_id", "n", "n_known", "base", "of_tail", "unknown", "ids").mapInArrow(trimmed(_scored(model, lex.tail)), shape))
    each = told.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("k"))
    more = each.join(counts, "word").groupBy("row").agg(F.sum("k").alias("known"), F.sum(F.col("k") * F.log10(F.col("n") + 1.0)).alias("log"))
    log = F.coalesce("log", F.lit(0.0))
    space = F.log10(F.lit(float(lex.total + lex.kinds + 1)))
    return rows.join(more, "row", "left").select(
        "doc_id", held_out().alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(lex.total).cast("long").alias("train_tokens"), (F.col("base") + log - F.col("n_tokens") * space).alias("base_score"), (F.col("score") + log).alias("score"),
    )
