from __future__ import annotations

import hashlib

import numpy as np
import pytest

from sparkloom.llm import repeats
from sparkloom.llm.substring_dedup import substring_dedup
from sparkloom.llm.suffix_dedup import suffix_dedup


def _split(t):
    return (t or "").encode().split()


def brute(corpus, window):
    """For each row, which words windows cover that a smaller id, or any other id, has too."""
    first, holders = {}, {}
    for i, t in corpus:
        if i is not None:
            w = _split(t)
            for a in range(len(w) - window + 1):
                k = tuple(w[a : a + window])
                first[k] = min(first.get(k, i), i)
                holders.setdefault(k, set()).add(i)
    out = []
    for i, t in corpus:
        w = _split(t)
        later, shared = [False] * len(w), [False] * len(w)
        for a in range(len(w) - window + 1) if i is not None else ():
            k = tuple(w[a : a + window])
            for j in range(a, a + window):
                later[j] |= first[k] < i
                shared[j] |= len(holders[k]) > 1
        out.append((i, w, later, shared))
    return out


@pytest.mark.parametrize("flush", [1 << 20, 500])
def test_substring_dedup_is_exact(spark, docs, corpus, monkeypatch, flush):
    monkeypatch.setattr(repeats, "FLUSH", flush)
    got = sorted((repr(r.doc_id), r.n_words, r.n_removed, r.kept_sha256, r.kept) for r in substring_dedup(docs).collect())
    want = []
    for i, w, later, _ in brute(corpus, 13):
        kept = b" ".join(x for x, gone in zip(w, later, strict=True) if not gone)
        want.append((repr(i), len(w), sum(later), hashlib.sha256(kept).hexdigest(), kept.decode()))
    assert got == sorted(want)


def test_suffix_dedup_finds_all_passages(spark, docs, corpus):
    got = {(r.doc_id, r.n_repeated, r.n_copied) for r in suffix_dedup(docs).collect()}
    want = {(i, sum(shared), sum(later)) for i, _, later, shared in brute(corpus, 50) if any(shared)}
    assert got == want


@pytest.mark.parametrize("crowd", [4, 16])
def test_crowded_keys_go_by_window(spark, docs, corpus, monkeypatch, crowd):
    """Keys that many different entries share are dealt by whole windows; the result is the same."""
    monkeypatch.setattr(repeats, "CROWD", crowd)
    monkeypatch.setattr(repeats, "SHARE", 1)
    own = repeats.binary(docs.select("doc_id", "text"))
    assert len(repeats.crowded(own, 13, 2, 11)) > 0
    got = sorted((repr(r.doc_id), r.n_words, r.n_removed) for r in substring_dedup(docs, anchor=2, texts=False).collect())
    assert got == sorted((repr(i), len(w), sum(later)) for i, w, later, _ in brute(corpus, 13))


def test_long_texts_in_pieces(spark, words, monkeypatch):
    from sparkloom.llm import common

    monkeypatch.setattr(common, "CHUNK", 64)
    monkeypatch.setattr(repeats, "STEP", 200)
    w = [words[i * 7 % 400] + str(i) for i in range(600)]
    rows = [(1, " ".join(w)), (2, "x y " + " ".join(w[100:400]) + " z"), (3, " ".join(w[250:258])), (4, " ".join(w[250:263]))]
    found = repeats._Entries(13, 5, 8, np.zeros(0, np.uint64))
    for i, t in rows:
        found.add(i, 0, t.encode())
    key, doc, _, at, left, right, whole, context = found.take()
    windows = left.astype(int) + right - 8 + 1
    assert windows.sum() == sum(max(0, len(t.split()) - 12) for _, t in rows)
    assert len(context) == (left.astype(int) + right).sum()
    starts = [(d, p) for d, a, x, n in zip(doc.tolist(), at.tolist(), left.tolist(), windows.tolist(), strict=True) for p in range(a - x, a - x + n)]
    assert len(set(starts)) == len(starts) == windows.sum()
    got = {(r.doc_id, r.n_removed) for r in substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 0), (2, 300), (3, 0), (4, 13)}


def test_neighbours_of_sorted_suffixes():
    rng = np.random.default_rng(3)
    key, rest = rng.integers(0, 3, 60).astype(np.uint64), rng.integers(0, 2, (60, 5)).astype(np.uint32)
    order, common = repeats.sorted_neighbours(key, rest)
    rows = [(int(key[i]), *rest[i].tolist()) for i in order]
    assert rows == sorted(rows)
    for before, now, n in zip(rows, rows[1:], common[1:].tolist(), strict=False):
        assert n == -1 if before[0] != now[0] else before[: n + 1] == now[: n + 1] and (n == 5 or before[n + 1] != now[n + 1])


def test_least_by_doubling_is_leftmost():
    x = np.random.default_rng(1).integers(0, 5, 300).astype(np.uint64)
    for w in (1, 2, 7, 16, 43):
        want = np.lib.stride_tricks.sliding_window_view(x, w).argmin(axis=1)
        assert (repeats._least(x, w) == want).all()


def test_nothing(spark, empty):
    assert substring_dedup(empty).count() == suffix_dedup(empty).count() == 0
