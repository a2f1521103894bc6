from __future__ import annotations

import bisect
import random
import zlib

import numpy as np
import pytest

from sparkloom.llm import packing as P


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.default_tokenizer())


def test_word_by_word_is_the_tokenizer(tokenizer):
    rng = random.Random(3)
    parts = ["It's", "don't.", " ", "\n", "a.b", "e.g.,", "x!.", "Straße", "Élan", "é", "İstanbul", "ΣΑΣ", "ﬁne", "<|endoftext|>", "<|ENDOFTEXT|>", "5.", "5,000", "...", "日本語", "한국", "\x1c", "\xa0", "'Ll.", "naïve,", "😀", "\x85", "word,next", ""]
    for _ in range(400):
        text = "".join(rng.choice(parts) + rng.choice(("", " ", "\t")) for _ in range(rng.randint(0, 12)))
        own = b"".join(P.word_ids(P.default_tokenizer()).of(w) for w in P.words_of(text.encode()))
        assert np.frombuffer(own, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_pack(spark, docs, corpus, tokenizer):
    got = P.pack(docs, ids=True).collect()
    want = []
    for i, t in corpus:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048].tobytes()
            want.append((repr(i), k // 2048, k, len(part) // 4, zlib.crc32(part), part))
    assert sorted((repr(r.doc_id), r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in got) == sorted(want)
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))]
        assert sum(n for _, n in own) <= 2048
    total = sum(r.length for r in got)
    assert len(places) <= -(-total // 2048) + 1


def test_long_texts_in_pieces(spark, words, monkeypatch, tokenizer):
    from sparkloom.llm import common

    monkeypatch.setattr(P, "CHUNK", 200)
    monkeypatch.setattr(common, "CHUNK", 100)
    text = " ".join(words * 30)
    ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
    import pyarrow as pa

    batch = pa.record_batch({"doc_id": pa.array([4, 5]), "text": pa.array([text.encode(), b""])})
    rows = [r for b in P._cut(P.default_tokenizer(), 2048, 0, True)(iter([batch])) for r in b.to_pylist()]
    assert b"".join(r["ids"] for r in rows if r["doc_id"] == 4) == np.array(ids, "<u4").tobytes()


def _best_fit_one_by_one(counts):
    """Sequences that best-fit decreasing opens, a piece at a time."""
    rooms = []
    for n in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
        at = bisect.bisect_left(rooms, n)
        room = rooms.pop(at) if at < len(rooms) else 2048
        bisect.insort(rooms, room - n)
    return len(rooms)


def test_best_fit_uses_each_piece_once_and_fills():
    rng = random.Random(1)
    for most in (1, 3, 40):
        counts = {n: rng.randint(1, most) for n in rng.sample(range(1, 2049), 300)}
        plan = P.best_fit(counts, 2048)
        used = {}
        for times, filling in plan:
            assert sum(n * k for n, k in filling) <= 2048
            for n, k in filling:
                used[n] = used.get(n, 0) + k * times
        assert used == counts
        assert sum(t for t, _ in plan) <= 1.01 * _best_fit_one_by_one(counts) + 1
        slots = P.Slots(plan)
        for length, n in counts.items():
            sequence, offset = slots.take(np.full(n, length), np.arange(n))
            assert len(set(zip(sequence.tolist(), offset.tolist(), strict=True))) == n


def test_nothing(spark, empty):
    assert P.pack(empty).count() == 0
    assert P.best_fit({}, 2048) == []
