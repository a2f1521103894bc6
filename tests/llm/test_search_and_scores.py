from __future__ import annotations

import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sparkloom.llm import ann, gru_lm, toxicity


def test_ann_contract(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 8))
    x[50:90] = x[50]  # copies beyond k + 1
    x[100:140] = x[100] + rng.normal(size=(40, 8)) * 1e-3
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(500, None), (501, []), (502, [0.0] * 8), (503, [1.0] * 7 + [None]), (504, [1.0] * 7 + [float("nan")]), (520, [1.0] * 3), (None, [1.0] * 8), (60, x[3].tolist())]
    df = spark.createDataFrame([(*r, "t") for r in rows], "vec_id long, embedding array<double>, tree string")
    got = {}
    for r in ann.nearest(df, ann.by_modulus(20)).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    ids = np.array([*range(400), 60])
    every = np.vstack([x, x[3]])
    assert set(got) == {i for i in range(0, 400, 20)}
    hits = 0
    for i in range(0, 400, 20):
        if i == 60:
            continue
        scores = (every * x[i]).sum(axis=1)
        order = [j for j in np.lexsort((ids, -scores)) if ids[j] != i][:20]
        own = sorted(got[i])
        assert [r for r, _, _ in own] == list(range(1, 21))
        assert [(-s, v) for _, v, s in own] == sorted((-s, v) for _, v, s in own)
        hits += len({v for _, v, _ in own} & set(ids[order].tolist()))
        for _, v, s in own:
            assert any(abs(s - t) < 1e-12 for t in scores[ids == v])
    assert hits >= 0.9 * 20 * 19


def test_ann_few_and_none(spark):
    shape = "vec_id long, embedding array<float>"
    assert ann.nearest(spark.createDataFrame([], shape), ann.by_modulus(20)).count() == 0
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.0]), (20, [0.0, 2.0])], shape)
    got = sorted((r.query_id, r.rank, r.vec_id) for r in ann.nearest(df, ann.by_modulus(20)).collect())
    assert got == [(0, 1, 1), (0, 2, 20), (20, 1, 0), (20, 2, 1)]


@pytest.mark.parametrize("clusters", [0, 30])
def test_recall(spark, clusters):
    """Against brute force, over vectors that lie anywhere and over clusters; of norms that differ, with a shifted mean."""
    rng = np.random.default_rng(21)
    x = rng.normal(size=(6000, 32)) + 0.1 if not clusters else rng.normal(size=(clusters, 32))[rng.integers(0, clusters, 6000)] + rng.normal(size=(6000, 32)) * 0.2
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))], "vec_id long, embedding array<float>")
    got = {(r.query_id, r.vec_id) for r in ann.nearest(df, ann.by_modulus(20)).collect()}
    y = x.astype(np.float32).astype(np.float64)
    scores = y[::20] @ y.T
    scores[np.arange(300), np.arange(0, 6000, 20)] = -np.inf
    want = {(20 * i, int(j)) for i, row in enumerate(scores) for j in np.argsort(-row, kind="stable")[:20]}
    assert len(got & want) >= 0.93 * len(want)


def test_descent_finds_the_longest_prefix():
    rng = np.random.default_rng(2)
    keys = np.sort(rng.integers(0, 1 << 14, 300) << (ann.BITS - 14))
    own = np.concatenate([keys[:40], rng.integers(0, 1 << ann.BITS, 40)])
    a, b = ann.descended(keys, own, np.full(80, ann.BITS), 5)
    for q, i, j in zip(own.tolist(), a.tolist(), b.tolist(), strict=True):
        shared = [ann.BITS - (int(v) ^ q).bit_length() for v in keys]
        assert j - i >= 5 and min(shared[i:j]) > max([-1, *shared[:i], *shared[j:]])
        deepest = min(shared[i:j])
        assert sum(v > deepest for v in shared) < 5


def test_crowded_prefixes_are_cut(spark, monkeypatch):
    monkeypatch.setattr(ann, "SEGMENT", 40)
    rng = np.random.default_rng(6)
    x = np.vstack([rng.normal(size=6) + rng.normal(size=(300, 6)) * 0.01, rng.normal(size=(100, 6))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.nearest(df, ann.by_modulus(20)).groupBy("query_id").count().collect()
    assert {(r.query_id, r["count"]) for r in got} == {(i, 20) for i in range(0, 400, 20)}


@pytest.mark.parametrize("spread", [0.05, 1e-4])
def test_recall_in_a_crowded_cell(spark, monkeypatch, spread):
    """A third of the rows within some degrees, or so close that most share all bits: their queries find their true neighbours."""
    monkeypatch.setattr(ann, "SEGMENT", 16)
    rng = np.random.default_rng(12)
    x = np.vstack([rng.normal(size=6) + rng.normal(size=(700, 6)) * spread, rng.normal(size=(1400, 6))])
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id) for r in ann.nearest(df, ann.by_modulus(20)).where("query_id < 700").collect()}
    scores = x[:700:20] @ x.T
    scores[np.arange(35), np.arange(0, 700, 20)] = -np.inf
    want = {(20 * i, int(j)) for i, row in enumerate(scores) for j in np.argsort(-row, kind="stable")[:20]}
    assert len(got & want) >= 0.9 * len(want)


@pytest.fixture(scope="module")
def languages():
    """Texts of two languages whose words tell each other."""
    rng = random.Random(11)
    speech = [[a + b for a in x for b in y] for x, y in (("ka lo mi ru".split(), "ter ing os".split()), ("pe sa du vi".split(), "lor em ip".split()))]
    return [" ".join(rng.choice(speech[i % 2]) + ("!" if rng.random() < 0.02 else "") for _ in range(rng.randint(20, 120))) for i in range(300)]


def test_language_model(spark, languages, empty, monkeypatch):
    monkeypatch.setattr(gru_lm, "COMMON", 20)
    rows = [*enumerate(languages), (900, None), (901, ""), (None, "Ka lo unknownword"), (5, "a b c")]
    got = gru_lm.lm_scores(spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, score double")).collect()
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    tokens = [[*(t or "").lower().split(), None] for _, t in rows]
    counts = Counter(w for (i, _), ws in zip(rows, tokens, strict=True) if not out(i) for w in ws)
    total, kinds = sum(counts.values()), len(counts)
    want = sorted((repr(i), out(i), len(ws), sum(counts[w] > 0 for w in ws), total, round(sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in ws), 6)) for (i, _), ws in zip(rows, tokens, strict=True))
    assert sorted((repr(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    held = [r for r in got if r.held_out and r.n_tokens > 5]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert gru_lm.lm_scores(empty).count() == 0


def test_every_training_row_is_learned_from(spark, languages):
    docs = gru_lm.binary(spark.createDataFrame([*enumerate(languages), (None, "ka lo"), (None, None), (5, "")], "doc_id long, text string"))
    lex = gru_lm.lexicon(gru_lm.word_counts(docs))
    got = gru_lm.lessons(docs, lex).collect()
    assert len(got) == len(languages) + 3
    assert sum(len(r.ids) // 2 for r in got) == sum(r.n for r in got) == lex.total
    assert {r.turn for r in got} == set(range(gru_lm.ROUNDS))


@pytest.mark.parametrize("most", [1, 3, 50])
def test_lanes_hold_whole_documents(most):
    """Every token is learned from once, after the one before it, and only a document's first starts afresh."""
    rng = np.random.default_rng(4)
    docs = [np.append(rng.integers(2, 900, n), gru_lm.END) for n in (70, 40, 33, 32, 31, 1, 1, 9, 100)]
    told, lanes = [], {}
    for x, y, valid, fresh, live in gru_lm.streamed(iter(docs), most, 32):
        before = lanes
        lanes = {}
        for i, lane in enumerate(live.tolist()):
            own = before.get(lane, [])
            for t in range(32):
                if valid[t, i]:
                    if fresh[t, i]:
                        told += [own] if own else []
                        own = []
                    assert x[t, i] == (own[-1] if own else gru_lm.END)
                    own.append(int(y[t, i]))
            lanes[i] = own
        told += [own for lane, own in before.items() if lane not in live]
    told += [own for own in lanes.values() if own]
    assert sorted(told) == sorted(d.tolist() for d in docs)


def _network():
    rng = np.random.default_rng(2)
    model = gru_lm.Gru.fresh(rng.uniform(1, 5, gru_lm.VOCABULARY))
    for k in model.p:
        model.p[k] = model.p[k].astype(np.float64) + rng.normal(size=model.p[k].shape) * 0.05
    return model


def test_chances_add_up():
    model = _network()
    hs = np.random.default_rng(1).normal(size=(1, gru_lm.WIDTH)).astype(np.float32)
    model.p = {k: v.astype(np.float32) for k, v in model.p.items()}
    total = np.exp(model.losses(np.repeat(hs, gru_lm.VOCABULARY, axis=0), np.arange(gru_lm.VOCABULARY)).astype(np.float64)).sum()
    assert abs(total - 1) < 1e-3


def test_gradients_are_differences():
    model, rng = _network(), np.random.default_rng(5)
    x, y = rng.integers(0, 300, (6, 3)), rng.integers(0, 300, (6, 3))
    fresh = np.zeros((6, 3), bool)
    fresh[0], fresh[3, 1] = True, True
    valid, h = np.ones((6, 3), bool), rng.normal(size=(3, gru_lm.WIDTH)).astype(np.float32)
    valid[5, 2] = False

    def loss():
        hs, _, _ = model.run(x, fresh, h)
        at = np.flatnonzero(valid.ravel())
        return -model.losses(hs.reshape(-1, gru_lm.WIDTH)[at], y.ravel()[at]).astype(np.float64).mean()

    g, words, rows, _ = model.gradients(x, y, valid, fresh, h)
    for k, at in (("u", (3, 40)), ("u", (5, 70)), ("wc", (2, 1)), ("bc", (0,)), ("bx", (50,)), ("wo", (0, 3, 5)), ("bo", (1, 2))):
        was = model.p[k][at]
        e = 1e-2
        model.p[k][at] = was + e
        up = loss()
        model.p[k][at] = was - e
        down = loss()
        model.p[k][at] = was
        assert abs((up - down) / (2 * e) - g[k][at]) < 2e-3 * max(1, abs(g[k][at]) * 20), k
    w = words[0]
    was = model.p["wx"][w, 60]
    model.p["wx"][w, 60] = was + 1e-2
    up = loss()
    model.p["wx"][w, 60] = was - 1e-2
    assert abs((up - loss()) / 2e-2 - rows[0, 60]) < 2e-3
    model.p["wx"][w, 60] = was


def test_state_is_carried_and_reset():
    model = gru_lm.Gru({k: v.astype(np.float32) for k, v in _network().p.items()})
    rng = np.random.default_rng(8)
    texts = [rng.integers(0, 500, n).astype(np.int32) for n in (1, 300, 70, 64, 65, 2)]
    together = gru_lm.score(model, texts)
    alone = [gru_lm.score(model, [t])[0] for t in texts]
    assert np.allclose(together, alone, rtol=1e-4)


def test_toxicity(spark, words, empty, monkeypatch):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(600):
        w = [rng.choice(words) for _ in range(rng.randint(20, 80))]
        if bad := i % 6 == 0:
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(("Grub", "snarf", "blech")))
        rows.append((i, " ".join(w)))
        if i % 3 != 1:
            labels.append((i, int(bad)))
    rows += [(700, None), (701, ""), (None, "snarf blech grub snarf"), (5, "snarf")]
    docs = spark.createDataFrame([(i, t, 2) for i, t in rows], "doc_id long, text string, score int")
    marks = spark.createDataFrame([*labels, (None, 1), (3, None), (2, 0)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, marks).collect()
    assert len(got) == len(rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    known = [r for r in got if r.doc_id is not None and r.doc_id < 600 and r.held_out and r.doc_id != 5]
    assert np.mean([r.predicted == (r.doc_id % 6 == 0) for r in known]) > 0.95
    again = {(repr(r.doc_id), r.score) for r in toxicity.toxicity(docs, marks).collect()}
    assert again == {(repr(r.doc_id), r.score) for r in got}
    monkeypatch.setattr(toxicity, "HELD", 0)  # features are read again, not held
    assert again == {(repr(r.doc_id), r.score) for r in toxicity.toxicity(docs, marks).collect()}
    assert toxicity.toxicity(docs, marks.limit(0)).where("predicted = 1").count() == 0
    assert toxicity.toxicity(empty, marks).count() == toxicity.tolerated(empty, marks).count() == 0
    stay = {r.doc_id for r in toxicity.tolerated(docs, marks).collect()}
    assert stay == {r.doc_id for r in got if not r.predicted} | ({5} if 5 in stay else set())


def test_scoring_lays_out_a_window_at_a_time():
    """Memory of the layout goes by the lanes, not by the tokens; windows are whole documents in order."""
    rng = np.random.default_rng(6)
    texts = [rng.integers(2, 900, n).astype(np.int16) for n in [1, 63, 64, 65, 20_000, *rng.integers(1, 900, 4000).tolist()]]
    tracemalloc.start()
    told = [[] for _ in texts]
    for x, y, own, fresh in gru_lm.windows(texts, 256, 64):
        for i in range(4):  # the first lanes in full
            for t in np.flatnonzero(own[:, i] >= 0):
                k = own[t, i]
                assert fresh[t, i] == (not told[k])
                assert x[t, i] == (told[k][-1] if told[k] else gru_lm.END)
                told[k].append(int(y[t, i]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert all(not t or t == d.tolist() for t, d in zip(told, texts, strict=True))
    assert sum(map(bool, told)) > 4
    assert peak < 4 * sum(len(d) for d in texts)  # nine bytes a token if all are laid out at once


def test_learning_is_sent_its_vocabulary_only():
    lex = gru_lm.Lexicon([f"w{i}".encode() for i in range(9000)], np.arange(9000, 0, -1), 10**8, 9001, 50)
    small = lex.vocabulary()
    assert len(small.words) == gru_lm.VOCABULARY - 2
    assert (small.mass == lex.mass).all()
    assert small.tail == lex.tail


def test_texts_are_numbered_once(spark, languages, monkeypatch):
    """One table has what learning and scoring take of all rows: no text is split for each of them again."""
    monkeypatch.setattr(gru_lm, "COMMON", 12)
    texts = [*languages[:40], "", None, " \t ", "Ka\x0blo  \u00a0 TER\x1cing\u0085 \u00c9\n", " rare Rare other"]
    docs = gru_lm.binary(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string"))
    lex = gru_lm.lexicon(gru_lm.word_counts(docs.where(~gru_lm.held_out())))
    got = {r.doc_id: r for r in gru_lm.lessons(docs, lex, ~gru_lm.held_out()).collect()}
    out = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    tokens = [re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower()) for t in texts]
    counts = Counter(w for ws, o in zip(tokens, out, strict=True) if not o for w in ws)
    common = sorted(counts, key=lambda w: (-counts[w], w))[:12]
    assert len(got) == len({r.row for r in got.values()}) == len(texts)
    for i, ws in enumerate(tokens):
        r = got[i]
        assert (r.turn == gru_lm.ROUNDS) == out[i]
        assert np.frombuffer(r.ids, np.int16).tolist() == [common.index(w) + 2 if w in common else gru_lm.UNKNOWN for w in ws] + [gru_lm.END]
        assert (r.n, r.n_known, r.unknown) == (len(ws) + 1, sum(w in common for w in ws) + 1, sum(w not in common for w in ws))
        assert abs(r.base - sum(math.log10(counts[w] + 1) for w in ws if w in common) - math.log10(out.count(False) + 1)) < 1e-9
        assert dict(zip(map(bytes, r.rare), r.times, strict=True)) == Counter(w for w in ws if w not in common)


def test_pieces_are_all_rows_in_order(monkeypatch):
    monkeypatch.setattr(gru_lm, "_PIECE", 20)
    texts = [b"x" * n + b" y" for n in (0, 50, 3, 3, 3, 18, 0, 0, 90, 1)]
    batches = [pa.record_batch({"text": pa.array(texts[a:b], pa.binary())}) for a, b in ((0, 3), (3, 3), (3, 4), (4, 10))]
    got = [p["text"].to_pylist() for p in gru_lm._pieces(iter(batches))]
    assert sum(got, []) == texts
    assert all(len(p) == 1 or sum(map(len, p)) <= 20 for p in got)
    words = [gru_lm._words(p["text"]) for p in gru_lm._pieces(iter(batches))]
    assert sum((w.to_pylist() for w, _ in words), []) == [w for t in texts for w in t.split()]
    assert np.concatenate([n for _, n in words]).tolist() == [len(t.split()) for t in texts]


def test_classes_together_learn_as_one_by_one(monkeypatch):
    model, rng = _network(), np.random.default_rng(9)
    x, y = (np.minimum(rng.geometric(0.01, (40, 30)), 4095) for _ in range(2))
    valid, fresh, h = rng.random((40, 30)) < 0.9, rng.random((40, 30)) < 0.1, rng.normal(size=(30, gru_lm.WIDTH))
    told = []
    for few, block, long in ((1 << 30, 1 << 30, 1 << 30), (0, 7, 0), (256, 2048, 8)):
        for k, n in (("_FEW", few), ("_BLOCK", block), ("_LONG", long)):
            monkeypatch.setattr(gru_lm, k, n)
        g, words, rows, _ = model.gradients(x, y, valid, fresh, h)
        hs = rng.normal(size=(500, gru_lm.WIDTH)) if not told else told[0]["hs"]
        told.append(g | {"words": words, "rows": rows, "hs": hs, "losses": model.losses(hs, y.ravel()[:500])})
    for other in told[1:]:
        assert all(np.allclose(told[0][k], other[k], rtol=1e-9, atol=1e-12) for k in other)
