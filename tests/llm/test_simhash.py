from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sparkloom.llm import simhash as S
from sparkloom.llm.components import components


def slow_fingerprint(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    hs = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hs) > len(hs))


def slow_components(fps, radius):
    """Smallest index reachable."""
    label = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            for j in range(len(fps)):
                if (fps[i] ^ fps[j]).bit_count() <= radius and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


def test_contract(spark, docs, corpus):
    got = sorted((repr(r.doc_id), r.fingerprint, repr(r.component_id)) for r in S.simhash_components(docs).collect())
    fps = [slow_fingerprint(t) for _, t in corpus]
    groups = slow_components(fps, 4)
    least = {}
    for (i, _), g in zip(corpus, groups, strict=True):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    assert got == sorted((repr(i), f"{f:016x}", repr(least.get(g))) for (i, _), f, g in zip(corpus, fps, groups, strict=True))


def _nodes(spark, fps):
    rows = [(int(f).to_bytes(8, "big"), i, 1 + i % 3) for i, f in enumerate(fps)]
    return spark.createDataFrame(rows, "fp binary, node long, copies long")


@pytest.mark.parametrize(("crowd", "parts"), [(4096, None), (4, None), (4, 3), (3, 4), (4096, 3)])
def test_links_of_dense_balls(spark, monkeypatch, crowd, parts):
    """Balls of near fingerprints around a few centres, chains, and far ones: components as by brute force."""
    monkeypatch.setattr(S, "CROWD", crowd)
    rng = random.Random(crowd + (parts or 0))
    fps = set()
    for _ in range(4):
        centre = rng.getrandbits(64)
        for _ in range(40):
            f = centre
            for b in rng.sample(range(64), rng.randint(0, 3)):
                f ^= 1 << b
            fps.add(f)
    at = rng.getrandbits(64)
    for _ in range(25):  # a chain of steps of four bits
        fps.add(at)
        for b in rng.sample(range(64), 4):
            at ^= 1 << b
    fps |= {rng.getrandbits(64) for _ in range(40)}
    fps = sorted(fps)
    edges = S.near_pairs(_nodes(spark, fps), parts=parts)
    label = {r.node: r.root for r in components(edges).collect()}
    assert [label.get(i, i) for i in range(len(fps))] == slow_components(fps, 4)


def test_thresholds_add_up():
    plan = S.Plan([list(range(i * 16, i * 16 + 16)) for i in range(4)], 1, 4)
    plan.counts[0] += 1e6
    t = plan.thresholds(plan.values(np.random.default_rng(0).integers(0, 2**63, (50, 1), dtype=np.uint64)))
    assert (t.sum(axis=0) == 1).all()
    assert (t >= -1).all()
    assert (t[0] == -1).all()  # the crowded part is left to the others


def test_components_of_a_path_star_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(8, 60)] + [(5, 5), (1, 2), (2, 1), (1, 2)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 141)} | {i: 7 for i in range(7, 60)} | {1: 1, 2: 1}


def test_one_of_each_by_similarity(spark, words):
    rng = random.Random(2)
    rows, want = [], []
    for g in range(12):
        base = [rng.choice(words) + str(rng.randint(0, 9)) for _ in range(300)]
        want.append(10 * g)
        rows.append((10 * g, " ".join(base)))
        near = list(base)
        for at in rng.sample(range(300), 3):  # 15 of 296 shingles: similarity about 0.9
            near[at] = "changed"
        rows.append((10 * g + 1, " ".join(near)))
        far = list(base)
        for at in range(0, 300, 12):  # similarity about 0.4
            far[at] = "other" + str(at)
        want.append(10 * g + 2)
        rows.append((10 * g + 2, " ".join(far)))
    docs = spark.createDataFrame(rows + [(500, None), (501, ""), (0, rows[0][1])], "doc_id long, text string")
    kept = sorted(r.doc_id for r in S.one_of_each(docs).collect())
    assert kept == sorted([*want, 500])


@pytest.mark.parametrize("n", [10_000, 10_000_000, 1_000_000_000])
def test_wide_parts_find_pairs_at_every_size(n):
    """Pairs that differ in just the radius: some part is equal in 95 %, whatever n."""
    radius = S.bits_apart(0.8)
    m, w = S._wide_parts(n, radius, S.WIDE)
    rng = np.random.default_rng(n)
    differs = np.zeros((2000, S.WIDE), bool)
    for row in differs:
        row[rng.choice(S.WIDE, radius, replace=False)] = True
    parts = S.more_parts(m, w, S.WIDE)
    assert len(parts) == m
    assert all(len(set(p)) == w for p in parts)
    found = np.zeros(len(differs), bool)
    for p in parts:
        found |= ~differs[:, p].any(axis=1)
    assert found.mean() > 0.935


def test_overlapping_parts_link(spark, monkeypatch):
    monkeypatch.setattr(S, "_wide_parts", lambda *a: (60, 16))
    rng = np.random.default_rng(3)
    bits = rng.integers(0, 2, (200, S.WIDE)).astype(np.uint8)
    near = bits.copy()
    for row in near:
        row[rng.choice(S.WIDE, 40, replace=False)] ^= 1
    rows = [(np.packbits(b).tobytes(), i, 1) for i, b in enumerate([*bits, *near])]
    got = {(min(r.a, r.b), max(r.a, r.b)) for r in S.near_pairs(spark.createDataFrame(rows, "fp binary, node long, copies long"), 87, S.WIDE).collect()}
    assert got == {(i, i + 200) for i in range(200)}


@pytest.mark.parametrize("block", [256, 4])
def test_one_of_each_by_exact_similarity(spark, monkeypatch, block):
    """Pairs of 0.75 to 0.79 both stay; of pairs of 0.81 or more one goes, be the group of one block or many."""
    monkeypatch.setattr(S, "BLOCK", block)
    rng = random.Random(31)
    rows, want = [], []
    for g in range(40):
        base = [f"w{rng.randrange(10**6)}" for _ in range(404)]
        n = (33, 36, 41, 44)[g % 4]  # of 400 shingles these at the end differ: 0.85, 0.83, 0.81 and 0.80
        far = (52, 50, 48, 46)[g % 4]  # 0.77 to 0.79
        rows += [(10 * g, " ".join(base)), (10 * g + 1, " ".join(base[:-n] + [f"n{i}" for i in range(n)])), (10 * g + 2, " ".join([f"f{g}x{i}" for i in range(far)] + base[far:]))]
        want += [10 * g, 10 * g + 2]
    hub = [f"h{rng.randrange(10**6)}" for _ in range(404)]
    for i in range(40):  # near copies of one
        rows.append((1000 + i, " ".join(hub[:-10] + [f"c{i}x{j}" for j in range(10)])))
    got = {r.doc_id for r in S.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {*want, 1000}


def test_rows_of_a_repeated_id_are_decided_each(spark, words):
    rng = random.Random(8)
    a, b, c = (" ".join(rng.choice(words) + str(rng.randint(0, 9)) for _ in range(200)) for _ in range(3))
    rows = [(1, a), (5, a + " more"), (5, b), (5, b), (7, c), (7, b + " too")]
    got = sorted((r.doc_id, r.text) for r in S.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([(1, a), (5, b), (7, c)])


def test_nothing(spark, empty):
    assert S.simhash_components(empty).count() == 0
    assert S.one_of_each(empty).count() == 0


def test_extra_columns_stay(spark, docs):
    out = S.one_of_each(docs)
    assert out.columns == docs.columns
    assert out.where(F.col("doc_id").isNull()).count() == 2


def test_no_pair_at_the_threshold_is_missed(spark):
    """Pairs of just 0.8 link whatever else is there; those of 0.79, and what shares passages, do not."""
    rng = random.Random(77)
    new = lambda n: [f"w{rng.randrange(10**8)}" for _ in range(n)]
    passage, rows, want = new(90), [], []
    for g in range(600):
        base = new(154)  # 150 shingles
        rows += [(10 * g, " ".join(base)), (10 * g + 1, " ".join(base[:-16] + new(16))), (10 * g + 2, " ".join(new(18) + base[18:]))]  # 134 and 132 of 150: 0.807 and 0.786
        want += [10 * g, 10 * g + 2]
    for g in range(300):
        rows.append((10**6 + g, " ".join(new(60) + passage)))
        want.append(10**6 + g)
    got = {r.doc_id for r in S.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id").collect()}
    assert got == set(want)


def test_candidates_as_by_brute_force(spark):
    """Sets of a few items to some hundred, also of sizes whose prefixes are shortest: every pair at the threshold is connected."""
    rng = np.random.default_rng(12)
    sets = {}
    for g in range(60):
        base = rng.integers(0, 2**63, rng.integers(1, 30) if g % 2 else rng.integers(30, 300), dtype=np.uint64)
        for _ in range(5):
            x = np.unique(np.concatenate([rng.permutation(base)[: max(1, len(base) - rng.integers(0, 4 + len(base) // 4))], rng.integers(0, 50, rng.integers(0, 3)).astype(np.uint64)]))
            sets[x.tobytes()] = x
    sets = list(sets.values())
    frame = spark.createDataFrame([(i, len(x), x.tobytes()) for i, x in enumerate(sets)], "node long, size int, items binary")
    root = {r.node: r.root for r in components(S.candidates(frame, 0.8)).collect()}
    firsts = spark.createDataFrame([(i, len(x), x[: S.first(len(x), 0.8)].tobytes()) for i, x in enumerate(sets)], "node long, size int, items binary")
    some = {r.node for r in S.sharing(firsts.union(firsts), 0.8).collect()}
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if S.alike(sets[i], sets[j], 0.8)]
    assert len(pairs) > 50
    assert all(i in some and j in some and root[i] == root[j] for i, j in pairs)
