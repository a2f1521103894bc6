from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.errors import InvalidRequest, NotSymmetric, OutOfBounds
from sparkloom.operators import decompose, linalg, neighbors, pacmap, regression
from sparkloom.operators import matrix as M
from sparkloom.operators.summary import SummaryTable, number

RNG = np.random.default_rng(12)
TALL = RNG.normal(size=(300, 6)) @ RNG.normal(size=(6, 6)) + np.arange(6)


def frame(spark, a):
    return M.distributed(spark, a).repartition(3)


def test_moments_gram_standardize(spark):
    for a in (TALL, TALL[:, :3]):
        x = frame(spark, a)
        n, mean, sd = M.moments(x)
        assert n == 300
        assert np.allclose(mean, a.mean(axis=0))
        assert np.allclose(sd, a.std(axis=0))
        assert np.allclose(M.gram(x), a.T @ a)
        assert np.allclose(M.covariance(M.center(x)), np.cov(a.T))
        z = M.collected(M.standardize(x))
        assert np.allclose(z, (a - a.mean(axis=0)) / a.std(axis=0))
    still = np.column_stack([TALL[:, 0], np.full(300, 7.0)])
    assert np.allclose(M.collected(M.standardize(frame(spark, still)))[:, 1], 7)


def test_products_and_makers(spark):
    a, b = np.array([[1, 2, 3], [4, 5, 6.0]]), np.array([[7, 8], [9, 10], [11, 12.0]])
    assert M.collected(M.multiply(frame(spark, a), b)).tolist() == [[58, 64], [139, 154]]
    wide = RNG.normal(size=(3, 9))
    assert np.allclose(M.collected(M.multiply(frame(spark, a), wide)), a @ wide)
    with pytest.raises(OutOfBounds):
        M.multiply(frame(spark, a), b.T)
    assert np.allclose(M.transpose_multiply(frame(spark, TALL), frame(spark, TALL[:, :2])), TALL.T @ TALL[:, :2])
    assert (M.collected(M.identity(spark, 4)) == np.eye(4)).all()
    assert (M.collected(M.filled(spark, 2, 3, 1.5)) == 1.5).all()
    u, g = M.collected(M.random_uniform(spark, 2000, 2, -1, 3)), M.collected(M.random_gaussian(spark, 2000, 2, 2.0))
    assert -1 < u.min() < u.max() < 3
    assert abs(u.mean() - 1) < 0.1
    assert abs(g.std() - 2) < 0.1
    assert abs(g.mean()) < 0.1
    assert (M.collected(M.random_uniform(spark, 2000, 2, -1, 3).repartition(7)) == u).all()
    assert M.equals(frame(spark, a), frame(spark, a + 0.5), 0.5)
    assert not M.equals(frame(spark, a), frame(spark, a + 0.5), 0.4)
    assert M.collected(M.block(frame(spark, TALL), 5, 2, 1, 3)).shape == (2, 3)
    assert M.is_symmetric(a @ a.T)
    assert not M.is_symmetric(a)
    assert M.is_row_echelon(np.array([[1, 2, 3], [0, 0, 4], [0, 0, 0.0]]))
    assert not M.is_row_echelon(np.array([[0, 1], [1, 0.0]]))
    with pytest.raises(InvalidRequest):
        M.collected(frame(spark, TALL), limit=10)


def test_driver_linear_algebra():
    for shape in ((4, 4), (6, 4), (3, 5)):
        a = RNG.normal(size=shape)
        lower, upper = linalg.lu(a)
        assert np.allclose(lower @ upper, a)
        assert np.abs(lower).max() <= 1 + 1e-12
        for method in ("givens", "householder"):
            q, r = linalg.qr(a, method)
            assert np.allclose(q @ r, a)
            assert np.allclose(q.T @ q, np.eye(len(q)))
    a = RNG.normal(size=(4, 4))
    s = a @ a.T + np.eye(4)
    assert np.allclose(linalg.gauss_jordan(a, s), np.linalg.solve(a, s))
    assert np.isfinite(linalg.gauss_jordan(np.zeros((2, 2)), np.ones(2))).all()
    assert np.allclose(linalg.cholesky(s) @ linalg.cholesky(s).T, s)
    values, vectors = linalg.eigen(s)
    assert np.allclose(vectors @ np.diag(values) @ vectors.T, s)
    assert (np.diff(values) <= 0).all()
    assert (vectors[np.abs(vectors).argmax(axis=0), np.arange(4)] > 0).all()
    for bad in (linalg.cholesky, linalg.eigen):
        with pytest.raises(NotSymmetric):
            bad(a)
    with pytest.raises(InvalidRequest):
        linalg.cholesky(-s)
    with pytest.raises(InvalidRequest):
        linalg.qr(np.ones((2, 3)), thin=True)


def test_minimisers():
    x, fx, done = linalg.lbfgs(linalg.rosenbrock, np.array([-1.2, 1.0, -0.5, 2.0]), iterations=500, tolerance=1e-8)
    assert done
    assert np.allclose(x, 1, atol=1e-5)
    assert fx < 1e-9
    adam, at = linalg.Adam(rate=0.05), np.array([3.0, -2.0])
    for _ in range(2000):
        at = adam.descend(at, 2 * at)
    assert np.abs(at).max() < 1e-3
    assert (linalg.Adam(rate=0.1).step(np.zeros(1), np.ones(1)) > 0).all()


def test_decompositions(spark):
    x = frame(spark, TALL)
    for preprocess, own in (("none", TALL), ("center", TALL - TALL.mean(axis=0)), ("standardize", (TALL - TALL.mean(axis=0)) / TALL.std(axis=0))):
        p = decompose.pca(x, 3, preprocess)
        z = M.collected(p.projection)
        assert z.shape == (300, 3)
        assert np.allclose(z, own @ p.components)
        assert np.allclose(z.T @ z / 299, np.diag(p.values[:3]), atol=1e-8)
        assert p.explained.sum() == pytest.approx(1)
        for tall in (10, 100):
            s = decompose.svd(x, preprocess=preprocess, tall=tall)
            assert np.allclose(s.values, np.linalg.svd(own)[1])
            assert np.allclose(M.collected(decompose.reconstruction(s)), own)
    q, r = decompose.tsqr(x)
    own = M.collected(q)
    assert np.allclose(own @ r, TALL)
    assert np.allclose(own.T @ own, np.eye(6), atol=1e-8)
    b = decompose.low_rank(x)
    assert np.allclose(b.T @ b, TALL.T @ TALL)
    with pytest.raises(InvalidRequest):
        decompose.pca(x, 7)


@pytest.fixture(scope="module")
def simulated(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(4000, 3))
    y = 4 + x @ [5, 7, 8] + rng.normal(size=4000)
    z = (rng.uniform(size=4000) < 1 / (1 + np.exp(-(1 + 6 * x[:, 0] - 9 * x[:, 1])))).astype(int)
    g = np.column_stack([np.zeros(4000), 1 + x[:, 0], -1 + 2 * x[:, 1]]) + rng.gumbel(size=(4000, 3))
    rows = [(*map(float, v), float(a), int(b), "abc"[int(c)]) for v, a, b, c in zip(x, y, z, g.argmax(axis=1), strict=True)]
    return spark.createDataFrame(rows, "x1 double, x2 double, x3 double, y double, z int, g string").cache()


def test_ols(spark, simulated):
    m = regression.ols(simulated, "y", ["x1", "x2", "x3"])
    assert np.allclose(m.beta, [4, 5, 7, 8], atol=0.1)
    s = regression.ols_summary(m, simulated)
    a = np.array(simulated.select("x1", "x2", "x3", "y").collect())
    d = np.column_stack([np.ones(len(a)), a[:, :3]])
    sse = ((a[:, 3] - d @ m.beta) ** 2).sum()
    assert s.sse == pytest.approx(sse)
    assert np.allclose(s.se, np.sqrt(sse / 3996 * np.diag(np.linalg.inv(d.T @ d))))
    assert (s.p < 1e-10).all()
    assert ((s.low < [4, 5, 7, 8]) & (s.high > [4, 5, 7, 8])).sum() >= 3
    assert s.r2 > 0.98
    assert "R-squared" in str(s)
    exact = spark.createDataFrame([(float(i), float(i % 3), 4 + 5.0 * i + 7 * (i % 3)) for i in range(9)], "a double, b double, y double")
    assert np.allclose(regression.ols(exact, "y", ["a", "b"]).beta, [4, 5, 7])
    near = exact.withColumn("c", F.col("a") + F.col("b") * 1e-7)
    assert np.allclose(regression.ols(near, "y", ["a", "c"]).beta, [4, 5 - 7e7, 7e7], rtol=1e-2)
    with pytest.raises(OutOfBounds):
        regression.ols(exact.limit(2), "y", ["a", "b"])


def test_logistic(spark, simulated):
    m = regression.logistic(simulated, "z", ["x1", "x2"])
    assert m.converged
    assert not m.separated
    assert np.allclose(m.beta, [1, 6, -9], atol=1.2)
    s = regression.logistic_summary(m, simulated)
    assert s.n == s.tp + s.tn + s.fp + s.fn == 4000
    assert s.accuracy > 0.9
    assert 0 < s.pseudo_r2 < 1
    assert (s.p < 1e-3).all()
    assert "odds ratio" in str(s)
    apart = spark.createDataFrame([(float(i), int(i >= 10)) for i in range(20)], "x double, y int")
    m = regression.logistic(apart, "y", ["x"])
    assert m.separated
    assert "separated" in str(regression.logistic_summary(m, apart))


@pytest.mark.parametrize("newton", [10**6, 0])
def test_multinomial(spark, simulated, monkeypatch, newton):
    monkeypatch.setattr(regression, "NEWTON", newton)
    m = regression.multinomial(simulated, "g", ["x1", "x2"], tolerance=1e-6)
    assert m.converged
    assert np.allclose(m.beta.sum(axis=0), 0, atol=1e-8)
    assert np.allclose(m.beta[1] - m.beta[0], [1, 1, 0], atol=0.2)
    assert np.allclose(m.beta[2] - m.beta[0], [-1, 0, 2], atol=0.25)
    first = simulated.select(m.predict().alias("e")).first()["e"]
    assert sum(e.probability for e in first) == pytest.approx(1)
    assert first[0].probability >= first[1].probability >= first[2].probability
    s = regression.multinomial_summary(m, simulated)
    assert s.df == 6
    assert 0 < s.mcfadden < 1
    assert s.log_loss == pytest.approx(m.loss * 4000)
    assert np.nanmax(s.se) < 0.3
    assert "class c" in str(s)
    with pytest.raises(InvalidRequest):
        regression.multinomial(simulated.where("g = 'a'"), "g", ["x1"])


def test_exact_neighbours(spark, monkeypatch):
    a = np.array([(i % 6, i // 6) for i in range(36)], float)
    gaps = {"euclidean": np.sqrt(((a[:, None] - a) ** 2).sum(axis=2)), "manhattan": np.abs(a[:, None] - a).sum(axis=2), "hamming": (a[:, None] != a).sum(axis=2).astype(float)}
    monkeypatch.setattr(neighbors, "BLOCK", 10)
    for kind, d in gaps.items():
        np.fill_diagonal(d, np.inf)
        want = {(i, r + 1, int(j)) for i in range(36) for r, j in enumerate(np.lexsort((np.arange(36), d[i]))[:5])}
        assert {(r.row_id, r["rank"], r.neighbor) for r in neighbors.exact(frame(spark, a), 5, kind).collect()} == want
    one = neighbors.exact_of(frame(spark, a), 7, 4).collect()
    assert [r.neighbor for r in sorted(one, key=lambda r: r["rank"])] == [1, 6, 8, 13]


def written(spark):
    """Bytes of shuffles of all stages so far."""
    stages = spark._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def nearest(a, k):
    d = np.sqrt(((a[:, None] - a) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    return {(i, r + 1, int(j)) for i in range(len(a)) for r, j in enumerate(np.lexsort((np.arange(len(a)), d[i]))[:k])}


def test_exact_neighbours_send_as_much_as_there_is(spark, monkeypatch):
    """Four times the rows, four times what is sent; it was the square of that."""
    monkeypatch.setattr(neighbors, "BLOCK", 64)
    monkeypatch.setattr(neighbors, "FEWEST", 10, raising=False)
    a = np.random.default_rng(8).normal(size=(4000, 8))
    sent = []
    for n in (1000, 4000):
        before = written(spark)
        got = neighbors.exact(frame(spark, a[:n]), 3).collect()
        sent.append(written(spark) - before)
    assert {(r.row_id, r["rank"], r.neighbor) for r in got} == nearest(a, 3)
    assert sent[1] < 5 * sent[0]


def test_scales_send_as_much_as_there_is(spark, monkeypatch):
    """As the exact search: not the square of the rows."""
    monkeypatch.setattr(neighbors, "BLOCK", 64)
    monkeypatch.setattr(neighbors, "FEWEST", 10, raising=False)
    a = np.random.default_rng(10).normal(size=(3000, 8))
    sent = []
    for n in (750, 3000):
        before = written(spark)
        assert pacmap.scales(neighbors.exact(frame(spark, a[:n]), 6)).collect()[0].sigma > 0
        sent.append(written(spark) - before)
    assert sent[1] < 5 * sent[0]


def test_exact_neighbours_of_hard_rows(spark, monkeypatch):
    """Copies, tight clusters far out, tiny and huge values, more neighbours than rows of a piece."""
    monkeypatch.setattr(neighbors, "BLOCK", 32)
    rng = np.random.default_rng(9)
    shapes = [np.repeat(rng.normal(size=(3, 4)), 40, axis=0), 1e6 + 1e-4 * rng.normal(size=(120, 4)), rng.normal(size=(120, 4)) * np.repeat([1e-30, 1, 1e25], 40)[:, None]]
    shapes.append(np.vstack([1000 * rng.normal(size=(1, 4)) + 1e-3 * rng.normal(size=(40, 4)) for _ in range(3)]))
    for a in shapes:
        assert {(r.row_id, r["rank"], r.neighbor) for r in neighbors.exact(frame(spark, a), 40).collect()} == nearest(a, 40)


def test_forest_recall(spark, monkeypatch):
    a = RNG.normal(size=(800, 5))
    a[:200] = a[0]  # one crowded leaf
    x = frame(spark, a)
    truth = neighbors.exact(x.where("row_id >= 200"), 5)
    found = neighbors.approximate(x, 5, trees=12, leaf=60).where("row_id >= 200")
    assert neighbors.recall(found, truth) > 0.85
    assert neighbors.approximate(x.limit(0), 5).count() == 0


def test_pacmap_keeps_clusters_apart(spark):
    a = np.vstack([RNG.normal(size=(40, 5)) + c for c in (0, 25, -25)])
    x = frame(spark, a)
    out = {r.row_id: r.embedding for r in pacmap.pacmap(x, pacmap.Request(neighbors=6, phases=(60, 60, 80))).collect()}
    y = np.array([out[i] for i in range(120)])
    assert np.isfinite(y).all()
    centres = y.reshape(3, 40, 2).mean(axis=1)
    spread = max(y[40 * i : 40 * i + 40].std() for i in range(3))
    assert min(np.linalg.norm(centres[i] - centres[j]) for i, j in ((0, 1), (0, 2), (1, 2))) > 2 * spread
    for bad in (pacmap.Request(neighbors=0), pacmap.Request(neighbors=500), pacmap.Request(rate=0)):
        with pytest.raises(InvalidRequest):
            pacmap.pacmap(x, bad)


def test_pacmap_forces_by_row_are_those_by_pair(monkeypatch):
    """Also of rows without pairs and over more than one stretch of rows; and tables of 600,000 rows are embedded whole."""
    monkeypatch.setattr(pacmap, "ROWS", 2048)
    rng = np.random.default_rng(12)
    n = 5000
    start = rng.normal(size=(n, 2))
    near, mid, far = (np.unique(rng.integers(0, n - 7, (n * m, 2)), axis=0) for m in (2, 1, 3))
    got = pacmap.optimise(start, near, mid, far, pacmap.Request(phases=(2, 1, 2)))
    y, adam = start.copy(), pacmap.Adam(rate=1.0)
    for turn in range(5):
        g = np.zeros_like(y)
        for pairs, w, top, base, sign in zip((near, mid, far), pacmap._weights(turn, (2, 1, 2)), (20, 20_000, 2), (10, 10_000, 1), (1, 1, -1)):
            gap = y[pairs[:, 0]] - y[pairs[:, 1]]
            pull = (sign * top * w / (base + 1 + (gap * gap).sum(axis=1)) ** 2)[:, None] * gap
            np.add.at(g, pairs[:, 0], pull)
            np.add.at(g, pairs[:, 1], -pull)
        y = adam.descend(y, g)
    assert np.allclose(got, y, rtol=1e-8, atol=1e-8)
    pacmap.Request().check(600_000)


def test_scaled_pairs_find_neighbours_once(spark):
    """Every scan of the neighbours would be a search of all pairs."""
    rows = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            rows.add(batch.num_rows)
            yield batch

    near = neighbors.exact(frame(spark, np.random.default_rng(3).normal(size=(60, 3))), 8)
    got = pacmap.neighbor_pairs(near.mapInArrow(counted, near.schema), 3).collect()
    assert rows.value == 60 * 8
    sigma = {r.row_id: r.sigma for r in pacmap.scales(near).collect()}
    want = {}
    for r in near.collect():
        want.setdefault(r.row_id, []).append((r.distance**2 / (sigma[r.row_id] * sigma[r.neighbor]), r.neighbor))
    assert {(r.row_id, r["rank"], r.neighbor) for r in got} == {(i, n + 1, j) for i, pairs in want.items() for n, (_, j) in enumerate(sorted(pairs)[:3])}


def test_summary_table():
    text = str(SummaryTable("T").add("a", 1234567).add("b", 0.00001).add("c", 2.5).group("g", ["", "v"], [["x", 1.0]]).warn("w"))
    assert "a: 1,234,567" in text
    assert "1.0000e-05" in text
    assert text.endswith("Warning: w")
    assert number(None) == ""


def test_crowded_leaves_are_compared_whole(spark, monkeypatch):
    """One leaf of many blocks, with copies: as by the exact search."""
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(size=(60, 3)), np.ones((40, 3))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_id long, features array<double>")
    want = {(r.row_id, r.rank, r.neighbor) for r in neighbors.exact(df, 4).collect()}
    monkeypatch.setattr(neighbors, "BLOCK", 10)
    one = neighbors.Forest([neighbors.grow(x[:1], 1, 0)])
    assert {(r.row_id, r.rank, r.neighbor) for r in neighbors.approximate(df, 4, forest=one).collect()} == want


def test_transpose_and_swaps(spark):
    a = np.arange(12.0).reshape(4, 3)
    x = frame(spark, a)
    assert (M.collected(M.transpose(x)) == a.T).all()
    assert (M.collected(M.transpose(M.transpose(x))) == a).all()
    assert (M.collected(M.swap_rows(x, 0, 2)) == a[[2, 1, 0, 3]]).all()
    assert (M.collected(M.swap_columns(x, 2, 1)) == a[:, [0, 2, 1]]).all()
    assert M.transpose(x.limit(0)).count() == 0
    for wrong in (lambda: M.swap_rows(x, 0, 4), lambda: M.swap_columns(x, 0, 3), lambda: M.transpose(x, most=3)):
        with pytest.raises((OutOfBounds, InvalidRequest)):
            wrong()


def test_one_row_by_forest(spark):
    rng = np.random.default_rng(6)
    a = rng.normal(size=(3000, 6))
    x = frame(spark, a)
    own = neighbors.Forest.fit(x, trees=6, leaf=60)
    hits = {}
    for checks in (1, 60):
        hits[checks] = 0
        for i in (0, 700, 2999):
            got = neighbors.approximate_of(x, i, 10, checks=checks, forest=own).collect()
            d = ((a - a[i]) ** 2).sum(axis=1)
            want = [j for j in np.argsort(d) if j != i][:10]
            assert [r["rank"] for r in got] == list(range(1, len(got) + 1))
            assert all(abs(r.distance - d[r.neighbor] ** 0.5) < 1e-9 for r in got)
            hits[checks] += len({r.neighbor for r in got} & set(want))
    assert hits[60] >= 27 and hits[60] >= hits[1]
    assert [len(leaves) for leaves in own.near(a[0], 0)] == [1] * 6
    with pytest.raises(InvalidRequest):
        neighbors.approximate_of(x, 9999, 3)
    with pytest.raises(InvalidRequest):
        neighbors.exact(x, 3, most=100)
