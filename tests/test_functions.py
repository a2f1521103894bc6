from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.errors import InvalidPattern, InvalidRequest
from sparkloom.functions import casts, parsing, regex, vectors
from sparkloom.functions import distributions as D


def column(spark, values, kind, *exprs):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {kind}")
    return [tuple(r)[1:] for r in df.select("i", *(e.alias(f"e{j}") for j, e in enumerate(exprs))).orderBy("i").collect()]


def test_numbers_and_kinds(spark):
    cells = ["-1.5", ".2", "1e10", "1e-3", "9223372036854775807", "9223372036854775808", "12-34", "2/30/2023", "2024-02-29T10:11:12.5Z", "", None, " 42 ", "NaN", "1.", "-", "3 4"]
    got = column(spark, cells, "string", parsing.kind(F.col("c")), parsing.parse_float(F.col("c")))
    assert [k for k, _ in got] == ["double", "double", "double", "double", "bigint", "double", "string", "string", "timestamp", None, None, "bigint", "string", "double", "string", "string"]
    assert [v for _, v in got][:4] == [-1.5, 0.2, 1e10, 1e-3]


def test_dates(spark):
    cells = ["2/18/1992", "2-8-1992", "1992/2/8", "1992-02-08 1:02:03", "2024-02-29T10:11:12.5Z", "2023-02-29", "13/1/2020", "x"]
    got = column(spark, cells, "string", parsing.format_datetime(parsing.parse_datetime(F.col("c"))), F.unix_millis(parsing.parse_datetime(F.col("c"))))
    assert [a for a, _ in got] == ["1992-02-18T00:00:00Z", "1992-02-08T00:00:00Z", "1992-02-08T00:00:00Z", "1992-02-08T01:02:03Z", "2024-02-29T10:11:12Z", None, None, None]
    assert got[4][1] % 1000 == 500


def test_kinds_look_at_each_cell_once(spark):
    """As kind() has it for hard cells; it was five aggregates that each parsed every cell."""
    cells = ["", " ", None, "1", "+1", "-0", "1.", ".5", "1e3", "1e999", ".", "-", "9" * 19, "1" * 20, "12\n", "12\u2028", "1.5\u2028", "x", "1x", "NaN", "1996-01-02", "1996-02-30", "1996-01-02T03:04:05Z", "1996-01-02 03:04", "1996-01-02T25:00:00", "1/2/1996", "1996-01-02\u2028", "1996-01-02Z", "é", "٣"]
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    names = {None: 0, "bigint": 1, "double": 2, "timestamp": 4, "string": 8}
    for r in df.select("c", parsing.kind(F.col("c")).alias("kind"), parsing.kind_bit(F.col("c")).alias("bit")).collect():
        assert names[r.kind] == r.bit, r
    plan = df.agg(parsing.column_kind(F.col("c")))._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("partial_") == 1


@pytest.mark.parametrize(
    ("cells", "kind"),
    [(["1", None, "2"], "bigint"), (["1", "2.5"], "double"), (["1/2/2020", "2020-01-02"], "timestamp"), (["1", "1/2/2020"], "string"), (["1", "a"], "string"), ([None, " "], "string")],
)
def test_column_kind(spark, cells, kind):
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    assert df.agg(parsing.column_kind(F.col("c"))).first()[0] == kind


def test_casts(spark):
    c = F.col("c")
    assert column(spark, [2.9, -2.9, None], "double", casts.cast(c, "float", "int")) == [(2,), (-2,), (None,)]
    assert column(spark, [1500], "bigint", casts.cast(casts.cast(c, "int", "datetime"), "datetime", "float")) == [(1500.0,)]
    assert column(spark, ["7", "x"], "string", casts.cast(c, "string", "int", strict=False)) == [(7,), (None,)]
    with pytest.raises(Exception, match="x"):
        column(spark, ["x"], "string", casts.cast(c, "string", "int"))
    with pytest.raises(Exception, match="not a date"):
        column(spark, ["x"], "string", casts.cast(c, "string", "datetime"))
    with pytest.raises(InvalidRequest):
        casts.cast(c, "map", "int")


def test_vectors(spark):
    rows = [([0.0, 0.0], [0.0, 0.0]), ([1.0, 2.0], [1.0, 2.0]), ([1.0, 0.0], [-1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([3.0, 4.0], [0.0, 4.0])]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "i int, a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    got = df.orderBy("i").select(*(vectors.distance(k, a, b) for k in ("euclidean", "manhattan", "hamming", "angular")), vectors.dot(a, b), vectors.normalize(a), vectors.equals(a, b, 1e-9), vectors.normalize(a, flip=True)).collect()
    assert [r[0] for r in got] == [0, 0, 2, math.sqrt(2), 3]
    assert [r[1] for r in got] == [0, 0, 2, 2, 3]
    assert [r[2] for r in got] == [0, 0, 1, 2, 1]
    assert np.allclose([r[3] for r in got], [math.sqrt(2), 0, 2, math.sqrt(2), math.sqrt(2 - 1.6)], atol=1e-7)
    assert got[4][5] == [0.6, 0.8]
    assert got[0][5] == [0, 0]
    assert got[4][7] == [-0.6, -0.8]
    assert [r[6] for r in got] == [True, True, False, False, False]
    with pytest.raises(InvalidRequest):
        vectors.distance("cosine", a, b)


@pytest.mark.parametrize(
    ("pattern", "text", "end", "options"),
    [
        ("abc", "xabcy", 4, ()), ("^abc", "xabc", -1, ()), ("a.c", "a\nc", -1, ()), ("a.c", "a\nc", 3, ("single_line",)), ("^b$", "a\nb", 3, ("multi_line",)), ("ABC", "xabc", 4, ("insensitive",)),
        ("(a|bc)+d", "xabcad", 6, ()), ("a+?", "aaa", 1, ()), ("[^0-9]+", "12ab3", 4, ()), (r"\x41", "A", 1, ()), (r"\d\D?", "x1", 2, ()), (r"a\bb", "a\bb", 3, ()), ("()", "abc", 0, ()), ("q", "", -1, ()),
    ],
)
def test_match_end(spark, pattern, text, end, options):
    assert column(spark, [text], "string", regex.match_end(F.col("c"), pattern, *options)) == [(end,)]


def test_groups_and_all(spark):
    c = F.col("c")
    got = column(spark, ["k1=v1;k22=v2", "none", None], "string", regex.group(c, r"(\w+)=(\w+)", 2), regex.matches(c, r"\d+"), regex.match_count(c, r"\d"), regex.is_match(c, "^n"))
    assert got == [("v1", ["1", "1", "22", "2"], 5, False), (None, [], 0, True), (None, None, None, None)]
    with pytest.raises(InvalidRequest):
        regex.compiled("a\\")
    with pytest.raises(InvalidRequest):
        regex.compiled("a", "x")


def test_distributions_by_identities():
    for x in (0.0, 0.1, 0.35, 0.8, 1.0):
        assert D.beta_cdf(x, 1, 1) == pytest.approx(x, abs=1e-15)
        assert D.beta_cdf(x, 2, 3) == pytest.approx(x * x * (6 - 8 * x + 3 * x * x), abs=1e-14)
        for a, b in ((0.5, 0.5), (7.5, 2.25), (40, 300), (1e-3, 1e4), (1e5, 1e5)):
            assert D.beta_cdf(x, a, b) + D.beta_cdf(1 - x, b, a) == pytest.approx(1, abs=1e-12)
            assert D.beta_cdf(x, a, b) + D.beta_cdf(x, a, b, lower=False) == pytest.approx(1, abs=1e-12)
    for t in (-30.0, -2.0, -0.1, 0.0, 0.7, 5.0):
        assert D.t_cdf(t, 1) == pytest.approx(0.5 + math.atan(t) / math.pi, rel=1e-12)
        assert D.t_cdf(t, 2) == pytest.approx(0.5 + t / 2 / math.sqrt(2 + t * t), rel=1e-10)
        assert D.t_cdf(t, 1e7) == pytest.approx(NormalDist().cdf(t), rel=1e-3, abs=1e-12)
        assert D.t_cdf(t, 4) + D.t_cdf(-t, 4) == pytest.approx(1)
        assert D.t_pdf(t, 3) == pytest.approx((D.t_cdf(t + 1e-5, 3) - D.t_cdf(t - 1e-5, 3)) / 2e-5, rel=1e-5)
        assert D.f_cdf(t * t, 1, 9) == pytest.approx(2 * D.t_cdf(abs(t), 9) - 1, abs=1e-12)
    angle = math.atan(D.t_quantile(0.975, 10) / math.sqrt(10))  # even degrees have a closed form
    area = math.sin(angle) * sum(math.prod((2 * i + 1) / (2 * i + 2) for i in range(j)) * math.cos(angle) ** (2 * j) for j in range(5))
    assert (1 + area) / 2 == pytest.approx(0.975, rel=1e-13)
    assert D.normal_cdf(-1.5) == pytest.approx(NormalDist().cdf(-1.5))
    assert D.normal_cdf(-40, log=True) == pytest.approx(-804.608442, rel=1e-8)
    for p in (1e-9, 0.2, 0.5, 0.975):
        assert D.normal_cdf(D.normal_quantile(p, 3, 2), 3, 2) == pytest.approx(p)
        assert D.t_cdf(D.t_quantile(p, 3), 3) == pytest.approx(p)
    assert math.isnan(D.normal_quantile(1.5))
    assert D.normal_quantile(0) == -math.inf
    assert D.f_cdf(3, 2, 10, lower=False, log=True) == pytest.approx(math.log(1 - D.f_cdf(3, 2, 10)))


def test_distribution_columns(spark):
    got = column(spark, [0.25, None], "double", D.beta_cdf_of(F.col("c"), F.lit(2.0), F.lit(3.0)), D.t_pdf_of(F.col("c"), F.lit(3.0)))
    assert got[0] == pytest.approx((D.beta_cdf(0.25, 2, 3), D.t_pdf(0.25, 3)), rel=1e-13)
    assert got[1] == (None, None)


def test_whole_blocks_are_as_single_numbers():
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.uniform(0, 1, 200), [0.0, 1.0, np.nan, 0.5]])
    a, b = (np.concatenate([rng.uniform(0.05, 60, 150), 10 ** rng.uniform(-3, 5, 54)]) for _ in range(2))
    t = np.concatenate([rng.normal(size=201) * 10, [0.0, np.inf, -np.inf]])
    for lower in (True, False):
        for log in (False, True):
            for many, one, args in ((D.beta_cdfs, D.beta_cdf, (x, a, b)), (D.f_cdfs, D.f_cdf, (np.abs(t), a, b)), (D.t_cdfs, D.t_cdf, (t, a)), (D.normal_cdfs, D.normal_cdf, (t, x, a))):
                want = [one(*map(float, v), lower=lower, log=log) for v in zip(*args, strict=True)]
                np.testing.assert_allclose(many(*args, lower=lower, log=log), want, rtol=2e-9 if log else 1e-9, atol=1e-13)
    p = np.concatenate([x[:200], 10.0 ** -np.arange(1, 300, 17), [0.0, 1.0, 0.5, 1.5, np.nan]])
    want = [D.normal_quantile(float(v), 1.0, 2.0) for v in p]
    np.testing.assert_allclose(D.normal_quantiles(p, np.full(len(p), 1.0), np.full(len(p), 2.0)), want, rtol=1e-11, atol=1e-13)
    np.testing.assert_allclose(D.log_gamma(np.array([1e-3, 0.5, 1, 2, 11.9, 12, 170, 1e6])), [math.lgamma(v) for v in (1e-3, 0.5, 1, 2, 11.9, 12, 170, 1e6)], rtol=1e-13, atol=1e-13)


@pytest.mark.parametrize(
    ("pattern", "kind"),
    [("a[bc", "bracket"), ("a]", "bracket"), ("[]", "bracket"), ("[^]", "bracket"), ("(a", "parenthesis"), ("a)", "parenthesis"), ("*a", "metacharacter"), ("a**", "metacharacter"), ("(|+)", "metacharacter"), ("a{2", "metacharacter"), ("a\\", "metacharacter")],
)
def test_patterns_that_fail_say_why(pattern, kind):
    with pytest.raises(InvalidPattern) as e:
        regex.compiled(pattern)
    assert e.value.kind == kind


def test_patterns_that_compile():
    for pattern in (r"[\]a]+?", "(?i)a{2,}|b", "(?:a|b)*", "[^^]", "^(a)(b)?$", r"\(\[", "a{1,3}+", "(?<n>x)+"):
        assert regex.compiled(pattern) == pattern
    regex.check("a|b|c", branches=3)
    for limits in ({"branches": 2}, {"groups": 0}):
        with pytest.raises(InvalidPattern) as e:
            regex.check("(a|b|c)", **limits)
        assert e.value.kind == next(iter(limits))
