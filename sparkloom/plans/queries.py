"""Every operator as a query (spark, sf_dir) -> DataFrame over whole tables; oracle_sql() has the same in SQL.

Reals are rounded well above what summation order changes. Queries without SQL are those that SQL can't say: fitted
models, trees, embeddings, distribution functions. Where a decomposition has no SQL, what it multiplies back to has.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import casts, distributions, parsing, regex, vectors
from sparkloom.operators import containers, decompose, linalg, neighbors, pacmap, regression
from sparkloom.operators import matrix as M
from sparkloom.operators.table import Table, factorized
from sparkloom.session import scratch
from sparkloom.sources import delimited

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _cells(spark: SparkSession, a: np.ndarray, digits: int) -> DataFrame:
    return spark.createDataFrame([(i, j, round(float(v), digits) + 0.0) for (i, j), v in np.ndenumerate(np.asarray(a))], "i bigint, j bigint, v double")


def _line(spark: SparkSession, sf_dir: str, columns: Sequence[str] = LINE) -> DataFrame:
    return M.features(read(spark, sf_dir, "lineitem"), columns)


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("features"))


# moments, standardisation, covariance


@query(" union all ".join(f"select cast({i} as bigint) as i, count(*) as n, round(avg({c}), 6) as mean, round(stddev_pop({c}), 4) as sd from lineitem" for i, c in enumerate(LINE)))
def moments_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, mean, sd = M.moments(_line(spark, sf_dir))
    return spark.createDataFrame([(i, n, round(float(m), 6), round(float(s), 4)) for i, (m, s) in enumerate(zip(mean, sd, strict=True))], "i bigint, n bigint, mean double, sd double")


@query("select round((l_quantity - m1) / s1, 6) + 0.0 as z_quantity, round((l_extendedprice - m2) / s2, 6) + 0.0 as z_price from lineitem, (select avg(l_quantity) m1, stddev_pop(l_quantity) s1, avg(l_extendedprice) m2, stddev_pop(l_extendedprice) s2 from lineitem)")
def standardize_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = M.standardize(_line(spark, sf_dir, LINE[:2]))
    return z.select((F.round(F.col("features")[0], 6) + 0.0).alias("z_quantity"), (F.round(F.col("features")[1], 6) + 0.0).alias("z_price"))


@query("select round(l_discount - m, 6) + 0.0 as d from lineitem, (select avg(l_discount) m from lineitem)")
def center_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.center(_line(spark, sf_dir, ["l_discount"])).select((F.round(F.col("features")[0], 6) + 0.0).alias("d"))


def _cov_sql(columns: Sequence[str], digits: int, centred: bool = False) -> str:
    own = lambda a, b: f"covar_samp({a}, {b})" if centred else f"sum({a} * {b}) / (count(*) - 1)"
    return " union all ".join(f"select cast({i} as bigint) as i, cast({j} as bigint) as j, round({own(a, b)}, {digits}) + 0.0 as v from lineitem" for i, a in enumerate(columns) for j, b in enumerate(columns))


@query(_cov_sql(LINE, 2))
def covariance_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, M.covariance(_line(spark, sf_dir)), 2)


@query(_cov_sql(LINE, 3, True))
def covariance_centered(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _line(spark, sf_dir)
    n, mean, _ = M.moments(x)
    return _cells(spark, M.gram(x, mean) / (n - 1), 3)


WIDE = ["l_quantity", "l_discount", "l_tax", "l_linenumber", "l_quantity * l_discount", "l_quantity * l_tax"]


@query(_cov_sql([f"({c})" for c in WIDE], 5))
def covariance_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six columns: the block kernel."""
    x = read(spark, sf_dir, "lineitem").select(F.array(*(F.expr(c).cast("double") for c in WIDE)).alias("features"))
    return _cells(spark, M.covariance(x), 5)


# products


@query("select vec_id as row_id, round(list_inner_product(cast(embedding as double[]), [cast(k as double) / 64 for k in range(64)]), 9) + 0.0 as v from embeddings")
def multiply_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.multiply(_vectors(spark, sf_dir), np.arange(64).reshape(64, 1) / 64).select("row_id", (F.round(F.col("features")[0], 9) + 0.0).alias("v"))


@query("select cast(i - 1 as bigint) as i, cast(label as bigint) as j, round(sum(cast(embedding[i] as double)), 7) + 0.0 as v from embeddings, range(1, 65) r(i) group by all")
def transpose_multiply_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    b = e.select(F.col("vec_id").alias("row_id"), F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: F.when(k == F.col("label"), 1.0).otherwise(0.0)).alias("features"))
    return _cells(spark, M.transpose_multiply(_vectors(spark, sf_dir), b), 7)


@query("select distinct cast(label as double) as value from embeddings")
def matrix_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.distinct(read(spark, sf_dir, "embeddings").select(F.array(F.col("label").cast("double")).alias("features")), 0)


@query("select vec_id as row_id, round(cast(embedding[3] as double), 6) + 0.0 as a, round(cast(embedding[4] as double), 6) + 0.0 as b from embeddings where vec_id >= 10 and vec_id < 30")
def matrix_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.block(_vectors(spark, sf_dir), 10, 20, 2, 2).select("row_id", *((F.round(F.col("features")[i], 6) + 0.0).alias(c) for i, c in enumerate("ab")))


@query("select cast(k as bigint) as row_id, n_nationkey as i, cast(case k when 0 then n_nationkey else n_regionkey end as double) as v from nation, range(2) r(k)")
def matrix_transpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = M.features(read(spark, sf_dir, "nation").withColumn("row_id", F.col("n_nationkey").cast("long")), ["n_nationkey", "n_regionkey"])
    return M.transpose(x).select("row_id", F.posexplode("features").alias("i", "v")).select("row_id", F.col("i").cast("bigint").alias("i"), "v")


@query("select case vec_id when 3 then 8 when 8 then 3 else vec_id end as row_id, round(cast(embedding[64] as double), 6) + 0.0 as a, round(cast(embedding[2] as double), 6) + 0.0 as b, round(cast(embedding[1] as double), 6) + 0.0 as c from embeddings")
def matrix_swaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows 3 and 8, and the first and last columns, change places."""
    x = M.swap_columns(M.swap_rows(_vectors(spark, sf_dir), 3, 8), 0, 63)
    return x.select("row_id", *((F.round(F.col("features")[i], 6) + 0.0).alias(c) for i, c in ((0, "a"), (1, "b"), (63, "c"))))


# decompositions: what they multiply back to


def _line_cov(spark: SparkSession, sf_dir: str) -> np.ndarray:
    x = _line(spark, sf_dir)
    n, mean, _ = M.moments(x)
    return M.gram(x, mean) / (n - 1)


@query(_cov_sql(LINE, 3, True))
def lu_reconstruction(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = linalg.lu(_line_cov(spark, sf_dir))
    return _cells(spark, a @ b, 3)


@query(_cov_sql(LINE, 3, True))
def cholesky_reconstruction(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = linalg.cholesky(_line_cov(spark, sf_dir))
    return _cells(spark, a @ a.T, 3)


@query(_cov_sql(LINE, 3, True))
def qr_reconstruction(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, r = linalg.qr(_line_cov(spark, sf_dir))
    return _cells(spark, q @ r, 3)


@query(_cov_sql(LINE, 3, True))
def eigen_reconstruction(spark: SparkSession, sf_dir: str) -> DataFrame:
    values, vectors_ = linalg.eigen(_line_cov(spark, sf_dir))
    return _cells(spark, vectors_ @ np.diag(values) @ vectors_.T, 3)


#: Three columns of like scale, their covariances, and the inverse of those by cofactors.
THREE = ["l_quantity", "l_discount * 100", "l_linenumber"]
_COV3 = "select var_samp(q) a, covar_samp(q, d) b, covar_samp(q, n) c, var_samp(d) e, covar_samp(d, n) f, var_samp(n) g from (select l_quantity q, l_discount * 100 d, l_linenumber n from lineitem)"
_INVERSE = {(0, 0): "e * g - f * f", (0, 1): "c * f - b * g", (0, 2): "b * f - c * e", (1, 1): "a * g - c * c", (1, 2): "b * c - a * f", (2, 2): "a * e - b * b"}
_CELLS3 = " union all ".join(f"select {i} as i, {j} as j, ({_INVERSE[min(i, j), max(i, j)]}) / det as v from s" for i in range(3) for j in range(3))
_SUMS3 = f"with s as (select *, a * (e * g - f * f) - b * (b * g - f * c) + c * (b * f - e * c) as det from ({_COV3}))"


@query(f"{_SUMS3} select cast(i as bigint) as i, cast(j as bigint) as j, round(v, 9) + 0.0 as v from ({_CELLS3})")
def gauss_jordan_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = read(spark, sf_dir, "lineitem").select(F.array(*(F.expr(c).cast("double") for c in THREE)).alias("features"))
    n, mean, _ = M.moments(x)
    return _cells(spark, linalg.gauss_jordan(M.gram(x, mean) / (n - 1), np.eye(3)), 9)


_GRAM64 = "select cast(i - 1 as bigint) as i, cast(j - 1 as bigint) as j, round(sum(cast(embedding[i] as double) * cast(embedding[j] as double)), 6) + 0.0 as v from embeddings, range(1, 65) a(i), range(1, 65) b(j) group by all"


@query(_GRAM64)
def tsqr_gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R'R of the thin QR is the Gram matrix."""
    _, r = decompose.tsqr(_vectors(spark, sf_dir))
    return _cells(spark, r.T @ r, 6)


#: Five columns of rank two.
RANK2 = ["l_quantity", "l_discount * 100", "l_quantity + l_discount * 100", "l_quantity - l_discount * 50", "2 * l_quantity + l_discount * 300"]


@query(_cov_sql([f"({c})" for c in RANK2], 4))
def low_rank_gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of rank two, sketched with rank two: B'B is A'A only if the sketch holds the whole of their space."""
    x = read(spark, sf_dir, "lineitem").select(F.array(*(F.expr(c).cast("double") for c in RANK2)).alias("features"))
    b = decompose.low_rank(x, rank=2, iterations=2)
    return _cells(spark, b.T @ b / (x.count() - 1), 4)


_EACH = "select vec_id as row_id, cast(i - 1 as bigint) as i, round(cast(embedding[i] as double), 5) + 0.0 as v from embeddings, range(1, 65) r(i)"


def _exploded(x: DataFrame) -> DataFrame:
    return x.select("row_id", F.posexplode("features").alias("i", "v")).select("row_id", F.col("i").cast("bigint").alias("i"), (F.round("v", 5) + 0.0).alias("v"))


@query(_EACH)
def svd_reconstruction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exploded(decompose.reconstruction(decompose.svd(_vectors(spark, sf_dir), tall=1)))


@query("select round(l1 / (l1 + l2), 6) as first, round(l2 / (l1 + l2), 6) as second from (select (a + d) / 2 + sqrt((a - d) * (a - d) / 4 + b * b) as l1, (a + d) / 2 - sqrt((a - d) * (a - d) / 4 + b * b) as l2 from (select var_samp(l_quantity) a, covar_samp(l_quantity, l_discount * 100) b, var_samp(l_discount * 100) d from lineitem))")
def pca_ratio_2x2(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = read(spark, sf_dir, "lineitem").select(F.array(F.col("l_quantity"), F.col("l_discount") * 100).alias("features"))
    ratio = decompose.pca(x, preprocess="center").explained
    return spark.createDataFrame([tuple(round(float(v), 6) for v in ratio)], "first double, second double")


@query("select vec_id as row_id, round(sum(power(cast(embedding[i] as double) - m, 2)), 6) as squares from embeddings, range(1, 65) r(i), (select i as k, avg(cast(embedding[i] as double)) as m from embeddings, range(1, 65) r(i) group by i) where k = i group by vec_id")
def pca_projection_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A full projection keeps every row's distance from the mean."""
    z = decompose.pca(_vectors(spark, sf_dir), preprocess="center").projection
    return z.select("row_id", F.round(vectors.dot(F.col("features"), F.col("features")), 6).alias("squares"))


# regression


@query("select round(regr_intercept(l_extendedprice, l_quantity), 4) as intercept, round(regr_slope(l_extendedprice, l_quantity), 6) as slope, round(regr_r2(l_extendedprice, l_quantity), 8) as r2 from lineitem")
def ols_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "lineitem")
    model = regression.ols(df, "l_extendedprice", ["l_quantity"])
    s = regression.ols_summary(model, df)
    return spark.createDataFrame([(round(float(model.beta[0]), 4), round(float(model.beta[1]), 6), round(s.r2, 8))], "intercept double, slope double, r2 double")


_TWO = "select avg(l_extendedprice) my, avg(l_quantity) m1, avg(l_discount) m2, covar_pop(l_extendedprice, l_quantity) sy1, covar_pop(l_extendedprice, l_discount) sy2, covar_pop(l_quantity, l_discount) s12, var_pop(l_quantity) s11, var_pop(l_discount) s22, var_pop(l_extendedprice) syy, count(*) n from lineitem"
_BETA = f"select *, (sy1 * s22 - sy2 * s12) / (s11 * s22 - s12 * s12) as b1, (sy2 * s11 - sy1 * s12) / (s11 * s22 - s12 * s12) as b2 from ({_TWO})"


@query(f"select round(my - b1 * m1 - b2 * m2, 3) as b0, round(b1, 5) as b1, round(b2, 3) as b2 from ({_BETA})")
def ols_two_var(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = regression.ols(read(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount"]).beta
    return spark.createDataFrame([(round(float(b[0]), 3), round(float(b[1]), 5), round(float(b[2]), 3))], "b0 double, b1 double, b2 double")


@query(f"select n, round(1 - sse / (n * syy), 8) as r2, round(1 - (sse / (n - 3)) / (n * syy / (n - 1)), 8) as adjusted_r2, round((n * syy - sse) / 2 / (sse / (n - 3)), 1) as f, round(2 * 3 + n * ln(2 * pi() * sse / (n - 3)) + (n - 3), 2) as aic, round(3 * ln(n) + n * ln(2 * pi() * sse / (n - 3)) + (n - 3), 2) as bic, round(sqrt(sse / (n - 3) * s22 / (n * (s11 * s22 - s12 * s12))), 6) as se_quantity from (select *, n * (syy - b1 * sy1 - b2 * sy2) as sse from ({_BETA}))")
def ols_fit_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "lineitem")
    s = regression.ols_summary(regression.ols(df, "l_extendedprice", ["l_quantity", "l_discount"]), df)
    return spark.createDataFrame([(s.n, round(s.r2, 8), round(s.adjusted_r2, 8), round(s.f, 1), round(s.aic, 2), round(s.bic, 2), round(float(s.se[1]), 6))], "n bigint, r2 double, adjusted_r2 double, f double, aic double, bic double, se_quantity double")


def _coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "lineitem").select("l_extendedprice", *(F.expr(c).alias(n) for c, n in zip(THREE, ("quantity", "discount", "line"), strict=True)))
    s = regression.ols_summary(regression.ols(df, "l_extendedprice", ["quantity", "discount", "line"]), df)
    rows = [(n, *(float(v) for v in r)) for n, *r in zip(s.names, s.beta, s.se, s.t, s.p, s.low, s.high, strict=True)]
    return spark.createDataFrame(rows, "name string, coefficient double, std_error double, t double, p double, low double, high double")


_NORMAL = f"""{_SUMS3}, y as (select avg(p) my, var_samp(p) yy, covar_samp(p, q) y0, covar_samp(p, d) y1, covar_samp(p, n) y2, avg(q) m0, avg(d) m1, avg(n) m2, count(*) rows_ from (select l_extendedprice p, l_quantity q, l_discount * 100 d, l_linenumber n from lineitem)),
inv as ({_CELLS3}),
beta as (select i, sum(v * case j when 0 then y0 when 1 then y1 else y2 end) as b from inv, y group by i),
left_ as (select (yy - (select sum(b * case i when 0 then y0 when 1 then y1 else y2 end) from beta)) * (rows_ - 1) / (rows_ - 4) as s2 from y),
told as (select case b.i when 0 then 'quantity' when 1 then 'discount' else 'line' end as name, b.b as coefficient, sqrt(s2 * v / (rows_ - 1)) as std_error from beta b join inv on inv.i = b.i and inv.j = b.i, left_, y
  union all select 'constant', my - (select sum(b * case i when 0 then m0 when 1 then m1 else m2 end) from beta), sqrt(s2 * (1.0 / rows_ + (select sum(v * case i when 0 then m0 when 1 then m1 else m2 end * case j when 0 then m0 when 1 then m1 else m2 end) from inv) / (rows_ - 1))) from left_, y)
select name, round(coefficient, 5) as coefficient, round(std_error, 5) as std_error, round(coefficient / std_error, 4) as t from told"""


@query(_NORMAL)
def ols_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: coefficients of prices on three columns, their errors and t; in SQL by the normal equations."""
    return _coefficients(spark, sf_dir).select("name", F.round("coefficient", 5).alias("coefficient"), F.round("std_error", 5).alias("std_error"), F.round("t", 4).alias("t"))


@query()
def ols_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rest of that table: p-values and intervals, which need the t distribution."""
    return _coefficients(spark, sf_dir).select("name", "p", "low", "high")


LOGIT_X = ["l_quantity", "l_discount", "l_tax"]


@query("select cast(count(*) as bigint) as n, round(sum(case when l_linestatus = 'O' then 1.0 else 0.0 end), 2) as positives, round(sum(case when l_linestatus = 'O' then l_quantity else 0.0 end), 1) as quantity, round(sum(case when l_linestatus = 'O' then l_discount else 0.0 end), 2) as discount from lineitem")
def logistic_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At the optimum, predicted chances add up to the positives, and so do their products with each column."""
    df = read(spark, sf_dir, "lineitem")
    p = regression.logistic(df, "l_linestatus", LOGIT_X, "O", tolerance=1e-9, ridge=0.0).predict()
    return df.agg(F.count("*").alias("n"), F.round(F.sum(p), 2).alias("positives"), F.round(F.sum(p * F.col("l_quantity")), 1).alias("quantity"), F.round(F.sum(p * F.col("l_discount")), 2).alias("discount"))


@query(f"select cast(label as bigint) as class, round(count(*), 2) as expected, {', '.join(f'round(sum(cast(embedding[{i + 1}] as double)), 3) + 0.0 as x{i}' for i in range(4))}, cast(count(*) as bigint) as n from embeddings group by label")
def multinomial_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likewise for each class, and for each column within it: what only the optimum meets."""
    df = read(spark, sf_dir, "embeddings").select("label", *(F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(4)))
    model = regression.multinomial(df, "label", [f"x{i}" for i in range(4)], tolerance=1e-9, iterations=200)
    chances = df.select(*(f"x{i}" for i in range(4)), F.explode(model.predict()).alias("e"))
    sums = [(F.round(F.sum(F.col("e.probability") * F.col(f"x{i}")), 3) + 0.0).alias(f"x{i}") for i in range(4)]
    each = chances.groupBy(F.col("e.class").cast("bigint").alias("class")).agg(F.round(F.sum("e.probability"), 2).alias("expected"), *sums)
    return each.join(df.groupBy(F.col("label").cast("bigint").alias("class")).agg(F.count("*").alias("n")), "class").select("class", "expected", "x0", "x1", "x2", "x3", "n")


@query()
def logistic_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "lineitem")
    s = regression.logistic_summary(regression.logistic(df, "l_linestatus", LOGIT_X, "O"), df)
    return spark.createDataFrame([(n, *(float(v) for v in r)) for n, *r in zip(s.names, s.beta, s.odds, s.se, s.z, s.p, strict=True)], "name string, coefficient double, odds double, std_error double, z double, p double")


@query()
def multinomial_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "embeddings").select("label", *(F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(4)))
    s = regression.multinomial_summary(regression.multinomial(df, "label", [f"x{i}" for i in range(4)]), df)
    return spark.createDataFrame([(s.n, s.accuracy, s.log_loss, s.mcfadden, s.df, s.df_residual, s.precision, s.recall)], "n bigint, accuracy double, log_loss double, mcfadden double, df bigint, df_residual bigint, precision double, recall double")


_B = regression.Binary("y", 1, ["l_quantity", "l_discount"], np.array([-1.0, 0.05, 3.0]), True, False, 0, 0)


@query("select round(1 / (1 + exp(-(-1.0 + 0.05 * l_quantity + 3.0 * l_discount))), 9) as p from lineitem")
def sigmoid_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(F.round(_B.predict(), 9).alias("p"))


@query("select sum(case when y and p >= 0.5 then 1 else 0 end)::bigint as tp, sum(case when not y and p < 0.5 then 1 else 0 end)::bigint as tn, sum(case when not y and p >= 0.5 then 1 else 0 end)::bigint as fp, sum(case when y and p < 0.5 then 1 else 0 end)::bigint as fn from (select l_tax > 0.04 as y, 1 / (1 + exp(-(-1.0 + 0.05 * l_quantity + 3.0 * l_discount))) as p from lineitem)")
def confusion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "lineitem").withColumn("y", (F.col("l_tax") > 0.04).cast("int"))
    s = regression.logistic_summary(_B, df)
    return spark.createDataFrame([(s.tp, s.tn, s.fp, s.fn)], "tp bigint, tn bigint, fp bigint, fn bigint")


_SOFT = "select vec_id, 0.1 + cast(embedding[1] as double) as a, 0.2 - cast(embedding[2] as double) as b, cast(embedding[3] as double) * 2 as c from embeddings"


@query(f"select vec_id, round(exp(a) / (exp(a) + exp(b) + exp(c)), 9) as pa, round(exp(b) / (exp(a) + exp(b) + exp(c)), 9) as pb, case when a >= b and a >= c then 'a' when b >= c then 'b' else 'c' end as best from ({_SOFT})")
def softmax_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "embeddings").select("vec_id", *(F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(3)))
    model = regression.Multinomial("y", ["a", "b", "c"], ["x0", "x1", "x2"], np.array([[0.1, 1, 0, 0], [0.2, 0, -1, 0], [0, 0, 0, 2.0]]), 0.0, True, 0)
    own = df.select("vec_id", model.predict().alias("e"))
    of = lambda c: F.round(F.filter("e", lambda x: x["class"] == c)[0]["probability"], 9)
    return own.select("vec_id", of("a").alias("pa"), of("b").alias("pb"), F.col("e")[0]["class"].alias("best"))


# labels, casts, parsing


@query("select o_orderpriority, row_number() over (order by f, o_orderpriority) - 1 as code from (select o_orderpriority, min(o_orderkey) as f from orders group by 1)")
def factorize_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factorized(read(spark, sf_dir, "orders"), "o_orderpriority", "o_orderkey")


@query("select o_orderkey, code from orders join (select o_orderpriority, row_number() over (order by f, o_orderpriority) - 1 as code from (select o_orderpriority, min(o_orderkey) as f from orders group by 1)) using (o_orderpriority)")
def factorize_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Table(read(spark, sf_dir, "orders").withColumn("o_key", F.col("o_orderkey")), "o_orderkey")
    return t.factorize("O_ORDERPRIORITY", "code", 0).select("code").df


@query("select o_orderkey, cast(trunc(o_totalprice) as bigint) as whole, cast(o_orderkey as double) as as_real, epoch_ms(o_orderdate) as millis, cast(epoch_ms(o_orderdate) as double) as real_millis, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') as printed, cast(o_orderkey as varchar) as text from orders")
def cast_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return read(spark, sf_dir, "orders").select("o_orderkey", casts.cast(c("o_totalprice"), "float", "int").alias("whole"), casts.cast(c("o_orderkey"), "int", "float").alias("as_real"), casts.cast(c("o_orderdate"), "datetime", "int").alias("millis"), casts.cast(c("o_orderdate"), "datetime", "float").alias("real_millis"), casts.cast(c("o_orderdate"), "datetime", "string").alias("printed"), casts.cast(c("o_orderkey"), "int", "string").alias("text"))


@query("select o_orderkey, epoch_ms(cast(date_trunc('day', o_orderdate) as timestamp)) as slashes, epoch_ms(cast(date_trunc('day', o_orderdate) as timestamp)) as dashes, epoch_ms(date_trunc('second', o_orderdate)) as iso, true as valid, false as invalid from orders")
def parse_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate")
    slashes, dashes = F.concat_ws("/", F.month(d), F.day(d), F.year(d)), F.concat_ws("-", F.year(d), F.month(d), F.day(d))
    millis = lambda c: F.unix_millis(parsing.parse_datetime(c))
    return read(spark, sf_dir, "orders").select("o_orderkey", millis(slashes).alias("slashes"), millis(dashes).alias("dashes"), millis(F.date_format(d, parsing.ISO)).alias("iso"), parsing.valid_datetime(slashes).alias("valid"), parsing.valid_datetime(F.concat(F.lit("2/30/"), F.year(d))).alias("invalid"))


@query("select event_id, cast(regexp_extract(props, '[0-9]+') as bigint) as whole, cast(regexp_extract(props, '[0-9]+') || '.5' as double) as part, cast(regexp_extract(props, '[0-9]+') || 'e2' as double) as power, cast(null as bigint) as none, 'bigint' as kind_whole, 'double' as kind_part, 'string' as kind_text from events")
def parse_infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.regexp_extract("props", "[0-9]+", 0)
    return read(spark, sf_dir, "events").select("event_id", parsing.parse_integer(n).alias("whole"), parsing.parse_float(F.concat(n, F.lit(".5"))).alias("part"), parsing.parse_float(F.concat(n, F.lit("e2"))).alias("power"), parsing.parse_integer(F.col("props")).alias("none"), parsing.kind(n).alias("kind_whole"), parsing.kind(F.concat(n, F.lit(".5"))).alias("kind_part"), parsing.kind(F.col("props")).alias("kind_text"))


def _mixed(cast: str) -> dict[str, str]:
    """Columns of text cells, some of one kind and some of several, in words that both engines have."""
    key, price, day = (f"cast({c} as {cast})" for c in ("o_orderkey", "o_totalprice", "cast(o_orderdate as date)"))
    return {
        "keys": key, "prices": price, "days": day, "words": "o_orderstatus", "gaps": f"case when o_orderkey % 3 = 0 then '' else {key} end",
        "mostly_whole": f"case when o_orderkey % 1000 = 7 then {price} else {key} end", "mostly_days": f"case when o_orderkey % 1000 = 7 then {key} else {day} end",
        "mostly_numbers": f"case when o_orderkey = (select max(o_orderkey) from orders) then 'n/a' else {price} end",
    }


def _kind_sql(cell: str) -> str:
    whole, real, day = (f"count(*) filter (regexp_full_match(x, '{p}'))" for p in ("[+-]?[0-9]{1,19}", "[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?", "[0-9]{4}-[0-9]{2}-[0-9]{2}"))
    return f"(select case when count(x) = 0 then 'string' when {whole} = count(x) then 'bigint' when {real} = count(x) then 'double' when {day} = count(x) then 'timestamp' else 'string' end from (select nullif({cell}, '') as x from orders))"


@query("select " + ", ".join(f"{_kind_sql(cell)} as {name}" for name, cell in _mixed("varchar").items()))
def infer_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders")
    last = orders.agg(F.max("o_orderkey")).first()[0]
    cells = {n: c.replace("(select max(o_orderkey) from orders)", str(last)) for n, c in _mixed("string").items()}
    return orders.agg(*(parsing.column_kind(F.expr(c)).alias(n) for n, c in cells.items()))


# delimited text: tables are written as text and read again with inferred types


@query("select c_custkey, c_name, c_mktsegment, round(c_acctbal, 2) as c_acctbal from customer")
def delimited_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    delimited.to_delimited(read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal"), path)
    df = delimited.from_delimited(spark, path)
    return df.select("c_custkey", "c_name", "c_mktsegment", F.round("c_acctbal", 2).alias("c_acctbal"))


@query("select o_orderkey, epoch_ms(o_orderdate) as millis, case when o_orderkey % 5 <> 0 then o_totalprice end as price, o_orderstatus from orders")
def delimited_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates, numbers with gaps and words; separated by semicolons."""
    path = scratch(spark)
    cells = read(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", parsing.ISO).alias("day"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice")).alias("price"), "o_orderstatus")
    delimited.to_delimited(cells, path, sep=";")
    df = delimited.from_delimited(spark, path, sep=";")
    return df.select("o_orderkey", F.unix_millis("day").alias("millis"), "price", "o_orderstatus")


@query("select count(*) as n, cast(0 as bigint) as least, count(*) - 1 as most, count(*) as different, cast(sum(l_quantity) as double) as quantity, round(sum(l_discount), 2) as discount from lineitem")
def delimited_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A matrix from text without names: rows are numbered from 0 without gaps."""
    path = scratch(spark)
    delimited.to_delimited(read(spark, sf_dir, "lineitem").select("l_quantity", "l_discount"), path, header=False)
    x = delimited.matrix_from_delimited(spark, path)
    return x.agg(F.count("*").alias("n"), F.min("row_id").alias("least"), F.max("row_id").alias("most"), F.count_distinct("row_id").alias("different"), F.sum(F.col("features")[0]).alias("quantity"), F.round(F.sum(F.col("features")[1]), 2).alias("discount"))


# tables


@query("select n_nationkey, n_name, n_regionkey from nation union all select 25, 'NOWHERE', null")
def row_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Table(read(spark, sf_dir, "nation").withColumn("row_id", F.col("n_nationkey").cast("long")))
    return t.append([[25, "NOWHERE"]]).select("n_nationkey", "n_name", "n_regionkey").df.drop("row_id")


@query("select r_regionkey, cast(7 as bigint) as seven, r_name, cast(null as double) as nothing, r_name as again from region")
def add_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Table(read(spark, sf_dir, "region").withColumn("row_id", F.col("r_regionkey").cast("long")))
    return t.add_constant_column(7, "seven", 1).add_empty_column("float", "nothing").add_copy("R_NAME", "again").df.drop("row_id")


@query("select r_regionkey, r_name, cast(10 * (row_number() over (order by r_regionkey)) as bigint) as tens from region")
def add_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Table(read(spark, sf_dir, "region").withColumn("row_id", F.col("r_regionkey").cast("long")))
    return t.add_values([10, 20, 30, 40, 50], "tens").df.drop("row_id")


@query("select event_id, user_id + 2 as user_id, round(value + 2.5, 6) as value, epoch_us(ts) // 1000 + 1500 as millis, event_type || '2.5' as event_type from events")
def column_plus_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Table(read(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value"), "event_id")
    df = t.add_to("user_id", 2.5).add_to("value", 2.5).add_to("ts", 1500).add_to("event_type", 2.5).df
    return df.select("event_id", "user_id", F.round("value", 6).alias("value"), F.unix_millis("ts").alias("millis"), "event_type")


@query("select c_mktsegment, c_name as name, c_custkey from customer")
def drop_reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Table(read(spark, sf_dir, "customer"), "c_custkey")
    return t.remove_column("c_acctbal").remove_column(1).rename("C_NAME", "name").select("c_mktsegment", "name").df


@query("select c_custkey, case when c_custkey = 3 then 'nobody' else c_name end as c_name, 1.5 as c_acctbal from customer")
def assign_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Table(read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"), "c_custkey")
    return t.set_cell(3, "c_name", "nobody").assign("c_acctbal", 1.5).df


@query("select c_custkey, case when c_custkey = 3 then c_name || '2' else c_name end as c_name, case when c_custkey = 5 then round(c_acctbal + 2.5, 6) else round(c_acctbal, 6) end as c_acctbal from customer")
def cell_plus_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Table(read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"), "c_custkey")
    return t.add_to_cell(3, "c_name", 2).add_to_cell(5, "c_acctbal", 2.5).df.select("c_custkey", "c_name", F.round("c_acctbal", 6).alias("c_acctbal"))


@query("select o_orderkey, cast(o_custkey as double) as a, o_totalprice as b, cast(epoch_ms(o_orderdate) as double) as c from orders")
def table_to_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = Table(read(spark, sf_dir, "orders"), "o_orderkey").to_matrix(["o_custkey", "o_totalprice", "o_orderdate"])
    return m.select("o_orderkey", *(F.col("features")[i].alias(c) for i, c in enumerate("abc")))


# vectors and neighbours

_PAIRS = "from embeddings a join embeddings b on b.vec_id = a.vec_id + 1"
_LISTS = "cast(a.embedding as double[])", "cast(b.embedding as double[])"
_ZIP = f"list_zip({_LISTS[0]}, {_LISTS[1]})"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _vectors(spark, sf_dir)
    return x.select("row_id", F.col("features").alias("a")).join(x.select((F.col("row_id") - 1).alias("row_id"), F.col("features").alias("b")), "row_id")


def _distance(kind: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _pairs(spark, sf_dir).select(F.col("row_id").alias("vec_id"), (F.round(vectors.distance(kind, F.col("a"), F.col("b")), 8) + 0.0).alias("d"))

    run.__name__ = f"distance_{kind}"
    return run


for _kind, _sql in {"euclidean": f"list_distance({_LISTS[0]}, {_LISTS[1]})", "manhattan": f"list_sum(list_transform({_ZIP}, lambda x: abs(x[1] - x[2])))", "hamming": f"list_sum(list_transform({_ZIP}, lambda x: case when x[1] <> x[2] then 1.0 else 0.0 end))", "angular": f"sqrt(greatest(0, 2 - 2 * list_cosine_similarity({_LISTS[0]}, {_LISTS[1]})))"}.items():
    query(f"select a.vec_id, round(cast({_sql} as double), 8) + 0.0 as d {_PAIRS}")(_distance(_kind))


@query(f"select a.vec_id, round(list_inner_product({_LISTS[0]}, {_LISTS[1]}), 9) + 0.0 as dot, round(sqrt(list_inner_product({_LISTS[0]}, {_LISTS[0]})), 9) as norm, round({_LISTS[0]}[1] / sqrt(list_inner_product({_LISTS[0]}, {_LISTS[0]})), 8) + 0.0 as unit, round(list_max({_LISTS[0]}), 8) + 0.0 as top {_PAIRS}")
def vector_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    return _pairs(spark, sf_dir).select(F.col("row_id").alias("vec_id"), (F.round(vectors.dot(a, b), 9) + 0.0).alias("dot"), F.round(vectors.l2_norm(a), 9).alias("norm"), (F.round(vectors.normalize(a)[0], 8) + 0.0).alias("unit"), (F.round(vectors.sort_descending(a)[0], 8) + 0.0).alias("top"))


def _knn_sql(k: int) -> str:
    return f"select a.vec_id as row_id, b.vec_id as neighbor, list_distance(cast(a.embedding as double[]), cast(b.embedding as double[])) as distance, row_number() over (partition by a.vec_id order by list_distance(cast(a.embedding as double[]), cast(b.embedding as double[])), b.vec_id) as rank from embeddings a join embeddings b on a.vec_id <> b.vec_id qualify rank <= {k}"


@query(f"select row_id, cast(rank as bigint) as rank, neighbor, round(distance, 7) as distance from ({_knn_sql(12)})")
def knn_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbors.exact(_vectors(spark, sf_dir), 12).select("row_id", F.col("rank").cast("bigint").alias("rank"), "neighbor", F.round("distance", 7).alias("distance"))


@query("select cast(row_number() over (order by d, vec_id) as bigint) as rank, vec_id as neighbor, round(d, 7) as distance from (select b.vec_id, list_distance(cast(a.embedding as double[]), cast(b.embedding as double[])) as d from embeddings a, embeddings b where a.vec_id = 7 and b.vec_id <> 7 order by d, b.vec_id limit 20)")
def knn_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbors.exact_of(_vectors(spark, sf_dir), 7, 20).select(F.col("rank").cast("bigint").alias("rank"), "neighbor", F.round("distance", 7).alias("distance"))


@query()
def ann_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbors.approximate(_vectors(spark, sf_dir), 12)


@query(f"select row_id, round(greatest(avg(distance), 1e-10), 7) as sigma from ({_knn_sql(6)}) where rank between 4 and 6 group by row_id")
def nn_scale_sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pacmap.scales(neighbors.exact(_vectors(spark, sf_dir), 6)).select("row_id", F.round("sigma", 7).alias("sigma"))


@query(f"with near as ({_knn_sql(20)}), s as (select row_id, greatest(avg(distance), 1e-10) as sigma from near where rank between 4 and 6 group by row_id) select n.row_id, n.neighbor, cast(row_number() over (partition by n.row_id order by n.distance * n.distance / (a.sigma * b.sigma), n.neighbor) as bigint) as rank, round(n.distance * n.distance / (a.sigma * b.sigma), 6) as scaled from near n join s a on n.row_id = a.row_id join s b on n.neighbor = b.row_id qualify row_number() over (partition by n.row_id order by n.distance * n.distance / (a.sigma * b.sigma), n.neighbor) <= 5")
def nn_scaled_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = pacmap.neighbor_pairs(neighbors.exact(_vectors(spark, sf_dir), 20), 5)
    return pairs.select("row_id", "neighbor", F.col("rank").cast("bigint").alias("rank"), F.round("scaled", 6).alias("scaled"))


@query()
def pacmap_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pacmap.pacmap(_vectors(spark, sf_dir))


# containers

_KEYS = ", ".join(LINE_KEY)


@query(f"select {_KEYS} from lineitem order by l_extendedprice, {_KEYS} limit 100")
def topk_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containers.smallest(read(spark, sf_dir, "lineitem").select(*LINE_KEY), 100, "l_extendedprice", *LINE_KEY)


@query(f"select {_KEYS} from lineitem order by l_extendedprice desc, {_KEYS} limit 100")
def topk_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containers.largest(read(spark, sf_dir, "lineitem").select(*LINE_KEY), 100, "l_extendedprice", *LINE_KEY)


@query("select l_suppkey, cast(row_number() over (partition by l_suppkey order by l_extendedprice, l_orderkey, l_linenumber, l_partkey, l_quantity) as bigint) as rank, l_extendedprice from lineitem qualify rank <= 3")
def topk_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = containers.smallest_per_key(read(spark, sf_dir, "lineitem"), 3, "l_suppkey", "l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return top.select("l_suppkey", F.col("rank").cast("bigint").alias("rank"), "l_extendedprice")


@query("select o_custkey, arg_min(o_orderstatus, o_orderkey) as o_orderstatus from orders group by o_custkey")
def first_wins_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containers.first_wins(read(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus", "o_orderkey")


@query("select c_custkey, o_orderstatus from customer left join (select o_custkey as c_custkey, arg_min(o_orderstatus, o_orderkey) as o_orderstatus from orders group by 1) using (c_custkey)")
def map_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = containers.first_wins(read(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus", "o_orderkey").withColumnRenamed("o_custkey", "c_custkey")
    return containers.lookup(read(spark, sf_dir, "customer").select("c_custkey"), first, "c_custkey")


@query("select distinct o_orderdate from orders")
def distinct_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containers.distinct_values(read(spark, sf_dir, "orders"), "o_orderdate")


@query("select c_custkey, c_name from customer where c_custkey in (select o_custkey from orders)")
def membership_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containers.members(read(spark, sf_dir, "customer").select("c_custkey", "c_name"), read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("select c_custkey, c_name from customer where c_custkey not in (select o_custkey from orders)")
def membership_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containers.others(read(spark, sf_dir, "customer").select("c_custkey", "c_name"), read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("select o_orderkey, o_totalprice > 100000 as set_, (select count(*) from orders where o_totalprice > 100000) as n, true as some from orders")
def bitset_of_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bitmap of the dear orders, read back bit by bit."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    bits = containers.bitset(orders, "o_orderkey", F.col("o_totalprice") > 100_000)
    back = orders.join(bits, F.bitmap_bucket_number("o_orderkey") == F.col("bucket"), "left").select("o_orderkey", containers.bit_is_set(F.col("bits"), F.col("o_orderkey")).alias("set_"))
    return back.crossJoin(containers.bits_set(bits))  # one row


@query("select min(o_totalprice) as least, max(o_totalprice) as most from orders")
def both_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containers.both_ends(read(spark, sf_dir, "orders"), "o_totalprice")


@query("select distinct p_size from part order by p_size")
def ordered_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containers.ordered(read(spark, sf_dir, "part"), "p_size", unique=True)


# regular expressions


@query("select page_id, regexp_matches(html, '<h[12]') as heads, regexp_extract(url, '^([a-z]+)://([^/]+)', 2) as host, regexp_extract(html, '<[a-z]+', 0) as tag from pages")
def regex_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", regex.is_match(F.col("html"), "<h[12]").alias("heads"), regex.group(F.col("url"), "^([a-z]+)://([^/]+)", 2).alias("host"), F.coalesce(regex.match(F.col("html"), "<[a-z]+"), F.lit("")).alias("tag"))


@query("select p_partkey, cast(case when regexp_matches(p_brand, '[0-9]') then length(regexp_extract(p_brand, '^[^0-9]*[0-9]', 0)) else -1 end as bigint) as digit_end, cast(-1 as bigint) as never from part")
def regex_end_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", regex.match_end(F.col("p_brand"), r"\d").alias("digit_end"), regex.match_end(F.col("p_brand"), "~").alias("never"))


@query("select doc_id, cast(len(regexp_extract_all(text, '[A-Z][a-z]+')) as bigint) as n, regexp_extract_all(text, '[A-Z][a-z]+')[1] as first, regexp_matches(text, '(?i)THE') as the from documents")
def regex_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return read(spark, sf_dir, "documents").select("doc_id", regex.match_count(t, "[A-Z][a-z]+").alias("n"), F.get(regex.matches(t, "[A-Z][a-z]+"), F.lit(0)).alias("first"), regex.is_match(t, "THE", "insensitive").alias("the"))


# distributions


_ERF = "list_sum(list_transform(range(0, 30), lambda k: case when k % 2 = 0 then 1 else -1 end * power(x, 2 * k + 1) / (power(2.0, k) * factorial(cast(least(k, 19) as integer)) * (2 * k + 1)) * case when k < 20 then 1 else 0 end))"


@query(f"select p_partkey, x, round(1 - power(1 + 2 * x / 7, -3.5), 9) as f, round(0.5 + (atan(x / sqrt(5)) + x / sqrt(5) / (1 + x * x / 5) * (1 + 2.0 / 3 / (1 + x * x / 5))) / pi(), 9) as t, round(8 / (3 * pi() * sqrt(5)) * power(1 + x * x / 5, -3), 9) as t_density, round(0.5 + {_ERF} / sqrt(2 * pi()), 9) as normal, round(exp(-x * x / 2) / sqrt(2 * pi()), 9) as density, round(x, 9) as back from (select p_partkey, p_size / 51.0 as x from part)")
def distribution_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F of 2 and 7 and t of 5 degrees have closed forms, the normal distribution a series; its quantile is the inverse."""
    d, x = distributions, F.col("x")
    rows = read(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") / 51.0).alias("x"))
    zero, one = F.lit(0.0), F.lit(1.0)
    told = rows.withColumn("q", d.normal_quantile_of(x, zero, one)).select(
        "p_partkey", "x", F.round(d.f_cdf_of(x, F.lit(2.0), F.lit(7.0)), 9).alias("f"), F.round(d.t_cdf_of(x, F.lit(5.0)), 9).alias("t"), F.round(d.t_pdf_of(x, F.lit(5.0)), 9).alias("t_density"),
        F.round(d.normal_cdf_of(x, zero, one), 9).alias("normal"), F.round(d.normal_density_of(x, zero, one), 9).alias("density"), F.round(d.normal_cdf_of(F.col("q"), zero, one), 9).alias("back"),
    )
    return told


@query()
def ann_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The approximate neighbours of one row, looking into 200 leaves."""
    return neighbors.approximate_of(_vectors(spark, sf_dir), 7, 20, checks=200)


@query("select p_partkey, round(x * x * (6 - 8 * x + 3 * x * x), 9) as beta, round(0.5 + x / 2 / sqrt(2 + x * x), 9) as t from (select p_partkey, p_size / 51.0 as x from part)")
def distributions_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beta(2, 3) and t with two degrees have closed forms."""
    d, x = distributions, (F.col("p_size") / 51.0)
    return read(spark, sf_dir, "part").select("p_partkey", F.round(d.beta_cdf_of(x, F.lit(2.0), F.lit(3.0)), 9).alias("beta"), F.round(d.t_cdf_of(x, F.lit(2.0)), 9).alias("t"))


@query("select n_nationkey as i, cast(k as bigint) as j, cast(case k when 0 then n_nationkey else n_regionkey end as double) as v from nation, range(2) r(k)")
def matrix_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I'A is A."""
    nation = read(spark, sf_dir, "nation").withColumn("row_id", F.col("n_nationkey").cast("long"))
    return _cells(spark, M.transpose_multiply(M.identity(spark, nation.count()), M.features(nation, ["n_nationkey", "n_regionkey"])), 9)


@query("select count(*) * 3 as cells, count(*) * 3 as different, true as bounded, true as centred, true as spread, true as of_normal_shape from orders")
def random_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many rows as orders; means and variances within five standard errors."""
    n = read(spark, sf_dir, "orders").count()
    u = M.random_uniform(spark, n, 3, -1.0, 1.0).select(F.explode("features").alias("u")).agg(F.count("*").alias("cells"), F.count_distinct("u").alias("different"), (F.max(F.abs("u")) < 1).alias("bounded"), (F.abs(F.avg("u")) < 5 / (9 * n) ** 0.5).alias("centred"))
    g = M.random_gaussian(spark, n, 3, 2.0).select(F.explode("features").alias("g")).agg((F.abs(F.var_pop("g") - 4) < 5 * 4 * (2 / (3 * n)) ** 0.5).alias("spread"), (F.abs(F.avg(F.when(F.abs("g") < 2, 1.0).otherwise(0.0)) - 0.6826894921) < 5 * (0.22 / (3 * n)) ** 0.5).alias("of_normal_shape"))
    return u.crossJoin(g)  # a row each
