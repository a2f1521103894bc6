"""Matrices as rows (row_id, features): moments, Gram matrices, products, standardisation, predicates.

All of it is one associative sum over the rows. Up to NARROW columns it is generated SQL; wider, a block kernel: each
task multiplies its own rows and sends one p x p partial sum, which Spark adds up by cell.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.errors import InvalidRequest, OutOfBounds
from sparkloom.functions import named
from sparkloom.functions.vectors import doubles

NARROW = 4
FEATURES = "features"


def features(df: DataFrame, columns: Sequence[str], row_id: str = "row_id") -> DataFrame:
    keep = [row_id] if row_id in df.columns else []
    return df.select(*keep, F.array(*(named(c).cast("double") for c in columns)).alias(FEATURES))


def width(x: DataFrame) -> int:
    row = x.select(F.size(FEATURES)).first()
    if row is None:
        raise OutOfBounds("the matrix has no rows")
    return row[0]


def rows_of(batch: pa.RecordBatch, column: str = FEATURES) -> np.ndarray:
    values = batch[column]
    n = len(values)
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def block_sum(x: DataFrame, kernel, shape: tuple[int, ...], columns: Sequence[str] = (FEATURES,)) -> np.ndarray:
    """Sum over tasks of what kernel(batch) gives, an array of that shape."""
    size = int(np.prod(shape))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(shape)
        for batch in batches:
            if batch.num_rows:
                out += kernel(batch)
        yield pa.record_batch([pa.array(np.arange(size)), pa.array(out.ravel())], names=["cell", "v"])

    got = x.select(*columns).mapInArrow(run, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(size)
    out[got["cell"].to_numpy()] = got["v"].to_numpy()
    return out.reshape(shape)


def moments(x: DataFrame, p: int | None = None) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, means and population standard deviations, by generated SQL: one pass, no Python."""
    p = p or width(x)
    at = [F.col(FEATURES)[i] for i in range(p)]
    row = x.agg(F.count("*"), *(F.avg(c) for c in at), *(F.stddev_pop(c) for c in at)).first()
    if not row[0]:
        raise OutOfBounds("the matrix has no rows")
    return row[0], np.array(row[1 : p + 1], float), np.array(row[p + 1 :], float)


def gram(x: DataFrame, centre: np.ndarray | None = None, p: int | None = None) -> np.ndarray:
    """X'X, of rows less centre."""
    p = p or width(x)
    c = np.zeros(p) if centre is None else np.asarray(centre, float)
    if p <= NARROW:
        at = [F.col(FEATURES)[i] - F.lit(float(c[i])) for i in range(p)]
        row = x.agg(*(F.sum(at[i] * at[j]).alias(f"s{i}_{j}") for i in range(p) for j in range(i, p))).first()
        out, values = np.zeros((p, p)), iter(row)
        for i in range(p):
            for j in range(i, p):
                out[i, j] = out[j, i] = next(values) or 0.0
        return out

    def kernel(batch: pa.RecordBatch) -> np.ndarray:
        rows = rows_of(batch) - c
        return rows.T @ rows

    return block_sum(x, kernel, (p, p))


def covariance(x: DataFrame, p: int | None = None) -> np.ndarray:
    """X'X / (n - 1) of the rows as they are: centre them first for covariances."""
    return gram(x, p=p) / (x.count() - 1)


def transpose_multiply(a: DataFrame, b: DataFrame, on: str = "row_id") -> np.ndarray:
    """A'B of matrices whose rows meet by row_id."""
    p, q = width(a), width(b)
    both = a.select(on, F.col(FEATURES).alias("a")).join(b.select(on, F.col(FEATURES).alias("b")), on)
    return block_sum(both, lambda batch: rows_of(batch, "a").T @ rows_of(batch, "b"), (p, q), ("a", "b"))


def multiply(x: DataFrame, b: np.ndarray) -> DataFrame:
    """Each row times a small matrix: Spark's own expressions for few result columns, a block kernel for more."""
    b = np.asarray(b, float)
    if b.ndim != 2 or b.shape[0] != width(x):
        raise OutOfBounds(f"{width(x)} columns by {b.shape}")
    if b.shape[1] > NARROW:
        return mapped(x, lambda rows: rows @ b)
    column = lambda j: F.aggregate(F.zip_with(doubles(F.col(FEATURES)), F.array(*map(F.lit, b[:, j].tolist())), lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)
    return x.withColumn(FEATURES, F.array(*(column(j) for j in range(b.shape[1]))))


def mapped(x: DataFrame, f) -> DataFrame:
    """x with f of the features, a block at a time; other columns stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(FEATURES)
            out = np.asarray(f(rows_of(batch))) if batch.num_rows else np.zeros((0, 1))
            offsets = pa.array(np.arange(len(out) + 1, dtype=np.int32) * out.shape[1])
            yield pa.record_batch([*batch.columns[:at], pa.ListArray.from_arrays(offsets, pa.array(out.ravel())), *batch.columns[at + 1 :]], names=batch.schema.names)

    own = x.withColumn(FEATURES, doubles(F.col(FEATURES)))
    return own.mapInArrow(run, own.schema)


def shifted(x: DataFrame, shift: np.ndarray, scale: np.ndarray) -> DataFrame:
    a, b = (F.array(*map(F.lit, np.asarray(v, float).tolist())) for v in (shift, scale))
    return x.withColumn(FEATURES, F.zip_with(F.zip_with(doubles(F.col(FEATURES)), a, lambda u, v: u - v), b, lambda u, v: u / v))


def center(x: DataFrame) -> DataFrame:
    _, mean, _ = moments(x)
    return shifted(x, mean, np.ones(len(mean)))


def standardize(x: DataFrame, epsilon: float = 1e-12) -> DataFrame:
    """(x - mean) / population sd; a column that hardly varies stays as it is."""
    n, mean, sd = moments(x)
    keep = (sd * sd * n < epsilon) | (sd < epsilon)
    return shifted(x, np.where(keep, 0, mean), np.where(keep, 1, sd))


def filled(spark, n: int, p: int, value: float) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("row_id"), F.array_repeat(F.lit(float(value)), p).alias(FEATURES))


def identity(spark, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("row_id"), F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.when(j == F.col("id"), 1.0).otherwise(0.0)).alias(FEATURES))


def _unit(seed: int, salt: int, j: Column) -> Column:
    """Uniform in (0, 1) by hash of row, column and seed: the same however rows are dealt out."""
    return (F.shiftrightunsigned(F.xxhash64(F.col("id"), j, F.lit(seed), F.lit(salt)), 11).cast("double") + 0.5) / float(1 << 53)


def random_uniform(spark, n: int, p: int, low: float = 0.0, high: float = 1.0, seed: int = 42) -> DataFrame:
    cells = F.transform(F.sequence(F.lit(0), F.lit(p - 1)), lambda j: F.lit(low) + _unit(seed, 0, j) * (high - low))
    return spark.range(n).select(F.col("id").alias("row_id"), cells.alias(FEATURES))


def random_gaussian(spark, n: int, p: int, sd: float = 1.0, seed: int = 42) -> DataFrame:
    """By the transform of Box and Muller."""
    normal = lambda j: F.sqrt(-2 * F.log(_unit(seed, 0, j))) * F.cos(2 * np.pi * _unit(seed, 1, j)) * sd
    return spark.range(n).select(F.col("id").alias("row_id"), F.transform(F.sequence(F.lit(0), F.lit(p - 1)), normal).alias(FEATURES))


def collected(x: DataFrame, limit: int = 1_000_000) -> np.ndarray:
    """All rows by row_id, on the driver: for small matrices, at most `limit` cells."""
    n = x.count()
    if n and n * width(x) > limit:
        raise InvalidRequest(f"{n} rows are too many for the driver")
    return np.array([r[0] for r in x.orderBy("row_id").select(FEATURES).collect()], float)


def distributed(spark, a: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(i, row) for i, row in enumerate(np.asarray(a, float).tolist())], f"row_id bigint, {FEATURES} array<double>")


def largest_difference(a: DataFrame, b: DataFrame) -> float:
    both = a.select("row_id", F.col(FEATURES).alias("a")).join(b.select("row_id", F.col(FEATURES).alias("b")), "row_id")
    gap = F.array_max(F.zip_with("a", "b", lambda x, y: F.abs(x - y)))
    return both.agg(F.max(gap)).first()[0] or 0.0


def equals(a: DataFrame, b: DataFrame, tolerance: float = 0.0) -> bool:
    return a.count() == b.count() and largest_difference(a, b) <= tolerance


def distinct(x: DataFrame, column: int) -> DataFrame:
    return x.select(F.col(FEATURES)[column].alias("value")).distinct()


def block(x: DataFrame, first_row: int, rows: int, first_column: int, columns: int) -> DataFrame:
    own = x.where((F.col("row_id") >= first_row) & (F.col("row_id") < first_row + rows))
    return own.withColumn(FEATURES, F.slice(FEATURES, first_column + 1, columns))


def transpose(x: DataFrame, most: int = 1_000_000) -> DataFrame:
    """Columns as rows, numbered from 0, cells by row_id; a row of the result has a cell for each row, at most so many."""
    if (n := x.count()) > most:
        raise InvalidRequest(f"{n} rows are too many for a row")
    cells = x.select("row_id", F.posexplode(FEATURES).alias("i", "v"))
    rows = cells.groupBy(F.col("i").cast("bigint").alias("row_id")).agg(F.array_sort(F.collect_list(F.struct("row_id", "v"))).alias("cells"))
    return rows.select("row_id", F.transform("cells", lambda c: c["v"]).alias(FEATURES))


def swap_rows(x: DataFrame, i: int, j: int) -> DataFrame:
    if x.where(F.col("row_id").isin(i, j)).count() != len({i, j}):
        raise OutOfBounds(f"rows {i} and {j}")
    return x.withColumn("row_id", F.when(F.col("row_id") == i, F.lit(j)).when(F.col("row_id") == j, F.lit(i)).otherwise(F.col("row_id")).cast("bigint"))


def swap_columns(x: DataFrame, i: int, j: int) -> DataFrame:
    if not 0 <= min(i, j) <= max(i, j) < width(x):
        raise OutOfBounds(f"columns {i} and {j}")
    cell = F.col(FEATURES)
    return x.withColumn(FEATURES, F.transform(FEATURES, lambda v, k: F.when(k == i, cell[j]).when(k == j, cell[i]).otherwise(v)))


def is_square(a: np.ndarray) -> bool:
    return a.ndim == 2 and a.shape[0] == a.shape[1]


def is_symmetric(a: np.ndarray, tolerance: float = 1e-9) -> bool:
    return is_square(a) and bool(np.abs(a - a.T).max(initial=0) <= tolerance)


def is_row_echelon(a: np.ndarray, tolerance: float = 1e-9) -> bool:
    last = -1
    for row in np.abs(a) > tolerance:
        lead = int(row.argmax()) if row.any() else a.shape[1]
        if lead <= last and lead < a.shape[1]:
            return False
        last = lead
    return True
