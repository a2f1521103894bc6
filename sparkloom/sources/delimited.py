"""Delimited text: one pass that infers column types and counts rows, and one lazy pass that casts.

Every row keeps `row_id`, its place in the file, because tables here are positional. It comes from the scan's own
order (partition and place in it), so it needs counts of rows and no shuffle.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.errors import OutOfBounds
from sparkloom.functions.parsing import as_kind, kind_bit, kind_of_bits

ROW_ID = "row_id"


def _parted(df: DataFrame) -> DataFrame:
    return df.withColumn("__m", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__m", 33))


def with_row_id(df: DataFrame, name: str = ROW_ID) -> DataFrame:
    """Consecutive numbers from 0 in scan order. Counts per partition (a number each) come to the driver and go back as a table.

    A row outside what was counted, as where files have changed since, is an error.
    """
    counts = _parted(df).groupBy("__part").agg(F.count("*").alias("n")).collect()
    return _numbered(df, {r["__part"]: r["n"] for r in counts}, name)


def _numbered(df: DataFrame, counts: dict[int, int], name: str = ROW_ID) -> DataFrame:
    starts, at = [], 0
    for p, n in sorted(counts.items()):
        starts.append((p, at, n))
        at += n
    known = df.sparkSession.createDataFrame(starts, "__part bigint, __start bigint, __n bigint")
    place = F.col("__m").bitwiseAND((1 << 33) - 1)
    checked = F.when(place < F.col("__n"), F.col("__start") + place).otherwise(F.raise_error(F.lit("the rows have changed since they were counted")).cast("bigint"))
    return _parted(df).join(F.broadcast(known), "__part", "left").withColumn(name, checked).drop("__m", "__part", "__start", "__n")


def _header(name: str | None, i: int) -> str:
    clean = (name or "").strip().strip('"').strip()
    return clean or f"column_{i}"


def read_cells(spark: SparkSession, path: str, header: bool = True, sep: str = ",") -> DataFrame:
    """All cells as text. A row that is too short ends in nulls; one that is too long is an error."""
    first = spark.read.option("sep", sep).option("header", "false").csv(path).limit(1).collect()
    if not first:
        return spark.createDataFrame([], T.StructType([]))
    width = len(first[0])
    names = [_header(c, i) for i, c in enumerate(first[0])] if header else [f"column_{i}" for i in range(width)]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, "__more"]])
    rows = spark.read.schema(schema).option("header", str(header).lower()).option("sep", sep).option("mode", "PERMISSIVE").option("enforceSchema", "true").csv(path)
    long = F.when(F.col("__more").isNotNull(), F.raise_error(F.lit(f"a row has more than {width} cells")).cast("string"))
    return rows.select(F.coalesce(long, F.col(f"`{names[0]}`")).alias(names[0]), *(F.col(f"`{n}`") for n in names[1:]))


def from_delimited(spark: SparkSession, path: str, header: bool = True, sep: str = ",") -> DataFrame:
    """A typed table: integers, reals, dates or text by what the cells are; row_id first."""
    cells = read_cells(spark, path, header, sep)
    if not cells.columns:
        return cells
    bits = [F.bit_or(kind_bit(F.col(f"`{c}`"))).alias(f"__kind_{i}") for i, c in enumerate(cells.columns)]
    told = _parted(cells).groupBy("__part").agg(F.count("*").alias("__rows"), *bits).collect()
    kinds = {c: kind_of_bits(reduce(or_, (r[f"__kind_{i}"] for r in told), 0)) for i, c in enumerate(cells.columns)}
    counts = {r["__part"]: r["__rows"] for r in told}
    return _numbered(cells, counts).select(ROW_ID, *(as_kind(F.col(f"`{c}`"), kinds[c]).alias(c) for c in cells.columns))


def matrix_from_delimited(spark: SparkSession, path: str, header: bool = False, sep: str = ",") -> DataFrame:
    """row_id and features; a cell that is no number is an error."""
    cells = read_cells(spark, path, header, sep)
    if not cells.columns:
        raise OutOfBounds("the file has no rows")
    return with_row_id(cells).select(ROW_ID, F.array(*(F.trim(F.col(f"`{c}`")).cast("double") for c in cells.columns)).alias("features"))


def from_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def to_delimited(df: DataFrame, path: str, header: bool = True, sep: str = ",") -> None:
    df.write.option("header", str(header).lower()).option("sep", sep).csv(path)
