"""What sets, maps, trees and heaps are for, as plans: membership, first-wins maps, order statistics, bounded top k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.errors import InvalidRequest


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def members(df: DataFrame, keys: DataFrame, on: str | Column) -> DataFrame:
    """Rows whose key is among keys."""
    return df.join(keys, on, "left_semi")


def others(df: DataFrame, keys: DataFrame, on: str | Column) -> DataFrame:
    """Rows whose key is not among keys."""
    return df.join(keys, on, "left_anti")


def first_wins(df: DataFrame, key: str, value: str, order: str | Sequence[str]) -> DataFrame:
    """key and the value of its first row by order: a map into which the first insert counts."""
    by = F.struct(*([order] if isinstance(order, str) else order))
    return df.groupBy(key).agg(F.min_by(value, by).alias(value))


def lookup(df: DataFrame, mapping: DataFrame, key: str) -> DataFrame:
    """df with the mapping's values, null where there is none."""
    return df.join(mapping, key, "left")


def smallest(df: DataFrame, k: int, *order: str) -> DataFrame:
    """The k first rows by order: each task keeps k rows."""
    return _top(df, k, [F.col(c).asc() for c in order])


def largest(df: DataFrame, k: int, *order: str) -> DataFrame:
    """The k rows of largest first column; the others break ties upwards."""
    return _top(df, k, [F.col(c).desc() if i == 0 else F.col(c).asc() for i, c in enumerate(order)])


def _top(df: DataFrame, k: int, order: list[Column]) -> DataFrame:
    if k < 0:
        raise InvalidRequest("k is negative")
    return df.orderBy(*order).limit(k)


def smallest_per_key(df: DataFrame, k: int, key: str, *order: str) -> DataFrame:
    """The k first rows of each key; Spark keeps k rows a key and task before it shuffles."""
    rank = F.row_number().over(W.partitionBy(key).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= k)


def both_ends(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.min(column).alias("least"), F.max(column).alias("most"))


def ordered(df: DataFrame, column: str, unique: bool = False) -> DataFrame:
    """All values in order; unique: each once."""
    own = df.select(column)
    return (own.distinct() if unique else own).orderBy(column)


def bitset(df: DataFrame, row_id: str, holds: Column) -> DataFrame:
    """bucket and bits: bitmaps of 32,768 rows each, whose bits are set where the condition holds; a bucket without any has no row."""
    own = df.where(holds).select(F.col(row_id).cast("bigint").alias("__row"))
    return own.groupBy(F.bitmap_bucket_number("__row").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("__row")).alias("bits"))


def bit_is_set(bits: Column, row: Column) -> Column:
    """Whether a bitmap of bitset() has the row's bit; false where there is no bitmap."""
    at = F.bitmap_bit_position(row.cast("bigint"))
    byte = F.conv(F.hex(F.substr(bits, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce((F.floor(byte / F.pow(F.lit(2), at % 8)) % 2) == 1, F.lit(False))


def bits_set(bits: DataFrame) -> DataFrame:
    """n and some: how many bits are set in all, and whether any is."""
    return bits.agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).cast("bigint").alias("n")).withColumn("some", F.col("n") > 0)
