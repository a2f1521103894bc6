"""Moments of a stream's numeric columns, by event-time windows or over all of it.

The sums are Spark's own aggregates, so the same plan runs on a bounded table and on a stream; late rows are dropped
behind the watermark. Nothing in the batch operators needs this: it serves tables that grow.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_moments(df: DataFrame, time: str, columns: Sequence[str], window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """start, n, and mean_c and sd_c (population) of each column in each window."""
    sums = [f(F.col(c).cast("double")).alias(f"{name}_{c}") for c in columns for name, f in (("mean", F.avg), ("sd", F.stddev_pop))]
    own = df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return own.groupBy(F.window(time, window)).agg(F.count("*").alias("n"), *sums).select(F.col("window.start").alias("start"), "n", *(f"{a}_{c}" for c in columns for a in ("mean", "sd")))
