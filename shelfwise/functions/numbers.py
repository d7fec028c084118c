"""Numeric functions; NULL in gives NULL out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def clip(x: Column, low: float | None = None, high: float | None = None) -> Column:
    out = x if low is None else F.greatest(x, F.lit(low))
    out = out if high is None else F.least(out, F.lit(high))
    return F.when(x.isNotNull(), out)


def finite(x: Column) -> Column:
    """NULL for NaN and infinities."""
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def row_mean(*columns: Column) -> Column:
    present = F.filter(F.array(*columns), lambda x: x.isNotNull())
    return F.aggregate(present, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(present), F.lit(0))


def row_std(*columns: Column) -> Column:
    """Sample standard deviation over the columns that are not NULL."""
    present = F.filter(F.array(*columns), lambda x: x.isNotNull())
    mean = row_mean(*columns)
    return F.sqrt(F.aggregate(present, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / F.nullif(F.size(present) - 1, F.lit(0)))


def variation(x: str) -> Column:
    """Sample standard deviation over the mean; NULL where the mean isn't positive."""
    return F.when(F.avg(x) > 0, F.stddev_samp(x) / F.avg(x))


def count_true(*conditions: Column) -> Column:
    out = F.lit(0)
    for c in conditions:
        out = out + F.coalesce(c, F.lit(False)).cast("int")
    return out


def fixed_bin(x: Column, edges: Sequence[float]) -> Column:
    """Bin 0, 1, .. of right-closed ranges between edges; NULL outside."""
    out = F.lit(None).cast("int")
    for i in range(len(edges) - 2, -1, -1):
        out = F.when((x > edges[i]) & (x <= edges[i + 1]), i).otherwise(out)
    return out


def edge_bin(x: Column, edges: Column) -> Column:
    """Bin of right-closed ranges between the edges of an array, the lowest edge included."""
    return F.when(x.isNotNull(), F.greatest(F.size(F.filter(F.array_distinct(edges), lambda e: e < x)) - 1, F.lit(0)))


def percent_off(before: Column, after: Column) -> Column:
    return clip(F.when(before > 0, (before - after) / before * 100).otherwise(0.0), 0.0, 100.0)


def ratio(top: Column, bottom: Column, otherwise: float = 0.0) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(otherwise)


def exact_median(df, column: str):
    """One row (middle): the median of a column's values that are not NULL, as the mean of the two middle ones.

    Values are counted first and numbered by running totals over ranges of
    them, so no task holds all.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_v")).count()
    total = counts.agg(F.sum("count")).first()[0] or 0
    edges = counts.agg(F.percentile_approx("_v", [i / 64 for i in range(1, 64)], 1000)).first()[0] or []
    ranged = counts.withColumn("_part", sum(((F.col("_v") > e).cast("int") for e in edges), F.lit(0)))
    sums = ranged.groupBy("_part").agg(F.sum("count").alias("_n"))
    before = sums.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # at most 64 rows
    upto = F.col("_before") + F.sum("count").over(Window.partitionBy("_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    placed = ranged.join(F.broadcast(before), "_part").withColumn("_upto", upto)
    holds = lambda k: F.min(F.when(F.col("_upto") >= k, F.col("_v")))
    return placed.agg(((holds((total + 1) // 2) + holds(total // 2 + 1)) / 2).alias("middle"))


def composite_decay(days: Column) -> Column:
    """a / sqrt(d) + b * exp(-c d) - 1000, at least 0, days clamped to 1."""
    d = F.greatest(days, F.lit(1))
    return F.greatest(F.lit(0.0), 25_000 / F.sqrt(d) + 150_000 * F.exp(-0.2 * d) - 1000)
