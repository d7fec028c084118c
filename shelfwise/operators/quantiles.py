"""Exact quantiles of groups of any size, by narrowing the range in which each wanted value lies.

A first pass takes a grid of approximate quantiles of each group, a sketch of
fixed size; each wanted rank lies between two of them.  What lies in such a
bracket is counted exactly, and brackets that hold too much get a grid of their
own, until the distinct values left are few enough to count one by one.  No task
ever holds a group's values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written

#: Steps of a grid, and the accuracy of its quantiles (an error of at most one in so many).
GRID, ACCURACY = 500, 5_000
#: Rows of a bracket whose distinct values are counted one by one.
LIMIT = 1_000_000


def _grid(c: str):
    return F.percentile_approx(c, F.array(*[F.lit(i / GRID) for i in range(GRID + 1)]), ACCURACY)


def _narrowed(wanted: DataFrame, place, n) -> DataFrame:
    """Brackets (lo, hi) two grid steps to either side of a place among n rows."""
    at = place / n * GRID
    low, high = F.greatest(F.floor(at) - 2, F.lit(0)).cast("int"), F.least(F.ceil(at) + 2, F.lit(GRID)).cast("int")
    return wanted.withColumns({"_lo2": F.get("_grid", low), "_hi2": F.get("_grid", high)}).drop("_grid")


def exact_quantiles(df: DataFrame, keys: list[str], value: str, at: list[float], limit: int = LIMIT, rounds: int = 12) -> DataFrame:
    """(keys, q0, q1, ...): the quantiles ``at`` of ``value`` within keys, values between two rows interpolated.

    NULL and NaN values are left out; a group without any value gives no row.
    NULL keys make up groups of their own.
    """
    rows = written(
        df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(F.to_json(F.struct(*keys)).alias("_key"), F.col(value).cast("double").alias("_v"))
    )
    groups = written(rows.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"), _grid("_v").alias("_grid"), F.min("_v").alias("_min"), F.max("_v").alias("_max")))
    places = F.array_distinct(F.flatten(F.array(*[F.array(F.floor((F.col("_n") - 1) * F.lit(q)), F.ceil((F.col("_n") - 1) * F.lit(q))) for q in at])))
    wanted = groups.withColumn("_place", F.explode(places))
    whole = {"_lo": F.col("_min"), "_hi": F.col("_max"), "_below": F.lit(0).cast("long"), "_size": F.col("_n")}
    brackets = _counted(rows, _narrowed(wanted.withColumns(whole), F.col("_place"), F.col("_n")).drop("_min", "_max", "_n"))
    for _ in range(rounds):
        wide = brackets.where((F.col("_size") > limit) & (F.col("_lo") < F.col("_hi")))
        if not wide.take(1):
            break
        inside = rows.join(wide, "_key").where(F.col("_v").between(F.col("_lo"), F.col("_hi")))
        grids = inside.groupBy("_key", "_place").agg(_grid("_v").alias("_grid"))
        narrowed = _narrowed(wide.join(grids, ["_key", "_place"]), F.col("_place") - F.col("_below"), F.col("_size"))
        rest = brackets.join(wide.select("_key", "_place"), ["_key", "_place"], "left_anti")
        after = written(rest.unionByName(_counted(rows, narrowed)))
        same = after.agg(F.sum("_size")).first()[0] == brackets.agg(F.sum("_size")).first()[0]
        brackets = after
        if same:  # a few values repeated very often: counting them one by one costs little
            break
    values = rows.join(brackets, "_key").where(F.col("_v").between(F.col("_lo"), F.col("_hi"))).groupBy("_key", "_place", "_below", "_v").count()
    upto = F.col("_below") + F.sum("count").over(Window.partitionBy("_key", "_place").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    found = values.withColumn("_upto", upto).where(F.col("_upto") > F.col("_place")).groupBy("_key", "_place").agg(F.min("_v").alias("_v"))
    by_key = found.groupBy("_key").agg(F.map_from_entries(F.collect_list(F.struct("_place", "_v"))).alias("_at")).join(groups.select("_key", "_n"), "_key")

    def quantile(q: float):
        place = (F.col("_n") - 1) * F.lit(q)
        low, high = (F.element_at("_at", f(place).cast("long")) for f in (F.floor, F.ceil))
        return low + (place - F.floor(place)) * (high - low)

    names = by_key.select("_key", *[quantile(q).alias(f"q{i}") for i, q in enumerate(at)])
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return names.select(F.from_json("_key", kinds).alias("_k"), *names.columns[1:]).select("_k.*", *names.columns[1:])


def _counted(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Brackets (_key, _place, _lo, _hi, _below, _size) narrowed to (_lo2, _hi2) where that holds their place, written."""
    inside = F.col("_v").between(F.col("_lo2"), F.col("_hi2"))
    met = rows.join(wanted, "_key").groupBy("_key", "_place", "_lo", "_hi", "_below", "_size", "_lo2", "_hi2")
    sums = met.agg(F.count_if(F.col("_v") < F.col("_lo2")).alias("_below2"), F.count_if(inside).alias("_size2"))
    holds = (F.col("_below2") <= F.col("_place")) & (F.col("_place") < F.col("_below2") + F.col("_size2"))
    return written(sums.select("_key", "_place", *[F.when(holds, F.col(f"{c}2")).otherwise(F.col(c)).alias(c) for c in ("_lo", "_hi", "_below", "_size")]))
