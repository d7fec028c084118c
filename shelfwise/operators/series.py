"""Time-series operators: every window is partitioned by key and ordered by date."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by(keys: list[str], order: list[str | Column]):
    return Window.partitionBy(*keys).orderBy(*order)


def row_lag(c: str, n: int, keys: list[str], order: str) -> Column:
    return F.lag(c, n).over(by(keys, [order]))


def rolling(f, c: str | Column, rows: int, keys: list[str], order: str) -> Column:
    """f over the ``rows`` rows before, the current one left out."""
    return f(c).over(by(keys, [order]).rowsBetween(-rows, -1))


def expanding(f, c: str | Column, keys: list[str], order: str) -> Column:
    return f(c).over(by(keys, [order]).rowsBetween(Window.unboundedPreceding, -1))


def calendar_lag(df: DataFrame, keys: list[str], date: str, value: str, days: int, name: str) -> DataFrame:
    """The value ``days`` days earlier, NULL if that day has no row; one window instead of a self join.

    Where that day has several rows of the key their values are summed; a self
    join would repeat the row for each.
    """
    number = F.datediff(F.col(date), F.lit("1970-01-01").cast("date"))
    w = Window.partitionBy(*keys).orderBy(number).rangeBetween(-days, -days)
    return df.withColumn(name, F.sum(value).over(w))


def ewm_mean(c: str, span: int, keys: list[str], order: str) -> Column:
    """Exponentially weighted mean of the rows before, weights normalized over the history.

    A NULL adds nothing but ages what is before it.  Rows so far back that
    their weight is lost in a double's rounding are not read, so a row costs
    the same however long its key's history is.
    """
    keep = 1 - 2 / (span + 1)
    reach = math.ceil(-60 * math.log(2) / math.log(keep))
    history = F.collect_list(F.struct(F.col(c).alias("x"))).over(by(keys, [order]).rowsBetween(-reach, -1))
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("w"))

    def step(a: Column, r: Column) -> Column:
        return F.struct((a["n"] * keep + F.coalesce(r["x"], F.lit(0.0))).alias("n"), (a["w"] * keep + F.when(r["x"].isNull(), 0.0).otherwise(1.0)).alias("w"))

    return F.aggregate(history, start, step, lambda a: F.when(a["w"] > 0, a["n"] / a["w"]))


def forward_fill(c: str, keys: list[str], order: list[str | Column]) -> Column:
    return F.last(c, ignorenulls=True).over(by(keys, order).rowsBetween(Window.unboundedPreceding, 0))


def as_of(targets: DataFrame, facts: DataFrame, keys: list[str], date: str, values: list[str]) -> DataFrame:
    """Each target row with the last non-NULL value of each column at or before its date; one shuffle by key."""
    marked = targets.withColumn("_target", F.lit(1)).unionByName(facts.select(*keys, date, *values).withColumn("_target", F.lit(0)), allowMissingColumns=True)
    filled = marked.withColumns({v: forward_fill(v, keys, [F.col(date), F.col("_target")]) for v in values})
    return filled.where("_target = 1").drop("_target")


def dense_grid(sales: DataFrame, keys: list[str], date: str, value: str, first: Column | str, last: Column | str) -> DataFrame:
    """All keys by all days, days without a row as 0; ``sales`` must have one row per key and day."""
    days = sales.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr("interval 1 day"))).alias(date))
    grid = sales.select(*keys).distinct().crossJoin(F.broadcast(days))  # one row per day of the range
    return grid.join(sales.select(*keys, date, value), [*keys, date], "left").withColumn(value, F.coalesce(value, F.lit(0.0)))


def carry_shift(df: DataFrame, keys: list[str], week: str, value: str, share: float, weeks: tuple[int, int]) -> DataFrame:
    """In the given weeks of the year, move ``share`` of the running value on to the next row of the key.

    A key's rows are cut where nothing is moved on, so what is solved together
    is the few rows of one year's weeks.
    """
    order = by(keys, [week])
    before = F.lag(F.weekofyear(week).between(*weeks)).over(order)
    df = df.withColumn("_piece", F.sum((~F.coalesce(before, F.lit(False))).cast("int")).over(by(keys, [week]).rowsBetween(Window.unboundedPreceding, 0)))
    rows = df.groupBy(*keys, "_piece").agg(F.sort_array(F.collect_list(F.struct(F.col(week).alias("w"), F.weekofyear(week).alias("n"), F.col(value).cast("double").alias("v")))).alias("_rows"))
    start = F.struct(F.lit(0.0).alias("carry"), F.array().cast("array<struct<w:date,v:double>>").alias("out"))

    def step(acc: Column, r: Column) -> Column:
        held = r["v"] + acc["carry"]
        gives = F.when(r["n"].between(*weeks), held * share).otherwise(0.0)
        return F.struct(gives.alias("carry"), F.concat(acc["out"], F.array(F.struct(r["w"].alias("w"), (held - gives).alias("v")))).alias("out"))

    moved = rows.select(*keys, F.explode(F.aggregate("_rows", start, step, lambda a: a["out"])).alias("r"))
    return moved.select(*keys, F.col("r.w").alias(week), F.col("r.v").alias(value))


def drop_outliers(df: DataFrame, keys: list[str], value: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Rows within the exact quantiles of the positive values of their key, zeros always."""
    limits = df.where(F.col(value) > 0).groupBy(*keys).agg(F.percentile(value, F.array(F.lit(low), F.lit(high))).alias("_q"))
    joined = df.join(limits, keys, "left")
    inside = F.col(value).between(F.get("_q", F.lit(0)), F.get("_q", F.lit(1)))
    return joined.where((F.col(value) <= 0) | F.col("_q").isNull() | inside).drop("_q")
