"""Windows over keys whose history doesn't fit one task.

Rows get their place in their key from ranges of key and order, as far as
possible of equal size, so a key may span any number of tasks.  A key is then
cut into stretches of a fixed number of rows.  A stretch is worked on by
itself, and what it needs of those before is handed on: some rows copied from
the last one (rolling frames), a running total or last value of all before
(expanding frames, fills, as-of joins), or the state of a recursion that can be
composed (exponential weights).  What is handed on is a row per stretch.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import dropped, written

#: Rows of a range partition, and of a stretch, about.
PART_ROWS = 250_000
STRETCH = 20_000
#: Stretches back that a recursion is handed on from.
NEAR = 64


def placed(df: DataFrame, keys: list[str], order: list[str], part_rows: int = PART_ROWS) -> DataFrame:
    """``df`` with _key (the keys as text) and _place, each row's number from 0 on in its key; NULL comes first, of equal rows any.

    The result is a written table.
    """
    rows = df.withColumn("_key", F.to_json(F.struct(*keys))).withColumn("_row", F.monotonically_increasing_id())
    rows = written(rows)
    parts = max(1, -(-rows.count() // part_rows))
    by = ["_key", *order, "_row"]
    dealt = written(rows.repartitionByRange(parts, *by).withColumn("_part", F.spark_partition_id()))
    totals = dealt.groupBy("_part", "_key").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_part", "_key", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    number = F.row_number().over(Window.partitionBy("_part", "_key").orderBy(*by))
    out = written(dealt.join(totals, ["_part", "_key"]).withColumn("_place", F.col("_before") + number - 1).drop("_part", "_before"))
    dropped(rows)
    dropped(dealt)
    return out


def _stretched(df: DataFrame, keys: list[str], order: list[str], stretch: int, part_rows: int) -> DataFrame:
    return placed(df, keys, order, part_rows).withColumn("_stretch", F.floor(F.col("_place") / stretch))


_OWN = ("_key", "_row", "_place", "_stretch")


def _inside(first: int, last: int):
    """A frame of rows of one stretch."""
    return Window.partitionBy("_key", "_stretch").orderBy("_place").rowsBetween(first, last)


def _stretches_before():
    return Window.partitionBy("_key").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)


def rolling(df: DataFrame, frames: dict[str, tuple[Column, int]], keys: list[str], order: list[str], stretch: int = STRETCH, part_rows: int = PART_ROWS) -> DataFrame:
    """``df`` with aggregates over some rows before, the current one left out; ``frames`` has name: (such as F.avg("x"), rows).

    The last rows of a stretch, as many as the longest frame has, are copied to
    the next one, so a row is read at most twice; no stretch is shorter.
    """
    most = max(n for _, n in frames.values())
    stretch = max(stretch, most)
    own = _stretched(df, keys, order, stretch, part_rows).withColumn("_copy", F.lit(False))
    edge = own.where(F.col("_place") % stretch >= stretch - most).withColumns({"_stretch": F.col("_stretch") + 1, "_copy": F.lit(True)})
    added = {name: f.over(_inside(-n, -1)) for name, (f, n) in frames.items()}
    return own.unionByName(edge).withColumns(added).where("NOT _copy").drop(*_OWN, "_copy")


def expanding_mean(df: DataFrame, value: str, name: str, keys: list[str], order: list[str], stretch: int = STRETCH, part_rows: int = PART_ROWS) -> DataFrame:
    """``df`` with the mean of ``value`` over all rows before in the key; NULL where none has one."""
    own = _stretched(df, keys, order, stretch, part_rows)
    sums = own.groupBy("_key", "_stretch").agg(F.sum(value).alias("_s"), F.count(value).alias("_c"))
    sums = sums.select("_key", "_stretch", F.sum("_s").over(_stretches_before()).alias("_s"), F.sum("_c").over(_stretches_before()).alias("_c"))
    near = _inside(Window.unboundedPreceding, -1)
    total = F.coalesce("_s", F.lit(0)) + F.coalesce(F.sum(value).over(near), F.lit(0))
    seen = F.coalesce("_c", F.lit(0)) + F.coalesce(F.count(value).over(near), F.lit(0))
    return own.join(sums, ["_key", "_stretch"]).withColumn(name, total / F.nullif(seen, F.lit(0))).drop(*_OWN, "_s", "_c")


def fill_forward(df: DataFrame, values: list[str], keys: list[str], order: list[str], stretch: int = STRETCH, part_rows: int = PART_ROWS) -> DataFrame:
    """``df`` with each NULL of ``values`` replaced by the last value of its key before it, if there is one."""
    own = _stretched(df, keys, order, stretch, part_rows)
    last = own.groupBy("_key", "_stretch").agg(*[F.max_by(v, F.when(F.col(v).isNotNull(), F.col("_place"))).alias(f"_l{i}") for i, v in enumerate(values)])
    last = last.select("_key", "_stretch", *[F.last(f"_l{i}", ignorenulls=True).over(_stretches_before()).alias(f"_l{i}") for i in range(len(values))])
    upto = _inside(Window.unboundedPreceding, 0)
    filled = {v: F.coalesce(F.last(v, ignorenulls=True).over(upto), F.col(f"_l{i}")) for i, v in enumerate(values)}
    return own.join(last, ["_key", "_stretch"]).withColumns(filled).drop(*_OWN, *[f"_l{i}" for i in range(len(values))])


def as_of(targets: DataFrame, facts: DataFrame, keys: list[str], date: str, values: list[str], stretch: int = STRETCH, part_rows: int = PART_ROWS) -> DataFrame:
    """Each target row with the last non-NULL value of each column at or before its date.

    Targets and facts are merged by key and date and dealt in ranges of both, so
    one key with any share of the rows is spread like many.
    """
    marked = targets.withColumn("_target", F.lit(1)).unionByName(facts.select(*keys, date, *values).withColumn("_target", F.lit(0)), allowMissingColumns=True)
    return fill_forward(marked, values, keys, [date, "_target"], stretch, part_rows).where("_target = 1").drop("_target")


def _decayed(x: np.ndarray, first: np.ndarray, keep: float) -> np.ndarray:
    """s[i] = x[i] + keep * s[i - 1] inside runs that begin at ``first``, in steps of doubling reach."""
    s, at = x.copy(), np.arange(len(x))
    reach = 1
    while reach <= (at - first).max(initial=0) and keep**reach > 0:
        add = np.zeros_like(s)
        add[reach:] = s[:-reach] * keep**reach
        s = s + np.where(at - reach >= first, add, 0.0)
        reach *= 2
    return s


def ewm_mean(df: DataFrame, value: str, span: int, name: str, keys: list[str], order: list[str], stretch: int = STRETCH, part_rows: int = PART_ROWS) -> DataFrame:
    """``df`` with the exponentially weighted mean of the rows before, weights normalized over the history.

    A NULL adds nothing but ages what is before it.  The state of a stretch is
    two numbers, its weighted sum and its weights, which fade by ``keep`` for
    each row after it; states are composed along a key, one row a stretch, and
    a row costs one step of a scan inside its stretch.
    """
    keep = 1 - 2 / (span + 1)
    stretch = max(stretch, math.ceil(46 / NEAR / -math.log(keep)))  # NEAR stretches fade below a double's rounding
    df = df.withColumn(value, F.when(~F.isnan(F.col(value).cast("double")), F.col(value)))
    own = _stretched(df, keys, order, stretch, part_rows)
    age = F.pow(F.lit(keep), F.max("_place").over(Window.partitionBy("_key", "_stretch")) - F.col("_place"))
    aged = own.select("_key", "_stretch", (F.col(value) * age).alias("_x"), F.when(F.col(value).isNotNull(), age).alias("_w"))
    ends = aged.groupBy("_key", "_stretch").agg(F.coalesce(F.sum("_x"), F.lit(0.0)).alias("_x"), F.coalesce(F.sum("_w"), F.lit(0.0)).alias("_w"))
    near, fade = Window.partitionBy("_key").orderBy("_stretch"), keep**stretch  # all stretches but a key's last are full
    state = [sum((F.coalesce(F.lag(c, k).over(near), F.lit(0.0)) * fade ** (k - 1) for k in range(1, NEAR + 1) if k == 1 or fade ** (k - 1) > 0), F.lit(0.0)) for c in ("_x", "_w")]
    ends = ends.select("_key", "_stretch", state[0].alias("_x_in"), state[1].alias("_w_in"))

    groups = max(1, -(-own.count() // part_rows))
    rows = own.join(ends, ["_key", "_stretch"]).withColumn("_group", F.pmod(F.xxhash64("_key", "_stretch"), F.lit(groups)))
    columns = df.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{name}` double"

    def local(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("_key", "_stretch", "_place")])
        key, piece = (table[c].to_pandas() for c in ("_key", "_stretch"))
        at = np.arange(len(table))
        first = np.maximum.accumulate(np.where((key != key.shift()) | (piece != piece.shift()), at, 0))
        x = table[value].cast("double").to_numpy()
        known = ~np.isnan(x)
        faded = keep ** (at - first).astype(np.float64)
        carried = (table[c].to_numpy() for c in ("_x_in", "_w_in"))
        own = (_decayed(v, first, keep) for v in (np.where(known, x, 0.0), known.astype(np.float64)))
        n, w = (np.where(at > first, np.concatenate(([0.0], s[:-1])), 0.0) + c * faded for s, c in zip(own, carried, strict=True))
        seen = w > 0
        return table.select(columns).append_column(name, pa.array(n / np.where(seen, w, 1.0), mask=~seen))

    return rows.groupBy("_group").applyInArrow(local, schema)
