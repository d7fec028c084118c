"""Price elasticity by double machine learning: what price explains of quantity once both are freed of what the controls explain."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _other_folds_mean(df: DataFrame, cells: list[str], fold: str, names: list[str]) -> DataFrame:
    """``df`` with _m_<name>: the mean of ``name`` over rows of the same cells in the other folds; over all rows of the other folds where there are none."""
    sums = df.groupBy(*cells, fold).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(n).alias(f"_s_{n}") for n in names])
    by_cell = sums.groupBy(*cells).agg(F.sum("_n").alias("_cn"), *[F.sum(f"_s_{n}").alias(f"_cs_{n}") for n in names]) if cells else None
    by_fold = sums.groupBy(fold).agg(F.sum("_n").alias("_fn"), *[F.sum(f"_s_{n}").alias(f"_fs_{n}") for n in names])
    whole = by_fold.agg(F.sum("_fn").alias("_an"), *[F.sum(f"_fs_{n}").alias(f"_as_{n}") for n in names])
    general = by_fold.crossJoin(F.broadcast(whole))  # a row per fold
    general = general.select(fold, *[((F.col(f"_as_{n}") - F.col(f"_fs_{n}")) / F.nullif(F.col("_an") - F.col("_fn"), F.lit(0))).alias(f"_g_{n}") for n in names])
    if not cells:
        return df.join(F.broadcast(general), fold).withColumns({f"_m_{n}": F.col(f"_g_{n}") for n in names}).drop(*[f"_g_{n}" for n in names])
    means = sums.join(by_cell, cells).join(F.broadcast(general), fold)
    own = [F.coalesce((F.col(f"_cs_{n}") - F.col(f"_s_{n}")) / F.nullif(F.col("_cn") - F.col("_n"), F.lit(0)), F.col(f"_g_{n}")).alias(f"_m_{n}") for n in names]
    return df.join(means.select(*cells, fold, *own), [*cells, fold])


def _freed_of_lines(df: DataFrame, numbers: list[str], fold: str, folds: int, smooth: float) -> DataFrame:
    """_y and _t less a ridge regression on ``numbers`` fitted on the other folds; each fold gives one row of sums."""
    names = [*numbers, "_y", "_t"]
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    rows = df.groupBy(fold).agg(*[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"p{k}") for k, (i, j) in enumerate(pairs)]).collect()
    products = np.zeros((folds, len(names), len(names)))
    for r in rows:
        for k, (i, j) in enumerate(pairs):
            products[r[fold], i, j] = products[r[fold], j, i] = r[f"p{k}"] or 0.0
    p = len(numbers)
    out = {}
    for target, at in (("_y", p), ("_t", p + 1)):
        guess = F.lit(0.0)
        for k in range(folds):
            others = products.sum(0) - products[k]
            beta = np.linalg.solve(others[:p, :p] + smooth * np.eye(p), others[:p, at])
            guess = F.when(F.col(fold) == k, sum((F.lit(float(b)) * F.col(c) for b, c in zip(beta, numbers, strict=True)), F.lit(0.0))).otherwise(guess)
        out[target] = F.col(target) - guess
    return df.withColumns(out)


def dml_elasticity(
    df: DataFrame, keys: list[str], price: Column, quantity: Column, fold: Column, folds: int, cells: list[str] | None = None, numbers: list[str] | None = None, smooth: float = 1e-6
) -> DataFrame:
    """(keys, elasticity, error, n): the slope of log quantity on log price within keys, both freed of the controls, with a standard error that allows for unequal variances.

    Both nuisance models are cross-fitted: a row's expected quantity and price
    come from the other folds (``fold`` gives 0 to folds - 1), first the means
    of rows with the same ``cells``, then a regression on ``numbers`` (less
    their own such means).  Rows without a positive price and quantity or with
    a NULL control number are left out; NULL cells are cells of their own.  The
    slope is NULL where a key's price, freed, doesn't vary.
    """
    cells, numbers = list(cells or []), list(numbers or [])
    text = {c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in cells}
    rows = df.select(
        *keys, fold.cast("int").alias("_fold"), F.when(quantity > 0, F.ln(quantity)).alias("_y"), F.when(price > 0, F.ln(price)).alias("_t"),
        *[t.alias(f"_c{i}") for i, t in enumerate(text.values())], *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(numbers)],
    ).dropna(subset=["_y", "_t", "_fold", *[f"_x{i}" for i in range(len(numbers))]])
    x = [f"_x{i}" for i in range(len(numbers))]
    names = ["_y", "_t", *x]
    freed = _other_folds_mean(rows, [f"_c{i}" for i in range(len(cells))], "_fold", names).withColumns({n: F.col(n) - F.col(f"_m_{n}") for n in names})
    if numbers:
        freed = _freed_of_lines(freed, x, "_fold", folds, smooth)
    t, y = F.col("_t"), F.col("_y")
    sums = freed.groupBy(*keys).agg(
        F.sum(t * t).alias("tt"), F.sum(t * y).alias("ty"), F.sum(t * t * y * y).alias("ttyy"), F.sum(t * t * t * y).alias("ttty"), F.sum(t * t * t * t).alias("tttt"), F.count(F.lit(1)).alias("n")
    )
    slope = F.col("ty") / F.nullif("tt", F.lit(0.0))
    spread = F.col("ttyy") - 2 * slope * F.col("ttty") + slope * slope * F.col("tttt")
    return sums.select(*keys, slope.alias("elasticity"), (F.sqrt(F.greatest(spread, F.lit(0.0))) / F.nullif("tt", F.lit(0.0))).alias("error"), "n")
