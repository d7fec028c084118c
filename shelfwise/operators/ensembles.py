"""Ensembles of forecasts, chosen and weighted on sums: whatever the rows, the driver sees a member-by-member table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fits on rows and gives a function that adds a column of that name to other rows.
Fit = Callable[[DataFrame, str], Callable[[DataFrame], DataFrame]]


@dataclass
class Errors:
    """Weighted sums of products of the members' errors: ``products[i, j]`` over rows of weight ``weight``."""

    members: list[str]
    products: np.ndarray
    weight: float
    also: tuple = ()

    def mse(self, weights: np.ndarray) -> float:
        """Mean squared error of the members' mix; weights add up to 1."""
        return float(weights @ self.products @ weights / self.weight)


def error_products(df: DataFrame, members: list[str], target: str, weight: Column | None = None, also: tuple[Column, ...] = ()) -> Errors:
    """Sums over the rows in which no member, target or weight is NULL or NaN, in one job; ``also`` are more sums over them."""
    w = F.lit(1.0) if weight is None else weight.cast("double")
    e = [F.col(m).cast("double") - F.col(target).cast("double") for m in members]
    known = reduce(lambda a, b: a & b, [x.isNotNull() & ~F.isnan(x) for x in (*e, w)])
    pairs = [(i, j) for i in range(len(e)) for j in range(i, len(e))]
    row = df.where(known).agg(F.sum(w), *[F.sum(w * e[i] * e[j]) for i, j in pairs], *[F.sum(x) for x in also]).first()
    products = np.zeros((len(e), len(e)))
    for (i, j), v in zip(pairs, row[1:], strict=False):
        products[i, j] = products[j, i] = v or 0.0
    return Errors(list(members), products, row[0] or 1.0, tuple(x or 0.0 for x in row[1 + len(pairs) :]))


def greedy_selection(errors: Errors, picks: int = 25) -> np.ndarray:
    """Weights of an ensemble grown one member at a time, repeats allowed: each time the one that leaves the mean of all picks with the least squared error.

    Of equally good members the first is taken, and of the ensembles met on the
    way the best (of equal ones the smallest) is kept.
    """
    n = len(errors.members)
    counts, best, least = np.zeros(n), None, np.inf
    for size in range(1, picks + 1):
        tried = [errors.mse((counts + unit) / size) for unit in np.eye(n)]
        counts[int(np.argmin(tried))] += 1
        if min(tried) < least - 1e-12 * abs(least if np.isfinite(least) else 0.0):
            best, least = counts / size, min(tried)
    return best


def simplex_weights(errors: Errors) -> np.ndarray:
    """The non-negative weights adding up to 1 with the least squared error.

    With weights that add up to 1 the mix's error is the mix of the errors, so
    this is the point of least norm in the convex hull of the members' errors;
    members enter and leave until none would help (Wolfe's method).
    """
    q = errors.products / max(float(np.trace(errors.products)), 1e-300)
    n = len(q)
    held = [int(np.argmin(np.diag(q)))]
    w = np.zeros(n)
    w[held] = 1.0
    for _ in range(20 * n + 20):
        slope = q @ w
        enter = int(np.argmin(slope))
        if slope[enter] > w @ slope - 1e-13 or enter in held:
            break
        held.append(enter)
        while True:
            k = len(held)
            system = np.ones((k + 1, k + 1))
            system[:k, :k], system[k, k] = q[np.ix_(held, held)], 0.0
            target = np.linalg.lstsq(system, np.append(np.zeros(k), 1.0), rcond=None)[0][:k]
            if (target > 1e-12).all():
                w[:] = 0.0
                w[held] = target
                break
            now = w[held]
            falling = np.flatnonzero(target <= 1e-12)
            ratio = now[falling] / np.maximum(now[falling] - target[falling], 1e-300)
            w[held] = now + min(1.0, float(ratio.min())) * (target - now)
            gone = {held[i] for i in falling if w[held[i]] <= 1e-12} or {held[int(falling[int(np.argmin(ratio))])]}
            held = [i for i in held if i not in gone]
            w[[i for i in range(n) if i not in held]] = 0.0
    w = np.maximum(w, 0.0)
    return w / w.sum()


def absolute_weights(df: DataFrame, members: list[str], target: str, weight: Column | None = None, steps: int = 25) -> tuple[np.ndarray, float]:
    """Non-negative weights adding up to 1 with the least mean absolute error, and that error.

    Least squares again and again, each row weighted by the inverse of its
    error before, which is held off zero by a bound that shrinks.  Each step is
    one job that also measures the weights it starts from; the best are kept.
    """
    base = F.lit(1.0) if weight is None else weight.cast("double")
    errors = error_products(df, members, target, weight)
    weights = simplex_weights(errors)
    floor = max(errors.mse(weights) ** 0.5 / 4, 1e-12)
    best, least = weights, np.inf
    for _ in range(steps):
        miss = F.abs(sum(F.lit(float(x)) * (F.col(m).cast("double") - F.col(target).cast("double")) for x, m in zip(weights, members, strict=True)))
        found = error_products(df, members, target, base / F.greatest(miss, F.lit(floor)), (base * miss, base))
        error = found.also[0] / (found.also[1] or 1.0)
        if error < least:
            best, least = weights, error
        weights, floor = simplex_weights(found), max(floor * 0.6, 1e-12)
    return best, least


def mix(members: list[str], weights: np.ndarray) -> Column:
    """The weighted members as one column; those without weight aren't read."""
    return sum((F.lit(float(w)) * F.col(m) for m, w in zip(members, weights, strict=True) if w > 0), F.lit(0.0))


def out_of_fold(df: DataFrame, fold: str, folds: int, fits: dict[str, Fit]) -> DataFrame:
    """``df`` with a column per member, its forecast by a fit that has not seen the row's fold (0 to folds - 1)."""
    if taken := set(fits) & set(df.columns):
        raise ValueError(f"members named like columns: {sorted(taken)}")
    parts = []
    for k in range(folds):
        train, rows = df.where(F.col(fold) != k), df.where(F.col(fold) == k)
        for name, fit in fits.items():
            rows = fit(train, name)(rows)
        parts.append(rows)
    return reduce(DataFrame.unionByName, parts)


@dataclass
class Stack:
    """Members fitted on all rows, mixed by weights chosen on forecasts of rows they had not seen."""

    members: dict[str, Callable[[DataFrame], DataFrame]]
    weights: np.ndarray
    errors: Errors

    def forecast(self, rows: DataFrame, name: str = "forecast") -> DataFrame:
        columns = rows.columns
        used = [m for m, w in zip(self.members, self.weights, strict=True) if w > 0]
        for m in used:
            rows = self.members[m](rows)
        return rows.select(*columns, mix(list(self.members), self.weights).alias(name))

    def leaderboard(self) -> list[tuple[str, float, float]]:
        """(member, root mean squared error out of fold, weight), best first; the ensemble is a member too."""
        units = np.eye(len(self.members))
        rows = [(m, self.errors.mse(u) ** 0.5, float(w)) for m, u, w in zip(self.members, units, self.weights, strict=True)]
        return sorted([*rows, ("ensemble", self.errors.mse(self.weights) ** 0.5, 1.0)], key=lambda r: r[1])


def stack(df: DataFrame, fold: str, folds: int, target: str, fits: dict[str, Fit], picks: int = 25) -> Stack:
    errors = error_products(out_of_fold(df, fold, folds, fits), list(fits), target)
    weights = greedy_selection(errors, picks)
    return Stack({m: fit(df, m) if w > 0 else (lambda rows: rows) for (m, fit), w in zip(fits.items(), weights, strict=True)}, weights, errors)


def mean_of(keys: list[str], target: str) -> Fit:
    """A member: the mean of the rows with the same keys, of all rows where there are none."""

    def fit(train: DataFrame, name: str):
        means = train.groupBy(*keys).agg(F.avg(target).alias(name))
        whole = train.agg(F.avg(target)).first()[0]
        return lambda rows: rows.join(means, keys, "left").withColumn(name, F.coalesce(name, F.lit(whole).cast("double")))

    return fit


def column(source: str, otherwise: float = 0.0) -> Fit:
    """A member that is a column of the rows already, such as last year's value."""
    return lambda train, name: lambda rows: rows.withColumn(name, F.coalesce(F.col(source).cast("double"), F.lit(otherwise)))


def trees_on(features: list[str], target: str, trees: int = 10, seed: int = 1) -> Fit:
    from .models import fit_regression, scored

    return lambda train, name: (lambda model: lambda rows: scored(model, rows, name))(fit_regression(train, features, target, trees=trees, seed=seed))


def line_on(features: list[str], target: str) -> Fit:
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    from .models import scored

    def fit(train: DataFrame, name: str):
        stages = [VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep"), LinearRegression(labelCol=target, regParam=1e-3)]
        model = Pipeline(stages=stages).fit(train)
        return lambda rows: scored(model, rows, name)

    return fit
