"""Ensembles, blends and elasticities against brute force on collected rows."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwise.operators import causal, ensembles


@pytest.fixture(scope="module")
def forecasts(spark):
    rng = np.random.default_rng(0)
    y = rng.normal(10, 3, 3000)
    a, b, c = y + rng.normal(1, 2, 3000), y + rng.normal(-1.5, 3, 3000), rng.normal(10, 1, 3000)
    rows = [tuple(map(float, r)) + (float(w),) for r, w in zip(np.stack([y, a, b, c, a + 5], 1), rng.integers(1, 6, 3000), strict=True)]
    rows += [(1.0, None, 1.0, 1.0, 1.0, 1.0), (1.0, float("nan"), 1.0, 1.0, 1.0, 1.0), (None, 1.0, 1.0, 1.0, 1.0, 1.0), (1.0, 1.0, 1.0, 1.0, 1.0, None)]
    return spark.createDataFrame(rows, "y double, a double, b double, c double, d double, w double").cache()


def collected(df):
    p = df.dropna().toPandas()
    return p[["a", "b", "c", "d"]].to_numpy(), p["y"].to_numpy(), p["w"].to_numpy()


NAMES = ["a", "b", "c", "d"]


def test_sums_equal_those_of_collected_rows(forecasts):
    x, y, w = collected(forecasts)
    got = ensembles.error_products(forecasts, NAMES, "y", F.col("w"))
    e = x - y[:, None]
    assert got.products == pytest.approx(e.T @ (e * w[:, None])) and got.weight == w.sum()


def test_greedy_selection_equals_trying_on_rows(forecasts):
    x, y, w = collected(forecasts)
    picks, best, least = [], None, np.inf
    for _ in range(15):
        tried = [np.average((x[:, [*picks, k]].mean(1) - y) ** 2, weights=w) for k in range(4)]
        picks.append(int(np.argmin(tried)))
        if min(tried) < least:
            best, least = np.bincount(picks, minlength=4) / len(picks), min(tried)
    errors = ensembles.error_products(forecasts, NAMES, "y", F.col("w"))
    got = ensembles.greedy_selection(errors, 15)
    assert got == pytest.approx(best) and errors.mse(got) == pytest.approx(least)
    assert errors.mse(got) <= min(errors.mse(u) for u in np.eye(4))


def by_supports(q):
    """The least w q w over the simplex, from every set of members that might be in use."""
    best = np.inf
    for k in range(1, len(q) + 1):
        for s in itertools.combinations(range(len(q)), k):
            sub = q[np.ix_(s, s)]
            if np.linalg.matrix_rank(sub, tol=1e-10 * np.trace(q)) == k:
                x = np.linalg.solve(sub, np.ones(k))
                if (x >= 0).all():
                    w = x / x.sum()
                    best = min(best, float(w @ sub @ w))
    return best


def test_simplex_weights_equal_the_best_of_all_supports():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 6):
        for k in range(40):
            e = rng.normal(rng.normal(0, 1, n), 1, (30, n)) @ (np.eye(n) + rng.normal(0, 0.5, (n, n)))
            if k % 4 == 0 and n > 1:
                e[:, 1] = e[:, 0]  # the same member twice
            q = e.T @ e
            w = ensembles.simplex_weights(ensembles.Errors(list("abcdef"[:n]), q, 30.0))
            assert (w >= 0).all() and w.sum() == pytest.approx(1)
            assert w @ q @ w == pytest.approx(by_supports(q), rel=1e-7)


def test_absolute_weights_beat_every_mix_of_a_grid(forecasts):
    x, y, w = collected(forecasts)
    got, error = ensembles.absolute_weights(forecasts, NAMES, "y", F.col("w"))
    loss = lambda v: np.average(np.abs(x @ v - y), weights=w)
    assert error == pytest.approx(loss(got))
    grid = [np.array([i, j, k, 20 - i - j - k]) / 20 for i in range(21) for j in range(21 - i) for k in range(21 - i - j)]
    assert error <= min(map(loss, grid)) + 1e-9
    near = [np.maximum(got + d, 0) for d in np.random.default_rng(2).normal(0, 0.01, (300, 4))]
    assert error <= min(loss(v / v.sum()) for v in near) + 2e-4 * error


def test_stack_uses_forecasts_of_unseen_folds_and_is_no_worse_than_its_best_member(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i % 12), float(x), int(i // 10 % 3), float(2 * x + i % 12 + rng.normal()), i % 5 == 0) for i, x in enumerate(rng.normal(0, 2, 3000))]
    df = spark.createDataFrame(rows, "item int, x double, fold int, quantity double, held boolean")
    past, now = df.where("NOT held").cache(), df.where("held")
    fits = {"means": ensembles.mean_of(["item"], "quantity"), "line": ensembles.line_on(["x"], "quantity"), "none": ensembles.column("x", 0.0)}
    unseen = ensembles.out_of_fold(past, "fold", 3, {"mean": ensembles.mean_of(["item"], "quantity")}).toPandas()
    data = past.toPandas()
    for k in range(3):
        own = unseen[unseen.fold == k]
        assert np.allclose(own["mean"], data[data.fold != k].groupby("item").quantity.mean().loc[own["item"]])
    assert len(unseen) == len(data)
    made = ensembles.stack(past, "fold", 3, "quantity", fits)
    error = lambda d, c: math.sqrt(d.agg(F.avg((F.col(c) - F.col("quantity")) ** 2)).first()[0])
    members = {m: error(fit(past, "f")(now), "f") for m, fit in fits.items()}
    board = made.leaderboard()
    print(members, board)
    assert board[0][0] == "ensemble" and error(made.forecast(now), "forecast") <= min(members.values())


def test_elasticity_survives_a_confounder(spark):
    """Demand and price both follow the season and a cost; the plain slope is far off."""
    rng = np.random.default_rng(4)
    n = 20_000
    season, cost, item = rng.integers(0, 12, n), rng.normal(0, 1, n), rng.integers(0, 2, n)
    t = 0.3 * np.sin(season) + 0.5 * cost + rng.normal(0, 0.2, n)
    theta = np.where(item == 0, -1.5, -0.5)
    y = theta * t + 2.0 * np.sin(season) + 1.0 * cost + rng.normal(0, 0.3, n)
    rows = [(int(a), int(b), float(c), float(np.exp(d)), float(np.exp(e)), int(k % 5)) for k, (a, b, c, d, e) in enumerate(zip(item, season, cost, t, y, strict=True))]
    rows += [(0, 1, 0.5, None, 2.0, 0), (0, 1, 0.5, -1.0, 2.0, 0), (0, None, 0.5, 2.0, 2.0, 0), (1, 1, None, 2.0, 2.0, 0), (7, 1, 0.1, 2.0, 2.0, 0)]
    df = spark.createDataFrame(rows, "item int, season int, cost double, price double, quantity double, fold int").cache()
    got = {r.item: r for r in causal.dml_elasticity(df, ["item"], F.col("price"), F.col("quantity"), F.col("fold"), 5, ["season"], ["cost"]).collect()}
    for i, want in ((0, -1.5), (1, -0.5)):
        x, z = t[item == i], y[item == i]
        naive = np.cov(x, z)[0, 1] / x.var(ddof=1)
        assert abs(got[i].elasticity - want) < 4 * got[i].error < 0.1 and abs(naive - want) > 0.5
        assert 1 < got[i].error / (0.3 / (0.2 * math.sqrt((item == i).sum()))) < 1.5  # more than known controls would leave, as the items share their controls' effects
    assert got[7].n == 1


@pytest.mark.parametrize("cells", [["season"], []])
def test_cross_fitting_equals_loops(spark, cells):
    rng = np.random.default_rng(5)
    rows = [(int(i % 3), int(rng.integers(0, 40)), float(rng.normal()), float(rng.random() + 0.5), float(rng.random() + 0.5), int(i % 4)) for i in range(300)]
    df = spark.createDataFrame(rows, "item int, season int, x double, price double, quantity double, fold int")
    got = {r.item: r for r in causal.dml_elasticity(df, ["item"], F.col("price"), F.col("quantity"), F.col("fold"), 4, cells, ["x"], smooth=0.1).collect()}
    values = np.array([(math.log(q), math.log(p), x) for _, _, x, p, q, _ in rows])
    fold, season = np.array([r[5] for r in rows]), np.array([r[1] if cells else 0 for r in rows])
    free = np.empty_like(values)
    for k in range(len(rows)):
        others = fold != fold[k]
        same = others & (season == season[k])
        free[k] = values[k] - values[same if same.any() else others].mean(0)
    for f in range(4):
        o, x = fold != f, free[:, 2]
        for c in (0, 1):
            beta = (x[o] @ free[o, c]) / (x[o] @ x[o] + 0.1)
            values[fold == f, c] = free[fold == f, c] - beta * x[fold == f]
    for i in range(3):
        own = np.array([r[0] == i for r in rows])
        y, t = values[own, 0], values[own, 1]
        theta = t @ y / (t @ t)
        assert got[i].elasticity == pytest.approx(theta) and got[i].error == pytest.approx(math.sqrt((t * t * (y - theta * t) ** 2).sum()) / (t @ t))
