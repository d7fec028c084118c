"""The list-wise ranker: gradients and trees by brute force, and ranking on held-out lists."""

from __future__ import annotations

import math

import numpy as np
import pytest
from conftest import FOLDER
from pyspark.sql import functions as F

from shelfwise.functions import lists
from shelfwise.operators import list_ranker, models, ranking
from shelfwise.plans.catalog import QUERIES


def slow_gradients(score, label, sizes, depth):
    """Every pair of every list, by the definition."""
    g, h, at = np.zeros(len(score)), np.zeros(len(score)), 0
    for m in sizes:
        own = range(at, at + m)
        order = sorted(own, key=lambda i: (-score[i], i))
        rank = {i: r for r, i in enumerate(order)}
        gain = lambda i: 2.0 ** label[i] - 1
        cut = lambda r: 1 / math.log2(r + 2) if r < depth else 0.0
        ideal = sum(gain(i) * cut(r) for r, i in enumerate(sorted(own, key=lambda i: -label[i])))
        for i in own:
            for j in own:
                if label[i] > label[j] and min(rank[i], rank[j]) < depth:
                    weight = (gain(i) - gain(j)) * abs(cut(rank[i]) - cut(rank[j])) / ideal
                    p = 1 / (1 + math.exp(score[i] - score[j]))
                    g[i] += p * weight
                    g[j] -= p * weight
                    h[i] += p * (1 - p) * weight
                    h[j] += p * (1 - p) * weight
        at += m
    return g, h


@pytest.mark.parametrize("depth", [1, 3, 12])
def test_gradients_equal_all_pairs(depth):
    rng = np.random.default_rng(depth)
    sizes = np.array([1, 2, 30, 7, 1, 15, 40])
    n = sizes.sum()
    score, label = np.round(rng.normal(size=n), 1), rng.integers(0, 3, n).astype(float)
    label[3:33] = 0  # a list of one label
    for got, want in zip(list_ranker.gradients(score, label, sizes, depth), slow_gradients(score, label, sizes, depth), strict=True):
        assert got == pytest.approx(want, abs=1e-12)


@pytest.fixture(scope="module")
def made(spark):
    """Lists that differ much in how many of their rows are bought, which says nothing of the order inside one."""
    rng = np.random.default_rng(1)
    rows = []
    for c in range(1500):
        n, many = int(rng.integers(15, 45)), int(rng.integers(0, 3))
        taste, second, noise = rng.normal(size=(3, n))
        bought = np.argsort(-(taste + np.sin(3 * second) + 0.7 * rng.normal(size=n)))[: 1 if many < 2 else n - 3]
        rows += [(c, i, many * 10.0 + c % 2, float(taste[i]), float(second[i]), float(noise[i]), int(i in bought), c % 5 == 0) for i in range(n)]
    return spark.createDataFrame(rows, "cust long, art long, price double, taste double, second double, noise double, label int, held boolean").cache()


def map12(df, score):
    best = ranking.as_list(ranking.top_per(df, ["cust"], [score.desc(), F.col("art")], 12), ["cust"], "rank", "art", "predicted")
    actual = df.where("label = 1").groupBy("cust").agg(F.collect_set("art").alias("actual"))
    return actual.join(best, "cust").agg(F.avg(lists.average_precision(F.col("predicted"), F.col("actual")))).first()[0]


def test_first_tree_takes_the_best_split_of_all_rows(spark, made):
    features = ["price", "taste", "noise"]
    model = list_ranker.fit_ranker(made, ["cust"], "label", features, trees=1, levels=1, least=1, smooth=0.5, rate=1.0)
    tree = model.trees[0]
    assert len(tree.feature) == 3 and features[tree.feature[0]] == "taste"
    scored = made.withColumn("s", model.score())
    low = F.col("taste") <= float(tree.threshold[0])
    assert scored.where(low != (F.abs(F.col("s") - float(tree.value[1])) < 1e-12)).count() == 0


def test_best_split_equals_trying_all():
    rng = np.random.default_rng(4)
    cells = np.stack([rng.normal(size=(5, 64)), rng.random((5, 64)), rng.integers(0, 9, (5, 64))], -1)
    cells[1:] *= cells[:1].sum(1, keepdims=True) / cells[1:].sum(1, keepdims=True)  # the same totals in each feature
    tried = []
    for f in range(5):
        for b in range(64):
            x, y = cells[f, : b + 1].sum(0), cells[f, b + 1 :].sum(0)
            if x[2] >= 20 and y[2] >= 20:
                z = x + y
                tried.append((x[0] ** 2 / (x[1] + 1) + y[0] ** 2 / (y[1] + 1) - z[0] ** 2 / (z[1] + 1), f, b))
    gain, f, b = list_ranker.best_split(cells, 20, 1.0)
    assert (f, b) == max(tried)[1:] and gain == pytest.approx(max(tried)[0])


def test_ranks_held_out_lists_better_than_rows_scored_one_by_one(made):
    features, train, held = ["price", "taste", "second", "noise"], made.where("NOT held"), made.where("held")
    ranker = list_ranker.fit_ranker(train, ["cust"], "label", features, trees=16, levels=3, rate=0.3, smooth=1.0)
    pointwise = models.fit_scorer(train, features, "label", trees=16)
    a, b = map12(held.withColumn("s", ranker.score()), F.col("s")), map12(models.scored(pointwise, held, "s"), F.round("s", 8))
    print("MAP@12 list-wise", a, "pointwise", b)
    assert a > b + 0.01
    shares = ranker.importances()
    assert sum(shares.values()) == pytest.approx(1) and max(shares, key=shares.get) == "taste"


def test_null_features_labels_groups_and_long_lists(spark, monkeypatch):
    monkeypatch.setattr(list_ranker, "LIST_ROWS", 100)
    monkeypatch.setattr(list_ranker, "BLOCK_ROWS", 300)
    rows = [(i % 9 if i % 4 else None, (float(i % 13) if i % 5 else None), float("nan") if i % 7 == 0 else float("inf") if i % 7 == 1 else float(i % 11), (1 if i % 13 > 10 else 0) if i % 17 else None) for i in range(2000)]
    df = spark.createDataFrame(rows, "cust long, x double, y double, label int")
    raw = list_ranker._rows(df, ["cust"], "label", ["x", "y"])
    blocks = list_ranker._blocks(raw, list_ranker._edges(raw, 2)).toPandas()
    assert blocks["n"].sum() == 2000 and len(blocks) > 3
    longest = max(np.frombuffer(s, np.int64).max() for s in blocks["sizes"])
    assert longest < 200  # the list of NULL has 500 rows
    model = list_ranker.fit_ranker(df, ["cust"], "label", ["x", "y"], trees=10, levels=2, rate=0.3)
    assert len(model.trees) == 10
    scored = df.withColumn("s", model.score())
    assert scored.where("s IS NULL OR isnan(s)").count() == 0
    assert scored.where("label = 1").agg(F.avg("s")).first()[0] > scored.where("label = 0").agg(F.avg("s")).first()[0]
    assert not list_ranker.fit_ranker(df.limit(0), ["cust"], "label", ["x", "y"]).trees
    assert not list_ranker.fit_ranker(df.withColumn("label", F.lit(1)), ["cust"], "label", ["x", "y"]).trees


def test_scores_of_bins_and_of_raw_features_agree(made):
    features = ["price", "taste", "noise"]
    model = list_ranker.fit_ranker(made, ["cust"], "label", features, trees=3, levels=3)
    edges = list_ranker._edges(list_ranker._rows(made, ["cust"], "label", features), 3)
    rows = made.withColumn("s", model.score()).toPandas()
    bins = np.stack([np.searchsorted(e, rows[f].to_numpy(), "left") + 1 for f, e in zip(features, edges, strict=True)], 1)
    assert rows["s"].to_numpy() == pytest.approx(list_ranker._scores(bins, np.zeros(len(bins)), model.trees))


def test_recommendation_query(spark):
    got = QUERIES["m24_list_ranker"](spark, FOLDER).collect()
    assert len(got) == spark.read.parquet(f"{FOLDER}/customer.parquet").count()
    for r in got:
        ids = r.prediction.split(" ")
        assert len(ids) == 12 == len(set(ids)) and all(len(i) == 10 for i in ids)
