"""Exact quantiles of large groups against pandas, and the vector index against the exact search."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from conftest import FOLDER
from pyspark.sql import functions as F

from shelfwise.operators import quantiles, vector_index, vectors
from shelfwise.plans.catalog import QUERIES

AT = [0.0, 0.01, 0.25, 0.5, 0.77, 0.99, 1.0]


@pytest.fixture(scope="module")
def groups(spark):
    rng = np.random.default_rng(0)
    rows = [("wide", float(x)) for x in rng.lognormal(0, 8, 20_000)] + [("ties", float(x)) for x in rng.integers(0, 3, 20_000)] + [("same", 4.0)] * 3000
    rows += [("one", 7.0), ("two", 1.0), ("two", 2.0), (None, -1.0), (None, 3.0), ("none", None), ("none", float("nan")), ("wide", None), ("wide", float("nan"))]
    rows += [(f"k{i % 40}", float(x)) for i, x in enumerate(rng.normal(size=2000))]
    return spark.createDataFrame(rows, "k string, v double").repartition(6).cache()


@pytest.mark.parametrize("limit", [1_000_000, 50, 3])
def test_quantiles_equal_numpy(groups, limit):
    got = {r.k: [r[f"q{i}"] for i in range(len(AT))] for r in quantiles.exact_quantiles(groups, ["k"], "v", AT, limit=limit).collect()}
    p = groups.toPandas().dropna(subset=["v"])
    want = {(None if pd.isna(k) else k): np.quantile(v, AT) for k, v in p.groupby("k", dropna=False)["v"]}
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(v, rel=1e-12), k


def test_no_values(groups):
    assert quantiles.exact_quantiles(groups.limit(0), ["k"], "v", AT).count() == 0
    assert quantiles.exact_quantiles(groups.where("k = 'none'"), ["k"], "v", AT).count() == 0


def test_index_holds_every_row_and_all_lists_give_the_exact_search(spark, monkeypatch):
    monkeypatch.setattr(vector_index, "CHUNK", 16)
    monkeypatch.setattr(vector_index, "BLOCK", 8)
    rng = np.random.default_rng(1)
    m = np.round(rng.normal(size=(12, 6))[rng.integers(0, 12, 300)] + 0.3 * rng.normal(size=(300, 6)), 3)
    m[11], m[13] = m[5], 0  # a tie, no direction
    rows = [(i, m[i].tolist()) for i in range(300)] + [(300, None)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    index = vector_index.build(df, "id", "v", lists=12)
    held = index.blocks.select(F.explode("ids").alias("id")).collect()
    assert sorted(r.id for r in held) == [i for i in range(300) if i != 13]
    assert index.blocks.select(F.max(F.size("ids"))).first()[0] <= 40
    asked = df.where("id % 5 = 0 OR id IN (11, 13)")
    exact = vectors.nearest(asked, df, "id", "v", 7)
    rows_of = lambda d: sorted((r.id, r.other, round(r.sim, 4), r["rank"]) for r in d.collect())
    assert rows_of(index.search(asked, "v", 7, probes=12)) == rows_of(exact)
    few = index.search(asked, "v", 7, probes=3)
    print("recall of 3 of 12 lists", vector_index.recall(few, exact, "id"))
    assert vector_index.recall(few, exact, "id") > 0.9
    assert vector_index.recall(index.search(asked, "v", 7, index.probes_for(df, "v", 7)), exact, "id") > 0.93
    assert index.probes_for(df, "v", 7, target=0.5) <= index.probes_for(df, "v", 7, target=1.0) <= 12
    assert vector_index.build(df.limit(0), "id", "v").search(asked, "v", 3, 2).count() == 0


@pytest.mark.parametrize("folder", [FOLDER, FOLDER.replace("0.001", "0.01")])
def test_recall_on_the_embedding_table(spark, folder):
    found, exact = QUERIES["k13_index"](spark, folder), QUERIES["k13_cosine"](spark, folder)
    share = vector_index.recall(found, exact, "vec_id")
    print("recall", folder, share)
    assert share >= 0.9
