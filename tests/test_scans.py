"""Windows in stretches: one hot key over many stretches and partitions against pandas, DuckDB and the plain windows."""

from __future__ import annotations

import datetime as dt

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shelfwise.operators import scans, series

SMALL = {"stretch": 37, "part_rows": 150}


@pytest.fixture(scope="module")
def hot(spark):
    """A key with nine tenths of the rows, small ones, a NULL key, NULL values, equal order values."""
    rng = np.random.default_rng(0)
    rows = [("hot" if i % 10 else f"k{i % 7}", int(i), None if rng.random() < 0.2 else float(np.round(rng.normal(), 3)), bool(i % 3 == 0)) for i in rng.permutation(2000)]
    rows += [(None, 5, 1.0, True), (None, 6, None, False), (None, 7, 2.0, True), ("alone", 1, None, None)]
    return spark.createDataFrame(rows, "k string, t int, v double, flag boolean").cache()


def rows_of(df, *columns):
    return {(r.k, r.t): tuple(r[c] for c in columns) for r in df.collect()}


def same(got, want):
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-9, nan_ok=True), k


def test_places_span_partitions_of_a_hot_key(hot):
    got = scans.placed(hot, ["k"], ["t"], 150)
    want = rows_of(hot.withColumn("p", F.row_number().over(series.by(["k"], ["t"])) - 1), "p")
    assert rows_of(got, "_place") == want


def test_rolling_and_expanding_equal_plain_windows(hot):
    frames = {"m": (F.avg("v"), 5), "s": (F.stddev_samp("v"), 30), "c": (F.count("v"), 37), "first": (F.first("v"), 2)}
    got = scans.rolling(hot, frames, ["k"], ["t"], **SMALL)
    assert got.columns == [*hot.columns, *frames] and [f.dataType for f in got.schema][:4] == [f.dataType for f in hot.schema]
    want = hot.withColumns({n: f.over(series.by(["k"], ["t"]).rowsBetween(-r, -1)) for n, (f, r) in frames.items()})
    same(rows_of(got, "m", "s", "c", "first"), rows_of(want, "m", "s", "c", "first"))
    got = scans.expanding_mean(hot, "v", "e", ["k"], ["t"], **SMALL)
    same(rows_of(got, "e"), rows_of(hot.withColumn("e", series.expanding(F.avg, "v", ["k"], "t")), "e"))


def test_fill_equals_pandas(hot):
    got = scans.fill_forward(hot, ["v", "flag"], ["k"], ["t"], **SMALL)
    p = hot.toPandas().sort_values("t")
    p["v"] = p.groupby("k", dropna=False)["v"].ffill()
    want = {(None if pd.isna(k) else k, t): (None if pd.isna(v) else v,) for k, t, v in p[["k", "t", "v"]].itertuples(index=False)}
    same(rows_of(got, "v"), want)


@pytest.mark.parametrize("span", [2, 7, 400])
def test_exponential_weights_equal_pandas_on_one_key_over_many_stretches(hot, span):
    got = rows_of(scans.ewm_mean(hot, "v", span, "e", ["k"], ["t"], **SMALL), "e", "v", "flag")
    p = hot.toPandas().sort_values("t")
    want = {}
    for k, own in p.groupby("k", dropna=False):
        mean = own["v"].ewm(span=span, ignore_na=False).mean().ffill().shift()
        want |= {(None if pd.isna(k) else k, t): (None if pd.isna(m) else m,) for t, m in zip(own["t"], mean, strict=True)}
    same({k: x[:1] for k, x in got.items()}, want)
    assert {k: x[1:] for k, x in got.items()} == rows_of(hot, "v", "flag")


def test_as_of_equals_duckdb_with_one_hot_key(spark):
    rng = np.random.default_rng(1)
    day = lambda n: dt.date(2000, 1, 1) + dt.timedelta(int(n))
    facts = pd.DataFrame([("hot" if i % 9 else "cold", day(d), float(i)) for i, d in enumerate(rng.choice(4000, 900, False))], columns=["k", "d", "v"])
    targets = pd.DataFrame([("hot" if i % 5 else ("cold" if i % 2 else "none"), day(d), int(i)) for i, d in enumerate(rng.integers(0, 4000, 1200))], columns=["k", "d", "n"])
    got = scans.as_of(spark.createDataFrame(targets, "k string, d date, n int"), spark.createDataFrame(facts, "k string, d date, v double"), ["k"], "d", ["v"], **SMALL)
    con = duckdb.connect()
    con.register("facts", facts)
    con.register("targets", targets)
    want = con.execute("SELECT t.n, f.v FROM targets t ASOF LEFT JOIN facts f ON t.k = f.k AND CAST(t.d AS DATE) >= CAST(f.d AS DATE)").fetchall()
    assert sorted((r.n, r.v) for r in got.collect()) == sorted(want) or {r.n: r.v for r in got.collect()} == dict(want)


def test_no_rows(hot):
    none = hot.limit(0)
    assert scans.fill_forward(none, ["v"], ["k"], ["t"]).count() == 0 == scans.ewm_mean(none, "v", 7, "e", ["k"], ["t"]).count()
    assert scans.rolling(none, {"m": (F.avg("v"), 5)}, ["k"], ["t"]).count() == 0 == scans.expanding_mean(none, "v", "e", ["k"], ["t"]).count()
