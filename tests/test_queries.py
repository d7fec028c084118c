"""Every retail query against its SQL, and the operators SQL can't express against loops."""

from __future__ import annotations

import datetime as dt
import math
from collections import Counter

import numpy as np
import oracle
import pandas as pd
import pytest
from conftest import FOLDER
from pyspark.sql import functions as F

from shelfwise.functions import dates, lists, numbers
from shelfwise.operators import models, ranking, series, vectors
from shelfwise.plans.catalog import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def con():
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    assert oracle.difference(QUERIES[name](spark, FOLDER).toPandas(), con.execute(ORACLE_SQL[name]).df()) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_gives_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_rolling_stays_inside_its_key(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate((1.0, 2.0, 3.0))] + [("b", i, v) for i, v in enumerate((10.0, 20.0, 30.0))], "k string, d int, v double")
    got = df.select("k", "d", series.rolling(F.avg, "v", 3, ["k"], "d").alias("m")).orderBy("k", "d").collect()
    assert [r.m for r in got] == [None, 1.0, 1.5, None, 10.0, 15.0]


def test_as_of_takes_last_known_value_also_of_the_same_day(spark):
    day = lambda n: dt.date(2024, 1, n)
    facts = spark.createDataFrame([("a", day(2), 1.0), ("a", day(4), None), ("a", day(5), 3.0)], "k string, d date, v double")
    targets = spark.createDataFrame([("a", day(n)) for n in (1, 2, 4, 5, 9)] + [("b", day(3))], "k string, d date")
    got = series.as_of(targets, facts, ["k"], "d", ["v"]).orderBy("k", "d").collect()
    assert [r.v for r in got] == [None, 1.0, 1.0, 3.0, 3.0, None]


def test_calendar_lag_is_not_row_lag(spark):
    rows = [("a", dt.date(2024, 1, n), float(n)) for n in (1, 2, 4)]
    got = series.calendar_lag(spark.createDataFrame(rows, "k string, d date, v double"), ["k"], "d", "v", 1, "p").orderBy("d").collect()
    assert [r.p for r in got] == [None, 1.0, None]


def test_carry_shift_compounds(spark):
    weeks = [dt.date(2023, 11, 20) + dt.timedelta(7 * i) for i in range(6)]  # weeks 47 to 52
    got = series.carry_shift(spark.createDataFrame([("a", w, 70.0) for w in weeks], "k string, w date, v double"), ["k"], "w", "v", 2.5 / 7, (48, 51)).orderBy("w").collect()
    carry, expected = 0.0, []
    for w in weeks:
        held = 70.0 + carry
        carry = held * 2.5 / 7 if 48 <= w.isocalendar().week <= 51 else 0.0
        expected.append(held - carry)
    assert [r.v for r in got] == pytest.approx(expected)


def test_average_precision_and_layers(spark):
    df = spark.createDataFrame([(["a", "b", "c", "d"], ["b", "d"], ["x", "b", "y", "z"])], "p array<string>, a array<string>, l array<string>")
    row = df.select(lists.average_precision(F.col("p"), F.col("a")).alias("ap"), lists.layered_fill([(F.col("a"), None), (F.col("l"), 2), (F.col("p"), None)], 5).alias("f")).first()
    assert row.ap == 0.5 and row.f == ["b", "d", "x", "y", "a"]


def test_bins_and_clip(spark):
    values = spark.createDataFrame([(float(v),) for v in (1, 1, 1, 1, 2, 3, 4, 5, 6, 7)], "v double")
    edges = values.agg(F.percentile("v", F.array(*map(F.lit, (0.0, 0.2, 0.4, 0.6, 0.8, 1.0)))).alias("e"))
    got = values.crossJoin(edges).select("v", numbers.edge_bin(F.col("v"), F.col("e")).alias("b"), numbers.fixed_bin(F.col("v"), [0, 2, 5]).alias("f"), numbers.clip(F.col("v"), 2.0, 5.0).alias("c")).orderBy("v").collect()
    assert [r.b for r in got] == [0, 0, 0, 0, 1, 1, 2, 2, 3, 3]
    assert [r.f for r in got] == [0, 0, 0, 0, 0, 1, 1, 1, None, None]


def test_next_holiday(spark):
    got = spark.sql("SELECT date '2024-12-20' AS d").select(dates.days_to_next(F.col("d"), ["2024-12-25"]).alias("a"), dates.days_to_next(F.col("d"), ["2024-12-01"]).alias("b")).first()
    assert (got.a, got.b) == (5, 365)


def test_negatives_are_reproducible_and_bounded(spark):
    c = spark.range(200).select((F.col("id") % 4).alias("cust"), F.col("id").alias("art"), (F.col("id") % 50 == 0).cast("int").alias("label"))
    one, two = (sorted(map(tuple, ranking.negatives(c, "label").collect())) for _ in range(2))
    assert one == two
    assert all(sum(r[0] == k and r[2] == 0 for r in one) == max(4, 4 * sum(r[0] == k and r[2] == 1 for r in one)) for k in range(4))


def test_regression_learns(spark):
    df = spark.range(400).select((F.col("id") % 20).cast("double").alias("x")).withColumn("y", F.col("x") * 3)
    out = models.scored(models.fit_regression(df, ["x"], "y", trees=5), df)
    assert out.agg(F.sqrt(F.avg(F.pow(F.col("score") - F.col("y"), 2)))).first()[0] < 5


def test_ewm_equals_pandas_also_with_gaps_and_long_histories(spark):
    values = [None if i % 7 == 3 else float((i * 37) % 101) for i in range(900)]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)], "k string, d int, v double")
    got = [r.m for r in df.select("d", series.ewm_mean("v", 7, ["k"], "d").alias("m")).orderBy("d").collect()]
    expected = pd.Series(values, dtype=float).ewm(span=7).mean().shift(1)
    assert got[0] is None and np.allclose(got[1:], expected[1:], rtol=1e-12)


def test_ewm_query_covers_the_whole_history(spark, con):
    weekly = con.execute("SELECT p_brand AS item, s_nationkey AS store, CAST(date_trunc('week', CAST(l_shipdate AS DATE)) AS DATE) AS week, sum(l_quantity)::DOUBLE AS quantity FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL ORDER BY ALL").df()
    expected = weekly.groupby(["item", "store"])["quantity"].transform(lambda q: q.ewm(span=7).mean().shift(1))
    got = QUERIES["e09_ewm"](spark, FOLDER).toPandas().astype({"week": "datetime64[us]"})
    both = weekly.assign(expected=expected, week=weekly["week"].astype("datetime64[us]")).merge(got, on=["item", "store", "week"])
    assert len(both) == len(weekly) == len(got)
    assert np.allclose(both["ewm7"].astype(float), both["expected"], atol=1e-5, equal_nan=True)


def test_daily_demand_covers_all_keys_up_to_the_last_day(spark, con):
    keys, last = con.execute("SELECT count(DISTINCT (p_brand, s_nationkey)), CAST(max(l_shipdate) AS DATE) FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey").fetchone()
    got = QUERIES["m26_daily_demand"](spark, FOLDER).toPandas()
    assert len(got.drop_duplicates(["item", "store"])) == keys and got["date"].max() == last
    assert len(got) == keys * ((last - dt.date(2001, 7, 15)).days + 1)


def test_seed_average_is_the_mean_of_its_models(spark):
    df = spark.range(300).select((F.col("id") % 20).cast("double").alias("x")).withColumn("y", F.col("x") * 3)
    one, two, both = (models.seed_average(df, df.limit(20), ["x"], "y", seeds, trees=3).orderBy("x").toPandas()["forecast"] for seeds in ((1,), (2,), (1, 2)))
    assert not np.allclose(one, two) and np.allclose((one + two) / 2, both)


def test_factors_and_vectors_know_what_goes_together(spark):
    """Two groups of customers who buy two sets of items: recommendations and vectors keep them apart."""
    rows = [(c, (c % 2) * 10 + (c + k) % 8, dt.date(2020, 1, 1) + dt.timedelta(k)) for c in range(60) for k in range(6)]
    df = spark.createDataFrame(rows, "cust int, art int, day date")
    top = models.fit_als(df.groupBy("cust", "art").agg(F.lit(1.0).alias("rating")), rank=4).recommendForAllUsers(3).collect()
    assert np.mean([(x.art >= 10) == (r.cust % 2 == 1) for r in top for x in r.recommendations]) > 0.95
    v = {int(r.word): r.vector.toArray() for r in models.item_vectors(df, parts=1).collect()}
    assert len(v) == 16
    cos = lambda a, b: a @ b / np.linalg.norm(a) / np.linalg.norm(b)
    same = np.mean([cos(v[a], v[b]) for a in v for b in v if a != b and (a < 10) == (b < 10)])
    assert same > np.mean([cos(v[a], v[b]) for a in v for b in v if (a < 10) != (b < 10)])


def test_late_events_are_left_out_and_state_is_freed(spark, tmp_path):
    """Files read one after the other: the second moves the watermark on, which holds for rows from the next batch but one on."""
    import time

    from shelfwise.streaming import windows

    hour = lambda h, v: (dt.datetime(2024, 1, 1) + dt.timedelta(hours=h), "a", v)
    for rows in ([hour(1, 1.0), hour(2, 1.0)], [hour(9, 1.0)], [hour(8, 5.0), hour(12, 1.0)], [hour(1, 5.0), hour(11, 1.0)]):
        spark.createDataFrame(rows, "ts timestamp, event_type string, value double").coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
        time.sleep(1.1)
    given = windows.run_to_end(windows.windowed(windows.reader(spark, str(tmp_path / "events"), 1)), "update")
    assert {r.window.start.hour: r.value for r in given.orderBy("batch").collect()} == {1: 1.0, 2: 1.0, 8: 5.0, 9: 1.0, 11: 1.0, 12: 1.0}


def test_item_similarity_reads_whole_sequences(spark):
    rows = [(c, (i * (c + 3)) % 11, dt.date(2020, 1, 1) + dt.timedelta(i), i) for c, n in ((1, 400), (2, 64), (3, 2), (4, 1)) for i in range(n)]
    got = ranking.item_similarity(spark.createDataFrame(rows, "cust int, art int, day date, receipt int"), 50)
    expected: Counter = Counter()
    for c in (1, 2, 3, 4):
        seq = [r[1] for r in rows if r[0] == c]
        for i, a in enumerate(seq):
            for j in range(max(0, i - 64), min(len(seq), i + 65)):
                if i != j:
                    expected[a, seq[j]] += (1 if j > i else 0.9) * 0.7 ** (abs(i - j) - 1) / math.log(1 + len(seq))
    assert {(r.art, r.other): r.sim for r in got.collect()} == pytest.approx(dict(expected))


def test_nearest_vectors_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 3)
    monkeypatch.setattr(vectors, "SLICE", 7)
    m = np.random.default_rng(3).normal(size=(40, 4))
    m[11] = m[5]  # a tie
    m[12] = 0  # no direction
    df = spark.createDataFrame([(i, m[i].tolist()) for i in range(40)] + [(40, None)], "id long, v array<double>")
    got = vectors.nearest(df.where("id % 4 = 0"), df, "id", "v", 5).collect()
    length = np.linalg.norm(m, axis=1)
    expected = set()
    for i in range(0, 40, 4):
        if length[i]:
            sims = sorted((-round(float(m[i] @ m[j] / length[i] / length[j]), 5), j) for j in range(40) if j != i and length[j])
            expected |= {(i, j, n + 1) for n, (_, j) in enumerate(sims[:5])}
    assert {(r.id, r.other, r["rank"]) for r in got} == expected
    assert vectors.nearest(df.where("id < 0"), df, "id", "v", 5).count() == 0


def test_cosine_of_two_arrays(spark):
    row = spark.sql("SELECT array(3.0D, 4.0D) AS a, array(4.0D, 3.0D) AS b").select(lists.cosine(F.col("a"), F.col("b")).alias("c")).first()
    assert row.c == pytest.approx(0.96)


def test_weekly_forecast_values(spark, con):
    got = QUERIES["m26_weekly_forecast"](spark, FOLDER).toPandas()
    rows = con.execute("SELECT p_brand AS item, s_nationkey AS store, CAST(date_trunc('week', l_shipdate) AS DATE) AS week, sum(l_quantity) AS quantity FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL").df()
    rows["week"] = pd.to_datetime(rows["week"]).dt.date
    past, now = rows[rows.week < dt.date(2001, 1, 1)], rows[rows.week >= dt.date(2001, 1, 1)]
    both = now.merge(got, on=["item", "store", "week"], suffixes=("", "_got"))
    assert len(got) == len(now) == len(both) and (both["quantity"] == both["quantity_got"]).all()
    assert (got["forecast"] >= 0).all() and got["forecast"].nunique() > 20
    weight = np.where(pd.to_datetime(both["week"]).dt.isocalendar().week.isin([47, 51, 52]), 5.0, 1.0)
    error = lambda f: np.average(np.abs(f - both["quantity"]), weights=weight)
    print("weighted error", error(both["forecast"]), "of the mean", error(past["quantity"].mean()))
    assert error(both["forecast"]) < 1.1 * error(past["quantity"].mean())  # the table's quantities are random


def test_importances_are_shares(spark):
    got = QUERIES["m30_importances"](spark, FOLDER).collect()
    assert {r.feature for r in got} == {"iso", "prev"} and sum(r.importance for r in got) == pytest.approx(1, abs=1e-3)
    assert [r.importance for r in got] == sorted((r.importance for r in got), reverse=True)


def test_recommendations_are_twelve_known_articles(spark, con):
    known = {f"{a:010d}" for (a,) in con.execute("SELECT p_partkey FROM part").fetchall()}
    bought = {c for (c,) in con.execute("SELECT DISTINCT o_custkey FROM orders").fetchall()}
    rows = QUERIES["m24_top12_recommendation"](spark, FOLDER).collect()
    assert len({r.cust for r in rows}) == len(rows) == con.execute("SELECT count(*) FROM customer").fetchone()[0]
    for r in rows:
        ids = r.prediction.split(" ")
        assert len(ids) == 12 == len(set(ids)) and set(ids) <= known
    assert len({r.prediction for r in rows if r.cust not in bought}) <= 1 < len({r.prediction for r in rows})  # without a history, the popular ones
