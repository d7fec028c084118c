"""Week anchors: repeats and NULL ids against the SQL, and rows by anchor that aren't shuffled."""

from __future__ import annotations

import datetime as dt

import numpy as np
import oracle
import pandas as pd

import __spark_entry__ as entry

NAME = "m11_week_anchors"


def test_repeats_and_rows_without_ids_equal_the_sql(spark, tmp_path):
    rng = np.random.default_rng(4)
    orders = pd.DataFrame({"o_orderkey": range(400), "o_custkey": pd.array([None if x == 9 else int(x) for x in rng.integers(0, 10, 400)], "Int64"), "o_orderpriority": "x"})
    orders["o_orderdate"] = [dt.datetime(2020, 1, 1) + dt.timedelta(int(x)) for x in rng.integers(0, 120, 400)]
    orders.loc[5, "o_orderdate"] = pd.NaT
    line = pd.DataFrame({"l_orderkey": rng.integers(0, 410, 1500), "l_partkey": pd.array([None if x == 30 else int(x) for x in rng.integers(0, 31, 1500)], "Int64"), "l_extendedprice": 1.0})
    line.loc[:300, "l_partkey"] = 7  # an item that all buy again and again
    for name, table in (("orders", orders), ("lineitem", line)):
        table.astype({c: "datetime64[us]" for c in table if c == "o_orderdate"}).to_parquet(f"{tmp_path}/{name}.parquet")
    want = oracle.connect(str(tmp_path)).execute(entry.oracle_sql()[NAME]).df()
    assert want["repeat"].between(0.01, 0.99).any()
    assert oracle.difference(entry.queries()[NAME](spark, str(tmp_path)).toPandas(), want) == ""


def test_purchases_are_shuffled_before_they_become_rows_by_anchor(spark):
    plan = entry.queries()[NAME](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().split("\n")
    made = next(i for i, x in enumerate(plan) if "Generate explode" in x)
    assert not any("Exchange" in x for x in plan[:made])  # before, twelve rows a purchase were shuffled and sorted
    assert any("Exchange" in x for x in plan[made:])
