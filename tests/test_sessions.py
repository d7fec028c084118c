"""Sessions with own state and timers: order, late rows, state that goes, edge cases."""

from __future__ import annotations

import datetime as dt
import time

import numpy as np
import pandas as pd
import pytest

from shelfwise.streaming import sessions, windows

MINUTE = 60_000_000
DAY = dt.datetime(2024, 1, 1)


def slow(rows, gap):
    """{(key, first): (n, value)} of rows (key, minutes, value)."""
    out = {}
    for key in {r[0] for r in rows}:
        last = None
        for t, v in sorted((t, v) for k, t, v in rows if k == key):
            if last is None or t - last >= gap:
                first = t
                out[key, first] = (0, 0.0)
            n, x = out[key, first]
            out[key, first], last = (n + 1, x + (v or 0.0)), t
    return out


def test_merging_in_any_order_equals_sorting():
    rng = np.random.default_rng(0)
    for _ in range(50):
        t = rng.integers(0, 500, 60)
        want = sessions.spans(pd.Series(t), pd.Series(np.ones(60)), 10)
        held = []
        for part in np.array_split(rng.permutation(t), 7):
            held = sessions.merged(held, sessions.spans(pd.Series(part), pd.Series(np.ones(len(part))), 10), 10)
        assert held == want == [(a, b, n, v) for a, b, n, v in want]
        assert {(0, a): (n, v) for a, _, n, v in want} == slow([(0, int(x), 1.0) for x in t], 10)


def test_whole_table_equals_its_sessions(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(int(k), int(t), float(v)) for k, t, v in zip(rng.integers(0, 7, 400), rng.integers(0, 10_000, 400), rng.random(400), strict=True)] + [(None, 5, 1.0), (None, 9_999, None), (3, None, 1.0)]
    table = [(k, None if t is None else DAY + dt.timedelta(minutes=t), v) for k, t, v in rows]
    spark.createDataFrame(table, "user_id long, ts timestamp, value double").repartition(5).write.parquet(str(tmp_path / "events"))
    got, progress = sessions.replayed(spark, str(tmp_path / "events"), "user_id", "ts", "value", 60 * MINUTE, slices=3, files=4)
    base = int(DAY.replace(tzinfo=dt.UTC).timestamp() * 1e6)
    found = {(r.user_id, (r.first - base) // MINUTE): (r.n, r.value) for r in got.collect()}
    want = slow([r for r in rows if r[1] is not None], 60)
    assert found.keys() == want.keys()
    for k, (n, v) in want.items():
        assert found[k] == (n, pytest.approx(v))
    held = [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]]
    assert max(held) > 0 and held[-1] == 0  # all state went with the sessions


def test_late_rows_are_left_out_and_sessions_are_given_once(spark, tmp_path):
    def batch(*rows):
        spark.createDataFrame([("a", DAY + dt.timedelta(minutes=t), v) for t, v in rows], "k string, ts timestamp, value double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)

    batch((0, 1.0), (10, 1.0))
    batch((200, 1.0))  # the watermark goes to 170: the first session is over
    batch((201, 0.0))
    batch((5, 50.0), (190, 2.0))  # the first row is late, the second merges backwards
    batch((1000, 1.0))
    out, progress = sessions.run(sessions.finished(windows.reader(spark, str(tmp_path / "in"), 1), "k", "ts", "value", 30 * MINUTE, "30 minutes"))
    got = sorted((r.n, r.value, (r.last - r.first) // MINUTE) for r in out.collect())
    assert got == [(2, 2.0, 10), (3, 3.0, 11)]  # the last one is still open
    assert sum(p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in progress if p["stateOperators"]) == 1


def test_no_rows(spark, tmp_path):
    spark.createDataFrame([], "user_id long, ts timestamp, value double").write.parquet(str(tmp_path / "events"))
    got, _ = sessions.replayed(spark, str(tmp_path / "events"), "user_id", "ts", "value", MINUTE, slices=1)
    assert got.count() == 0


def test_state_and_timers_are_a_groups_not_a_sessions(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(k, int(t), 1.0) for k in range(900) for t in rng.choice(40, 6, False) * 100]
    table = [(k, DAY + dt.timedelta(minutes=t), v) for k, t, v in rows]
    spark.createDataFrame(table, "user_id long, ts timestamp, value double").repartition(3).write.parquet(str(tmp_path / "events"))
    got, progress = sessions.replayed(spark, str(tmp_path / "events"), "user_id", "ts", "value", 101 * MINUTE, slices=3)
    base = int(DAY.replace(tzinfo=dt.UTC).timestamp() * 1e6)
    assert {(r.user_id, (r.first - base) // MINUTE): (r.n, r.value) for r in got.collect()} == slow(rows, 101)
    timers = [p["stateOperators"][0]["customMetrics"]["numRegisteredTimers"] for p in progress if p["stateOperators"]]
    assert 0 < max(timers) <= 2 * 256  # one where rows came, one where a timer went off; before, one a session
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]) <= 4 * 256
