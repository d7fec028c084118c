"""Items near each other in sequences: parts and passes, what is shuffled, packing, ties, rows without ids."""

from __future__ import annotations

import datetime as dt
import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from shelfwise.operators import neighbours, ranking


def slow(rows, k, reach):
    """{art: [(other, sim)]} of rows (cust, art, day, receipt)."""
    sums, by = Counter(), defaultdict(list)
    for c, a, d, r in rows:
        by[c].append((d, -1 if a is None else a, r, a))
    for c, seq in by.items():
        seq = [x[3] for x in sorted(seq, key=lambda x: x[:3])]
        for i, a in enumerate(seq if c is not None else []):
            for j in range(max(0, i - reach), min(len(seq), i + reach + 1)):
                if i != j:
                    sums[a, seq[j]] += (1 if j > i else 0.9) * 0.7 ** (abs(i - j) - 1) / math.log(1 + len(seq))
    out = defaultdict(list)
    for (a, b), x in sums.items():
        out[a].append((b, x))
    return {a: sorted(x, key=lambda p: (-round(p[1], 8), -(1 << 63) if p[0] is None else p[0]))[:k] for a, x in out.items()}


def purchases(rng):
    day = dt.date(2020, 1, 1)
    rows = [(c, int(a), day + dt.timedelta(int(d)), r) for r, (c, a, d) in enumerate(zip(rng.integers(0, 60, 2500).tolist(), rng.integers(0, 90, 2500), rng.integers(0, 400, 2500), strict=True))]
    rows += [(c, 1 << 40, day + dt.timedelta(3 * c), 5000 + c) for c in range(60)] * 2  # an item that all buy, twice in one receipt
    rows += [(c, a + s, day + dt.timedelta(a), 6000) for c, s in ((100, 1000), (101, 2000)) for a in range(30)]  # equal sums
    return [*rows, (None, 3, day, 1), (None, 4, day, 2), (7, None, day, 8000), (8, None, day, 8001)]


def test_several_parts_and_passes_shuffle_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PART_PAIRS", 9_000)
    monkeypatch.setattr(neighbours, "PASS_PARTS", 2)
    made, lists = [], neighbours._lists
    monkeypatch.setattr(neighbours, "_lists", lambda *a: made.append(a) or lists(*a))
    rows = purchases(np.random.default_rng(5))
    got = ranking.item_similarity(spark.createDataFrame(rows, "cust long, art long, day date, receipt int"), 6, reach=9)
    assert 2 <= len(made) <= neighbours.PASSES
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()  # before, all pairs were shuffled here
    found = defaultdict(list)
    for r in sorted(got.collect(), key=lambda r: r.rank):
        found[r.art].append((r.other, r.sim))
    want = slow(rows, 6, 9)
    assert found.keys() == want.keys()
    for a, best in want.items():
        assert [b for b, _ in found[a]] == [b for b, _ in best]
        assert [x for _, x in found[a]] == pytest.approx([x for _, x in best])


def test_neighbours_are_packed_in_few_bytes():
    rng = np.random.default_rng(0)
    for low, high, width in ((0, 200, 1), (-5, 60_000, 2), (1 << 50, (1 << 50) + (1 << 23), 3), (-(1 << 63), (1 << 63) - 1, 8)):
        x = rng.integers(low, high, 5000)
        x[:2] = low, high
        least, need, data = neighbours.packed(x)
        assert need == width and len(data) == width * len(x)
        assert (neighbours.unpacked(least, need, data) == x).all()


def test_best_of_each_by_rounded_sums():
    rng = np.random.default_rng(1)
    for spread in (3, 1000):
        art, other = np.repeat(np.arange(50), 200), np.tile(np.arange(200), 50)
        x = rng.integers(1, spread, len(art)) / spread + rng.random(len(art)) * 1e-10
        kept = rng.random(len(art)) < rng.random(50)[art]  # items with few others, too
        art, other, x = art[kept], other[kept], x[kept]
        want = [t for a in range(50) for t in sorted(((a, o, v) for a2, o, v in zip(art.tolist(), other.tolist(), x.tolist(), strict=True) if a2 == a), key=lambda t: (-round(t[2], 8), t[1]))[:7]]
        assert list(zip(*(c.tolist() for c in neighbours.best(art, other, x, 7)), strict=True)) == want


def test_sums_that_come_bit_by_bit(monkeypatch):
    monkeypatch.setattr(neighbours, "PART_PAIRS", 100)
    rng = np.random.default_rng(2)
    art, other, x = rng.integers(-(1 << 62), 1 << 62, 40)[rng.integers(0, 40, 5000)], rng.integers(0, 1 << 62, 30)[rng.integers(0, 30, 5000)], rng.random(5000)
    sums, want = neighbours.Sums(), Counter()
    for at in np.array_split(np.arange(5000), 60):
        sums.add(art[at], other[at], x[at])
        for a, o, v in zip(art[at].tolist(), other[at].tolist(), x[at].tolist(), strict=True):
            want[a, o] += v
    a, o, v = sums.all()
    assert dict(zip(zip(a.tolist(), o.tolist(), strict=True), v.tolist(), strict=True)) == pytest.approx(dict(want))


def test_no_purchases(spark):
    assert ranking.item_similarity(spark.createDataFrame([], "cust long, art long, day date, receipt int"), 5).count() == 0
