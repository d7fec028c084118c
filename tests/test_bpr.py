"""BPR: gradients by differences, negatives, what is learned over several parts, edge cases."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwise.operators import bpr


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    parts = [rng.normal(size=(4, 5)) for _ in range(3)]

    def gain(p):
        u, i, j = p
        return np.log(1 / (1 + np.exp(-(u * (i - j)).sum(1)))) - 0.05 * sum((x * x).sum(1) for x in p)

    got = bpr.loss_gradients(*parts, decay=0.1)
    for k in range(3):
        for c in range(5):
            up, down = [p.copy() for p in parts], [p.copy() for p in parts]
            up[k][:, c] += 1e-6
            down[k][:, c] -= 1e-6
            assert got[k][:, c] == pytest.approx((gain(up) - gain(down)) / 2e-6, abs=1e-6)


def test_negatives_are_never_bought():
    rng = np.random.default_rng(1)
    bought = {(int(u), int(i)) for u, i in zip(rng.integers(0, 20, 300), rng.integers(0, 30, 300), strict=True)} | {(20, i) for i in range(30)} | {(21, i) for i in range(29)}
    known = np.sort(np.array([u * 30 + i for u, i in bought]))
    users = np.repeat(np.arange(22), 50)
    got = bpr.negatives(users, known, 30, rng)
    assert not {(u, i) for u, i in zip(users.tolist(), got.tolist(), strict=True)} & bought
    assert (got[users == 20] == -1).all() and set(got[users == 21].tolist()) <= {-1, 29} and (got[users < 20] >= 0).all()


@pytest.fixture(scope="module")
def groups(spark):
    """Two kinds of users who each buy from one half of the items, a user who buys all and an item that all buy."""
    rng = np.random.default_rng(2)
    rows = [(u, int(i) * 2 + u % 2) for u in range(200) for i in rng.choice(40, 8, False)]
    rows += [(500, i) for i in range(80)] + [(u, 999) for u in range(200)] + rows[:50] + [(None, 3), (4, None)]
    return spark.createDataFrame(rows, "cust long, art long")


@pytest.mark.parametrize("parts", [{}, {"part_rows": 50, "part_pairs": 400}])
def test_unbought_items_of_the_own_kind_rank_higher(spark, groups, parts):
    model = bpr.fit_bpr(groups, rank=8, epochs=8, rate=0.2, **parts)
    if parts:
        assert model.items.count() == 2 and model.users.count() >= 5
    assert model.vectors("users").count() == 201 and model.vectors("items").count() == 81
    bought = {tuple(r) for r in groups.collect()}
    asked = [(u, i) for u in range(200) for i in range(80) if (u, i) not in bought]
    scored = model.score(spark.createDataFrame([*asked, (7777, 1), (1, 7777)], "cust long, art long")).collect()
    assert all((r.score is None) == (7777 in (r.cust, r.art)) for r in scored)
    by_user = {}
    for r in scored:
        if r.score is not None:
            by_user.setdefault(r.cust, ([], []))[(r.cust + r.art) % 2].append(r.score)
    auc = np.mean([np.mean(np.array(same)[:, None] > np.array(other)[None, :]) for same, other in by_user.values()])
    print("AUC", auc, parts)
    assert auc > 0.9


def test_recommendations_are_the_best_of_all_items(spark, groups):
    model = bpr.fit_bpr(groups, rank=4, epochs=2, part_rows=50, part_pairs=400)
    u = {r.cust: np.array(r.vector) for r in model.vectors("users").collect()}
    v = {r.art: np.array(r.vector) for r in model.vectors("items").collect()}
    got = {}
    for r in model.recommend(5).orderBy("cust", "rank").collect():
        got.setdefault(r.cust, []).append((r.art, r.score))
    assert set(got) == set(u)
    for c, best in got.items():
        want = sorted(((float(u[c] @ x), -i) for i, x in v.items()), reverse=True)[:5]
        assert [s for _, s in best] == pytest.approx([s for s, _ in want]) and [i for i, _ in best] == [-i for _, i in want]
    assert all(x[-1] == 1 for x in u.values())


def test_reruns_agree(spark, groups):
    a, b = (bpr.fit_bpr(groups, rank=4, epochs=2, part_rows=60, part_pairs=500) for _ in range(2))
    rows = lambda m: m.vectors("items").orderBy("art").collect()
    assert rows(a) == rows(b)


def test_no_purchases(groups):
    model = bpr.fit_bpr(groups.limit(0))
    assert model.vectors("users").count() == 0 == model.score(groups.limit(0)).count()
    assert model.score(groups).where(F.col("score").isNotNull()).count() == 0


def test_few_items_are_multiplied_for_each_user_and_none_is_missed(monkeypatch):
    monkeypatch.setattr(bpr, "ITEMS", 77)
    rng = np.random.default_rng(6)
    u, v = rng.normal(0, 0.1, (101, 17)) * rng.lognormal(0, 1, (101, 1)), rng.normal(0, 0.1, (3000, 17)) * rng.lognormal(0, 0.7, (3000, 1))
    u[:, -1], v[:9] = 1, v[9]  # equal items
    v = v[np.argsort(-np.linalg.norm(v, axis=1))]
    size, short, k = np.linalg.norm(v, axis=1), v.astype(np.float32), 12
    low = bpr.reached(u, v[:300], k)
    kth = np.sort(u @ v.T, axis=1)[:, -k]
    assert (low <= kth).all() and (low >= kth - 0.5 * np.abs(kth)).mean() > 0.9
    i, j = bpr.reaching(u, low, short, size)
    found = np.zeros((101, 3000), bool)
    found[i, j] = True
    assert found[u @ v.T >= kth[:, None]].all()
    assert len(i) < 101 * 200 and len(i) == found.sum()
    assert (bpr.reached(u, v[: k - 1], k) == -np.inf).all()
