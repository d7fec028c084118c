"""Bayesian personalized ranking: factors of users and items learned from pairs of a bought and an unbought item.

Users and items are dealt to parts by hash, and a part's factors are one row.
In each round every part of users meets one part of items, the next one in turn,
so a task holds two parts and the purchases between them, whatever the tables'
sizes.  Where there are more parts of users than of items, several learn on
copies of the same part of items, which are then averaged item by item over
those copies that changed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import dropped, written

#: Users or items of a part, and purchases of a part of users, about.
PART_ROWS = 50_000
PART_PAIRS = 1_000_000
#: Purchases of one step.
STEP = 128
#: Of recommend: users and items multiplied at a time, items that give the first bound, and what products of float32 may be wrong by, as a share of both lengths.
USERS, ITEMS, HEAD, SLACK = 256, 2_048, 32_768, 1e-5
_FACTORS = "part long, ids binary, matrix binary, changed binary"


def loss_gradients(user: np.ndarray, good: np.ndarray, bad: np.ndarray, decay: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Descent directions of ln(sigmoid(user . (good - bad))) less decay / 2 times all squares, row by row."""
    wrong = 1 / (1 + np.exp(np.clip((user * (good - bad)).sum(1, keepdims=True), -500, 500)))
    return wrong * (good - bad) - decay * user, wrong * user - decay * good, -wrong * user - decay * bad


def negatives(users: np.ndarray, known: np.ndarray, items: int, rng: np.random.Generator, tries: int = 20) -> np.ndarray:
    """For each row an item its user hasn't bought, or -1 if none turned up; ``known`` are sorted keys user * items + item."""
    out = rng.integers(0, items, len(users))
    for _ in range(tries):
        key = users * items + out
        at = np.minimum(np.searchsorted(known, key), len(known) - 1)
        taken = np.flatnonzero(known[at] == key)
        if not len(taken):
            return out
        out[taken] = rng.integers(0, items, len(taken))
    key = users * items + out
    out[known[np.minimum(np.searchsorted(known, key), len(known) - 1)] == key] = -1
    return out


def learn(u: np.ndarray, v: np.ndarray, users: np.ndarray, items: np.ndarray, rate: float, decay: float, rng: np.random.Generator) -> None:
    """One pass over the purchases (users[k], items[k]) of two parts, in random order; changes u and v."""
    known = np.sort(users * len(v) + items)
    order = rng.permutation(len(users))
    for a in range(0, len(order), STEP):
        own = order[a : a + STEP]
        x, i = users[own], items[own]
        j = negatives(x, known, len(v), rng)
        x, i, j = x[j >= 0], i[j >= 0], j[j >= 0]
        du, di, dj = loss_gradients(u[x], v[i], v[j], decay)
        du[:, -1] = 0  # the users' last factor stays 1: the items' is their bias
        np.add.at(u, x, rate * du)
        np.add.at(v, i, rate * di)
        np.add.at(v, j, rate * dj)


def reached(u: np.ndarray, head: np.ndarray, k: int) -> np.ndarray:
    """For each user a score that at least ``k`` of the items ``head`` reach; minus infinity where there are fewer."""
    if len(head) < k:
        return np.full(len(u), -np.inf)
    short, most = u.astype(np.float32), np.full((len(u), k), -np.inf, np.float32)
    for a in range(0, len(head), ITEMS):
        s = short @ head[a : a + ITEMS].T.astype(np.float32)
        more = np.flatnonzero((s > most.min(1, keepdims=True)).any(1))
        most[more] = np.partition(np.concatenate([most[more], s[more]], 1), -k, axis=1)[:, -k:]
    return most.min(1).astype(np.float64) - SLACK * np.linalg.norm(u, axis=1) * np.linalg.norm(head, axis=1).max()


def reaching(u: np.ndarray, low: np.ndarray, short: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``u`` and of ``short`` whose product may be ``low`` or more; ``size`` are the lengths of ``short``, falling."""
    if not len(u) or not len(size):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    long = np.linalg.norm(u, axis=1)
    bias = short[:, -1].astype(np.float64)
    far = np.linalg.norm(u[:, :-1], axis=1).max() * np.sqrt(np.maximum(size**2 - bias**2, 0)) + bias  # the users' last factor is 1
    there = np.flatnonzero(far >= low.min() - 2 * SLACK * long.max() * size[0])
    least = (low - SLACK * long * size[0]).astype(np.float32)[:, None]
    least = np.nextafter(least, np.float32(-np.inf))
    mine, rows, columns = u.astype(np.float32), [], []
    product, enough = np.empty(len(u) * ITEMS, np.float32), np.empty(len(u) * ITEMS, bool)  # new ones for each step would take most of the time
    for a in range(0, len(there), ITEMS):
        own = there[a : a + ITEMS]
        n = len(u) * len(own)
        s = np.matmul(mine, short[own].T, out=product[:n].reshape(len(u), -1))
        np.greater_equal(s, least, out=enough[:n].reshape(s.shape))
        eight = np.flatnonzero(enough[: n // 8 * 8].view(np.uint64))  # few are, so eight are looked at together
        at = np.concatenate([(eight[:, None] * 8 + np.arange(8)).ravel(), np.arange(n // 8 * 8, n)])
        at = at[enough[at]]
        rows.append(at // len(own))
        columns.append(own[at % len(own)])
    return (np.concatenate(rows), np.concatenate(columns)) if rows else (there, there)


@dataclass
class Factors:
    """Tables of factors, (part, ids, matrix, changed) with a row per part."""

    users: DataFrame
    items: DataFrame
    user: str
    item: str
    width: int

    def vectors(self, side: str) -> DataFrame:
        """(id, vector) of all ``users`` or ``items``; the last number of an item's is its bias, of a user's 1."""
        width = self.width

        def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for row in pdf.itertuples():
                    yield pd.DataFrame({"id": np.frombuffer(row.ids, np.int64), "vector": list(np.frombuffer(row.matrix).reshape(-1, width))})

        name = self.user if side == "users" else self.item
        return getattr(self, side).mapInPandas(rows, "id long, vector array<double>").withColumnRenamed("id", name)

    def score(self, pairs: DataFrame) -> DataFrame:
        """``pairs`` with the column score; NULL where the user or the item is unknown."""
        dot = F.aggregate(F.zip_with("_u", "_v", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        joined = pairs.join(self.vectors("users").withColumnRenamed("vector", "_u"), self.user, "left")
        joined = joined.join(self.vectors("items").withColumnRenamed("vector", "_v"), self.item, "left")
        return joined.withColumn("score", dot).select(*pairs.columns, "score")

    def recommend(self, k: int) -> DataFrame:
        """(user, item, score, rank): each user's best ``k`` items, ties by item; parts of items give k each at most, which then meet.

        The items of the longest vectors give each user a score that the best
        ``k`` reach.  Of the others only those are multiplied whose length lets
        them reach it, and those that do are multiplied again in full precision.
        """
        width, user, item = self.width, self.user, self.item

        def longest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for row in pdf.itertuples():
                    v = np.frombuffer(row.matrix).reshape(-1, width)
                    size = np.linalg.norm(v, axis=1)
                    top = np.argsort(-size, kind="stable")[:HEAD]
                    yield pd.DataFrame({"size": size[top], "vector": [x.tobytes() for x in v[top]]})

        head = self.items.select("matrix").mapInPandas(longest, "size double, vector binary").orderBy(F.desc("size"), "vector").limit(HEAD).select("vector").collect()
        head = np.frombuffer(b"".join(bytes(r.vector) for r in head)).reshape(-1, width)

        def bounded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for row in pdf.itertuples():
                    u = np.frombuffer(row.matrix).reshape(-1, width)
                    order = np.argsort(np.linalg.norm(u, axis=1), kind="stable")  # users of a block are alike in length
                    u, ids = u[order], np.frombuffer(row.ids, np.int64)[order]
                    low = [reached(u[a : a + USERS], head, k) for a in range(0, len(u), USERS)]
                    yield pd.DataFrame({"ids": [ids.tobytes()], "matrix": [u.tobytes()], "low": [np.concatenate(low).tobytes()]})

        def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for row in pdf.itertuples():
                    u, v = np.frombuffer(row.matrix).reshape(-1, width), np.frombuffer(row.other).reshape(-1, width)
                    ids, names, low = np.frombuffer(row.ids, np.int64), np.frombuffer(row.names, np.int64), np.frombuffer(row.low)  # names ascend
                    size = np.linalg.norm(v, axis=1)
                    order = np.argsort(-size, kind="stable")
                    size, names, v = size[order], names[order], v[order]
                    short = v.astype(np.float32)
                    for a in range(0, len(u), USERS):
                        i, j = reaching(u[a : a + USERS], low[a : a + USERS], short, size)
                        score = np.einsum("ij,ij->i", u[a : a + USERS][i], v[j])
                        place = np.lexsort((names[j], -score, i))
                        i, j, score = i[place], j[place], score[place]
                        first = np.searchsorted(i, i)  # where each one's user begins
                        kept = np.arange(len(i)) - first < k
                        yield pd.DataFrame({user: ids[a + i[kept]], item: names[j[kept]], "score": score[kept]})

        parts = written(self.items.select(F.col("part").alias("_q"), F.col("ids").alias("names"), F.col("matrix").alias("other")))
        users = written(self.users.select("ids", "matrix").mapInPandas(bounded, "ids binary, matrix binary, low binary"), 1)
        numbers = F.sequence(F.lit(0).cast("long"), F.lit(parts.count() - 1).cast("long"))
        met = users.withColumn("_q", F.explode(numbers)).join(parts, "_q").select("ids", "matrix", "low", "names", "other")
        found = written(met.mapInPandas(best, f"{user} long, {item} long, score double"), 1)
        place = F.row_number().over(Window.partitionBy(user).orderBy(F.desc("score"), item))
        return found.withColumn("rank", place).where(F.col("rank") <= k)


def fit_bpr(
    purchases: DataFrame, user: str = "cust", item: str = "art", rank: int = 16, epochs: int = 10, rate: float = 0.05, decay: float = 0.01, seed: int = 1, part_rows: int = PART_ROWS, part_pairs: int = PART_PAIRS
) -> Factors:
    """Factors of the users and items of ``purchases``; ids are integers.

    Repeated purchases count once, rows without a user or an item not at all.  A
    purchase is passed over where its user has bought all items of the part.  An
    empty table gives factors without rows.
    """
    width = rank + 1
    pairs = written(purchases.select(F.col(user).cast("long").alias("_u"), F.col(item).cast("long").alias("_i")).dropna().distinct())
    n_pairs, n_users, n_items = pairs.agg(F.count(F.lit(1)), F.countDistinct("_u"), F.countDistinct("_i")).first()
    item_parts = max(1, -(-n_items // part_rows))
    user_parts = max(item_parts, -(-n_users // part_rows), -(-n_pairs // part_pairs))
    dealt = pairs.withColumns({"_p": F.pmod(F.xxhash64("_u"), F.lit(user_parts)), "_q": F.pmod(F.xxhash64("_i"), F.lit(item_parts))})

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_u", "_i"])
        return pd.DataFrame({"_p": pdf["_p"].iloc[:1], "_q": pdf["_q"].iloc[:1], "_us": [pdf["_u"].to_numpy(np.int64).tobytes()], "_is": [pdf["_i"].to_numpy(np.int64).tobytes()]})

    blocks = written(dealt.groupBy("_p", "_q").applyInPandas(block, "_p long, _q long, _us binary, _is binary"))

    def begun(salt: int, last: float):
        def made(pdf: pd.DataFrame) -> pd.DataFrame:
            ids = np.sort(pdf["id"].to_numpy(np.int64))
            matrix = np.random.default_rng([seed, salt, int(pdf["part"].iloc[0])]).normal(0, 0.1, (len(ids), width))
            matrix[:, -1] = last
            return pd.DataFrame({"part": pdf["part"].iloc[:1], "ids": [ids.tobytes()], "matrix": [matrix.tobytes()], "changed": [bytes(len(ids))]})

        return made

    u = written(dealt.select(F.col("_p").alias("part"), F.col("_u").alias("id")).distinct().groupBy("part").applyInPandas(begun(0, 1.0), _FACTORS))
    v = written(dealt.select(F.col("_q").alias("part"), F.col("_i").alias("id")).distinct().groupBy("part").applyInPandas(begun(1, 0.0), _FACTORS))
    dropped(pairs)

    def met(number: int):
        def step(pdf: pd.DataFrame) -> pd.DataFrame:
            own, other = (pdf[pdf["of"] == k].iloc[0] for k in (0, 1))
            ids, names = np.frombuffer(own.ids, np.int64), np.frombuffer(other.ids, np.int64)
            x, y = np.frombuffer(own.matrix).reshape(-1, width).copy(), np.frombuffer(other.matrix).reshape(-1, width).copy()
            for row in pdf[pdf["of"] == 2].itertuples():
                users, items = np.searchsorted(ids, np.frombuffer(row.ids, np.int64)), np.searchsorted(names, np.frombuffer(row.matrix, np.int64))
                learn(x, y, users, items, rate, decay, np.random.default_rng([seed, 2, number, int(own.part)]))
            changed = (y != np.frombuffer(other.matrix).reshape(-1, width)).any(1)
            return pd.DataFrame({"of": [0, 1], "part": [own.part, other.q], "ids": [own.ids, other.ids], "matrix": [x.tobytes(), y.tobytes()], "changed": [b"", changed.tobytes()]})

        return step

    def averaged(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("matrix")  # any fixed order, as sums of floats depend on it
        each = [np.frombuffer(m).reshape(-1, width) for m in pdf["matrix"]]
        changed = [np.frombuffer(c, bool) for c in pdf["changed"]]
        times = np.sum(changed, axis=0)[:, None]
        total = sum(np.where(c[:, None], m, 0.0) for c, m in zip(changed, each, strict=True))
        matrix = np.where(times > 0, total / np.maximum(times, 1), each[0])
        return pdf[:1].assign(matrix=[matrix.tobytes()], changed=[bytes(len(times))])[["part", "ids", "matrix", "changed"]]

    tables = [u, v]
    for number in range(epochs * item_parts if n_pairs else 0):
        # a user part's factors, its item part's and the purchases between them are three rows of one group, shuffled once
        turn = F.pmod(F.col("part") + number, F.lit(item_parts))
        asking = F.sequence(F.pmod(F.col("part") - number, F.lit(item_parts)), F.lit(user_parts - 1).cast("long"), F.lit(item_parts).cast("long"))
        own = u.select("part", F.lit(0).alias("of"), turn.alias("q"), "ids", "matrix")
        other = v.select(F.explode(asking).alias("_p"), F.lit(1).alias("of"), F.col("part").alias("q"), "ids", "matrix").withColumnRenamed("_p", "part")
        there = blocks.withColumnRenamed("_p", "part").where(F.col("_q") == turn).select("part", F.lit(2).alias("of"), F.col("_q").alias("q"), F.col("_us").alias("ids"), F.col("_is").alias("matrix"))
        after = written(own.unionByName(other).unionByName(there).groupBy("part").applyInPandas(met(number), f"of int, {_FACTORS}"))
        for t in tables:
            dropped(t)
        tables = [after]
        u = after.where("of = 0").drop("of")
        v = after.where("of = 1").drop("of")
        if user_parts > item_parts:
            v = v.groupBy("part").applyInPandas(averaged, _FACTORS)
    dropped(blocks)
    return Factors(u, v, user, item, width)
