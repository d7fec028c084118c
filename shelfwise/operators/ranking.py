"""Recall lists and candidate tables; every order has the item as tie-breaker."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import weeks_back
from . import neighbours


def with_weeks(purchases: DataFrame) -> DataFrame:
    """Add days_ago and week (0: the last seven days) to purchases; the last day is one scalar row."""
    last = purchases.agg(F.max("day").alias("_last"))
    return purchases.crossJoin(F.broadcast(last)).withColumn("days_ago", F.datediff("_last", "day")).withColumn("week", weeks_back(F.col("_last"), F.col("day"))).drop("_last")


def top_per(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def as_list(df: DataFrame, keys: list[str], rank: str, item: str, name: str) -> DataFrame:
    """One ordered array of items per key."""
    ordered = F.sort_array(F.collect_list(F.struct(rank, item)))
    return df.groupBy(*keys).agg(F.transform(ordered, lambda x: x[item]).alias(name))


def recent_items(purchases: DataFrame, weeks: int, k: int = 12) -> DataFrame:
    """cust, items: distinct items of the last weeks, latest first."""
    last = purchases.where(F.col("week") < weeks).groupBy("cust", "art").agg(F.min("days_ago").alias("ago"))
    return as_list(top_per(last, ["cust"], [F.col("ago"), F.col("art")], k), ["cust"], "rank", "art", "recent")


def popular(purchases: DataFrame, score: Column, k: int, segment: list[str] = []) -> DataFrame:  # noqa: B006
    """The k items of the highest summed score, overall or per segment."""
    scored = purchases.groupBy(*segment, "art").agg(F.sum(score).alias("score"))
    order = [F.round("score", 6).desc(), F.col("art")]
    return top_per(scored, segment, order, k) if segment else scored.orderBy(*order).limit(k)


def pair_counts(purchases: DataFrame, least: int = 2, most: int = 10) -> DataFrame:
    """art, other, n: receipts of ``least`` to ``most`` distinct items that hold both, in both directions."""
    baskets = purchases.groupBy("receipt").agg(F.sort_array(F.collect_set("art")).alias("b")).where(F.size("b").between(least, most))
    left = baskets.select("b", F.posexplode("b").alias("i", "art"))
    pairs = left.select("art", F.explode(F.slice("b", F.col("i") + 2, F.size("b"))).alias("other"))  # later items of the same basket, at most ``most``
    counted = pairs.groupBy("art", "other").agg(F.count(F.lit(1)).alias("n"))
    return counted.unionByName(counted.select(F.col("other").alias("art"), F.col("art").alias("other"), "n"))


def similar_lists(purchases: DataFrame, k: int, reach: int = 64) -> DataFrame:
    """art, others, sims: the ``k`` most similar items of each by direction-aware co-purchase similarity from each customer's purchase sequence, best first.

    Each ordered pair of positions at most ``reach`` apart adds
    a * 0.7^(gap-1) / ln(1+n) with a = 1 forward and 0.9 backward; at the next
    gap the weight is below 2e-10.  Sequences are whole: they are cut in
    stretches of ``reach`` positions that know their neighbours, so pairs grow
    with the length of a sequence, not its square, and a customer with very many
    purchases is dealt over many tasks.  Ids of items are integers.
    """
    gap = np.arange(-reach, reach + 1)
    weights = np.where(gap > 0, 1.0, 0.9) * 0.7 ** (np.abs(gap) - 1.0)
    return neighbours.nearest(purchases.select("cust", "art", "day", "receipt"), "cust", ["day", "art", "receipt"], "art", weights, k)


def item_similarity(purchases: DataFrame, k: int, reach: int = 64) -> DataFrame:
    """art, other, sim, rank: the rows of ``similar_lists``."""
    rows = similar_lists(purchases, k, reach).select("art", F.posexplode(F.arrays_zip("others", "sims")).alias("_at", "_r"))
    return rows.select("art", F.col("_r.others").alias("other"), F.col("_r.sims").alias("sim"), (F.col("_at") + 1).alias("rank"))


def expand(recent: DataFrame, similar: DataFrame, score: Column, k: int) -> DataFrame:
    """cust, art, score: related items of each customer's recent items, scores summed."""
    joined = recent.select("cust", F.col("art").alias("_from")).join(similar.withColumnRenamed("art", "_from"), "_from")
    scored = joined.groupBy("cust", F.col("other").alias("art")).agg(F.sum(score).alias("score"))
    return top_per(scored, ["cust"], [F.round("score", 8).desc(), F.col("art")], k)


def expand_lists(recent: DataFrame, similar: DataFrame, k: int) -> DataFrame:
    """cust, art, score, rank: the same with ``similar_lists``, which become rows only where all of a customer's are."""
    joined = recent.select("cust", F.col("art").alias("_from")).join(similar.withColumnRenamed("art", "_from"), "_from")
    rows = joined.select("cust", "others", "sims").repartition("cust").select("cust", F.explode(F.arrays_zip("others", "sims")).alias("_r"))
    scored = rows.groupBy("cust", F.col("_r.others").alias("art")).agg(F.sum("_r.sims").alias("score"))
    return top_per(scored, ["cust"], [F.round("score", 8).desc(), F.col("art")], k)


def candidate_table(channels: dict[str, DataFrame]) -> DataFrame:
    """cust, art, then score, rank and flag per channel and the number of channels; one aggregation for all."""
    parts = [df.select("cust", "art", F.col("score").cast("double").alias("score"), "rank", F.lit(name).alias("channel")) for name, df in channels.items()]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    made = []
    for name in channels:
        own = F.col("channel") == name
        made += [
            F.coalesce(F.max(F.when(own, F.col("score"))), F.lit(0.0)).alias(f"{name}_score"), F.coalesce(F.min(F.when(own, F.col("rank"))), F.lit(99)).alias(f"{name}_rank"),
            F.max(own.cast("int")).alias(f"in_{name}"),
        ]
    return union.groupBy("cust", "art").agg(*made, F.countDistinct("channel").alias("n_channels"))


def min_max(score: str, within: list[str]) -> Column:
    """Scaled to 0..1 within groups; a constant group gives 0."""
    w = Window.partitionBy(*within)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return F.when(high > low, (F.col(score) - low) / (high - low)).otherwise(0.0)


def average_rank(score: str, within: list[str]) -> Column:
    """Rank by falling score, ties sharing their mean rank."""
    w = Window.partitionBy(*within)
    return F.rank().over(w.orderBy(F.col(score).desc())) + (F.count(F.lit(1)).over(Window.partitionBy(*within, score)) - 1) / 2


def negatives(candidates: DataFrame, label: str, per_positive: int = 4, least: int = 4, seed: int = 7) -> DataFrame:
    """All positives and, per customer, a hash-ordered sample of negatives."""
    w = Window.partitionBy("cust")
    draw = Window.partitionBy("cust", label).orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("cust").cast("string"), F.col("art").cast("string"))), "art")
    sized = candidates.withColumn("_pos", F.sum(label).over(w)).withColumn("_n", F.row_number().over(draw))
    return sized.where((F.col(label) == 1) | (F.col("_n") <= F.greatest(F.col("_pos") * per_positive, F.lit(least)))).drop("_pos", "_n")


def key_check(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row (keys, repeated, most): distinct keys, those with several rows, and the most rows of one; ``most`` of 1 means that a join on them multiplies nothing."""
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return n.agg(F.count(F.lit(1)).alias("keys"), F.count_if(F.col("_n") > 1).alias("repeated"), F.max("_n").alias("most"))


def time_folds(purchases: DataFrame, folds: int, label_weeks: int, history_weeks: int) -> DataFrame:
    """(fold, cust, art, n, label): for each fold, pairs of its history with their purchases, and whether its label weeks have them too.

    Fold 0 has the last weeks as labels, fold 1 those before, and so on; a
    purchase is dealt at once to every fold that it belongs to.
    """
    weeks, w = range(folds), F.col("week")
    first = lambda f: label_weeks * (f + 1)
    roles = F.array(*[F.struct(F.lit(f).alias("fold"), F.when(w.between(label_weeks * f, first(f) - 1), 1).when(w.between(first(f), first(f) + history_weeks - 1), 0).alias("y")) for f in weeks])
    dealt = purchases.select("cust", "art", F.explode(roles).alias("r")).select("cust", "art", "r.fold", "r.y").where("y is not null")
    found = dealt.groupBy("fold", "cust", "art").agg(F.count_if(F.col("y") == 0).alias("n"), F.max("y").alias("label"))
    return found.where("n > 0").select("fold", "cust", "art", "n", "label")
