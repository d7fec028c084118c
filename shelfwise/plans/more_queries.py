"""Queries of single operators: key checks, variation, folds, routing, interleaving, seed averaging."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import lists, numbers
from ..operators import models, ranking, series, vector_index
from ..operators.quantiles import exact_quantiles
from .recall_queries import _RECENT, _text, stored, tx
from .registry import ORACLE_SQL, query

KEY = ["item", "store"]


@query("""SELECT * FROM (SELECT 'part' AS name, count(*) AS keys, count(*) FILTER (WHERE n > 1) AS repeated, max(n) AS most FROM (SELECT count(*) AS n FROM part GROUP BY p_partkey)
UNION ALL SELECT 'orders', count(*), count(*) FILTER (WHERE n > 1), max(n) FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderkey)
UNION ALL SELECT 'lineitem', count(*), count(*) FILTER (WHERE n > 1), max(n) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey))""")
def c21_unique_keys(s):  # C21: what a join on these keys would multiply
    checks = [ranking.key_check(s.table(t), [k]).withColumn("name", F.lit(t)) for t, k in (("part", "p_partkey"), ("orders", "o_orderkey"), ("lineitem", "l_orderkey"))]
    return checks[0].unionByName(checks[1]).unionByName(checks[2])


@query("SELECT item, store, round(CASE WHEN avg(quantity) > 0 THEN stddev_samp(quantity) / avg(quantity) END, 6) AS cv FROM weekly GROUP BY item, store", "weekly")
def i07_variation(s):  # I7
    return s.weekly.groupBy(*KEY).agg(F.round(numbers.variation("quantity"), 6).alias("cv"))


@query("SELECT item, count(quantity) AS n, round(avg(quantity), 6) AS mean, round(stddev_samp(quantity), 6) AS std, min(quantity) AS low, round(quantile_cont(quantity, 0.25), 4) AS p25, round(quantile_cont(quantity, 0.5), 4) AS p50, round(quantile_cont(quantity, 0.75), 4) AS p75, max(quantity) AS high FROM sales GROUP BY item", "sales")
def d39_describe(s):  # D39
    q = F.percentile("quantity", F.array(*map(F.lit, (0.25, 0.5, 0.75))))
    g = s.sales.groupBy("item").agg(F.count("quantity").alias("n"), F.round(F.avg("quantity"), 6).alias("mean"), F.round(F.stddev_samp("quantity"), 6).alias("std"), F.min("quantity").alias("low"), q.alias("q"), F.max("quantity").alias("high"))
    return g.select("item", "n", "mean", "std", "low", *[F.round(F.get("q", F.lit(i)), 4).alias(f"p{p}") for i, p in enumerate((25, 50, 75))], "high")


_DEPT = "dp AS (SELECT dept, list(art ORDER BY n DESC, art)[1:12] AS top FROM (SELECT dept, art, count(*) AS n FROM tx JOIN articles USING (art) GROUP BY ALL) GROUP BY dept), fav AS (SELECT cust, dept FROM (SELECT cust, dept, count(*) AS n FROM tx JOIN articles USING (art) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY cust ORDER BY n DESC, dept) = 1), g AS (SELECT list(art ORDER BY n DESC, art)[1:12] AS pop FROM (SELECT art, count(*) AS n FROM tx GROUP BY art))"


def _departments(s, t):
    """Each customer's commonest department, the best sellers of departments, and of all."""
    n = t.join(s.articles.select("art", "dept"), "art")
    favourite = ranking.top_per(n.groupBy("cust", "dept").agg(F.count(F.lit(1)).alias("n")), ["cust"], [F.col("n").desc(), F.col("dept")], 1).select("cust", "dept")
    best = ranking.top_per(n.groupBy("dept", "art").agg(F.count(F.lit(1)).alias("n")), ["dept"], [F.col("n").desc(), F.col("art")], 12)
    overall = t.groupBy("art").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "art").limit(12)
    pop = overall.agg(F.transform(F.sort_array(F.collect_list(F.struct(-F.col("n"), "art"))), lambda x: x["art"]).alias("pop"))
    return favourite, ranking.as_list(best, ["dept"], "rank", "art", "top"), F.broadcast(pop)  # 12 items


@query("WITH " + _RECENT.format(w=26) + ", " + _DEPT + """, z AS (SELECT cust, coalesce(items, [])[1:6] AS a, coalesce(top, []) AS b, pop FROM customers LEFT JOIN l USING (cust) LEFT JOIN fav USING (cust) LEFT JOIN dp USING (dept), g),
y AS (SELECT cust, list_concat(a, list_filter(b, lambda q: NOT list_contains(a, q))) AS ab, pop FROM z)
SELECT cust, array_to_string(list_concat(ab, list_filter(pop, lambda q: NOT list_contains(ab, q)))[1:12], ' ') AS items FROM y""", "tx txw customers articles")
def k11_interleaved(s):  # K11: the head of one list, then another, then a fallback
    t = stored(s)
    favourite, top, pop = _departments(s, t)
    j = s.customers.select("cust").join(ranking.recent_items(t, 26), "cust", "left").join(favourite, "cust", "left").join(top, "dept", "left").crossJoin(pop)
    return j.select("cust", _text(lists.interleave(lists.listed(F.col("recent")), lists.listed(F.col("top")), F.col("pop"))).alias("items"))


@query("WITH " + _RECENT.format(w=26) + ", " + _DEPT + """, a AS (SELECT cust, min(week) AS last FROM txw GROUP BY cust), z AS (SELECT cust, CASE WHEN last < 10 THEN 'active' WHEN last < 52 THEN 'fading' WHEN last IS NOT NULL THEN 'gone' ELSE 'new' END AS tier, items, top, pop FROM customers LEFT JOIN a USING (cust) LEFT JOIN l USING (cust) LEFT JOIN fav USING (cust) LEFT JOIN dp USING (dept), g)
SELECT cust, tier, array_to_string(CASE tier WHEN 'active' THEN coalesce(items, pop) WHEN 'fading' THEN coalesce(top, pop) ELSE pop END, ' ') AS items FROM z""", "tx txw customers articles")
def k12_tiered_routing(s):  # K12: which list a customer gets depends on how long ago the last purchase was
    t = stored(s)
    favourite, top, pop = _departments(s, t)
    last = t.groupBy("cust").agg(F.min("week").alias("last"))
    j = s.customers.select("cust").join(last, "cust", "left").join(ranking.recent_items(t, 26), "cust", "left").join(favourite, "cust", "left").join(top, "dept", "left").crossJoin(pop)
    tier = F.when(F.col("last") < 10, "active").when(F.col("last") < 52, "fading").when(F.col("last").isNotNull(), "gone").otherwise("new")
    chosen = F.when(F.col("tier") == "active", F.coalesce("recent", "pop")).when(F.col("tier") == "fading", F.coalesce("top", "pop")).otherwise(F.col("pop"))
    return j.withColumn("tier", tier).select("cust", "tier", _text(chosen).alias("items"))


@query("""WITH f AS (SELECT unnest([0, 1, 2]) AS fold), h AS (SELECT fold, cust, art, count(*) AS n FROM txw, f WHERE week BETWEEN 4 * fold + 4 AND 4 * fold + 55 GROUP BY ALL), y AS (SELECT DISTINCT fold, cust, art FROM txw JOIN f ON week // 4 = fold)
SELECT h.fold, h.cust, h.art, n, CAST(y.cust IS NOT NULL AS INT) AS label FROM h LEFT JOIN y ON y.fold = h.fold AND y.cust = h.cust AND y.art = h.art""", "txw")
def m23_time_folds(s):  # M23: a fold's labels are four weeks, its history the year before them
    return ranking.time_folds(tx(s), 3, 4, 52)


@query()
def m29_seed_average(s):  # M29: one forecast from models that differ in their seeds only
    w = s.weekly.withColumn("iso", F.weekofyear("week").cast("double")).withColumn("mean8", F.coalesce(series.rolling(F.avg, "quantity", 8, KEY, "week"), F.lit(0.0)))
    past, now = w.where("week < date '2001-01-01'"), w.where("week >= date '2001-01-01'")
    return models.seed_average(past, now, ["iso", "mean8"], "quantity", (1, 2, 3), trees=4).select(*KEY, "week", "quantity", F.round("forecast", 4).alias("forecast"))


_RULES = """u1 AS (SELECT cust, art, count(*) AS score, row_number() OVER (PARTITION BY cust ORDER BY count(*) DESC, art) AS rank FROM txw WHERE week >= 4 GROUP BY cust, art QUALIFY rank <= 12),
seg AS (SELECT segment, art, count(*) AS score, row_number() OVER (PARTITION BY segment ORDER BY count(*) DESC, art) AS rank FROM txw JOIN customers USING (cust) WHERE week >= 4 GROUP BY segment, art QUALIFY rank <= 6),
u2 AS (SELECT cust, art, score, rank FROM customers JOIN seg USING (segment)),
tr AS (SELECT art, count(*) FILTER (WHERE week BETWEEN 4 AND 11) / (1.0 + count(*) FILTER (WHERE week BETWEEN 12 AND 27)) AS score FROM txw GROUP BY art),
tq AS (SELECT art, score, row_number() OVER (ORDER BY round(score, 8) DESC, art) AS rank FROM tr QUALIFY rank <= 6),
u3 AS (SELECT cust, art, score, rank FROM customers, tq),
b AS (SELECT DISTINCT receipt, art FROM txw WHERE week >= 4 AND receipt IN (SELECT receipt FROM txw WHERE week >= 4 GROUP BY receipt HAVING count(DISTINCT art) BETWEEN 2 AND 10)),
p AS (SELECT x.art, y.art AS other, count(*) AS n FROM b x JOIN b y ON x.receipt = y.receipt AND x.art <> y.art GROUP BY ALL),
pt AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY art ORDER BY n DESC, other) <= 3),
q AS (SELECT cust, other AS art, sum(n) AS score FROM (SELECT DISTINCT cust, art FROM u1) JOIN pt USING (art) GROUP BY ALL),
u4 AS (SELECT cust, art, score, row_number() OVER (PARTITION BY cust ORDER BY score DESC, art) AS rank FROM q QUALIFY rank <= 12),
v AS (SELECT *, 'own' AS c FROM u1 UNION ALL SELECT *, 'segment' FROM u2 UNION ALL SELECT *, 'trend' FROM u3 UNION ALL SELECT *, 'pair' FROM u4)"""


@query("WITH " + _RULES + " SELECT cust, art, " + ", ".join(f"coalesce(min(rank) FILTER (WHERE c = '{c}'), 99) AS {c}_rank, CAST(bool_or(c = '{c}') AS INT) AS in_{c}" for c in ("own", "segment", "trend", "pair")) + ", count(DISTINCT c) AS n_channels FROM v GROUP BY cust, art", "txw customers")
def m09_multi_rule(s):  # M9: own history, user group, trend and item pairs as channels of one candidate table
    t = stored(s).where("week >= 4")
    n = F.count(F.lit(1)).alias("score")
    own = ranking.top_per(t.groupBy("cust", "art").agg(n), ["cust"], [F.col("score").desc(), F.col("art")], 12)
    groups = s.customers.select("cust", "segment")
    group = ranking.top_per(t.join(groups, "cust").groupBy("segment", "art").agg(n), ["segment"], [F.col("score").desc(), F.col("art")], 6)
    w = F.col("week")
    trend = stored(s).groupBy("art").agg((F.count_if(w.between(4, 11)) / (1.0 + F.count_if(w.between(12, 27)))).alias("score"))
    trend = trend.orderBy(F.round("score", 8).desc(), "art").limit(6).withColumn("rank", F.row_number().over(Window.orderBy(F.round("score", 8).desc(), "art")))  # six rows
    pairs = ranking.top_per(ranking.pair_counts(t), ["art"], [F.col("n").desc(), F.col("other")], 3).drop("rank")
    rules = {"own": own, "segment": groups.join(group, "segment"), "trend": groups.crossJoin(F.broadcast(trend)), "pair": ranking.expand(own.select("cust", "art"), pairs, F.col("n"), 12)}
    c = ranking.candidate_table(rules)
    return c.select("cust", "art", *[x for r in rules for x in (f"{r}_rank", f"in_{r}")], "n_channels")


@query()
def k13_index(s):  # K13: the same neighbours by inverted lists, with a recall measured in the tests
    e = s.table("embeddings")
    index, asked = vector_index.build(e, "vec_id", "embedding"), e.where("vec_id % 50 = 0")
    return index.search(asked, "embedding", 10, index.probes_for(e, "embedding", 10)).select("vec_id", "other", "sim", "rank")


@query(ORACLE_SQL["d10_quantiles"])
def d10_quantiles_by_brackets(s):  # D10: for groups whose values don't fit one task
    at = [0.01, 0.25, 0.75, 0.99]
    found = exact_quantiles(s.sales, ["item"], "price", at)
    return found.select("item", *[F.round(f"q{i}", 4).alias(f"p{round(a * 100):02d}") for i, a in enumerate(at)])
