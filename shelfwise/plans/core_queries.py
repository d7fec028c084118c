"""Queries of the relational core: scans, projections, joins, aggregates, sets, scalar functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import dates, lists, numbers
from ..operators import ranking, vectors
from ..sources import files
from ..sources.scratch import scratch
from .registry import query


@query("SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance FROM customer WHERE c_acctbal >= 0", "")
def a01_csv_round_trip(s):  # A1-A6, A12: written as CSV with an index column, read back with schema, pruning and filter
    path = f"{scratch(s.spark)}/customer_csv"
    files.write_csv(s.table("customer").select(F.monotonically_increasing_id().alias("_c0"), "c_custkey", "c_name", "c_acctbal"), path)
    back = files.read_csv(s.spark, path, "_c0 long, id long, name string, balance double", ["id", "name", "balance"])
    return back.where("balance >= 0")


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders ORDER BY o_orderkey LIMIT 100")
def a02_csv_other_dates(s):
    path = f"{scratch(s.spark)}/orders_csv"
    s.table("orders").select("o_orderkey", F.date_format("o_orderdate", "dd.MM.yyyy").alias("day")).write.mode("overwrite").option("header", True).option("sep", ";").csv(path)
    return files.read_csv(s.spark, path, "o_orderkey long, day string", sep=";", dates={"day": "dd.MM.yyyy"}, rows=100, order=["o_orderkey"])


@query("SELECT week, count(*) AS n, round(sum(quantity), 2) AS quantity FROM weekly WHERE week >= DATE '2001-01-01' GROUP BY week", "weekly")
def a10_partitioned_parquet(s):  # A10, A11: one folder per week, pruned on reading
    path = f"{scratch(s.spark)}/weekly_parquet"
    files.write_parquet(s.weekly.repartition("week"), path, ["week"])
    back = files.read_parquet(s.spark, path).where(F.col("week") >= F.lit("2001-01-01").cast("date"))
    return back.groupBy("week").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("quantity"), 2).alias("quantity"))


@query("SELECT r_name, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name")
def a07_views_in_sql(s):  # A7-A9, A15
    files.as_view(s.table("region"), "region_view")
    files.as_view(s.table("nation"), "nation_view")
    return s.spark.sql("SELECT r_name, count(*) AS n FROM region_view JOIN nation_view ON n_regionkey = r_regionkey GROUP BY r_name")


@query("SELECT p_type AS dept, dense_rank() OVER (ORDER BY p_type) - 1 AS code FROM (SELECT DISTINCT p_type FROM part)")
def a13_dense_codes(s):
    return files.dense_codes(s.table("part").withColumnRenamed("p_type", "dept"), "dept")


@query("""SELECT l_orderkey, l_linenumber, l_suppkey * 100 + l_linenumber AS code, round(l_extendedprice / (l_quantity + 1), 7) AS per_unit,
  CASE WHEN l_discount > 0.05 THEN 'high' ELSE 'low' END AS band, CASE WHEN l_returnflag = 'R' THEN 0.0 ELSE l_quantity END AS kept, CAST(l_tax > 0.04 AS INT) AS taxed,
  CAST(l_quantity AS INT) AS q, round((l_discount + l_tax + l_quantity) / 3, 6) AS mean3, greatest(l_discount, l_tax) AS top2,
  round(sqrt((pow(l_discount - (l_discount + l_tax) / 2, 2) + pow(l_tax - (l_discount + l_tax) / 2, 2))), 6) AS std2, CAST(l_discount > 0 AS INT) + CAST(l_tax > 0 AS INT) + CAST(l_quantity > 25 AS INT) AS n_true
FROM lineitem WHERE l_quantity >= 10 AND CAST(l_shipdate AS DATE) BETWEEN DATE '1997-01-01' AND DATE '1997-06-30' AND l_returnflag IN ('R', 'N')""")
def b01_project_and_filter(s):  # B1-B9, B16, B17, B20, B21
    d, t, q = F.col("l_discount"), F.col("l_tax"), F.col("l_quantity")
    kept = s.table("lineitem").where((q >= 10) & F.to_date("l_shipdate").between("1997-01-01", "1997-06-30") & F.col("l_returnflag").isin("R", "N"))
    return kept.select(
        "l_orderkey", "l_linenumber", (F.col("l_suppkey") * 100 + F.col("l_linenumber")).alias("code"), F.round(F.col("l_extendedprice") / (q + 1), 7).alias("per_unit"),
        F.when(d > 0.05, "high").otherwise("low").alias("band"), F.when(F.col("l_returnflag") == "R", 0.0).otherwise(q).alias("kept"), (t > 0.04).cast("int").alias("taxed"),
        q.cast("int").alias("q"), F.round(numbers.row_mean(d, t, q), 6).alias("mean3"), F.greatest(d, t).alias("top2"), F.round(numbers.row_std(d, t), 6).alias("std2"),
        numbers.count_true(d > 0, t > 0, q > 25).alias("n_true"),
    )


@query("""WITH j AS (SELECT c_custkey, c_mktsegment, o.n, o.total FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY 1) o ON o_custkey = c_custkey)
SELECT c_custkey, CAST(n IS NULL AS INT) AS missing, coalesce(n, 0) AS n0, round(coalesce(total, (SELECT median(total) FROM j)), 2) AS filled, coalesce(CAST(n AS DOUBLE), total, -1) AS fallback FROM j""")
def b10_nulls(s):  # B10-B15
    orders = s.table("orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"))
    j = s.table("customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    # the exact median of a column, from its distinct values and how often each occurs before and upto it
    j.write.parquet(path := f"{scratch(s.spark)}/joined")
    j = s.spark.read.parquet(path)
    middle = F.broadcast(numbers.exact_median(j, "total"))
    return j.crossJoin(middle).select(
        "c_custkey", F.col("n").isNull().cast("int").alias("missing"), F.coalesce("n", F.lit(0)).alias("n0"), F.round(F.coalesce(numbers.finite(F.col("total")), "middle"), 2).alias("filled"),
        F.coalesce(F.col("n").cast("double"), "total", F.lit(-1.0)).alias("fallback"),
    )


@query("SELECT o_custkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'filled' END AS status, max(n_name) AS nation FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2")
def b18_map_and_lookup(s):  # B18, B19, B22
    names = F.create_map(F.lit("O"), F.lit("open"), F.lit("F"), F.lit("filled"))
    rows = s.table("orders").join(s.table("customer"), F.col("c_custkey") == F.col("o_custkey")).join(s.table("nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return rows.select("o_custkey", F.element_at(names, F.col("o_orderstatus")).alias("status"), F.col("n_name").alias("nation")).distinct()


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def b23_first_per_key(s):
    w = Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    return s.table("orders").withColumn("_n", F.row_number().over(w)).where("_n = 1").select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT p_partkey AS key, 'part' AS kind, p_size AS size, NULL::DOUBLE AS balance FROM part UNION ALL SELECT s_suppkey, 'supplier', NULL, s_acctbal FROM supplier")
def b24_aligned_union(s):  # B24, G1
    part = s.table("part").select(F.col("p_partkey").alias("key"), F.lit("part").alias("kind"), F.col("p_size").alias("size"))
    return part.unionByName(s.table("supplier").select(F.col("s_suppkey").alias("key"), F.lit("supplier").alias("kind"), F.col("s_acctbal").alias("balance")), allowMissingColumns=True)


@query("SELECT n_name, r_name, count(s_suppkey) AS suppliers FROM nation LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name, r_name")
def c01_left_joins(s):  # C1-C3
    n = s.table("nation").join(s.table("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return n.join(s.table("supplier"), F.col("s_nationkey") == F.col("n_nationkey"), "left").groupBy("n_name", "r_name").agg(F.count("s_suppkey").alias("suppliers"))


@query("""SELECT coalesce(a.date, b.date) AS date, coalesce(q, 0) AS offline, round(coalesce(v, 0), 2) AS online, round(coalesce(q, 0) + coalesce(v, 0), 2) AS total
FROM (SELECT date, sum(quantity) AS q FROM sales GROUP BY date) a FULL OUTER JOIN (SELECT date, sum(value) AS v FROM online GROUP BY date) b ON a.date = b.date""", "sales online")
def c05_full_outer(s):
    a, b = s.sales.groupBy("date").agg(F.sum("quantity").alias("q")), s.online.groupBy("date").agg(F.sum("value").alias("v"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return a.join(b, "date", "full_outer").select("date", zero("q").alias("offline"), F.round(zero("v"), 2).alias("online"), F.round(zero("q") + zero("v"), 2).alias("total"))


@query("""SELECT a.art, w.week, coalesce(n, 0) AS n, CAST(n IS NOT NULL AS INT) AS valid FROM articles a CROSS JOIN (SELECT unnest(range(0, 8)) AS week) w
LEFT JOIN (SELECT art, week, count(*) AS n FROM txw GROUP BY art, week) t ON t.art = a.art AND t.week = w.week""", "articles txw")
def c07_forced_keys(s):  # C7-C9
    wanted = s.articles.select("art").crossJoin(F.broadcast(s.spark.range(8).select(F.col("id").cast("int").alias("week"))))
    counts = ranking.with_weeks(s.purchases).groupBy("art", "week").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(wanted, ["art", "week"], "right").select("art", "week", F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNotNull().cast("int").alias("valid"))


@query("SELECT cust, segment, CAST(cust IN (SELECT cust FROM txw WHERE week < 12) AS INT) AS active FROM customers", "customers txw")
def c12_semi_and_anti(s):  # C12, C13
    recent = ranking.with_weeks(s.purchases).where("week < 12").select("cust").distinct()
    yes = s.customers.join(recent, "cust", "left_semi").withColumn("active", F.lit(1))
    return yes.unionByName(s.customers.join(recent, "cust", "left_anti").withColumn("active", F.lit(0))).select("cust", "segment", "active")


HOLIDAYS = ["1998-12-25", "1999-12-25", "2000-12-25"]
_H = ", ".join(f"DATE '{h}'" for h in HOLIDAYS)


@query(f"""SELECT day, CAST(list_bool_or(list_transform([{_H}], lambda h: abs(h - day) <= 14)) AS INT) AS near, list_min(list_transform([{_H}], lambda h: abs(h - day))) AS nearest,
  coalesce(list_min(list_filter([{_H}], lambda h: h >= day)) - day, 365) AS to_next, list_min(list_transform([{_H}], lambda h: abs(h - day))) // 7 AS weeks_off, CAST(day IN ({_H}) AS INT) AS is_holiday FROM (SELECT DISTINCT day FROM tx)""", "tx")
def c14_holiday_distance(s):  # C14-C16, H11, I6
    d = F.col("day")
    near = dates.days_to_nearest(d, HOLIDAYS)
    return s.purchases.select("day").distinct().select(
        "day", dates.near_any(d, HOLIDAYS, 14).cast("int").alias("near"), near.alias("nearest"), dates.days_to_next(d, HOLIDAYS).alias("to_next"), F.floor(near / 7).alias("weeks_off"),
        d.isin(*[F.lit(h).cast("date") for h in HOLIDAYS]).cast("int").alias("is_holiday"),
    )


@query("SELECT a.art, b.art AS variant FROM articles a JOIN articles b ON a.product = b.product AND a.art <> b.art QUALIFY row_number() OVER (PARTITION BY a.art ORDER BY b.art) <= 3", "articles")
def c20_variants(s):
    a = s.articles.select("art", "product")
    # the three smallest others of a product: of its four smallest, those that are not the article itself
    four = a.withColumn("_r", F.row_number().over(Window.partitionBy("product").orderBy("art"))).where("_r <= 4").select(F.col("art").alias("variant"), "product")
    pairs = a.join(four, "product").where("art <> variant")
    return ranking.top_per(pairs, ["art"], [F.col("variant")], 3).select("art", "variant")


@query("SELECT item, round(avg(quantity), 4) AS mean, round(stddev_samp(quantity), 4) AS std, median(quantity) AS middle, max(quantity) AS most, min(quantity) AS least, count(*) AS n, count(DISTINCT store) AS stores FROM sales GROUP BY item", "sales")
def d01_group_statistics(s):  # D1, D2, D5, D6
    q = "quantity"
    return s.sales.groupBy("item").agg(F.round(F.avg(q), 4).alias("mean"), F.round(F.stddev_samp(q), 4).alias("std"), F.median(q).alias("middle"), F.max(q).alias("most"), F.min(q).alias("least"), F.count(F.lit(1)).alias("n"), F.countDistinct("store").alias("stores"))


@query("""SELECT weekofyear(date) AS week, round(sum(quantity), 2) AS total, count(*) FILTER (WHERE quantity > 40) AS large, round(avg(quantity) FILTER (WHERE store < 5), 4) AS few_stores, (SELECT count(*) FROM (SELECT DISTINCT item, store FROM sales)) AS n_keys FROM sales GROUP BY 1""", "sales")
def d03_derived_key_and_filters(s):  # D3, D4, D7
    keys = F.broadcast(s.sales.select("item", "store").distinct().agg(F.count(F.lit(1)).alias("n_keys")))
    g = s.sales.groupBy(F.weekofyear("date").alias("week")).agg(F.round(F.sum("quantity"), 2).alias("total"), F.count_if(F.col("quantity") > 40).alias("large"), F.round(F.avg(F.when(F.col("store") < 5, F.col("quantity"))), 4).alias("few_stores"))
    return g.crossJoin(keys)


@query("SELECT o_custkey, min_by(o_orderkey, (o_orderdate, o_orderkey)) AS first_order, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS last_order, round(max_by(o_totalprice, (o_orderdate, o_orderkey)), 2) AS last_price FROM orders GROUP BY 1")
def d08_first_and_last(s):  # C11, D8, D9
    at = F.struct("o_orderdate", "o_orderkey")
    return s.table("orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", at).alias("first_order"), F.max_by("o_orderkey", at).alias("last_order"), F.round(F.max_by("o_totalprice", at), 2).alias("last_price"))


@query("SELECT item, round(quantile_cont(price, 0.01), 4) AS p01, round(quantile_cont(price, 0.25), 4) AS p25, round(quantile_cont(price, 0.75), 4) AS p75, round(quantile_cont(price, 0.99), 4) AS p99 FROM sales GROUP BY item", "sales")
def d10_quantiles(s):  # D10, D11, G6
    at = [0.01, 0.25, 0.75, 0.99]
    g = s.sales.groupBy("item").agg(F.percentile("price", F.array(*map(F.lit, at))).alias("q"))
    return g.select("item", *[F.round(F.get("q", F.lit(i)), 4).alias(f"p{round(a * 100):02d}") for i, a in enumerate(at)])


@query("SELECT cust, dept FROM (SELECT cust, dept, count(*) AS n FROM tx JOIN articles USING (art) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY cust ORDER BY n DESC, dept) = 1", "tx articles")
def d12_mode(s):
    n = s.purchases.join(s.articles, "art").groupBy("cust", "dept").agg(F.count(F.lit(1)).alias("n"))
    return ranking.top_per(n, ["cust"], [F.col("n").desc(), F.col("dept")], 1).select("cust", "dept")


@query("""WITH d AS (SELECT store, item, date, sum(quantity) AS q FROM sales GROUP BY ALL), i AS (SELECT store, item, isodow(date) - 1 AS dow, avg(q) AS m FROM d GROUP BY ALL),
s AS (SELECT store, isodow(date) - 1 AS dow, avg(t) AS m FROM (SELECT store, date, sum(quantity) AS t FROM sales GROUP BY ALL) GROUP BY ALL)
SELECT i.store, item, i.dow, round(i.m, 4) AS item_mean, round(s.m, 4) AS store_mean, round(CASE WHEN s.m > 0 THEN i.m / s.m ELSE 0 END, 6) AS share FROM i JOIN s ON i.store = s.store AND i.dow = s.dow""", "sales")
def d13_two_level_and_share(s):  # D13-D15
    day = s.daily
    i = day.groupBy("store", "item", F.weekday("date").alias("dow")).agg(F.avg("quantity").alias("i"))
    t = day.groupBy("store", "date").agg(F.sum("quantity").alias("t")).groupBy("store", F.weekday("date").alias("dow")).agg(F.avg("t").alias("s"))
    return i.join(t, ["store", "dow"]).select("store", "item", "dow", F.round("i", 4).alias("item_mean"), F.round("s", 4).alias("store_mean"), F.round(numbers.ratio(F.col("i"), F.col("s")), 6).alias("share"))


@query("""SELECT art, round(sum(exp(-0.15 * week)), 6) AS decayed, round(sum(1.0 / (1 + days_ago)), 6) AS hyperbolic, round(sum(1 / sqrt(days_ago + 1)), 6) AS root, round(sum(greatest(0, 25000 / sqrt(greatest(days_ago, 1)) + 150000 * exp(-0.2 * greatest(days_ago, 1)) - 1000)), 3) AS composite,
  4 * count(*) FILTER (WHERE week < 1) + 2 * count(*) FILTER (WHERE week < 2) + count(*) FILTER (WHERE week < 4) AS tiers FROM txw GROUP BY art""", "txw")
def d16_decayed_popularity(s):  # D16-D19
    t, w, d = ranking.with_weeks(s.purchases), F.col("week"), F.col("days_ago")
    return t.groupBy("art").agg(
        F.round(F.sum(F.exp(-0.15 * w)), 6).alias("decayed"), F.round(F.sum(1 / (1 + d)), 6).alias("hyperbolic"), F.round(F.sum(1 / F.sqrt(d + 1)), 6).alias("root"), F.round(F.sum(numbers.composite_decay(d)), 3).alias("composite"),
        (4 * F.count_if(w < 1) + 2 * F.count_if(w < 2) + F.count_if(w < 4)).alias("tiers"),
    )


@query("""WITH b AS (SELECT art, cust, count(*) AS n FROM txw GROUP BY ALL), r AS (SELECT art, count(*) AS buyers, sum(CAST(n > 1 AS INT)) / count(*) AS repeat FROM b GROUP BY art),
t AS (SELECT art, count(*) AS n, count(DISTINCT cust) AS c, count(*) FILTER (WHERE week = 1) AS w1, count(*) FILTER (WHERE week = 0) AS w0 FROM txw GROUP BY art)
SELECT t.art, round(repeat, 6) AS repeat_share, round(c / n, 6) AS buyers_per_purchase, round(w1 / greatest(n / 12.0, 0.1), 6) AS trend, CAST(w1 >= 5 AND w0 < 0.2 * w1 AS INT) AS dropped FROM t JOIN r USING (art)""", "txw")
def d20_repeat_and_trend(s):  # D20-D22, D25
    t, w = ranking.with_weeks(s.purchases), F.col("week")
    r = t.groupBy("art", "cust").agg(F.count(F.lit(1)).alias("n")).groupBy("art").agg((F.sum((F.col("n") > 1).cast("int")) / F.count(F.lit(1))).alias("repeat"))
    g = t.groupBy("art").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("cust").alias("c"), F.count_if(w == 1).alias("w1"), F.count_if(w == 0).alias("w0"))
    return g.join(r, "art").select(
        "art", F.round("repeat", 6).alias("repeat_share"), F.round(F.col("c") / F.col("n"), 6).alias("buyers_per_purchase"), F.round(F.col("w1") / F.greatest(F.col("n") / 12, F.lit(0.1)), 6).alias("trend"),
        ((F.col("w1") >= 5) & (F.col("w0") < 0.2 * F.col("w1"))).cast("int").alias("dropped"),
    )


@query("""WITH t AS (SELECT art, count(*) FILTER (WHERE days_ago < 56) AS now, count(*) FILTER (WHERE days_ago BETWEEN 56 AND 111) AS before, count(*) FILTER (WHERE week BETWEEN 0 AND 11) AS w1, count(*) FILTER (WHERE week BETWEEN 12 AND 23) AS w2, count(*) FILTER (WHERE week BETWEEN 24 AND 35) AS w3 FROM txw GROUP BY art)
SELECT art, round((now - before) / greatest(before, 1), 6) AS growth, CAST(w1 > w2 AND w2 > w3 AS INT) AS faster, round(w1 / greatest(w3, 1), 6) AS speed FROM t WHERE (now - before) / greatest(before, 1) > 0.5 ORDER BY growth DESC, art LIMIT 30""", "txw")
def d23_growth(s):  # D23, D24, D26, M15
    t, w, d = ranking.with_weeks(s.purchases), F.col("week"), F.col("days_ago")
    g = t.groupBy("art").agg(F.count_if(d < 56).alias("now"), F.count_if(d.between(56, 111)).alias("before"), F.count_if(w.between(0, 11)).alias("w1"), F.count_if(w.between(12, 23)).alias("w2"), F.count_if(w.between(24, 35)).alias("w3"))
    growth = (F.col("now") - F.col("before")) / F.greatest("before", F.lit(1))
    rows = g.where(growth > 0.5).select("art", F.round(growth, 6).alias("growth"), ((F.col("w1") > F.col("w2")) & (F.col("w2") > F.col("w3"))).cast("int").alias("faster"), F.round(F.col("w1") / F.greatest("w3", F.lit(1)), 6).alias("speed"))
    return rows.orderBy(F.col("growth").desc(), "art").limit(30)


@query("SELECT art, round(avg(balance), 8) AS mean_balance, round(stddev_samp(balance), 5) AS std_balance, round(avg(price), 8) AS mean_price, count(DISTINCT channel) AS channels FROM tx JOIN customers USING (cust) GROUP BY art", "tx customers")
def d27_buyer_profile(s):
    t = s.purchases.join(s.customers, "cust")
    return t.groupBy("art").agg(F.round(F.avg("balance"), 8).alias("mean_balance"), F.round(F.stddev_samp("balance"), 5).alias("std_balance"), F.round(F.avg("price"), 8).alias("mean_price"), F.countDistinct("channel").alias("channels"))


@query("""WITH m AS (SELECT max(date) AS last FROM sales), g AS (SELECT item, store, sum(quantity) FILTER (WHERE date > last - 364) AS r, sum(quantity) FILTER (WHERE date <= last - 364 AND date > last - 728) AS p, min(date) AS first_sale, sum(quantity) AS total, max(last) AS last FROM sales, m GROUP BY ALL)
SELECT item, store, round(greatest(-10, least(10, CASE WHEN p > 0 THEN (coalesce(r, 0) - p) / p ELSE 0 END)), 6) AS growth, first_sale, total, last - first_sale AS age, CAST(last - first_sale <= 90 AS INT) AS is_new FROM g""", "sales")
def d28_growth_and_lifecycle(s):  # D28, D29
    last = F.broadcast(s.sales.agg(F.max("date").alias("last")))
    d, q = F.col("date"), F.col("quantity")
    zero = lambda c: F.coalesce(F.sum(F.when(c, q)), F.lit(0.0))
    g = s.sales.crossJoin(last).groupBy("item", "store").agg(zero(d > F.date_sub("last", 364)).alias("r"), zero((d <= F.date_sub("last", 364)) & (d > F.date_sub("last", 728))).alias("p"), F.min("date").alias("first_sale"), F.sum(q).alias("total"), F.max("last").alias("last"))
    age = F.datediff("last", "first_sale")
    return g.select("item", "store", F.round(numbers.clip(numbers.ratio(F.col("r") - F.col("p"), F.col("p")), -10.0, 10.0), 6).alias("growth"), "first_sale", "total", age.alias("age"), (age <= 90).cast("int").alias("is_new"))


@query("SELECT item, " + ", ".join(f"coalesce(sum(quantity) FILTER (WHERE year(date) = {y}), 0) AS y{y}" for y in (*range(1995, 2002), 2030)) + " FROM sales GROUP BY item", "sales")
def d30_pivot(s):  # D30, D31: a column also for a year without sales
    g = s.sales.withColumn("y", F.year("date")).groupBy("item").pivot("y", [*range(1995, 2002), 2030])
    return g.agg(F.sum("quantity")).fillna(0.0).select("item", *[F.col(str(y)).alias(f"y{y}") for y in (*range(1995, 2002), 2030)])


@query("SELECT receipt, array_to_string(list(art ORDER BY price, art), ',') AS by_price, array_to_string(list_sort(list(DISTINCT art)), ',') AS arts, count(DISTINCT art) AS n FROM tx GROUP BY receipt HAVING count(DISTINCT art) BETWEEN 2 AND 10", "tx")
def d32_collect(s):  # D32, K6-K7, O4
    g = s.purchases.groupBy("receipt").agg(F.sort_array(F.collect_list(F.struct("price", "art"))).alias("p"), F.sort_array(F.collect_set("art")).alias("a"))
    return g.where(F.size("a").between(2, 10)).select("receipt", F.array_join(F.transform("p", lambda x: x["art"].cast("string")), ",").alias("by_price"), F.array_join(F.transform("a", lambda x: x.cast("string")), ",").alias("arts"), F.size("a").cast("long").alias("n"))


@query("""WITH p AS (SELECT item, date, quantity AS y, avg(quantity) OVER (PARTITION BY item, store) AS f, CAST(month(date) = 12 AS INT) AS hol FROM daily)
SELECT round(sum((1 + 4 * hol) * abs(y - f)) / sum(1 + 4 * hol), 6) AS wmae, round(avg(abs(y - f)), 6) AS mae, round(sqrt(avg(pow(f - y, 2))), 6) AS rmse, round(avg(hol), 6) AS share FROM p""", "daily")
def d33_error_metrics(s):  # D33-D35, D38
    y, f, h = F.col("quantity"), F.col("f"), F.col("h")
    p = s.daily.withColumn("f", F.avg("quantity").over(Window.partitionBy("item", "store"))).withColumn("h", (F.month("date") == 12).cast("int"))
    return p.agg(F.round(F.sum((1 + 4 * h) * F.abs(y - f)) / F.sum(1 + 4 * h), 6).alias("wmae"), F.round(F.avg(F.abs(y - f)), 6).alias("mae"), F.round(F.sqrt(F.avg(F.pow(f - y, 2))), 6).alias("rmse"), F.round(F.avg(h), 6).alias("share"))


@query("SELECT DISTINCT art FROM txw WHERE week < 4 UNION SELECT art FROM articles WHERE size = 1", "txw articles")
def g02_union_distinct(s):  # G2, G5
    return ranking.with_weeks(s.purchases).where("week < 4").select("art").union(s.articles.where("size = 1").select("art")).distinct()


@query("SELECT cust FROM txw WHERE week < 13 INTERSECT SELECT cust FROM txw WHERE week BETWEEN 13 AND 26", "txw")
def g03_intersection(s):
    t = ranking.with_weeks(s.purchases)
    return t.where("week < 13").select("cust").intersect(t.where("week between 13 and 26").select("cust"))


@query("SELECT cust FROM customers EXCEPT SELECT cust FROM txw WHERE week < 52", "customers txw")
def g04_difference(s):
    return s.customers.select("cust").subtract(ranking.with_weeks(s.purchases).where("week < 52").select("cust"))


@query("""SELECT DISTINCT day AS date, year(day) AS year, quarter(day) AS quarter, month(day) AS month, day(day) AS day, dayofyear(day) AS day_of_year, isodow(day) - 1 AS weekday, weekofyear(day) AS iso_week, (dayofyear(day) + 6 - (isodow(day) - 1)) // 7 AS plain_week, (day(day) - 1) // 7 + 1 AS week_of_month,
  CAST(isodow(day) >= 6 AS INT) AS is_weekend, CAST(day(day) = 1 AS INT) AS is_month_start, CAST(day = last_day(day) AS INT) AS is_month_end, CAST(day(day) IN (10, 25) AS INT) AS is_pay_day, round(sin(2 * pi() * (isodow(day) - 1) / 7), 6) AS dow_sin, round(cos(2 * pi() * month(day) / 12), 6) AS month_cos,
  days_ago, week, days_ago // 30 * 30 AS floor30 FROM txw""", "txw")
def h01_date_parts(s):  # H1-H9, H12, I1
    d = ranking.with_weeks(s.purchases).select("day", "days_ago", "week").distinct()
    c = F.col("day")
    return d.select(c.alias("date"), *[v.alias(k) for k, v in dates.parts(c).items()], F.round(dates.cyclic(F.weekday(c), 7)[0], 6).alias("dow_sin"), F.round(dates.cyclic(F.month(c), 12)[1], 6).alias("month_cos"), "days_ago", "week", (F.floor(F.col("days_ago") / 30) * 30).alias("floor30"))


@query("SELECT receipt_month, day FROM (SELECT month AS receipt_month, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day FROM (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month, CAST(min(l_shipdate) AS DATE) AS lo, CAST(max(l_shipdate) AS DATE) AS hi FROM lineitem GROUP BY 1))")
def h10_date_series(s):  # H10, K2, O5: every day from the first to the last shipment of each month
    months = s.table("lineitem").groupBy(F.to_date(F.date_trunc("month", "l_shipdate")).alias("receipt_month")).agg(F.to_date(F.min("l_shipdate")).alias("lo"), F.to_date(F.max("l_shipdate")).alias("hi"))
    return months.select("receipt_month", dates.day_series(F.col("lo"), F.col("hi")).alias("day"))


@query("""WITH q AS (SELECT list_sort(list_distinct([quantile_cont(CAST(size AS DOUBLE), 0.0), quantile_cont(CAST(size AS DOUBLE), 0.2), quantile_cont(CAST(size AS DOUBLE), 0.4), quantile_cont(CAST(size AS DOUBLE), 0.6), quantile_cont(CAST(size AS DOUBLE), 0.8), quantile_cont(CAST(size AS DOUBLE), 1.0)])) AS edges FROM articles)
SELECT art, round(ln(1 + list_price), 6) AS logged, round(exp(ln(1 + list_price)) - 1, 3) AS back, round(sqrt(greatest(list_price, 0)), 6) AS root, least(greatest(size, 5), 40) AS clipped, round(CASE WHEN list_price > 0 THEN greatest(0, least(100, (list_price - size * 20) / list_price * 100)) ELSE 0 END, 4) AS off,
  greatest(len(list_filter(edges, lambda e: e < size)) - 1, 0) AS quintile, CASE WHEN size > 0 AND size <= 10 THEN 0 WHEN size > 10 AND size <= 25 THEN 1 WHEN size > 25 AND size <= 45 THEN 2 END AS fixed FROM articles, q""", "articles")
def i02_number_functions(s):  # I2-I6, I8-I10
    p, z = F.col("list_price"), F.col("size")
    edges = F.broadcast(s.articles.agg(F.percentile("size", F.array(*map(F.lit, (0.0, 0.2, 0.4, 0.6, 0.8, 1.0)))).alias("edges")))
    return s.articles.crossJoin(edges).select(
        "art", F.round(F.log1p(p), 6).alias("logged"), F.round(F.expm1(F.log1p(p)), 3).alias("back"), F.round(F.sqrt(F.greatest(p, F.lit(0.0))), 6).alias("root"), F.least(F.greatest(z, F.lit(5)), F.lit(40)).alias("clipped"),
        F.round(numbers.percent_off(p, z * 20), 4).alias("off"), numbers.edge_bin(z, F.col("edges")).alias("quintile"), numbers.fixed_bin(z, [0, 10, 25, 45]).alias("fixed"),
    )


@query("SELECT cust, lpad(CAST(cust AS VARCHAR), 10, '0') AS padded, '0' || cust AS prefixed, segment || '_' || cust AS key, len(string_split(segment, 'O')) AS parts FROM customers", "customers")
def j01_strings(s):  # J1-J4
    c = F.col("cust").cast("string")
    return s.customers.select("cust", F.lpad(c, 10, "0").alias("padded"), F.concat(F.lit("0"), c).alias("prefixed"), F.concat_ws("_", "segment", c).alias("key"), F.size(F.split("segment", "O")).alias("parts"))


@query("""WITH d AS (SELECT q.vec_id, e.vec_id AS other, round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) / sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]) * list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])), 5) AS sim FROM embeddings q JOIN embeddings e ON q.vec_id % 50 = 0 AND e.vec_id <> q.vec_id)
SELECT vec_id, other, sim, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, other) AS rank FROM d QUALIFY rank <= 10""")
def k13_cosine(s):
    """The ten most similar vectors of every vector whose id is divisible by 50, among all others."""
    e = s.table("embeddings")
    return vectors.nearest(e.where("vec_id % 50 = 0"), e, "vec_id", "embedding", 10).select("vec_id", "other", "sim", "rank")


@query("SELECT event_type, count(*) AS n, count(json_extract_string(props, '$.k')) AS with_k FROM events GROUP BY event_type")
def l01_json(s):
    return s.table("events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count(F.get_json_object("props", "$.k")).alias("with_k"))
