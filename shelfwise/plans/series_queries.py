"""Queries over time series: windows, as-of values, grids, year-ago values."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import numbers
from ..operators import ranking, scans, series
from .registry import ORACLE_SQL, query

KEY = ["item", "store"]
_P = "PARTITION BY item, store ORDER BY date"


@query(f"SELECT item, store, date, quantity, " + ", ".join(f"lag(quantity, {n}) OVER ({_P}) AS lag{n}" for n in (1, 2, 5, 26)) + f", quantity - lag(quantity) OVER ({_P}) AS diff1, CAST(quantity <> lag(quantity) OVER ({_P}) AND lag(quantity) OVER ({_P}) IS NOT NULL AS INT) AS changed FROM daily", "daily")  # noqa: F541
def e01_row_lags(s):  # E1, E2, E11
    before = series.row_lag("quantity", 1, KEY, "date")
    return s.daily.select(*KEY, "date", "quantity", *[series.row_lag("quantity", n, KEY, "date").alias(f"lag{n}") for n in (1, 2, 5, 26)], (F.col("quantity") - before).alias("diff1"), F.coalesce(F.col("quantity") != before, F.lit(False)).cast("int").alias("changed"))


def _frames(fs: str, rows: int) -> str:
    return f"{fs} OVER ({_P} ROWS BETWEEN {rows} PRECEDING AND 1 PRECEDING)"


@query(f"SELECT item, store, date, round({_frames('avg(quantity)', 4)}, 4) AS mean4, round({_frames('stddev_samp(quantity)', 13)}, 4) AS std13, {_frames('min(quantity)', 8)} AS min8, {_frames('max(quantity)', 52)} AS max52, {_frames('sum(quantity)', 7)} AS sum7, round(avg(quantity) OVER ({_P} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 4) AS expanding FROM daily", "daily")
def e03_rolling(s):  # E3, E5-E8, O3: all windows of one key share one shuffle and sort
    r = lambda f, n: series.rolling(f, "quantity", n, KEY, "date")
    return s.daily.select(*KEY, "date", F.round(r(F.avg, 4), 4).alias("mean4"), F.round(r(F.stddev_samp, 13), 4).alias("std13"), r(F.min, 8).alias("min8"), r(F.max, 52).alias("max52"), r(F.sum, 7).alias("sum7"), F.round(series.expanding(F.avg, "quantity", KEY, "date"), 4).alias("expanding"))


@query(ORACLE_SQL["e03_rolling"])
def e03_rolling_in_stretches(s):  # E3, E6, E8: the same for keys whose history doesn't fit one task
    q = F.col("quantity")
    frames = {"mean4": (F.avg(q), 4), "std13": (F.stddev_samp(q), 13), "min8": (F.min(q), 8), "max52": (F.max(q), 52), "sum7": (F.sum(q), 7)}
    w = scans.expanding_mean(scans.rolling(s.daily, frames, KEY, ["date"]), "quantity", "expanding", KEY, ["date"])
    return w.select(*KEY, "date", *[F.round(c, 4).alias(c) if c in ("mean4", "std13") else F.col(c) for c in frames], F.round("expanding", 4).alias("expanding"))


_GRID = """WITH k AS (SELECT DISTINCT item, store FROM daily), b AS (SELECT min(date) AS lo, max(date) AS hi FROM daily), g AS (SELECT item, store, d.date, coalesce(quantity, 0) AS quantity FROM k CROSS JOIN (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM b) d LEFT JOIN daily USING (item, store, date))"""


def grid(s):
    """All keys by all days from the first to the last of the table."""
    first, last = s.table("lineitem").agg(F.to_date(F.min("l_shipdate")), F.to_date(F.max("l_shipdate"))).first()
    return series.dense_grid(s.daily, KEY, "date", "quantity", first, last)


@query(_GRID + f" SELECT item, store, date, quantity, round(coalesce({_frames('avg(quantity)', 7)}, 0), 4) AS mean7, round(coalesce({_frames('stddev_samp(quantity)', 30)}, 0), 4) AS std30 FROM g", "daily")
def e04_rolling_sql_frame(s):  # E4, M1, C8
    r = lambda f, n: series.rolling(f, "quantity", n, KEY, "date")
    return grid(s).select(*KEY, "date", "quantity", F.round(F.coalesce(r(F.avg, 7), F.lit(0.0)), 4).alias("mean7"), F.round(F.coalesce(r(F.stddev_samp, 30), F.lit(0.0)), 4).alias("std30"))


@query("""WITH w AS (SELECT item, store, week, quantity, row_number() OVER (PARTITION BY item, store ORDER BY week) AS n FROM weekly)
SELECT a.item, a.store, a.week, round(sum(b.quantity * pow(0.75, a.n - b.n - 1)) / sum(pow(0.75, a.n - b.n - 1)), 5) AS ewm7 FROM w a LEFT JOIN w b ON a.item = b.item AND a.store = b.store AND b.n < a.n GROUP BY ALL""", "weekly")
def e09_ewm(s):
    return s.weekly.select(*KEY, "week", F.round(series.ewm_mean("quantity", 7, KEY, "week"), 5).alias("ewm7"))


@query(ORACLE_SQL["e09_ewm"])
def e09_ewm_scan(s):  # E9: two numbers a stretch are handed on, a row costs one step
    return scans.ewm_mean(s.weekly, "quantity", 7, "ewm7", KEY, ["week"]).select(*KEY, "week", F.round("ewm7", 5).alias("ewm7"))


def _months_and_prices(s):
    facts = s.sales.groupBy(*KEY, "date").agg(F.avg("price").alias("price"))
    first, last = s.table("lineitem").agg(F.trunc(F.to_date(F.min("l_shipdate")), "month"), F.trunc(F.to_date(F.max("l_shipdate")), "month")).first()
    months = s.spark.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last), F.expr("interval 1 month"))).alias("date"))
    return s.sales.select(*KEY).distinct().crossJoin(F.broadcast(months)), facts  # a row per month


@query("""WITH f AS (SELECT item, store, date, avg(price) AS price FROM sales GROUP BY ALL), t AS (SELECT item, store, CAST(d AS DATE) AS date FROM (SELECT DISTINCT item, store FROM sales) CROSS JOIN (SELECT unnest(generate_series(date_trunc('month', min(date)), date_trunc('month', max(date)), INTERVAL 1 MONTH)) AS d FROM sales))
SELECT t.item, t.store, t.date, round(f.price, 7) AS price FROM t ASOF LEFT JOIN f ON t.item = f.item AND t.store = f.store AND t.date >= f.date""", "sales")
def c10_as_of(s):  # C10, E10
    targets, facts = _months_and_prices(s)
    return series.as_of(targets, facts, KEY, "date", ["price"]).select(*KEY, "date", F.round("price", 7).alias("price"))


@query(ORACLE_SQL["c10_as_of"])
def c10_as_of_in_stretches(s):  # C10, E10: merged in ranges of key and date
    targets, facts = _months_and_prices(s)
    return scans.as_of(targets, facts, KEY, "date", ["price"]).select(*KEY, "date", F.round("price", 7).alias("price"))


@query("""SELECT item, store, week, quantity, lag52, round((coalesce(lag52, lag51) + coalesce(lag51, lag52)) / 2, 4) AS around FROM (
SELECT *, sum(quantity) OVER (k RANGE BETWEEN 364 PRECEDING AND 364 PRECEDING) AS lag52, sum(quantity) OVER (k RANGE BETWEEN 357 PRECEDING AND 357 PRECEDING) AS lag51 FROM weekly WINDOW k AS (PARTITION BY item, store ORDER BY week - DATE '1970-01-01'))""", "weekly")
def c04_year_ago(s):  # C4, M20
    w = series.calendar_lag(series.calendar_lag(s.weekly, KEY, "week", "quantity", 364, "lag52"), KEY, "week", "quantity", 357, "lag51")
    return w.select(*KEY, "week", "quantity", "lag52", F.round(numbers.row_mean(F.col("lag52"), F.col("lag51")), 4).alias("around"))


@query("""WITH RECURSIVE w AS MATERIALIZED (SELECT *, weekofyear(week) BETWEEN 48 AND 51 AS gives, row_number() OVER (PARTITION BY item, store ORDER BY week) AS n FROM weekly),
r AS (SELECT item, store, week, n, gives, quantity AS held FROM w WHERE n = 1 UNION ALL SELECT w.item, w.store, w.week, w.n, w.gives, w.quantity + CASE WHEN r.gives THEN r.held * 2.5 / 7 ELSE 0 END FROM r JOIN w ON w.item = r.item AND w.store = r.store AND w.n = r.n + 1)
SELECT item, store, week, round(CASE WHEN gives THEN held - held * 2.5 / 7 ELSE held END, 6) AS quantity FROM r""", "weekly")
def e15_carry_shift(s):  # recursive along the series
    return series.carry_shift(s.weekly, KEY, "week", "quantity", 2.5 / 7, (48, 51)).withColumn("quantity", F.round("quantity", 6))


@query("""WITH q AS (SELECT item, store, isodow(date) AS dow, quantile_cont(quantity, 0.01) AS lo, quantile_cont(quantity, 0.99) AS hi FROM daily WHERE quantity > 0 GROUP BY ALL)
SELECT d.item, count(*) AS n, sum(quantity) AS quantity FROM daily d JOIN q ON d.item = q.item AND d.store = q.store AND isodow(d.date) = q.dow WHERE quantity BETWEEN lo AND hi GROUP BY d.item""", "daily")
def m02_quantile_outliers(s):
    kept = series.drop_outliers(s.daily.withColumn("dow", F.weekday("date")), [*KEY, "dow"], "quantity")
    return kept.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.sum("quantity").alias("quantity"))


@query("""WITH k AS (SELECT item, store, weekofyear(week) AS w, avg(quantity) AS m FROM weekly WHERE week < DATE '2001-01-01' GROUP BY ALL), f AS (SELECT item, store, median(quantity) AS md FROM weekly WHERE week < DATE '2001-01-01' GROUP BY ALL)
SELECT x.item, x.store, x.week, round(coalesce(m, md, 0), 4) AS naive FROM weekly x LEFT JOIN k ON k.item = x.item AND k.store = x.store AND k.w = weekofyear(x.week) LEFT JOIN f ON f.item = x.item AND f.store = x.store WHERE x.week >= DATE '2001-01-01'""", "weekly")
def m19_seasonal_naive(s):
    past, now = s.weekly.where("week < date '2001-01-01'"), s.weekly.where("week >= date '2001-01-01'")
    season = past.groupBy(*KEY, F.weekofyear("week").alias("w")).agg(F.avg("quantity").alias("m"))
    middle = past.groupBy(*KEY).agg(F.median("quantity").alias("md"))
    return now.withColumn("w", F.weekofyear("week")).join(season, [*KEY, "w"], "left").join(middle, KEY, "left").select(*KEY, "week", F.round(F.coalesce("m", "md", F.lit(0.0)), 4).alias("naive"))


@query("""WITH i AS (SELECT dept, item, avg(quantity) AS m FROM sales WHERE date < DATE '2001-01-01' AND item < 'Brand#4' GROUP BY ALL), d AS (SELECT dept, avg(m) AS m FROM i GROUP BY dept)
SELECT DISTINCT s.item, s.dept, round(coalesce(i.m, d.m, (SELECT avg(m) FROM i)), 5) AS expected FROM (SELECT DISTINCT item, dept FROM sales) s LEFT JOIN i USING (item, dept) LEFT JOIN d USING (dept)""", "sales")
def m21_cold_items(s):
    known = s.sales.where("date < date '2001-01-01' and item < 'Brand#4'").groupBy("dept", "item").agg(F.avg("quantity").alias("im"))
    dept = known.groupBy("dept").agg(F.avg("im").alias("dm"))
    overall = F.broadcast(known.agg(F.avg("im").alias("om")))
    return s.sales.select("item", "dept").distinct().join(known, ["item", "dept"], "left").join(dept, "dept", "left").crossJoin(overall).select("item", "dept", F.round(F.coalesce("im", "dm", "om"), 5).alias("expected"))


@query("""WITH p AS (SELECT item, date, avg(price) AS price FROM sales GROUP BY ALL), c AS (SELECT *, price - lag(price) OVER (PARTITION BY item ORDER BY date) AS diff FROM p)
SELECT item, date, round(price, 8) AS price, round(diff + 1e-9, 5) AS price_diff, round(stddev_samp(diff) OVER (PARTITION BY item ORDER BY date ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING), 5) AS volatility, CAST(abs(coalesce(diff, 0)) > 500 AS INT) AS jump FROM c""", "sales")
def e07_price_features(s):
    p = s.sales.groupBy("item", "date").agg(F.avg("price").alias("price"))
    p = p.withColumn("diff", F.col("price") - series.row_lag("price", 1, ["item"], "date"))
    return p.select("item", "date", F.round("price", 8).alias("price"), F.round(F.col("diff") + 1e-9, 5).alias("price_diff"), F.round(series.rolling(F.stddev_samp, "diff", 30, ["item"], "date"), 5).alias("volatility"), (F.abs(F.coalesce("diff", F.lit(0.0))) > 500).cast("int").alias("jump"))


@query("""WITH c AS (SELECT art, week, count(*) AS n FROM txw GROUP BY ALL) SELECT art, week, sum(n) OVER (PARTITION BY art ORDER BY week DESC) AS sold_so_far FROM c""", "txw")
def m12_cumulative_by_anchor(s):
    c = ranking.with_weeks(s.purchases).groupBy("art", "week").agg(F.count(F.lit(1)).alias("n"))
    return c.select("art", "week", F.sum("n").over(Window.partitionBy("art").orderBy(F.col("week").desc()).rowsBetween(Window.unboundedPreceding, 0)).alias("sold_so_far"))


@query("SELECT window_start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, value FROM events) GROUP BY ALL")
def n01_streaming_windows(s):  # an extension: the reference has no streams
    from ..streaming.windows import hourly_totals

    return hourly_totals(s.spark, f"{s.folder}/events.parquet")


@query("SELECT CAST(w AS TIMESTAMP) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM (SELECT unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS w, event_type, value FROM events) GROUP BY ALL")
def n02_sliding_windows(s):  # windows of two hours, one every hour
    from ..streaming.windows import hourly_totals

    return hourly_totals(s.spark, f"{s.folder}/events.parquet", "2 hours", "1 hour")


_SESSIONS = """WITH e AS (SELECT user_id, ts, value, ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL AS opens FROM events), s AS (SELECT *, sum(opens::INT) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM e)
SELECT user_id, min(ts) AS session_start, {}count(*) AS n, round(sum(value), 4) AS value FROM s GROUP BY user_id, session"""


@query(_SESSIONS.format(""))
def n03_session_windows(s):  # a session ends after six hours without an event
    from ..streaming.windows import sessions

    return sessions(s.spark, f"{s.folder}/events.parquet", "6 hours")


@query(_SESSIONS.format("max(ts) AS session_end, "))
def n04_stateful_sessions(s):  # the same with state and event-time timers, each session given once when it is over
    from ..streaming.sessions import replayed

    got, _ = replayed(s.spark, f"{s.folder}/events.parquet", "user_id", "ts", "value", 6 * 3_600_000_000)
    at = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
    return got.select("user_id", at("first").alias("session_start"), at("last").alias("session_end"), "n", F.round("value", 4).alias("value"))
