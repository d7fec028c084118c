"""Host-level quality rules, in DataFrame operations only.

Documents are measured one by one inside array functions, so no word ever
becomes a row.  Failures are summed by host; a host's failure rate is shrunk
towards the rate of all documents by a beta prior fitted to the hosts, and the
verdict on the host is joined back to its documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, shared_table, text_or_empty, words

MIN_WORDS = 10
#: Most percent of the words in repeated 5-word windows.
MAX_REPEATED = 20
WINDOW = 5
#: Other rules that count as failures of a host: symbols a word, percent of repeated lines, characters a word.
MAX_SYMBOLS = 1.0
MAX_DUP_LINES = 50
MIN_MEAN, MAX_MEAN = 2.0, 15.0
#: A host is rejected if its shrunk failure rate is above this.
MAX_HOST_RATE = 0.6
#: Bounds of the prior's weight, in documents.
MIN_PRIOR, MAX_PRIOR = 2.0, 10_000.0


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with value computed once a row, also where it is used inside a lambda."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def repeated_words(word_array: Column, width: int = WINDOW) -> Column:
    """How many words lie in windows of ``width`` words that occur twice or more in the array."""

    def covered(windows: Column) -> Column:
        def of_sorted(s: Column) -> Column:
            same = lambda k: (F.get(s, k)["h"] == F.get(s, k - 1)["h"]) | (F.get(s, k)["h"] == F.get(s, k + 1)["h"])
            places = F.sort_array(
                F.transform(F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: F.coalesce(same(k), F.get(s, k)["h"] == F.get(s, k + 1)["h"], F.get(s, k)["h"] == F.get(s, k - 1)["h"])), lambda k: F.get(s, k)["i"])
            )
            start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach"))
            step = lambda acc, i: F.struct((acc["n"] + i + width - F.greatest(acc["reach"], i)).alias("n"), (i + width).alias("reach"))
            return F.aggregate(places, start, step, lambda acc: acc["n"])

        placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(let(placed, of_sorted))

    def of_hashes(h: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(h) - width), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(width)]))
        return F.when(F.size(h) > width, let(windows, covered)).otherwise(F.lit(0))

    return let(F.transform(word_array, lambda w: F.xxhash64(w)), of_hashes)


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed.

    NULL and empty texts have no words and fail.
    """
    content = text_or_empty(text)
    lines = F.filter(F.split(content, "\n"), lambda x: x.rlike(WORD))
    return (
        df.withColumn("_words", words(F.col(text)))
        .withColumn("_lines", lines)
        .withColumns(
            {
                "n_words": F.size("_words").cast("long"),
                "word_chars": F.length(F.array_join("_words", "")).cast("long"),
                "n_symbols": F.regexp_count(content, F.lit("[#*$%&|<>]")).cast("long"),
                "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
                "_n_lines": F.size("_lines").cast("long"),
                "n_repeat_words": repeated_words(F.col("_words")).cast("long"),
            }
        )
        .drop("_words", "_lines")
        .withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words")))
    )


def fails() -> Column:
    """Whether a measured document fails any rule, as hosts are judged."""
    mean = F.try_divide("word_chars", "n_words")
    return (
        F.col("base_failed")
        | (F.col("n_symbols") > MAX_SYMBOLS * F.col("n_words"))
        | (100 * F.col("n_dup_lines") > MAX_DUP_LINES * F.col("_n_lines"))
        | ~F.coalesce(mean.between(MIN_MEAN, MAX_MEAN), F.lit(False))
    )


def host_rates(measured: DataFrame) -> DataFrame:
    """(host, n_docs, n_failed, host_rate): each host's failure rate under the fitted beta prior.

    The prior's mean is the rate of all documents; its weight comes from how
    much the hosts' rates differ beyond chance (method of moments).
    """
    hosts = measured.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(fails().cast("long")).alias("n_failed"))
    hosts = shared_table(hosts)
    n, f = F.sum("n_docs"), F.sum("n_failed")
    # one row: sums over hosts from which mean and variance follow
    total = hosts.agg(n.alias("n"), f.alias("f"), F.count(F.lit(1)).alias("hosts"), F.sum(F.col("n_failed") * F.col("n_failed") / F.col("n_docs")).alias("squares")).first()
    if not total["n"]:
        return hosts.withColumn("host_rate", F.lit(0.0))
    m = total["f"] / total["n"]
    spread = max(0.0, total["squares"] / total["n"] - m * m - m * (1 - m) * total["hosts"] / total["n"])
    weight = min(MAX_PRIOR, max(MIN_PRIOR, m * (1 - m) / spread - 1)) if spread > 0 else MAX_PRIOR
    return hosts.withColumn("host_rate", (F.col("n_failed") + F.lit(m * weight)) / (F.col("n_docs") + F.lit(weight)))


def judge(df: DataFrame, id_col: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """One row per document: id, the measures, base_failed, host_rate and kept.

    A document is kept if it passes the base rules and its host's shrunk
    failure rate is at most MAX_HOST_RATE.  NULL hosts are one host; repeated
    rows count each; an empty table gives no rows; other columns are not read.
    """
    rows = df.select(F.col(id_col).alias("_id"), F.col(text).alias("_text"), F.col(host).alias("host"))
    measured = shared_table(measure(rows, "_text").drop("_text"))
    rates = host_rates(measured).select(F.col("host").alias("_host"), "host_rate")
    joined = measured.join(rates, F.col("host").eqNullSafe(F.col("_host")), "left")
    return joined.select(
        F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("host_rate") <= MAX_HOST_RATE)).alias("kept"), "host_rate",
    )


def keep_good(df: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The rows of ``df``, unchanged, whose documents and hosts pass.

    NULL and empty texts have no words and go; NULL hosts are one host;
    repeated rows are judged each and count each; an empty table gives no rows;
    columns may have any names.
    """
    measured = measure(df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_all"), F.col(text).alias("_text"), F.col(host).alias("host")), "_text").drop("_text")
    measured = shared_table(measured)
    bad = host_rates(measured).where(F.col("host_rate") > MAX_HOST_RATE).select(F.col("host").alias("_host"))
    good = measured.where(~F.col("base_failed"))
    return good.join(bad, F.col("host").eqNullSafe(F.col("_host")), "left_anti").select("_all.*")


def op6(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP6_SQL = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents
), w AS (
  SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls
  FROM d
), g AS (
  SELECT r, i, list_slice(ws, i, i + {WINDOW - 1}) AS win
  FROM (SELECT r, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w WHERE len(ws) >= {WINDOW})
), rep AS (
  SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before
  FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS c FROM g) WHERE c > 1
), covered AS (
  SELECT r, sum(CASE WHEN before IS NULL OR i - before >= {WINDOW} THEN {WINDOW} ELSE i - before END)::BIGINT AS n FROM rep GROUP BY r
), m AS (
  SELECT w.doc_id, w.source, len(ws)::BIGINT AS n_words, length(list_aggregate(ws, 'string_agg', ''))::BIGINT AS wc,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls) AS n_lines, coalesce(covered.n, 0) AS n_repeat_words
  FROM w LEFT JOIN covered USING (r)
), f AS (
  SELECT *, coalesce(wc, 0) AS word_chars, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed FROM m
), x AS (
  SELECT *, base_failed OR n_symbols > {MAX_SYMBOLS} * n_words OR 100 * n_dup_lines > {MAX_DUP_LINES} * n_lines
    OR NOT coalesce(word_chars / nullif(n_words, 0) BETWEEN {MIN_MEAN} AND {MAX_MEAN}, false) AS failed FROM f
), h AS (
  SELECT source, count(*)::DOUBLE AS n, sum(failed::INT)::DOUBLE AS f FROM x GROUP BY source
), tot AS (
  SELECT sum(f) / sum(n) AS m, greatest(0, sum(f * f / n) / sum(n) - pow(sum(f) / sum(n), 2)
    - sum(f) / sum(n) * (1 - sum(f) / sum(n)) * count(*) / sum(n)) AS spread FROM h
), prior AS (
  SELECT m, CASE WHEN spread > 0 THEN least({MAX_PRIOR}, greatest({MIN_PRIOR}, m * (1 - m) / spread - 1)) ELSE {MAX_PRIOR} END AS k FROM tot
), rates AS (
  SELECT source, (f + m * k) / (n + k) AS host_rate FROM h, prior
)
SELECT x.doc_id, x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed,
  NOT x.base_failed AND host_rate <= {MAX_HOST_RATE} AS kept, host_rate
FROM x JOIN rates ON x.source IS NOT DISTINCT FROM rates.source
"""
