"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

A source's target is a number of words.  Its documents are taken once for each
whole multiple of the source's size in the target.  The rest is a sample without
replacement with unequal inclusion probabilities: each is proportional to the
document's value (its size, or its size times a stated weight), scaled so that
the words expected are those still wanted.  Documents for which that gives 1 or
more are certain copies and leave the sample.  Each other document draws a
uniform number from a hash of itself and is ranked by

    (u / (1 - u)) / (p / (1 - p))

the random odds over the odds of its inclusion.  Each source gives a fixed number
of documents, the lowest ranks of all of it: the sum of its probabilities rounded
to a whole number.  The probabilities move to that sum by as much as keeps the
words expected at those wanted; a source of a few documents, where that would
take one out of (0, 1), is moved plainly and may expect up to half of its largest
document more or less.

The random numbers of a source are collocated: its documents are put in an order,
by classes of value and size and at random inside a class, and a document's number
is the part of a unit left above the probabilities that came before it, from a
random start on.  Each number is uniform by itself, so a document is taken as
often as stated whatever the seed, yet neighbours share out their probabilities:
as many documents rank below 1 as the source gives, and its words miss its target
by a part of a large document however many it has, not by more the more it has.

The lowest ranks are found from counts in buckets of the rank, and only the
bucket of the last one is sorted, and only if it isn't taken whole, so that a hot
source is dealt over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import PART_ROWS, WORD, passing_tables, shared_table, text_or_empty

#: Weights of sources by code point, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0
SEED = 17
#: Rank buckets of a source.
BUCKETS = 65_536
#: Classes for each doubling of value, and of size.
CLASSES = 8
#: The largest probability of a document that isn't certain.
NEARLY = 1 - 1e-9


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size) to (source, source_size, target).

    ``share`` of all sizes is dealt by weight; no source gets more than
    ``most`` times its size and what it can't take is dealt again among the
    others.  That fixed point is found in one pass: sources in the order of
    limit over weight are full as long as the level they need is within reach.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*map(F.lit, weights))
    limit = F.col("source_size") * F.lit(most)
    weighed = sizes.withColumn("_w", F.element_at(cycle, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    by_level = Window.orderBy(F.col("_level"), F.col("source").asc_nulls_last())
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        weighed.withColumn("_level", limit / F.col("_w"))
        .withColumn("_budget", F.sum("source_size").over(everything) * F.lit(share))
        .withColumn("_full_before", F.coalesce(F.sum(limit).over(before), F.lit(0.0)))
        .withColumn("_w_left", F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
        .withColumn("_full", F.col("_full_before") + F.col("_level") * F.col("_w_left") <= F.col("_budget"))
    )
    open_from = F.min(F.when(~F.col("_full"), F.col("_level"))).over(everything)
    first_open = F.when(~F.col("_full") & (F.col("_level") == open_from), (F.col("_budget") - F.col("_full_before")) / F.col("_w_left"))
    return (
        ranked.withColumn("_share", F.max(first_open).over(everything))
        .select("source", "source_size", F.when(F.col("_full"), limit).otherwise(F.least(limit, F.col("_share") * F.col("_w"))).alias("target"))
    )


def _uniform(*by: Column) -> Column:
    """A number in (0, 1) from the md5 of some strings, NULL ones as empty."""
    digest = F.md5(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in by]))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))


def _class(x: Column) -> Column:
    return F.floor(F.log2(x) * CLASSES + F.lit(1e-9)).cast("int")


def _same(a: DataFrame, b: DataFrame, *names: str) -> Column:
    out = F.lit(True)
    for c in names:
        out = out & a[c].eqNullSafe(b[c])
    return out


def _cumulated(rows: DataFrame, key: str, value: str, *order: str) -> DataFrame:
    """``rows`` with ``_before``, the sum of ``value`` over those of their key that come before them; dealt by ranges of key and order, as by common.positions."""
    parts = max(1, -(-rows.count() // PART_ROWS))
    dealt = shared_table(rows.repartitionByRange(parts, key, *order).withColumn("_part", F.spark_partition_id()))
    earlier = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("_part", key).agg(F.sum(value).alias("_sum"))
    totals = totals.select("_part", key, F.coalesce(F.sum("_sum").over(earlier), F.lit(0.0)).alias("_parts"))
    inside = Window.partitionBy("_part", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = dealt.join(totals, _same(dealt, totals, "_part", key)).drop(totals["_part"]).drop(totals[key])
    return joined.withColumn("_before", F.col("_parts") + F.coalesce(F.sum(value).over(inside), F.lit(0.0))).drop("_part", "_parts")


def _decided(df: DataFrame, id_col: str, text: str, source: str, weight: str | None, weights: tuple[float, ...], share: float, most: float, seed: int) -> DataFrame:
    """(_id, _print, source, size, source_size, target, inclusion, copies) of each row."""
    size = F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")
    value = size.cast("double") if weight is None else size * F.coalesce(F.col(weight).cast("double"), F.lit(1.0))
    docs = df.select(
        F.col(id_col).alias("_id"), F.xxhash64(text_or_empty(text)).alias("_print"), F.col(source).alias("source"), size.alias("size"), value.alias("_value"),
        _uniform(F.lit(seed), F.col(id_col), F.md5(text_or_empty(text).cast("binary"))).alias("_u"),
    )
    docs = shared_table(docs.withColumn("_row", F.monotonically_increasing_id()))
    targets = shared_table(source_targets(docs.groupBy("source").agg(F.sum("size").cast("long").alias("source_size")), weights, share, most))
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(times + F.lit(1e-12)).cast("int")
    targets = targets.withColumn("_whole", whole).withColumn("_wanted", F.greatest(times - whole, F.lit(0.0)) * F.col("source_size"))
    open_ = (F.col("_wanted") > 0) & (F.col("size") > 0) & (F.col("_value") > 0)
    joined = docs.join(targets, _same(docs, targets, "source")).drop(targets["source"])
    joined = joined.withColumn("_vc", F.when(open_, _class(F.col("_value")))).withColumn("_sc", F.when(open_, _class(F.col("size"))))

    # the scale c of p = c * value: classes of value from the largest on are certain as long as c would take them beyond 1
    by_value = joined.where("_vc is not null").groupBy("source", "_vc").agg(
        F.sum("size").alias("_words"), F.sum(F.col("_value") * F.col("size")).alias("_product"), F.max("_value").alias("_top"), F.max("_wanted").alias("_wanted")
    )
    falling = Window.partitionBy("source").orderBy(F.col("_vc").desc())  # classes of one source
    before = F.coalesce(F.sum("_words").over(falling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    scale = (F.col("_wanted") - before) / F.sum("_product").over(falling.rowsBetween(0, Window.unboundedFollowing))
    fits = (scale * F.col("_top") <= 1) | (before + F.col("_words") > F.col("_wanted"))
    scales = by_value.select("source", "_vc", scale.alias("_scale"), fits.alias("_fits")).where("_fits").groupBy("source").agg(F.max(F.struct("_vc", "_scale")).alias("_s"))
    scales = shared_table(scales.select("source", F.col("_s._vc").alias("_below"), F.col("_s._scale").alias("_scale")))

    drawn = joined.join(scales, _same(joined, scales, "source"), "left").drop(scales["source"])
    certain = F.col("_below").isNull() | (F.col("_vc") > F.col("_below")) | (F.col("_scale") * F.col("_value") >= 1)
    drawn = drawn.withColumn("_p", F.when(F.col("_vc").isNull(), 0.0).when(certain, 1.0).otherwise(F.greatest(F.col("_scale") * F.col("_value"), F.lit(0.0))))
    drawn = shared_table(drawn)

    # a fixed number of documents of each source: its probabilities move by (more + slope * size) p (1 - p), which adds up to that number and to no words
    drawn_at_all = (F.col("_p") > 0) & (F.col("_p") < 1)
    loose = F.col("_p") * (1 - F.col("_p"))
    numbers = drawn.where(drawn_at_all).groupBy("source").agg(
        F.sum("_p").alias("_total"), F.count(F.lit(1)).alias("_n"), F.min("size").alias("_low"), F.max("size").alias("_high"),
        F.sum(loose).alias("_q0"), F.sum(loose * F.col("size")).alias("_q1"), F.sum(loose * F.col("size") * F.col("size")).alias("_q2"),
    )
    numbers = numbers.withColumn("_number", F.floor(F.col("_total") + 0.5))
    spread, short = F.expr("nullif(_q0 * _q2 - _q1 * _q1, 0)"), F.col("_number") - F.col("_total")
    numbers = numbers.withColumn("_more", short * F.col("_q2") / spread).withColumn("_slope", -short * F.col("_q1") / spread)
    inside_one = [F.abs(F.col("_more") + F.col("_slope") * F.col(c)) < 1 for c in ("_low", "_high")]  # then no probability leaves (0, 1)
    numbers = shared_table(numbers.withColumn("_even", F.coalesce(inside_one[0] & inside_one[1], F.lit(False))))  # a row per source
    moved = (
        F.when(F.col("_even"), F.col("_p") + loose * (F.col("_more") + F.col("_slope") * F.col("size")))
        .when(F.col("_number") > F.col("_total"), F.col("_p") + (F.col("_number") - F.col("_total")) * (1 - F.col("_p")) / (F.col("_n") - F.col("_total")))
        .otherwise(F.col("_p") * F.col("_number") / F.col("_total"))
    )
    closed = drawn.where(~drawn_at_all)
    drawn = drawn.where(drawn_at_all)
    drawn = drawn.join(numbers, _same(drawn, numbers, "source")).drop(numbers["source"])
    drawn = drawn.withColumn("_p", F.least(moved, F.lit(NEARLY)))

    # their collocated numbers and ranks
    drawn = _cumulated(drawn, "source", "_p", "_vc", "_sc", "_u", "_id", "_row")
    at = F.col("_before") + _uniform(F.lit(seed), F.col("source"))
    drawn = drawn.withColumn("_u", F.least(F.greatest(1 - (at - F.floor(at)), F.lit(1 - NEARLY)), F.lit(NEARLY)))
    drawn = drawn.withColumn("_rank", F.when(F.col("_p") > 0, F.col("_u") / (1 - F.col("_u")) / (F.col("_p") / (1 - F.col("_p")))))
    # rank / (1 + rank) lies in (0, 1), grows with the rank and is at most about 1/2 for the last one taken
    drawn = shared_table(drawn.withColumn("_bucket", F.floor(F.col("_rank") / (F.col("_rank") + 1) * BUCKETS).cast("int")))

    # the bucket in which the last of them is
    counts = drawn.where("_rank is not null").groupBy("source", "_number", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    inside = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # at most BUCKETS rows
    cuts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(inside), F.lit(0))).where("_before < _number and _number <= _before + _n")
    need = F.col("_number") - F.col("_before")
    cuts = shared_table(cuts.select(F.col("source").alias("source_of"), F.col("_bucket").alias("_cut"), need.alias("_need"), (need == F.col("_n")).alias("_all")))
    placed = drawn.drop("_before").join(cuts, drawn["source"].eqNullSafe(cuts["source_of"]), "left").drop("source_of")
    at_cut = F.coalesce((F.col("_bucket") == F.col("_cut")) & ~F.col("_all"), F.lit(False))
    order = Window.partitionBy("source").orderBy("_rank", "_id", "_row")  # one bucket of a source
    exact = placed.where(at_cut).withColumn("_in", F.row_number().over(order) <= F.col("_need"))
    rest = placed.where(~at_cut).withColumn("_in", F.coalesce(F.col("_bucket") <= F.col("_cut"), F.lit(False)))
    used = ["_id", "_print", "source", "size", "source_size", "target", "_whole", "_p", "_in"]
    chosen = exact.select(*used).unionByName(rest.select(*used)).unionByName(closed.withColumn("_in", F.lit(False)).select(*used))
    copies = F.col("_whole") + ((F.col("_p") >= 1) | F.col("_in")).cast("int")
    return chosen.select("_id", "_print", "source", "size", "source_size", "target", (F.col("_whole") + F.col("_p")).alias("inclusion"), copies.alias("copies"))


def mix(
    df: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weight: str | None = None, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED
) -> DataFrame:
    """How often each document is taken: (id, size, source, source_size, target, inclusion, copies, taken).

    Size is the number of words (NULL text: 0).  ``weight`` may name a column
    of non-negative document weights (NULL: 1); a document of weight 0 is taken
    only in whole copies.  ``inclusion`` is the expected number of copies.  Documents without words are taken as
    often as their source's whole copies.  Repeated rows count and are drawn each;
    a NULL source is a source of its own.  An empty table gives
    no rows; other columns are not read.  Reruns agree.
    """
    with passing_tables(df.sparkSession):
        decided = shared_table(_decided(df, id_col, text, source, weight, weights, share, most, seed), keep=True)
    return decided.select(F.col("_id").alias(id_col), "size", "source", "source_size", "target", "inclusion", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def take(df: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of ``df`` as the mix takes them: each as often as its copies, those with none not at all.

    All columns stay, whatever their names.  Rows of one id, text and source
    share their copies evenly, and what can't be divided goes to one of them.
    NULL and empty texts have no words and are taken in whole copies only; an
    empty table gives no rows.
    """
    with passing_tables(df.sparkSession):
        decided = _decided(df, id_col, text, source, None, WEIGHTS, SHARE, MOST, SEED)
        shares = decided.groupBy("_id", "_print", "source").agg(F.sum("copies").alias("_all"), F.count(F.lit(1)).alias("_rows")).where("_all > 0")
        shares = shared_table(shares.select("_id", "_print", "source", F.floor(F.col("_all") / F.col("_rows")).alias("_each"), (F.col("_all") % F.col("_rows")).alias("_more")), keep=True)
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), F.col(id_col).alias("_id"), F.xxhash64(text_or_empty(text)).alias("_print"), F.col(source).alias("source"))
    held = rows.join(shares, _same(rows, shares, "_id", "_print", "source")).select("_row", shares["_id"], shares["_print"], shares["source"], "_each", "_more")
    times = lambda x, n: x.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col(n)))).select("_row.*")
    taken = times(held.where("_each > 0"), "_each")
    if shares.where("_more > 0").limit(1).count():  # only repeated rows have any
        taken = taken.union(times(held.where("_more > 0").dropDuplicates(["_id", "_print", "source"]), "_more"))
    return taken


def op10(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("copies")


_WEIGHTS = ", ".join(map(str, WEIGHTS))
_U = "(CAST('0x' || substr(md5({}), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0"
OP10_SQL = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size, row_number() OVER () AS r,
    {_U.format(f"'{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))")} AS u
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), o AS (
  SELECT *, [{_WEIGHTS}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1]::DOUBLE AS w, source_size * {MOST}::DOUBLE AS most FROM s
), l AS (
  SELECT *, most / w AS level, {SHARE}::DOUBLE * sum(source_size) OVER () AS budget,
    coalesce(sum(most) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w_left
  FROM o
), f AS (
  SELECT *, before + level * w_left <= budget AS is_full FROM l
), t AS (
  SELECT source, source_size, CASE WHEN is_full THEN most ELSE least(most, w * (
    SELECT max((budget - before) / w_left) FROM f WHERE NOT is_full AND level = (SELECT min(level) FROM f WHERE NOT is_full))) END AS target FROM f
), n AS (
  SELECT *, floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END + 1e-12) AS whole,
    greatest(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END - floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END + 1e-12), 0) * source_size AS wanted FROM t
), j AS (
  SELECT d.*, source_size, target, whole, wanted, CASE WHEN wanted > 0 AND size > 0 THEN floor(log2(size) * {CLASSES} + 1e-9) END AS c FROM d JOIN n ON d.source IS NOT DISTINCT FROM n.source
), v AS (
  SELECT source, c, sum(size) AS words, sum(size::DOUBLE * size) AS product, max(size) AS top, max(wanted) AS wanted FROM j WHERE c IS NOT NULL GROUP BY source, c
), b AS (
  SELECT *, coalesce(sum(words) OVER (PARTITION BY source ORDER BY c DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    sum(product) OVER (PARTITION BY source ORDER BY c DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS below FROM v
), k AS (
  SELECT source, max(c) AS c, max_by((wanted - before) / below, c) AS scale FROM b WHERE (wanted - before) / below * top <= 1 OR before + words > wanted GROUP BY source
), p AS (
  SELECT j.*, CASE WHEN j.c IS NULL THEN 0.0 WHEN k.c IS NULL OR j.c > k.c OR scale * size >= 1 THEN 1.0 ELSE greatest(scale * size, 0) END AS p FROM j LEFT JOIN k ON j.source IS NOT DISTINCT FROM k.source
), h AS (
  SELECT source, sum(p) AS total, floor(sum(p) + 0.5) AS number, count(*) AS n, min(size) AS low, max(size) AS high,
    sum(p * (1 - p)) AS q0, sum(p * (1 - p) * size) AS q1, sum(p * (1 - p) * size * size) AS q2 FROM p WHERE p > 0 AND p < 1 GROUP BY source
), e AS (
  SELECT *, (number - total) * q2 / nullif(q0 * q2 - q1 * q1, 0) AS more, (total - number) * q1 / nullif(q0 * q2 - q1 * q1, 0) AS slope FROM h
), q AS (
  SELECT p.* EXCLUDE (p), p > 0 AND p < 1 AS drawn, number, CASE WHEN p > 0 AND p < 1 THEN least(CASE
      WHEN abs(more + slope * low) < 1 AND abs(more + slope * high) < 1 THEN p + p * (1 - p) * (more + slope * size)
      WHEN number > total THEN p + (number - total) * (1 - p) / (n - total) ELSE p * number / total END, {NEARLY}::DOUBLE) ELSE p END AS p
  FROM p LEFT JOIN e ON p.source IS NOT DISTINCT FROM e.source
), w AS (
  SELECT *, coalesce(sum(p) OVER (PARTITION BY source, drawn ORDER BY c, u, doc_id, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
    + {_U.format(f"'{SEED}|' || coalesce(source, '')")} AS upto FROM q
), y AS (
  SELECT * EXCLUDE (u, upto), least(greatest(1 - (upto - floor(upto)), {1 - NEARLY}::DOUBLE), {NEARLY}::DOUBLE) AS u FROM w
), x AS (
  SELECT *, row_number() OVER (PARTITION BY source, p > 0 AND p < 1 ORDER BY CASE WHEN p > 0 AND p < 1 THEN u / (1 - u) / (p / (1 - p)) END, doc_id, r) AS place FROM y
)
SELECT doc_id, size, source, source_size, target, whole + p AS inclusion, (size * (whole + CASE WHEN p >= 1 OR (p > 0 AND place <= number) THEN 1 ELSE 0 END))::BIGINT AS taken FROM x
"""
