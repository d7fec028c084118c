"""Secret scans: patterns, and a randomness test battery, in DataFrame operations only.

Matches are placed without leaving the row: a pattern's matches and the gaps
between them (the text split by the pattern) give all positions by adding up
their lengths.  A long token that no pattern covers is tested for randomness in
the alphabet of the encoding it looks like: chi-squared uniformity of the
symbols and of their classes (upper, lower, digit, sign), runs above and below
the middle of the alphabet, and correlation of neighbours.  Fisher's sum makes
the tests one p-value of "random".  False discoveries are counted with decoys:
for each token a piece of the document's own words, run together with capitals, as long and read in the
same alphabet, goes through the same tests.  In each class of length (a power of
two) and encoding, tokens count as random down to the p-value at which decoys would
be too large a share of what passes, over all documents.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_table, text_or_empty
from .quality_rules import let

ASSIGN = "(?i)(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
# At most one length of a run of these can match, so asking for the length at once drops what the plain pattern would.
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
TOKEN = "[A-Za-z0-9+/_=-]{20,}"
MIN_ASSIGNED = 12
KINDS = ("assign", "access", "hex", "random")
#: Share of false discoveries allowed in a class of length and encoding.
FDR = 0.05
#: Tenths of -log10 of a p-value: bins in all, and the last in which a token may still count as random.
BINS, LAST_BIN = 60, 30
#: Symbols of each encoding, and where its classes of symbols end.
ALPHABETS = {
    16: "0123456789abcdef", 26: "abcdefghijklmnopqrstuvwxyz", 32: "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 36: "0123456789abcdefghijklmnopqrstuvwxyz",
    64: "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
CLASSES = {16: (10, 16), 26: (26,), 32: (26, 32), 36: (10, 36), 64: (26, 52, 62, 64)}
_CHUNK = 128


def running_totals(lengths: Column) -> Column:
    """Sum of all entries before each, for an array of ints; in chunks, so long arrays stay cheap."""

    def of(a: Column) -> Column:
        add = lambda part: F.aggregate(part, F.lit(0), lambda x, y: x + y)
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / _CHUNK).cast("int")), lambda c: add(F.slice(a, c * _CHUNK + 1, _CHUNK)))
        bases = F.aggregate(
            chunks, F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("all")),
            lambda acc, x: F.struct((acc["n"] + x).alias("n"), F.concat(acc["all"], F.array(acc["n"])).alias("all")), lambda acc: acc["all"],
        )
        place = lambda b: F.transform(a, lambda x, i: F.get(b, F.floor(i / _CHUNK).cast("int")) + add(F.slice(a, i - i % _CHUNK + 1, i % _CHUNK)))
        return F.when(F.size(a) > 0, let(bases, place)).otherwise(F.array().cast("array<int>"))

    return let(lengths, of)


def matches(text: Column, pattern: str, group: int | None = None) -> Column:
    """array<struct<start, end, value>> of the leftmost non-overlapping matches, in code points; value is ``group`` or the match."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = found if group is None else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.split(text, pattern, -1)

    def place(m: Column) -> Column:
        # gap 0, match 0, gap 1, match 1 ..: a match starts after its gap and all before
        pair = F.transform(F.arrays_zip(m["found"].alias("m"), F.slice(m["gaps"], 1, F.size(m["found"])).alias("g")), lambda x: F.length(x["m"]) + F.length(x["g"]))
        start = lambda b: F.transform(
            m["found"], lambda x, i: F.struct((F.get(b, i) + F.length(F.get(m["gaps"], i))).alias("start"), (F.get(b, i) + F.length(F.get(m["gaps"], i)) + F.length(x)).alias("end"), F.get(m["value"], i).alias("value"))
        )
        return let(running_totals(pair), start)

    whole = let(F.struct(found.alias("found"), value.alias("value"), gaps.alias("gaps")), place)
    return F.when(text.rlike(pattern), whole).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>"))


def _spans(found: Column, kind: int) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")))


def _log_tail(z: Column) -> Column:
    """ln of the chance that a standard normal value exceeds z (a logistic approximation, within 2e-4 of the chance)."""
    return -F.log1p(F.exp(F.least(1.5976 * z + 0.070565 * z * z * z, F.lit(600.0))))


def _log_chi(x: Column, df: Column) -> Column:
    """ln of the chance that chi-squared with df degrees exceeds x (Wilson and Hilferty)."""
    return _log_tail((F.cbrt(x / df) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df)))


def randomness(symbols: Column, size: Column) -> Column:
    """-log10 of the p-value of the symbols 0..size-1 under uniform randomness: Fisher's sum of all tests; 99 below two symbols."""
    return let(F.struct(symbols.alias("v"), size.alias("size")), lambda t: _fisher(t["v"], t["size"]))


def _fisher(v: Column, size: Column) -> Column:
    n, k = F.size(v).cast("double"), size.cast("double")
    squares = F.aggregate(
        F.array_sort(v), F.struct(F.lit(-1).alias("p"), F.lit(0.0).alias("r"), F.lit(0.0).alias("s")),
        lambda a, x: let(F.when(x == a["p"], a["r"] + 1).otherwise(0.0), lambda r: F.struct(x.alias("p"), r.alias("r"), (a["s"] + 2 * r + 1).alias("s"))),
        lambda a: a["s"],
    )
    # counts squared are summed as 1 + 3 + 5 .. along each run of equal symbols
    half = k / 2
    start = F.struct(*[F.lit(0.0).alias(c) for c in ("i", "p", "c", "hi", "s", "q", "x")])
    scan = F.aggregate(
        v, start,
        lambda a, x: F.struct(
            (a["i"] + 1).alias("i"), x.cast("double").alias("p"),
            (a["c"] + ((a["i"] > 0) & ((a["p"] >= half) != (x >= half))).cast("double")).alias("c"), (a["hi"] + (x >= half).cast("double")).alias("hi"),
            (a["s"] + x).alias("s"), (a["q"] + x * x).alias("q"), (a["x"] + F.when(a["i"] > 0, a["p"] * x).otherwise(0.0)).alias("x"),
        ),
    )
    ends = F.element_at(F.create_map(*[c for s, e in CLASSES.items() for c in (F.lit(s), F.array(*map(F.lit, e)))]), size)

    def of_classes(e: Column) -> Column:
        """ln p of the classes' uniformity, 0 where an encoding has one class only."""
        low = lambda i: F.when(i > 0, F.get(e, i - 1)).otherwise(0)
        wanted = lambda i: n * (F.get(e, i) - low(i)) / k
        off = F.transform(F.sequence(F.lit(0), F.size(e) - 1), lambda i: let(F.size(F.filter(v, lambda x: (x >= low(i)) & (x < F.get(e, i)))) - wanted(i), lambda d: d * d / wanted(i)))
        return F.when(F.size(e) > 1, _log_chi(F.aggregate(off, F.lit(0.0), lambda a, x: a + x), (F.size(e) - 1).cast("double"))).otherwise(F.lit(0.0))

    def verdict(t: Column) -> Column:
        a, e = t["scan"], t["ends"]
        two = 2 * a["hi"] * (n - a["hi"])
        spread = F.sqrt(F.greatest(two * (two - n) / (n * n * (n - 1)), F.lit(1e-9)))
        runs = F.when(two > 0, F.abs(a["c"] + 1 - (1 + two / n)) / spread).otherwise(99.0)
        mean = a["s"] / n
        outer = (F.get(v, F.lit(0)) + F.element_at(v, -1)).cast("double")
        cross = a["x"] - mean * (2 * a["s"] - outer) + (n - 1) * mean * mean
        serial = F.abs(cross / F.greatest(a["q"] - n * mean * mean, F.lit(1e-9)) + 1 / n) * F.sqrt(n)
        both = lambda z: F.least(_log_tail(z) + math.log(2), F.lit(0.0))
        h = -(_log_chi(k / n * t["squares"] - n, k - 1) + of_classes(e) + both(runs) + both(serial))
        three = 1 + h + h * h / 2
        return (h - F.log(F.when(F.size(e) > 1, three + h * h * h / 6).otherwise(three))) / math.log(10)  # chi-squared of twice as many degrees as tests

    return F.when(F.size(v) > 1, let(F.struct(squares.alias("squares"), scan.alias("scan"), ends.alias("ends")), verdict)).otherwise(F.lit(99.0))


def encoding(token: Column) -> Column:
    """The size of the smallest alphabet in ALPHABETS that a token without padding fits; 0 for digits alone."""
    return (
        F.when(token.rlike("^[0-9]*$"), 0).when(token.rlike("^([0-9a-f]+|[0-9A-F]+)$"), 16).when(token.rlike("^([a-z]+|[A-Z]+)$"), 26)
        .when(token.rlike("^[A-Z2-7]+$"), 32).when(token.rlike("^([0-9a-z]+|[0-9A-Z]+)$"), 36).otherwise(64)
    )


def _ordinals(text: Column, size: Column) -> Column:
    symbols = F.element_at(F.create_map(*[F.lit(c) for x in ALPHABETS.items() for c in x]), size)
    one_case = F.when(size.isin(16, 26, 36), F.lower(text)).when(size == 64, F.translate(text, "-_", "+/")).otherwise(text)
    return let(F.struct(symbols.alias("a"), one_case.alias("t")), lambda s: F.filter(F.transform(F.split(s["t"], ""), lambda c: F.position(c, s["a"]) - 1), lambda x: x >= 0))


def _bin(evidence: Column) -> Column:
    return F.least(F.floor(F.greatest(evidence, F.lit(0.0)) * 10), F.lit(BINS)).cast("int")


def _tested(start: Column, end: Column, token: Column, letters: Column) -> Column:
    """Place, class of length and encoding, and the p-value bins of a token and of its decoy (NULL where the document has too few letters)."""
    body = F.regexp_replace(token, "=+$", "")

    def of(t: Column) -> Column:
        length, piece = F.length(t["body"]), t["piece"]
        # letters in other alphabets: by their place, around and around
        decoy = F.when(t["size"].isin(26, 64), _ordinals(piece, t["size"])).otherwise(F.transform(_ordinals(piece, F.lit(26)), lambda x: x % t["size"]))
        return F.struct(
            start.alias("start"), end.alias("end"), (F.floor(F.log2(length)).cast("int") * 100 + t["size"]).alias("size"),
            F.when(t["size"] == 0, BINS).otherwise(_bin(randomness(_ordinals(t["body"], t["size"]), t["size"]))).alias("bin"),
            F.when((t["size"] > 0) & (F.length(letters) >= length), _bin(randomness(decoy, t["size"]))).alias("decoy"),
        )

    def placed(b: Column) -> Column:
        length = F.length(b)
        piece = letters.substr(F.pmod(F.xxhash64(start, token), F.greatest(F.length(letters) - length + 1, F.lit(1))).cast("int") + 1, length)
        return let(F.struct(b.alias("body"), encoding(b).alias("size"), piece.alias("piece")), of)

    return let(body, placed)


def cuts(tested: DataFrame, fdr: float) -> DataFrame:
    """(size, cut) of the classes of length and encoding in which any token counts as random: those in bins up to ``cut``.

    It is the last bin, LAST_BIN at most, up to which decoys are no more than
    ``fdr`` of the tokens.
    """
    each = tested.select(F.explode("_tested").alias("t")).select("t.*")
    bins = each.groupBy("size", F.col("bin")).agg(F.count(F.lit(1)).alias("n"), F.lit(0).cast("long").alias("d"))
    bins = bins.unionByName(each.where("decoy is not null").groupBy("size", F.col("decoy").alias("bin")).agg(F.lit(0).cast("long").alias("n"), F.count(F.lit(1)).alias("d")))
    bins = bins.groupBy("size", "bin").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    upto = Window.partitionBy("size").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # at most BINS + 1 rows
    summed = bins.withColumn("_n", F.sum("n").over(upto)).withColumn("_d", F.sum("d").over(upto))
    return summed.where((F.col("bin") <= LAST_BIN) & (F.col("_n") > 0) & (F.col("_d") <= F.lit(fdr) * F.col("_n"))).groupBy("size").agg(F.max("bin").alias("cut"))


def scan(df: DataFrame, id_col: str = "doc_id", text: str = "text", fdr: float = FDR) -> DataFrame:
    """One row per document: (id, n_assign, n_access, n_hex, base_sha256, spans, n_random).

    Spans are in code points, end exclusive; ``spans`` adds random tokens that
    overlap no pattern match.  NULL is an empty text and has none.  Repeated
    rows are scanned each and count each in the false-discovery control; an
    empty table gives no rows; other columns are not read.
    """
    content = F.col("_text")
    rows = df.select(F.col(id_col).alias("_id"), text_or_empty(text).alias("_text"))
    found = rows.select(
        "_id", "_text",
        F.filter(matches(content, ASSIGN, 2), lambda x: F.length(x["value"]) >= MIN_ASSIGNED).alias("_assign"),
        matches(content, ACCESS).alias("_access"),
        matches(content, HEX).alias("_hex"),
        matches(content, TOKEN).alias("_tokens"),
    )
    based = found.select(
        "_id", "_text",
        *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS[:3]],
        F.array_sort(F.concat(*[_spans(F.col(f"_{k}"), i) for i, k in enumerate(KINDS[:3])])).alias("_base"),
        "_tokens",
    )
    free = F.filter("_tokens", lambda t: ~F.exists("_base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    based = based.withColumn("_free", free).withColumn("_letters", F.when(F.size("_free") > 0, F.regexp_replace(F.initcap(F.regexp_replace("_text", "[^A-Za-z]+", " ")), " ", "")).otherwise(F.lit("")))
    tested = based.withColumn("_tested", F.transform("_free", lambda t: _tested(t["start"], t["end"], t["value"], F.col("_letters")))).drop("_tokens", "_free", "_letters", "_text")
    tested = shared_table(tested)
    held = {r["size"]: r["cut"] for r in cuts(tested, fdr).collect()}  # a row per encoding and power of two of the token length
    limits = F.create_map(*[F.lit(x) for pair in held.items() for x in pair]) if held else F.lit(None).cast("map<int,int>")
    random = F.filter("_tested", lambda t: F.coalesce(t["bin"] <= F.element_at(limits, t["size"]), F.lit(False)))
    spans = F.array_sort(F.concat("_base", _spans(F.col("_random"), 3)))
    names = F.array(*map(F.lit, KINDS))
    joined = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")
    return tested.withColumn("_random", random).select(
        F.col("_id").alias(id_col), "n_assign", "n_access", "n_hex", F.sha2(joined(F.col("_base")), 256).alias("base_sha256"), joined(spans).alias("spans"), F.size("_random").cast("long").alias("n_random")
    )


def op2(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
