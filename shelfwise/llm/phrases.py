"""Phrases whose words stand together more often than their parts suggest, mined by pivot partitioning.

Words are ranked by frequency in their language, and a phrase belongs to its
rarest word, the pivot.  Where a word occurs, the neighbours that are no rarer
and at most three words off make up a fragment; fragments go to the pivot's
bucket, equal ones counted once, and there the phrases that hold the pivot are
counted.  Each occurrence of a phrase lies in exactly one fragment, that of the
first occurrence of its rarest word, so nothing is counted twice and no bucket
needs another's text.  Buckets are sized by their number of words; pivots too
frequent for one are dealt to several, and only their phrases are summed again.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, byte_lengths, mixed, parts_by, positions, runs, shared_table, squeezed, text_bytes, unsqueezed

#: Words of the longest phrase.
LONGEST = 4
#: How far from its pivot a phrase reaches.
REACH = LONGEST - 1
LEAST = 30
TOP = 2000
#: Share of its occurrences, in percent, that a longer phrase must have to hide a shorter one.
HIDES = 80
SCALE = 2_000_000
#: Words of a bucket, about; a pivot with more occurrences is dealt to several buckets.
BUCKET_WORDS = 1_000_000

_CUT = 0xFF  # in no UTF-8 text
_FOLD = bytearray(range(256))
_FOLD[ord("A") : ord("Z") + 1] = range(ord("a"), ord("z") + 1)
_FOLD[9] = 32
for _c in b".,;:!?\n\x0b\x0c\r":
    _FOLD[_c] = _CUT
_FOLD = bytes(_FOLD)
_MARK = bytes([_CUT])


def _planes(values: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, compressed byte by byte."""
    return squeezed(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _numbers(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(unsqueezed(blob), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def coded_blocks(df: DataFrame, text: str, group: str, block_bytes: int) -> DataFrame:
    """Blocks (block, lang, n, codes, words, counts): the words of some documents of one language, coded by the block's own list of words from 1 on, 0 between pieces."""

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, tuple[defaultdict, list[np.ndarray]]] = {}
        size = 0

        def done() -> Iterator[pd.DataFrame]:
            for lang, (index, parts) in held.items():
                codes = np.concatenate(parts)
                counts = np.bincount(codes, minlength=len(index))[1:]
                if len(counts):
                    yield pd.DataFrame({"lang": [lang], "n": [int(counts.sum())], "codes": [_planes(codes)], "words": [[w.decode() for w in list(index)[1:]]], "counts": [counts]})
            held.clear()

        for pdf in batches:
            for lang, own in pdf.groupby("lang")["_text"]:
                texts = own.tolist()
                for a, b in runs(byte_lengths(texts)):
                    if lang not in held:
                        index: defaultdict = defaultdict(count().__next__)
                        index[_MARK]
                        held[lang] = index, []
                    index, parts = held[lang]
                    tokens = (_MARK + _MARK.join(texts[a:b]).translate(_FOLD) + _MARK).replace(_MARK, b" \xff ").split()
                    parts.append(np.fromiter(map(index.__getitem__, tokens), np.uint32, len(tokens)))
                    size += sum(map(len, texts[a:b]))
                    if size >= block_bytes:
                        yield from done()
                        size = 0
        yield from done()

    rows = df.select(F.coalesce(F.col(group).cast("string"), F.lit("und")).alias("lang"), text_bytes(text).alias("_text"))
    made = rows.mapInPandas(blocks, "lang string, n long, codes binary, words array<string>, counts array<long>")
    return shared_table(made.withColumn("block", F.monotonically_increasing_id()))


#: Kinds of fragments: words left and right of the pivot, and whether the pivot is dealt to several buckets; then their number stands before the words.
_KINDS = [(a, b, shared) for shared in (False, True) for a in range(REACH + 1) for b in range(REACH + 1)]
Fragments = dict[int, tuple[np.ndarray, np.ndarray]]


def _hash(rows: np.ndarray) -> np.ndarray:
    key = np.zeros(len(rows), np.uint64)
    for j in range(rows.shape[1]):
        key = mixed(key ^ rows[:, j], j)
    return key


def _combined(rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows and their summed counts; equal rows meet by hash and are compared whole, so at worst some stay apart."""
    order = np.argsort(_hash(rows), kind="stable")
    rows, counts = rows[order], counts[order]
    new = np.flatnonzero(np.concatenate(([True], (rows[1:] != rows[:-1]).any(1))))
    return rows[new], np.add.reduceat(counts, new)


def fragments(ranks: np.ndarray, spread: np.ndarray) -> Fragments:
    """{kind: (rows, counts)} of a run of words: for each word its neighbours that are no rarer, those before it more frequent.

    Rank 0 breaks.  ``spread`` is in how many buckets a word lies as a pivot.
    """
    n = len(ranks)
    wide = np.concatenate([np.zeros(REACH, np.uint32), ranks.astype(np.uint32), np.zeros(REACH, np.uint32)])
    here = wide[REACH : REACH + n]
    left, right = np.zeros(n, np.int8), np.zeros(n, np.int8)
    on_left = on_right = here > 0
    for d in range(1, REACH + 1):
        before, after = wide[REACH - d : REACH - d + n], wide[REACH + d : REACH + d + n]
        on_left = on_left & (before > 0) & (before < here)
        on_right = on_right & (after > 0) & (after <= here)
        left += on_left
        right += on_right
    kind = left * (REACH + 1) + right + np.where((spread > 1) & (left + right > 0), (REACH + 1) ** 2, 0)
    out = {}
    for k, rows in parts_by(kind, len(_KINDS)):
        a, b, shared = _KINDS[k]
        if a + b:
            columns = [spread[rows].astype(np.uint32)] * shared + [wide[rows + REACH + d] for d in range(-a, b + 1)]
            out[k] = _combined(np.stack(columns, 1), np.ones(len(rows), np.int64))
    return out


def _message(found: Fragments) -> bytes:
    """Fragments of all kinds as one compressed run of numbers; counts are two numbers each."""
    kinds = sorted(found)
    head = np.zeros(len(_KINDS), np.int64)
    head[kinds] = [len(found[k][0]) for k in kinds]
    counts = np.concatenate([found[k][1] for k in kinds])
    return _planes(np.concatenate([head, *[found[k][0].ravel() for k in kinds], counts & 0xFFFFFFFF, counts >> 32]))


def _read(messages: list[bytes]) -> Fragments:
    held = defaultdict(list)
    for m in messages:
        data = _numbers(m)
        head, at = data[: len(_KINDS)].tolist(), len(_KINDS)
        low, high = data[len(data) - 2 * sum(head) :].reshape(2, -1).astype(np.int64)
        counts, seen = low | high << 32, 0
        for k, n in enumerate(head):
            if n:
                width = sum(_KINDS[k]) + 1
                held[k].append((data[at : at + n * width].reshape(n, width), counts[seen : seen + n]))
                at, seen = at + n * width, seen + n
    return {k: _combined(np.concatenate([r for r, _ in parts]), np.concatenate([c for _, c in parts])) for k, parts in held.items()}


def bucket_of(rows: np.ndarray, kind: int, buckets: int) -> np.ndarray:
    """The bucket of a fragment: its pivot's, or one of its pivot's several by the fragment itself."""
    a, _, shared = _KINDS[kind]
    at = mixed(rows[:, shared + a].astype(np.uint64))
    if shared:
        at = mixed(at + _hash(rows) % rows[:, 0].astype(np.uint64), 5)
    return (at % np.uint64(buckets)).astype(np.int64)


def _dealt(found: Fragments, buckets: int, side: int | None = None) -> Iterator[tuple[int, Fragments]]:
    """Fragments by bucket, or by bucket modulo ``side``."""
    out: dict[int, Fragments] = defaultdict(dict)
    for k, (rows, counts) in found.items():
        at = bucket_of(rows, k, buckets)
        for p, own in parts_by(at % side if side else at, side or buckets):
            out[p][k] = rows[own], counts[own]
    yield from out.items()


def mined(found: Fragments) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(rows of LONGEST ranks, 0 behind shorter phrases; counts; shared) of all phrases of two words and more that hold their fragment's pivot."""
    for shared in (False, True):
        for n in range(2, LONGEST + 1):
            rows, counts = [], []
            for k, (own, times) in found.items():
                a, b, s = _KINDS[k]
                for x in range(max(0, n - 1 - b), min(a, n - 1) + 1) if s == shared else ():
                    rows.append(own[:, s + a - x : s + a - x + n])
                    counts.append(times)
            if rows:
                grams, times = np.concatenate(rows), np.concatenate(counts)
                order = np.lexsort(grams.T)
                grams, times = grams[order], times[order]
                new = np.flatnonzero(np.concatenate(([True], (grams[1:] != grams[:-1]).any(1))))
                out = np.zeros((len(new), LONGEST), np.int64)
                out[:, :n] = grams[new]
                yield out, np.add.reduceat(times, new), shared


def frequent(df: DataFrame, text: str = "text", group: str = "lang", least: int = LEAST, block_bytes: int = BLOCK_BYTES, bucket_words: int = BUCKET_WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lang, n) of all languages, (lang, word, f, rank) of their frequent words, and (lang, gram, f) of frequent phrases of two words and more.

    ``gram`` has the ranks of the words; the most frequent word has rank 1 and
    words of equal frequency rank by their bytes.  Ranks are below 2^32.
    """
    blocks = coded_blocks(df, text, group, block_bytes)
    totals = shared_table(blocks.groupBy("lang").agg(F.sum("n").alias("n")))
    each = blocks.select("block", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("_pos", "_word")).select("block", "lang", "_pos", "_word.*")
    vocabulary = each.groupBy("lang", F.col("words").alias("word")).agg(F.sum("counts").alias("f")).where(F.col("f") >= least)
    ranked = positions(shared_table(vocabulary.withColumn("_down", -F.col("f"))), "lang", "_down", "word")
    ranked = shared_table(ranked.select("lang", "word", "f", (F.col("_at") + 1).alias("rank")))

    spread = F.ceil(F.col("f") / bucket_words).alias("spread")
    own = each.join(ranked.withColumnRenamed("word", "words"), ["lang", "words"]).select(F.col("block").alias("_block"), "_pos", "rank", spread)
    sizes = totals.select("lang", F.ceil(F.col("n") / bucket_words).alias("buckets"))
    texts = blocks.select("block", "lang", "codes", F.size("words").alias("n_words")).join(sizes, "lang")
    side = max(1, round(blocks.count() ** 0.5))

    def sent(texts: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in texts.itertuples():
            rank, spread = np.zeros(row.n_words + 1, np.uint32), np.ones(row.n_words + 1, np.uint32)
            place = words["_pos"].to_numpy(np.int64) + 1
            rank[place], spread[place] = words["rank"].to_numpy(np.uint32), words["spread"].to_numpy(np.uint32)
            codes = _numbers(row.codes)
            at = int(mixed(np.array([row.block], np.uint64), 41)[0] % np.uint64(side))
            for coarse, found in _dealt(fragments(rank[codes], spread[codes]), row.buckets, side):
                out.append((row.lang, row.buckets, at, coarse, _message(found)))
        return pd.DataFrame(out, columns=["lang", "buckets", "at", "coarse", "message"])

    def met(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = [(key[0], fine, _message(found)) for fine, found in _dealt(_read(pdf["message"].tolist()), int(key[1]))]
        return pd.DataFrame(out, columns=["lang", "bucket", "message"])

    names = [f"w{i}" for i in range(LONGEST)]

    def counted(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for rows, times, shared in mined(_read(pdf["message"].tolist())):
            keep = slice(None) if shared else times >= least
            parts.append(pd.DataFrame(rows[keep], columns=names).assign(f=times[keep], shared=shared))
        out = pd.concat(parts) if parts else pd.DataFrame(columns=[*names, "f", "shared"])
        return out.assign(lang=key[0])[["lang", *names, "f", "shared"]]

    messages = texts.groupBy("block").cogroup(own.groupBy("_block")).applyInPandas(sent, "lang string, buckets long, at long, coarse long, message binary")
    messages = messages.groupBy("lang", "buckets", "at", "coarse").applyInPandas(met, "lang string, bucket long, message binary")
    found = shared_table(messages.groupBy("lang", "bucket").applyInPandas(counted, f"lang string, {', '.join(f'{w} long' for w in names)}, f long, shared boolean"))
    parts = found.where("shared").groupBy("lang", *names).agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    grams = found.where("NOT shared").select("lang", *names, "f").unionByName(parts)
    return totals, ranked, shared_table(grams.select("lang", F.array_remove(F.array(*names), 0).alias("gram"), "f"))


def collocations(
    df: DataFrame, text: str = "text", group: str = "lang", least: int = LEAST, top: int = TOP, hides: int = HIDES, block_bytes: int = BLOCK_BYTES, bucket_words: int = BUCKET_WORDS
) -> DataFrame:
    """Each language's first ``top`` phrases: (lang, rank, phrase, a, l, r, n, score).

    Texts are lower-cased (A to Z), cut at . , ; : ! ? and line ends, and their
    words are what blanks and tabs leave.  A phrase of 2 to LONGEST words with
    at least ``least`` occurrences, ``a``, scores SCALE * a / (l + r), rounded
    down, at the cut into two parts of ``l`` and ``r`` occurrences where that is
    least; of equal cuts the first.  One whose words stand within a longer such
    phrase that has ``hides`` percent of its occurrences is dropped.  Order:
    score, then a, both falling, then the phrase.  ``n`` is the number of words
    of the language.  NULL language: ``und``; NULL or empty texts have no words;
    repeated rows count each; an empty table gives no rows; other columns are
    not read.
    """
    totals, ranked, grams = frequent(df, text, group, least, block_bytes, bucket_words)
    exact = "decimal(38,0)"
    longer = grams.where(F.size("gram") > 2)
    inside = F.expr("flatten(transform(sequence(2, size(gram) - 1), m -> transform(sequence(1, size(gram) - m + 1), i -> slice(gram, i, m))))")
    over = longer.select("lang", "f", F.explode(inside).alias("gram")).groupBy("lang", "gram").agg(F.max("f").alias("most"))
    kept = grams.join(over, ["lang", "gram"], "left").where(F.col("most").isNull() | (F.lit(100).cast(exact) * F.col("most") < F.lit(hides).cast(exact) * F.col("f")))
    parts = grams.unionByName(ranked.select("lang", F.array("rank").alias("gram"), "f"))

    cuts = kept.select("lang", "gram", F.col("f").alias("a"), F.explode(F.expr("sequence(1, size(gram) - 1)")).alias("k"))
    cuts = cuts.withColumn("first", F.expr("slice(gram, 1, k)")).withColumn("rest", F.expr("slice(gram, k + 1, size(gram) - k)"))
    cuts = cuts.join(parts.select("lang", F.col("gram").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(parts.select("lang", F.col("gram").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    score = F.expr(f"CAST({SCALE} AS {exact}) * a div (CAST(l AS {exact}) + r)")
    best = cuts.groupBy("lang", "gram", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("_best")).select("lang", "gram", "a", "_best.*")

    by_lang = Window.partitionBy("lang")
    near = best.withColumn("_rank", F.rank().over(by_lang.orderBy(F.desc("score"), F.desc("a")))).where(F.col("_rank") <= top)  # ties at the end stay
    spelled = near.select("lang", "gram", F.posexplode("gram").alias("_i", "rank")).join(ranked.select("lang", "rank", "word"), ["lang", "rank"])
    spelled = spelled.groupBy("lang", "gram").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    placed = near.join(spelled, ["lang", "gram"]).withColumn("rank", F.row_number().over(by_lang.orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long"))
    return placed.where(F.col("rank") <= top).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = f"""
WITH piece AS (
  SELECT lang, row_number() OVER () AS pid, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS ws
  FROM (SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents)),
total AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM piece GROUP BY lang),
f AS (SELECT lang, g, count(*) AS f FROM (
    SELECT lang, array_to_string(ws[i : i + m - 1], ' ') AS g FROM (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM piece, unnest(range(1, {LONGEST + 1})) AS t(m)))
  GROUP BY lang, g HAVING count(*) >= {LEAST}),
candidate AS (SELECT lang, g, f, string_split(g, ' ') AS ws, len(string_split(g, ' ')) AS m FROM f WHERE contains(g, ' ')),
inner_phrase AS (SELECT lang, array_to_string(ws[i : i + k - 1], ' ') AS g, max(f) AS most FROM (
    SELECT lang, ws, f, k, unnest(range(1, m - k + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS k FROM candidate WHERE m > 2)) GROUP BY ALL),
kept AS (SELECT c.* FROM candidate c LEFT JOIN inner_phrase o USING (lang, g) WHERE o.most IS NULL OR 100::HUGEINT * o.most < {HIDES}::HUGEINT * c.f),
cut AS (SELECT c.lang, c.g, c.f AS a, c.k, x.f AS l, y.f AS r, ({SCALE}::HUGEINT * c.f // (x.f + y.f)::HUGEINT)::BIGINT AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM kept) c
  JOIN f x ON x.lang = c.lang AND x.g = array_to_string(c.ws[1 : c.k], ' ') JOIN f y ON y.lang = c.lang AND y.g = array_to_string(c.ws[c.k + 1 :], ' ')),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank FROM best)
SELECT lang, rank, g AS phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= {TOP}
"""
