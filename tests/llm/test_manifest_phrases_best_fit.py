"""Manifest, phrases and best-fit packing against plain Python and SQL, on the small table and on edge cases."""

from __future__ import annotations

import hashlib
import re
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute
import oracle

from shelfwise.llm import best_fit, manifest, packing, phrases
from shelfwise.llm.queries import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 977}" for i in range(30_000))
#: NULLs in every column, empty and very long texts, ties, repeated rows; the other columns bear names that the operators use themselves.
ROWS = [
    (1, "one two, one two, one two. ONE two\tthree", "s", "en", 5), (1, "one two, one two, one two. ONE two\tthree", "s", "en", 5), (1, "another text with that id", "s", "en", None),
    (None, None, None, None, None), (None, None, None, None, None), (None, "a null id", "t", "de", 9), (2, None, "s", "de", 0), (3, "", "t", None, 0), (4, " \n\t ", None, "de", 3), (5, LONG, "t", "en", len(LONG)),
    (6, LONG + " end", "t", "en", 7), (7, "é ü 漢字 \U0001f600 <|endoftext|> don't I'LL 3²½", "ü", "ü", 4), (8, "x " * 5000, "v", "und", 1), (9, "a;b;a;b a b\x0ba b\x1cc", "v", None, 1),
]


@pytest.fixture(scope="module")
def edges(spark):
    rows = [(*r, 1, 2, "x", "y", "z", 3, 4) for r in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long, _id int, _row int, _key string, _text string, own string, _at int, piece int")


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op12_phrase_collocations"])
def test_query_equals_its_sql(spark, name):
    assert not oracle.difference(QUERIES[name](spark, FOLDER).toPandas(), oracle.connect(FOLDER).execute(ORACLE_SQL[name]).df())


# manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def a_leaf(row):
    return sha(*["-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in manifest.FIELDS])


def climb(nodes):
    """Levels of a hash tree over ``nodes``."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([sha(*below[i : i + 2]) for i in range(0, len(below), 2)])
    return levels


def siblings(levels, at):
    out = []
    for level in levels[:-1]:
        if at ^ 1 < len(level):
            out.append(level[at ^ 1])
        at //= 2
    return out


def expected_manifest(rows):
    """Sorted (doc_id, leaf, subroot, root, proof) of rows as dicts."""
    groups = defaultdict(list)
    for r in rows:
        groups[r["lang"]].append((r["doc_id"] is not None, r["doc_id"] or 0, a_leaf(r)))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: climb([x for _, _, x in sorted(groups[g])]) for g in order}
    top = climb([trees[g][-1][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for at, (known, i, x) in enumerate(sorted(groups[g])):
            out.append((i if known else None, x, trees[g][-1][0], top[-1][0], sha(*siblings(trees[g], at), *siblings(top, k))))
    return sorted(out, key=repr)


def got_manifest(df):
    rows = manifest.manifest(df, manifest.leaf(*[F.col(c) for c in manifest.FIELDS]), carry=(F.col("doc_id"),))
    rows = rows.withColumn("folded", manifest.folded(F.col("leaf"), F.col("path"))).withColumn("proof", F.sha2(manifest.proof(F.col("path")), 256)).collect()
    assert all(r.folded == r.root for r in rows)
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof) for r in rows), key=repr)


def test_manifest_of_edge_rows_and_of_nothing(edges):
    assert got_manifest(edges) == expected_manifest([r.asDict() for r in edges.collect()])
    assert got_manifest(edges.limit(0)) == []


@pytest.mark.parametrize("sizes", [(1,), (2,), (256,), (257, 1, 2, 3, 255), (70_000, 513)])
def test_manifest_of_blocks_full_and_not(spark, sizes):
    rows = [(i, f"l{g}", None) for g, n in enumerate(sizes) for i in range(n)]
    df = spark.createDataFrame([r for r in reversed(rows)], "doc_id long, lang string, source string").withColumns({"n_chars": F.lit(1), "text": F.col("doc_id").cast("string")})
    want = [{"doc_id": i, "lang": g, "source": None, "n_chars": 1, "text": str(i)} for i, g, _ in rows]
    assert got_manifest(df) == expected_manifest(want)


def test_one_hot_id_spans_several_range_partitions(spark, monkeypatch):
    from shelfwise.llm import common

    monkeypatch.setattr(common, "PART_ROWS", 100)
    seen = []
    write = common.shared_table
    monkeypatch.setattr(common, "shared_table", lambda df, keep=False: seen.append(write(df, keep)) or seen[-1])
    df = spark.range(1000).select(F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id")).alias("doc_id"), F.lit("en").alias("lang"), F.lit(None).cast("string").alias("source"), F.lit(1).alias("n_chars"), F.lit("same").alias("text"))
    assert got_manifest(df) == expected_manifest([r.asDict() for r in df.collect()])
    parts = seen[0].groupBy("_part").count().toPandas()["count"]
    assert len(parts) >= 8 and parts.max() < 300


def test_tampering_is_found(spark):
    rows = QUERIES["op11_merkle_manifest"](spark, FOLDER).collect()
    for r in rows:
        touched = zlib.crc32(str(r.doc_id).encode()) % 7 == 0
        assert r.verified == (not touched) == (r.folded_root == r.root)


# phrases


def found_phrases(rows, least, top=2000, hides=80):
    words, grams = Counter(), defaultdict(Counter)
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", brute.lowered(text)):
            w = re.findall("[^\x20\x09]+", piece)
            words[lang] += len(w)
            for n in range(1, 5):
                grams[lang].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, counts in grams.items():
        f = {g: n for g, n in counts.items() if n >= least}
        hidden = {g[i : i + k] for g, n in f.items() for k in range(2, len(g)) for i in range(len(g) - k + 1) if 100 * n >= hides * f[g[i : i + k]]}
        rated = []
        for g, a in f.items():
            if len(g) > 1 and g not in hidden:
                score, k = min((2_000_000 * a // (f[g[:k]] + f[g[k:]]), k) for k in range(1, len(g)))
                rated.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        out += [(lang, i, p.decode(), -a, x, y, words[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(rated)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("size", [{}, {"block_bytes": 20_000, "bucket_words": 300}, {"block_bytes": 150_000, "bucket_words": 5_000, "top": 20}])
def test_phrases_equal_counting_them_all(small, size):
    """Also with many blocks and with nearly all pivots dealt to several buckets."""
    got = phrases.collocations(small, least=8, **size).collect()
    assert sorted(map(tuple, got)) == found_phrases([(r.text, r.lang) for r in small.collect()], 8, size.get("top", 2000))


def test_phrases_of_edge_rows_and_of_nothing(edges):
    got = phrases.collocations(edges, least=2).collect()
    assert sorted(map(tuple, got)) == found_phrases([(t, g) for _, t, _, g, _ in ROWS], 2)
    assert phrases.collocations(edges.limit(0)).count() == 0
    assert phrases.collocations(edges.where("doc_id IN (2, 3, 4)"), least=1).count() == 0


def test_fragments_hold_each_phrase_once():
    rng = np.random.default_rng(3)
    for _ in range(30):
        ranks = rng.integers(0, 6, rng.integers(1, 400))
        spread = np.where(ranks > 0, 1 + (ranks % 3), 1)
        got = Counter()
        for rows, counts, shared in phrases.mined(phrases._read([phrases._message(phrases.fragments(ranks, spread))] * 2)):
            for r, n in zip(rows.tolist(), counts.tolist(), strict=True):
                r = tuple(x for x in r if x)
                assert shared == (max(r) % 3 > 0)
                got[r] += n
        w = ranks.tolist()
        want = Counter(tuple(w[i : i + n]) for n in (2, 3, 4) for i in range(len(w) - n + 1) if all(w[i : i + n]))
        assert got == {g: 2 * n for g, n in want.items()}


def test_a_hot_pivot_is_dealt_to_several_buckets():
    rows = np.stack([np.full(1000, 40), np.arange(1000), np.full(1000, 99_999)], 1).astype(np.uint32)
    kind = phrases._KINDS.index((1, 0, True))
    at = np.bincount(phrases.bucket_of(rows, kind, 64), minlength=64)
    assert (at > 0).sum() > 20 and at.max() < 120
    assert len(np.unique(phrases.bucket_of(rows[:, 1:], phrases._KINDS.index((1, 0, False)), 64))) == 1


def test_scores_are_exact_beyond_64_bits(spark):
    a, both = 9_000_000_000_000_001, 18_000_000_000_000_003
    expr = f"CAST({phrases.SCALE} AS decimal(38,0)) * a div (CAST(l AS decimal(38,0)) + r)"
    got = spark.createDataFrame([(a, both - a, a)], "a long, l long, r long").select(F.expr(expr).alias("x")).first().x
    assert got == phrases.SCALE * a // both


# best fit


def naive(lengths, window, most):
    """Best fit by looking at every open bin: (bin, offset) of each piece."""
    open_, made, out = {}, 0, []
    order = {}
    for i, n in enumerate(lengths):
        fits = [(free, -order[b], b) for b, free in open_.items() if free >= n]
        if fits:
            b = min(fits)[2]
        else:
            b, made = made, made + 1
            open_[b], order[b] = window, i
            if len(open_) > most:
                closing = min((free, -order[x], x) for x, free in open_.items() if x != b)[2]
                del open_[closing]
        out.append((b, window - open_[b]))
        open_[b] -= n
        order[b] = i
        if not open_[b]:
            del open_[b]
    return out


@pytest.mark.parametrize("most", [1, 3, 50])
def test_bins_equal_a_search_of_all_open_ones(most):
    lengths = np.random.default_rng(5).integers(1, 41, 2000).tolist()
    bins = best_fit.OpenBins(40, most)
    assert [bins.place(n) for n in lengths] == naive(lengths, 40, most)


def checked(df, docs, window):
    """Each id of each row exactly once, in sequences without gaps."""
    encode = best_fit.ChunkEncoder(best_fit.default_path())
    rows = df.collect()
    want = Counter()
    for key, text in docs:
        ids = [*encode.slow.encode(text or "", add_special_tokens=False).ids, 0]
        for piece, a in enumerate(range(0, len(ids), window)):
            part = np.array(ids[a : a + window], "<u4")
            want[key, piece, a, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    places_ = defaultdict(list)
    for r in rows:
        places_[r.sequence_id].append((r.offset, r.length))
    for own in places_.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= window
    return len(places_), sum(r.length for r in rows)


def test_packing_holds_every_id_once_and_is_tight(small, texts=None):
    docs = [(r.doc_id, r.text) for r in small.collect()]
    n, tokens = checked(best_fit.pack(small), docs, best_fit.WINDOW)
    assert n <= 1.02 * tokens / best_fit.WINDOW + 1
    n, tokens = checked(best_fit.pack(small, window=128, open_bins=16, group_rows=500), docs, 128)
    assert n <= 1.1 * tokens / 128 + 10


def test_packing_of_edge_rows_and_of_nothing(edges):
    checked(best_fit.pack(edges), [(i, t) for i, t, *_ in ROWS], best_fit.WINDOW)
    assert best_fit.pack(edges.limit(0)).count() == 0


def test_chunks_are_encoded_as_whole_texts_are():
    encode = best_fit.ChunkEncoder(best_fit.default_path(), remembered=50)
    texts = [t for _, t, *_ in ROWS if t] + ["it's we're ''s 'll'd ÀÉß× ÷ \x01 a\x01b <|x", "İstanbul ΣΑΣ ﬁ Ǆ é a\x1cb \xa0c  d", "<|startoftext|>a<|endoftext|>", "!?.,;: a1b2 € ªºµ"]
    got = list(encode([t.encode() for t in texts]))
    for t, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == encode.slow.encode(t, add_special_tokens=False).ids, t


def test_sequences_can_be_written(small, spark, tmp_path):
    packed = best_fit.pack(small, with_ids=True)
    packing.write_sequences(packed, str(tmp_path / "out"), parts=2)
    written = spark.read.parquet(str(tmp_path / "out"))
    assert written.count() == packed.select("sequence_id").distinct().count()
    assert written.agg(F.sum(F.size("ids"))).first()[0] == packed.agg(F.sum("length")).first()[0]
