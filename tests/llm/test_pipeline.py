"""The pipeline, stage by stage, against plain Python."""

from __future__ import annotations

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
import brute

import corpus_pipeline

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").cache()
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    texts = {r.doc_id: r.text for r in docs.collect()}

    good = stages["quality_rules"](spark, docs, FOLDER).cache()
    assert good.columns == columns
    assert {r.doc_id for r in good.collect()} == {i for i, t in texts.items() if not brute.quality(t)[5]}

    single = stages["ngram_jaccard_join"](spark, good, FOLDER).cache()
    groups = brute.components([(r.doc_id, r.text) for r in good.collect()])
    assert sorted(r.doc_id for r in single.collect()) == sorted({c for _, c in groups.values()})

    clean = stages["pii"](spark, single, FOLDER).cache()
    assert clean.columns == columns
    for r in clean.collect():
        assert r.n_chars == len(r.text) and not brute.personal(r.text)[5]
        if not brute.personal(texts[r.doc_id])[5]:
            assert r.text == texts[r.doc_id]

    mixed = stages["mixing"](spark, clean, FOLDER).cache()
    assert mixed.columns == columns and mixed.count() > 0

    packed = stages["packing"](spark, mixed, FOLDER)
    assert packed.agg({"length": "sum"}).first()[0] > 0
    assert packed.select("doc_id").distinct().count() == mixed.select("doc_id").distinct().count()


def test_stages_on_edge_rows_and_empty_tables(spark):
    """NULLs in every column, repeated rows and ids, and a host that fails as a whole."""
    good = "these are some plain words of a clean document that nobody would want to lose number"
    rows = [(i, f"{good} {i} {' '.join(f'w{i}x{j}' for j in range(20))}", "en", "clean", 5) for i in range(30)]
    rows += [(100 + i, "bad" if i else rows[0][1] + " also here", "en", "junk", None) for i in range(30)]
    rows += [(None, None, None, None, None), (1, "", None, "clean", 0), (1, None, "en", None, 1), rows[3], rows[3]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    left = docs
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, FOLDER).count() > 0, name
        assert stage(spark, docs.limit(0), FOLDER).count() == 0, name
        if name == "quality_rules":
            left = stage(spark, docs, FOLDER)
            assert sorted(r.doc_id for r in left.collect()) == sorted([*range(30), 3, 3])  # the one good page of a bad host goes too
        elif name == "ngram_jaccard_join":
            left = stage(spark, left, FOLDER)
            assert sorted(r.doc_id for r in left.collect()) == list(range(30))
