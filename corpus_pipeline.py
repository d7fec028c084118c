"""From raw documents to packed training sequences.

Quality rules, one of each group of near duplicates, personal data masked,
sources mixed to their weights, token sequences packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm import mixing, ngram_join, packing, pii, quality_rules
from shelfwise.llm.common import forget, passing_tables, shared_table


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and whose host does; NULL and empty texts go."""
    return quality_rules.keep_good(docs)


def ngram_jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, row by row; rows without words stay."""
    return ngram_join.keep_one_of_each(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, personal data in their texts masked and n_chars that of the new text; NULL texts stay NULL."""
    return pii.mask(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it; a NULL source is one of its own."""
    return mixing.take(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows, one sequence each or several to one; a NULL or empty text is its end token."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules_stage),
    ("ngram_jaccard_join", ngram_jaccard_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Hash-based near-duplicate classes, a trained tagger and a tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; a stage's table goes once the next one is written. An empty table gives no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        with passing_tables(spark):
            made = shared_table(stage(spark, docs, sf_dir), keep=True)
        forget(docs)
        docs = made
    packed = STAGES[-1][1](spark, docs, sf_dir)  # its pieces are written
    forget(docs)
    return packed
