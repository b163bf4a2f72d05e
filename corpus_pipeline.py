"""A training-corpus pipeline: quality rules, near duplicates, shared passages, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``documents``, whatever else there is beside doc_id,
text, lang and source.

Defined results: a null or empty text has no repeats, duplicates or passages
and goes through to the end, with no tokens; a null doc_id is kept by every
stage; of several rows with one doc_id the second stage keeps the one with the
least text, so that ids are unique after it; of equal texts the lowest doc_id
stays; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliospark.llm import bpe, mixture, ngram_join, passages, repetition
from foliospark.llm._spark import unused
from foliospark.llm.registry import WEIGHTS, domain

#: SQL can't express MinHash candidates, compact windows or BPE; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the repetition rules keep (operator 5)."""
    return repetition.filter_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (operator 7)."""
    return ngram_join.drop_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a document of lower doc_id has (operator 6); n_chars is that of the new text."""
    return passages.drop_passages(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture of 9/10 of the tokens, each document at most once (operator 8)."""
    epoch = unused("epoch", docs)
    return mixture.mix(docs, domain(), WEIGHTS, numerator=9, denominator=10, max_epochs=1, seed=8, epoch_col=epoch).drop(epoch)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source and the BPE tokens of the text (operator 1)."""
    return bpe.encode(docs.select("doc_id", "lang", "source", "text"), keep_text=False)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", substring_dedup),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
