"""The queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, mixture, ngram_join, passages, repetition, sharding, suffix_dedup, topk, warc
from ._spark import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(chat.with_parts(table(spark, sf_dir, "conversations")))


def op4_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.quality_rules(table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.near_passages(table(spark, sf_dir, "documents"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_classes(table(spark, sf_dir, "documents"))


#: Sources by domain, and integer weights of nodes of the domain-language-source tree; other nodes have weight 1.
DOMAINS = {"reference": ("src5", "src6", "src7", "src8", "src9"), "news": ("src10", "src11", "src12", "src13", "src14"), "community": ("src15", "src16", "src17", "src18", "src19")}
WEIGHTS = {("web",): 4, ("reference",): 3, ("news",): 2, ("community",): 1} | {(d, "en"): 5 for d in (*DOMAINS, "web")} | {(d, "de"): 2 for d in (*DOMAINS, "web")}


def domain() -> F.Column:
    column = F.lit("web")
    for name, sources in DOMAINS.items():
        column = F.when(F.col("source").isin(*sources), name).otherwise(column)
    return column


MIXTURE = {"numerator": 7, "denominator": 10, "max_epochs": 2, "seed": 8}


def op8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix(table(spark, sf_dir, "documents"), domain(), WEIGHTS, **MIXTURE).select("doc_id", "lang", "source", "epoch")


def domain_sql() -> str:
    return "CASE " + " ".join(f"WHEN source IN {sources} THEN '{name}'" for name, sources in DOMAINS.items()) + " ELSE 'web' END"


def op9_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derive(warc.responses(table(spark, sf_dir, "pages")))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), shards=64, seed=10)


OPERATORS = (
    op1_bpe, op2_suffix_dedup, op3_chat_format, op4_topk_search, op5_quality_rules,
    op6_substring_dedup, op7_ngram_join, op8_mixture, op9_warc_derivatives, op10_sharding,
)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    return {"op2_suffix_dedup": suffix_dedup.SQL, "op3_chat_format": chat.SQL, "op4_topk_search": topk.SQL, "op8_mixture": mixture.sql(domain_sql(), WEIGHTS, **MIXTURE), "op9_warc_derivatives": warc.SQL}
