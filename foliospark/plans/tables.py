"""Input tables of the queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A prediction: confusions of letters that readers make, in the output tag.
PREDICTED = "'<output>' || replace(replace(replace(text, 'rn', 'm'), 'cl', 'd'), 'h', 'b') || '</output>'"
KIND = "CASE quality WHEN 1 THEN 'print' WHEN 0 THEN 'handwriting' ELSE 'unlabelled' END"
EXAMPLES_SQL = f"ex AS (SELECT documents.doc_id AS example_id, text AS gold_text, lang AS main_language, source AS dataset_id, {KIND} AS document_type, {PREDICTED} AS predicted_text FROM documents LEFT JOIN labels ON documents.doc_id = labels.doc_id)"


def expression(text: str) -> Column:
    return F.expr(text.replace("\\", "\\\\"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of texts, whose work is in the expressions: over all cores, where its files make fewer tasks than there are."""
    rows, cores = table(spark, sf_dir, name), spark.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as gold texts, their degraded forms as predictions, label quality as document type."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("example_id"), F.col("text").alias("gold_text"), F.col("lang").alias("main_language"), F.col("source").alias("dataset_id"),
        expression(KIND).alias("document_type"), expression(PREDICTED).alias("predicted_text"),
    )
