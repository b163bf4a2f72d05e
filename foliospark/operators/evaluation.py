"""Scores of predicted transcriptions, and their averages by groups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import percentage, round_metric, similarity, text_scores
from ..functions.text import comparable_text

METRICS = ("normalized_levenshtein_similarity", "repetition", "is_empty", "bleu")
MAIN = METRICS[0]
ARABIC = ("Arabic", "Persian")
TYPES = ("print", "handwriting")


def normalized(text: Column, language: Column | None = None) -> Column:
    """A transcription as it is compared: without output tags, flattened if it is XML, in normal form."""
    return comparable_text(text, _folds(language))


def _folds(language: Column | None) -> Column:
    return F.lit(False) if language is None else F.coalesce(language.isin(*ARABIC), F.lit(False))


def page_scores(pairs: DataFrame, predicted: str = "predicted_text", gold: str = "gold_text", language: str | None = "main_language", partitions: int | None = None, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """pairs with both normal forms and the metrics, all four or those that are asked for; a null text is an empty one.

    Columns that the metrics are called like are replaced.  partitions: rows are
    first spread evenly, for a table in few large files, as texts differ in
    length a lot and long ones cost most.
    """
    pairs = pairs if partitions is None else pairs.repartition(partitions)
    mine, theirs = F.col("normalized_predicted_text"), F.col("normalized_gold_text")
    parts = {MAIN: "distance", "repetition": "repetition", "bleu": "bleu"}
    wanted = tuple(parts[m] for m in metrics if m in parts)
    rows = pairs.withColumn("__scores", text_scores(F.col(predicted), F.col(gold), _folds(F.col(language) if language else None), wanted))
    rows = rows.withColumns({"normalized_predicted_text": F.col("__scores.mine"), "normalized_gold_text": F.col("__scores.theirs")})
    made = {
        MAIN: lambda: similarity(F.col("__scores.distance"), mine, theirs),
        "repetition": lambda: F.col("__scores.repetition").cast("double"),
        "is_empty": lambda: (F.length(mine) == 0).cast("double"),
        "bleu": lambda: F.col("__scores.bleu"),
    }
    return rows.withColumns({m: made[m]() for m in metrics}).drop("__scores")


def failed_scores(pairs: DataFrame, predicted: str = "predicted_text", gold: str = "gold_text") -> DataFrame:
    """The rows of evaluations that broke off: all metrics 0, but is_empty 1."""
    values = dict.fromkeys(METRICS, F.lit(0.0)) | {"is_empty": F.lit(1.0)}
    return pairs.withColumns(values | {"normalized_predicted_text": F.col(predicted), "normalized_gold_text": F.col(gold)})


def join_predictions(examples: DataFrame, predictions: DataFrame, key: str = "example_id") -> DataFrame:
    """Examples with their predictions; both sides are partitioned by key once, for all that follows."""
    return examples.join(predictions, key)


def check_counts(examples: DataFrame, predictions: DataFrame, key: str = "example_id") -> None:
    """An error unless each example has one prediction: one pass over both."""
    sides = examples.select(key, F.lit(1).alias("side")).unionByName(predictions.select(key, F.lit(-1).alias("side")))
    off = sides.groupBy(key).agg(F.sum("side").alias("n"), F.count("*").alias("rows")).where("n != 0 or rows != 2").count()
    if off:
        raise ValueError(f"{off} examples don't have exactly one prediction")


def mean(column: str) -> Column:
    """Average over all rows; what isn't there counts as 0."""
    return F.sum(F.coalesce(F.col(column).cast("double"), F.lit(0.0))) / F.count("*")


def aggregate_scores(scores: DataFrame, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """One row of averages; no row for an empty table."""
    return scores.agg(*[mean(m).alias(m) for m in metrics], F.count("*").alias("n_pages")).where("n_pages > 0")


def grouped_scores(scores: DataFrame, metric: str = MAIN, language: str = "main_language", kind: str = "document_type") -> DataFrame:
    """level (all, language, type, language_type), both keys, mean and number of pages: one pass, one shuffle."""
    lang, kind_ = F.col(language).cast("string"), F.col(kind).cast("string")
    rows = scores.select(lang.alias("main_language"), kind_.alias("document_type"), F.col(metric).cast("double").alias("metric"))
    rows = rows.fillna("None", ["main_language", "document_type"])
    sets = rows.groupingSets([[], ["main_language"], ["document_type"], ["main_language", "document_type"]], "main_language", "document_type")
    level = F.element_at(F.array(*map(F.lit, ("language_type", "language", "type", "all"))), (F.grouping_id() + 1).cast("int"))
    return sets.agg(level.alias("level"), mean("metric").alias("mean"), F.count("metric").alias("n_pages")).select("level", "main_language", "document_type", "mean", "n_pages").where("n_pages > 0")


def seeded_types(groups: DataFrame) -> DataFrame:
    """document_type and mean of grouped_scores(); print and handwriting are there even if they have no page."""
    spark = groups.sparkSession
    seeds = reduce(DataFrame.unionAll, [spark.range(1).select(F.lit(t).alias("document_type"), F.lit(0.0).alias("mean"), F.lit(True).alias("seed")) for t in TYPES])
    found = groups.where("level = 'type'").select("document_type", "mean", F.lit(False).alias("seed"))
    # the groups are named once: a plan that joined them with themselves would work out all scores again
    return found.unionByName(seeds).groupBy("document_type").agg(F.min_by("mean", "seed").alias("mean"))


def metric_maps(scores: DataFrame, elapsed_s: float = 0.0, metric: str = MAIN) -> DataFrame:
    """One row of the four maps of the report, in per cent with one decimal place."""
    groups = grouped_scores(scores, metric)
    as_map = lambda rows, key: rows.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(key.alias("key"), percentage(F.col("mean")).alias("value"))))).alias("m"))
    language = as_map(groups.where("level = 'language'"), F.col("main_language")).withColumnRenamed("m", "main_language_metrics")
    kind = as_map(seeded_types(groups), F.col("document_type")).withColumnRenamed("m", "type_metrics")
    both = as_map(groups.where("level = 'language_type'"), F.concat_ws("_", "main_language", "document_type")).withColumnRenamed("m", "main_language_and_type_metrics")
    total = aggregate_scores(scores)
    costs = {"llm_cost ($)": F.lit(0.0), "azure_cost ($)": F.lit(0.0), "elapsed_time (s)": round_metric(F.lit(float(elapsed_s)))}
    entries = [*((F.lit(m), percentage(F.col(m))) for m in METRICS), *((F.lit(k), v) for k, v in costs.items())]
    total = total.select(F.create_map(*[x for e in entries for x in e]).alias("aggregate_metrics"))
    # four tables of one row (the first has none for an empty input)
    return language.crossJoin(kind).crossJoin(both).join(total, F.lit(True), "left").select("main_language_metrics", "type_metrics", F.coalesce("aggregate_metrics", F.create_map(*[x for k, v in costs.items() for x in (F.lit(k), v)])).alias("aggregate_metrics"), "main_language_and_type_metrics")


def call_counters(calls: DataFrame, *by: str, cost: str = "cost", order: str = "call_id") -> DataFrame:
    """requests, untracked requests (no cost known), total cost and the last known cost of a log of calls."""
    last = F.max(F.when(F.col(cost).isNotNull(), F.struct(order, cost)))[cost]
    return calls.groupBy(*by).agg(
        F.count("*").alias("request_count"), F.count_if(F.col(cost).isNull()).alias("untracked_request_count"), F.coalesce(F.sum(cost), F.lit(0.0)).alias("total_cost"), last.alias("last_cost")
    )
