"""Leaderboards: models in rows, document types and languages in columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GROUPS = {"printed": "print", "handwritten": "handwriting"}


def languages_by_type(scores: DataFrame) -> DataFrame:
    """group, languages: the languages that any model has a score for, in order."""
    name = F.when(F.col("document_type") == "print", "printed").when(F.col("document_type") == "handwriting", "handwritten")
    return scores.where(name.isNotNull() & F.col("main_language").isNotNull()).groupBy(name.alias("group")).agg(F.sort_array(F.collect_set("main_language")).alias("languages"))


def pivot(scores: DataFrame, languages: list[str] | None = None, digits: int | None = None) -> DataFrame:
    """model, printed, printed:<language>, ..., handwritten, ..., total: means of ``score`` in per cent; null where there is none.

    scores: model, document_type, main_language, score.  With the languages
    given, all means come from one aggregation; else they are looked up first.
    """
    if languages is None:
        languages = sorted(r[0] for r in scores.where("main_language is not null").select("main_language").distinct().collect())
    score = F.col("score").cast("double") * 100
    columns = []
    for name, kind in GROUPS.items():
        here = F.col("document_type") == kind
        columns.append(F.avg(F.when(here, score)).alias(name))
        columns += [F.avg(F.when(here & (F.col("main_language") == lang), score)).alias(f"{name}:{lang}") for lang in languages]
    columns.append(F.avg(score).alias("total"))
    made = scores.groupBy("model").agg(*columns)
    return made if digits is None else made.select("model", *[F.round(f"`{c}`", digits).alias(c) for c in made.columns if c != "model"])


def rank(board: DataFrame, by: str = "total", descending: bool = True, name: str = "model") -> DataFrame:
    """board with ``rank`` from 1: missing scores last in either direction, ties by name.  The board has a row a model, so one task orders it."""
    column = F.col(f"`{by}`")
    if by == name:
        order = [column.desc() if descending else column.asc()]
    else:
        number = F.when(F.isnan(column.cast("double")), None).otherwise(column.cast("double"))
        order = [number.desc_nulls_last() if descending else number.asc_nulls_last(), F.col(name).asc()]
    return board.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def display(board: DataFrame, name: str = "model") -> DataFrame:
    """Scores as texts with one decimal place; a dash where there is none."""
    kept = (name, "rank")
    return board.select(*[F.col(f"`{c}`") if c in kept else F.coalesce(F.format_number(f"`{c}`", 1), F.lit("—")).alias(c) for c in board.columns])
