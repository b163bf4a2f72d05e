"""Subsets of a benchmark table: filter, then offset, then limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import filter_value

EXAMPLE = ("example_id", "cleaned_transcription", "main_language", "main_script", "document_type", "dataset_id")


def to_evaluation_examples(dataset: DataFrame) -> DataFrame:
    """The columns that evaluation needs; the image is never read."""
    return dataset.select(*EXAMPLE)


def _value(value: str | None) -> str | None:
    value = (value or "").strip()
    return value.casefold() or None


def matches(language: str | None, document_type: str | None, language_col: str = "main_language", type_col: str = "document_type") -> Column:
    """Caseless equality with the filters that are active (not blank); a null matches none."""
    good = F.lit(True)
    for value, column in ((_value(language), language_col), (_value(document_type), type_col)):
        if value is not None:
            good = good & F.coalesce(filter_value(F.col(column)) == value, F.lit(False))
    return good


def select_subset(dataset: DataFrame, order_by: str, language: str | None = None, document_type: str | None = None, offset: int = 0, limit: int = 0, **columns: str) -> DataFrame:
    """The rows that match, without the first ``offset`` of them by ``order_by``, at most ``limit`` (0: all).

    Scans have no order, so the rows are ordered by a unique key.
    """
    chosen = dataset.where(matches(language, document_type, **columns))
    if offset <= 0 and limit <= 0:
        return chosen
    chosen = chosen.orderBy(order_by)
    chosen = chosen.offset(offset) if offset > 0 else chosen
    return chosen.limit(limit) if limit > 0 else chosen


def output_suffixes(language: str | None, document_type: str | None) -> list[str]:
    named = (("language", _value(language)), ("document_type", _value(document_type)))
    return [f"{name}_{value.replace(' ', '_')}" for name, value in named if value]


def output_directory(backend: str, model: str | None, language: str | None = None, document_type: str | None = None) -> str:
    """backend_model[_language_x][_document_type_y], with slashes as underscores."""
    return "_".join([*(p for p in (backend, (model or "").replace("/", "_")) if p), *output_suffixes(language, document_type)])
