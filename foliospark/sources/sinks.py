"""Results as files: rows and reports in JSON, texts, page images."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that write_outputs() puts into one JSON array on the driver; larger results are JSON lines in part files.
ARRAY_ROWS = 10_000


def write_file(spark: SparkSession, file: str, text: str) -> None:
    """text as one file, on whatever file system its name says."""
    path = spark._jvm.org.apache.hadoop.fs.Path(file)
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
    try:
        out.write(text.encode())
    finally:
        out.close()


def output_rows(scores: DataFrame, metadata: str = "metadata") -> DataFrame:
    """example_id and metadata first, then the other columns."""
    rest = [c for c in scores.columns if c not in ("example_id", metadata)]
    return scores.select(F.col("example_id").cast("string"), F.col(metadata).alias("metadata"), *[f"`{c}`" for c in rest])


def write_outputs(scores: DataFrame, folder: str, metadata: str = "metadata") -> None:
    """outputs.json: JSON lines, written by all tasks in parallel."""
    output_rows(scores, metadata).write.mode("overwrite").option("ignoreNullFields", "false").json(f"{folder}/outputs.json")


def write_outputs_array(scores: DataFrame, file: str, metadata: str = "metadata", most: int = ARRAY_ROWS) -> None:
    """One indented JSON array on the driver, for results of at most ``most`` rows; more are an error."""
    rows = output_rows(scores, metadata).limit(most + 1).toJSON().collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: use write_outputs()")
    write_file(scores.sparkSession, file, json.dumps([json.loads(r) for r in rows], indent=2, ensure_ascii=False))


def write_metrics(maps: DataFrame, file: str) -> dict:
    """all_metrics.json of metric_maps(), one row."""
    found = maps.first()
    report = {} if found is None else {name: dict(found[name] or {}) for name in maps.columns}
    write_file(maps.sparkSession, file, json.dumps(report, indent=2))
    return report


def write_texts(pages: DataFrame, path: str, text: str = "text") -> None:
    pages.select(F.coalesce(F.col(text), F.lit(""))).write.mode("overwrite").text(path)


def write_page_images(pages: DataFrame, folder: str, image: str = "image", index: str = "page_index", document: str | None = None) -> int:
    """One file page_0000.png a row in a folder that all executors share; the number of files.

    With several documents, the column ``document`` comes before the page in the
    name.  Two pages of one name are an error.  A file is written beside its
    place and renamed, so a task that runs twice leaves whole files.
    """
    key = F.lit("") if document is None else F.concat(F.regexp_replace(F.col(document).cast("string"), r"[^A-Za-z0-9.-]", "_"), F.lit("_"))
    named = pages.where(F.col(image).isNotNull()).select(F.concat(key, F.format_string("page_%04d.png", F.col(index).cast("int"))).alias("name"), F.col(image).alias("d"))
    if twice := named.groupBy("name").count().where("count > 1").first():
        raise ValueError(f"{twice['count']} pages would be {twice['name']}: name the column of the document")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in zip(batch["name"], batch["d"], strict=True):
                part = os.path.join(folder, f".{name}.{os.getpid()}")
                with open(part, "wb") as file:
                    file.write(bytes(data))
                os.replace(part, os.path.join(folder, name))
            yield pd.DataFrame({"n": [len(batch)]})

    os.makedirs(folder, exist_ok=True)
    return named.mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
