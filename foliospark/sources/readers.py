"""Tables of a benchmark, images and PDFs."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BENCHMARK_COLUMNS = tuple("cleaned_transcription dataset_id document_type example_id image main_language main_script".split())


def read_split(spark: SparkSession, path: str, split: str | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """The Parquet files of a split (``split-*.parquet`` beneath path, or a folder of its name); only the named columns are read.

    Where no file has the split in its name, all of path is read.
    """
    reader, where = spark.read, path
    if split is not None:
        to_path, conf = spark._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
        files = to_path(path).getFileSystem(conf)
        there = lambda p: bool(files.globStatus(to_path(p)))
        if there(f"{path}/{split}"):
            where = f"{path}/{split}"
        elif there(f"{path}/{split}*.parquet") or there(f"{path}/*/{split}*.parquet"):
            reader = reader.option("recursiveFileLookup", "true").option("pathGlobFilter", f"{split}*.parquet")
    found = reader.parquet(where)
    return found if columns is None else found.select(*columns)


def read_images(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, image (bytes), width, height, source_index 0: sizes of PNG, JPEG and GIF are read from their headers."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("content").alias("image"), _header("content").alias("size"), F.lit(0).alias("source_index")).select("path", "image", "size.*", "source_index")


def image_size(data: bytes | None) -> tuple[int, int] | None:
    """(width, height) by the header, as stored (for JPEG, turned if its orientation says so is left to the decoder)."""
    if not data:
        return None
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return int.from_bytes(data[16:20], "big"), int.from_bytes(data[20:24], "big")
    if data[:4] == b"GIF8" and len(data) >= 10:
        return int.from_bytes(data[6:8], "little"), int.from_bytes(data[8:10], "little")
    at = 2
    while data[:2] == b"\xff\xd8" and at + 9 <= len(data) and data[at] == 0xFF:
        kind = data[at + 1]
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            return int.from_bytes(data[at + 7 : at + 9], "big"), int.from_bytes(data[at + 5 : at + 7], "big")
        at += 2 + int.from_bytes(data[at + 2 : at + 4], "big")
    return None


def _header(column: str) -> F.Column:
    @F.pandas_udf("width int, height int")
    def sizes(content: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([image_size(None if c is None else bytes(c)) or (None, None) for c in content], columns=["width", "height"], dtype="Int32")

    return sizes(column)


Renderer = Callable[[bytes, float], Sequence[tuple[bytes, int, int]]]


def read_pdfs(spark: SparkSession, path: str, render: Renderer, dpi: int = 300) -> DataFrame:
    """path, source_index (page of the PDF), image, width, height: one row a page, from a renderer (bytes, scale) -> images.

    The scale is dpi / 72; no renderer comes with the package.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(path).select("path", "content")
    scale = max(dpi, 1) / 72

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                pages = list(render(bytes(content), scale))
                yield pd.DataFrame({"path": name, "source_index": range(len(pages)), "image": [p[0] for p in pages], "width": [p[1] for p in pages], "height": [p[2] for p in pages]})

    return files.mapInPandas(run, "path string, source_index int, image binary, width int, height int")
