"""Lineage, naming and schema helpers of this subpackage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ._text import released

#: Ids that repeat are broadcast up to this number of rows (8 bytes each), and joined by a shuffle beyond.
BROADCAST_ROWS = 100_000

#: Values that HOT rows or more of one in SAMPLE documents have, and HOT_PART of all rows, are salted: a salt for each SALTED rows.
SAMPLE, HOT, HOT_PART, SALTED = 64, 64, 1e-5, 1 << 18


def cut(df: DataFrame) -> DataFrame:
    """df, written to the checkpoint folder that all executors share, without its lineage.

    The folder is spark.checkpoint.dir.  Where that is unset, a local master
    (tests) gets a temporary folder until the process ends; a cluster is an error.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="folio-checkpoint-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> str:
    """A column name as an expression, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def unused(name: str, *frames: DataFrame) -> str:
    """name, longer by underscores until no column of the frames is called so."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id bigint, text string): other columns, whatever they are called, stay out of the way."""
    return docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).cast("string").alias("text"))


def one_row_each(docs: DataFrame) -> DataFrame:
    """docs with one row for each doc_id, of several the one with the least text (of equal texts, the least row as JSON); without null ids.

    Only the ids are exchanged; texts of ids that repeat are too, and only theirs
    as long as the ids that repeat are few enough for a broadcast.
    """
    docs = docs.where("doc_id is not null")
    ids = docs.groupBy("doc_id").count().where("count > 1").select("doc_id")
    n = ids.count()
    if not n:
        return docs
    ids = cut(ids)
    if n <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    row = F.struct(*[F.col(quoted(c)) for c in docs.columns])
    again = docs.join(ids, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(row, F.struct(F.col("text"), F.to_json(row))).alias("row"))
    return docs.join(ids, "doc_id", "left_anti").select(*[quoted(c) for c in docs.columns]).unionByName(again.select(*[F.col("row")[c].alias(c) for c in docs.columns]))


def sample(docs: DataFrame) -> DataFrame:
    """One in SAMPLE documents, by their ids."""
    return docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0)


def salted(rows: DataFrame, sampled: DataFrame, key: str) -> tuple[DataFrame, bool]:
    """rows with ``salts`` and ``salt`` by doc_id, where rows of sampled documents show that some values of key are very frequent; else rows as they are.

    At most 1 / HOT_PART values are salted, so the broadcast has a bound.  What
    is computed from the rows must not depend on the salts.
    """
    counts = sampled.groupBy(key).count()
    # one pass: the frequent values, and all others as one row
    counts = cut(counts.select(F.when(F.col("count") >= HOT, F.col(key)).alias(key), "count").groupBy(key).agg(F.sum("count").alias("n")))
    least = (counts.agg(F.sum("n")).first()[0] or 0) * HOT_PART
    salts = counts.where(F.col(key).isNotNull() & (F.col("n") >= least)).select(key, F.expr(f"cast(n * {SAMPLE} div {SALTED} + 1 as int)").alias("salts")).where("salts > 1")
    if salts.isEmpty():
        return rows, False
    rows = rows.join(F.broadcast(salts), key, "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    return rows.withColumn("salt", F.expr("cast(pmod(xxhash64(doc_id), salts) as int)")), True


def map_rows(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType) -> DataFrame:
    """df.mapInArrow(run, schema), for column names of any characters."""
    names = df.columns

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(pa.RecordBatch.from_arrays(batch.columns, names) for batch in batches)

    return df.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(released(renamed), schema)
