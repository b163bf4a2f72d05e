"""Responses as a stream: beyond the batch operators, the same column functions on Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.profiles import postprocess_by

RESPONSE = "example_id string, profile string, response string, received timestamp"


def read_responses(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """JSON lines of RESPONSE as they arrive in a folder."""
    return spark.readStream.schema(RESPONSE).option("maxFilesPerTrigger", files_per_trigger).json(path)


def texts(responses: DataFrame) -> DataFrame:
    """responses with text and metadata."""
    done = postprocess_by(F.col("response"), F.coalesce("profile", F.lit("default")))
    return responses.withColumn("__p", done).select("example_id", "profile", "received", "__p.text", "__p.metadata")


def counts(responses: DataFrame, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Responses and empty texts by profile and window of time; what is later than ``late`` is left out."""
    done = texts(responses).withWatermark("received", late)
    return done.groupBy(F.window("received", window).alias("window"), "profile").agg(F.count("*").alias("responses"), F.count_if(F.coalesce(F.length("text"), F.lit(0)) == 0).alias("empty"))


def write(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Parquet of all that is there now; run again, it goes on where it stopped."""
    return stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
