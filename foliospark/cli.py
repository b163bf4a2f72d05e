"""Command line over the DataFrame API: transcribe, extract-pages, benchmark."""

from __future__ import annotations

import argparse
import importlib
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import geometry
from .operators import detection, evaluation, inference, profiles, selection
from .sources import readers, sinks


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="foliospark", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    transcribe = commands.add_parser("transcribe", help="responses or images to texts")
    source = transcribe.add_mutually_exclusive_group(required=True)
    source.add_argument("--responses", help="Parquet with a column text")
    source.add_argument("--images", help="folder of page images; needs --backend")
    transcribe.add_argument("--backend", help="module:function that makes a backend of batches")
    transcribe.add_argument("--profile", help="name of a profile or a model")
    transcribe.add_argument("--output", required=True)
    extract = commands.add_parser("extract-pages", help="boxes of the pages in images")
    extract.add_argument("--images", required=True)
    extract.add_argument("--detector", help="module:function that makes a detector of batches; without it a page is a whole image")
    extract.add_argument("--trim-margin", type=int, default=30)
    extract.add_argument("--output", required=True)
    benchmark = commands.add_parser("benchmark", help="scores of predictions")
    benchmark.add_argument("--gold", required=True, help="Parquet of examples")
    benchmark.add_argument("--split")
    benchmark.add_argument("--predictions", required=True, help="Parquet of example_id, text and perhaps metadata")
    benchmark.add_argument("--output", required=True)
    for name, kind, default in (("--language", str, None), ("--document-type", str, None), ("--offset", int, 0), ("--limit", int, 0)):
        benchmark.add_argument(name, type=kind, default=default)
    return parser


def _named(path: str):
    module, _, name = path.partition(":")
    return getattr(importlib.import_module(module), name)


def _transcribe(spark: SparkSession, args: argparse.Namespace) -> None:
    if args.responses:
        pages = spark.read.parquet(args.responses)
    elif args.backend:
        pages = inference.transcribe(readers.read_images(spark, args.images), _named(args.backend))
    else:
        raise SystemExit("--images needs --backend")
    profile = profiles.resolve(args.profile)
    sinks.write_texts(pages.select(profiles.postprocess(F.col("text"), profile)["text"].alias("text")), args.output)


def _extract(spark: SparkSession, args: argparse.Namespace) -> None:
    images = readers.read_images(spark, args.images)
    found = inference.detect(images, _named(args.detector)) if args.detector else images.withColumn("candidates", F.lit(None).cast("array<struct<left:double,top:double,right:double,bottom:double>>"))
    boxes = detection.candidates_or_full_image(F.col("candidates"), F.col("width"), F.col("height"))
    pages = found.select("path", "source_index", "width", "height", F.posexplode(boxes).alias("position", "bbox"))
    pages = detection.number_pages(pages, "path", "source_index", "position")
    crop = geometry.crop(F.col("bbox"), F.col("width"), F.col("height"), args.trim_margin)
    pages.select("path", "page_index", "source_index", "bbox", crop.alias("crop")).write.mode("overwrite").parquet(args.output)


def _benchmark(spark: SparkSession, args: argparse.Namespace) -> None:
    began = time.monotonic()
    gold = selection.to_evaluation_examples(readers.read_split(spark, args.gold, args.split))
    gold = selection.select_subset(gold, "example_id", args.language, args.document_type, args.offset, args.limit)
    predictions = spark.read.parquet(args.predictions)
    metadata = F.col("metadata") if "metadata" in predictions.columns else F.create_map().cast("map<string,string>")
    predictions = predictions.select("example_id", F.coalesce("text", F.lit("")).alias("predicted_text"), metadata.alias("metadata"))
    pairs = evaluation.join_predictions(gold, predictions).withColumnRenamed("cleaned_transcription", "gold_text")
    # scored once: the report reads what was written
    sinks.write_outputs(evaluation.page_scores(pairs), args.output)
    scores = spark.read.schema("main_language string, document_type string, " + ", ".join(f"{m} double" for m in evaluation.METRICS)).json(f"{args.output}/outputs.json")
    sinks.write_metrics(evaluation.metric_maps(scores, time.monotonic() - began), f"{args.output}/all_metrics.json")


def main(arguments: list[str] | None = None) -> int:
    args = _parser().parse_args(arguments)
    spark = SparkSession.builder.getOrCreate()
    {"transcribe": _transcribe, "extract-pages": _extract, "benchmark": _benchmark}[args.command](spark, args)
    return 0


if __name__ == "__main__":
    sys.exit(main())
