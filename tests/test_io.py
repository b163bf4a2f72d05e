"""Sources, sinks, streaming and the command line."""

import datetime
import json
import struct
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from foliospark import cli
from foliospark.operators import evaluation as E
from foliospark.sources import readers, sinks
from foliospark.streaming import transcriptions

PNG = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 10, 20) + b"\x08\x02\x00\x00\x00"
JPEG = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08" + struct.pack(">HH", 30, 40) + b"\x01\x01\x11\x00"


def test_split(spark, tmp_path):
    for name, n in (("test-0", 2), ("test-1", 3), ("train-0", 5)):
        spark.range(n).withColumn("x", F.lit(name)).coalesce(1).write.parquet(str(tmp_path / "part"))
        next((tmp_path / "part").glob("part-*.parquet")).rename(tmp_path / f"{name}.parquet")
        for p in (tmp_path / "part").iterdir():
            p.unlink()
        (tmp_path / "part").rmdir()
    assert readers.read_split(spark, str(tmp_path), "test", ["id"]).count() == 5 and readers.read_split(spark, str(tmp_path), "none").count() == 10
    plan = readers.read_split(spark, str(tmp_path), "test", ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:bigint>" in plan


def test_images(spark, tmp_path):
    for name, data in (("a.png", PNG), ("b.jpg", JPEG), ("c.gif", b"GIF89a\x05\x00\x06\x00"), ("d.txt", b"x")):
        (tmp_path / name).write_bytes(data)
    found = {Path(r.path).name: (r.width, r.height) for r in readers.read_images(spark, str(tmp_path)).collect()}
    assert found == {"a.png": (10, 20), "b.jpg": (40, 30), "c.gif": (5, 6), "d.txt": (None, None)}
    (tmp_path / "e.pdf").write_bytes(b"2")
    pages = readers.read_pdfs(spark, str(tmp_path), lambda data, scale: [(b"x", int(72 * scale), 1)] * int(data)).collect()
    assert [(r.source_index, r.width) for r in pages] == [(0, 300), (1, 300)]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("1", "a", "a", "en", "print"), ("2", "b", "ä", "en", "print")], "example_id string, predicted_text string, gold_text string, main_language string, document_type string")
    scores = E.page_scores(rows.withColumn("metadata", F.create_map(F.lit("k"), F.lit("v"))))
    sinks.write_outputs_array(scores, str(tmp_path / "o" / "outputs.json"))
    found = json.loads((tmp_path / "o" / "outputs.json").read_text(encoding="utf-8"))
    assert list(found[0])[:2] == ["example_id", "metadata"] and {r["gold_text"] for r in found} == {"a", "ä"} and found[0]["metadata"] == {"k": "v"}
    sinks.write_outputs(scores, str(tmp_path / "p"))
    assert spark.read.json(str(tmp_path / "p" / "outputs.json")).count() == 2
    report = sinks.write_metrics(E.metric_maps(scores), str(tmp_path / "all_metrics.json"))
    assert report == json.loads((tmp_path / "all_metrics.json").read_text()) and report["aggregate_metrics"]["normalized_levenshtein_similarity"] == 50.0 and report["type_metrics"] == {"handwriting": 0.0, "print": 50.0}
    images = spark.createDataFrame([(0, bytearray(b"x")), (12, bytearray(b"y")), (13, None)], "page_index int, image binary")
    assert sinks.write_page_images(images, str(tmp_path / "img")) == 2 and sorted(p.name for p in (tmp_path / "img").iterdir()) == ["page_0000.png", "page_0012.png"]
    both = images.withColumn("doc", F.lit("a/1")).union(images.withColumn("doc", F.lit("b")))
    with pytest.raises(ValueError, match="document"):
        sinks.write_page_images(both, str(tmp_path / "two"))
    assert sinks.write_page_images(both, str(tmp_path / "two"), document="doc") == 4 and "a_1_page_0012.png" in {p.name for p in (tmp_path / "two").iterdir()}
    sinks.write_texts(spark.createDataFrame([("a",), (None,)], "text string"), str(tmp_path / "t"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "t")).collect()) == ["", "a"]


def test_stream(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1).isoformat()
    lines = [{"example_id": "1", "profile": "glm", "response": "Text Recognition:\nassistant\nx<|user|>", "received": at}, {"example_id": "2", "response": None, "received": at}]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, lines)))
    for _ in range(2):  # the second run finds nothing new
        transcriptions.write(transcriptions.texts(transcriptions.read_responses(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert {r.example_id: r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"1": "x", "2": None}
    counted = transcriptions.counts(transcriptions.read_responses(spark, str(tmp_path / "in")))
    query = counted.writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {r["profile"]: (r.responses, r.empty) for r in spark.table("counted").collect()} == {"glm": (1, 0), None: (1, 1)}


def test_command_line(spark, tmp_path):
    rows = [("1", "gold", "en", "print", "set", "Latin"), ("2", "text", "de", "print", "set", "Latin")]
    gold = spark.createDataFrame(rows, "example_id string, cleaned_transcription string, main_language string, document_type string, dataset_id string, main_script string")
    gold.write.parquet(str(tmp_path / "gold"))
    spark.createDataFrame([("1", "<output>gold</output>"), ("2", "txt")], "example_id string, text string").write.parquet(str(tmp_path / "predictions"))
    assert cli.main(["benchmark", "--gold", str(tmp_path / "gold"), "--predictions", str(tmp_path / "predictions"), "--output", str(tmp_path / "results"), "--language", "EN"]) == 0
    report = json.loads((tmp_path / "results" / "all_metrics.json").read_text())
    assert report["main_language_metrics"] == {"en": 100.0}
    assert cli.main(["transcribe", "--responses", str(tmp_path / "predictions"), "--output", str(tmp_path / "texts")]) == 0
    assert {r[0] for r in spark.read.text(str(tmp_path / "texts")).collect()} == {"gold", "txt"}


def test_nothing_needs_the_optional_package():
    code = "import sys; sys.modules['foliospark.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'pipeline' not in e.queries() and 'grouped_scores' in e.queries()"
    root = Path(__file__).resolve().parent.parent
    assert subprocess.run([sys.executable, "-c", code], cwd=root, check=False).returncode == 0
    inside = [p for p in (root / "foliospark").rglob("*.py") if "llm" not in p.parts]
    assert not [p for p in inside if "foliospark.llm" in p.read_text() or "from .llm" in p.read_text()]
