import random
import re

import duckdb

from foliospark.llm import _spark
from foliospark.llm.suffix_dedup import SQL, depths, repeated_passages, repeated_suffixes

SCHEMA = "doc_id long, text string"


def split(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(rows, length):
    seen = {}
    for d, t in rows:
        words = split(t)
        for i in range(len(words) - length + 1):
            seen.setdefault(tuple(words[i : i + length]), []).append((d, i))
    return {(*at, *min(places)) for places in seen.values() if len(places) > 1 for at in places}


def corpus():
    rng = random.Random(9)
    words = [f"w{i}" for i in range(40)]
    passages = [[rng.choice(words) for _ in range(rng.randrange(10, 40))] for _ in range(8)]
    rows = []
    for d in range(80):
        text = []
        for _ in range(rng.randrange(0, 6)):
            text += rng.choice(passages) if rng.random() < 0.4 else [rng.choice(words) for _ in range(rng.randrange(0, 60))]
        rows.append((d, ", ".join(text)))
    return [*rows, (80, "so la " * 60), (81, "la so " * 40)]


def test_against_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    for length, q in ((12, None), (13, 5), (20, 3), (2, 1), (7, 7)):
        assert {tuple(r) for r in repeated_suffixes(docs, length, q).collect()} == brute(rows, length)


def test_spans(spark):
    rows = corpus()
    length = 12
    want = {}
    for d, i, fd, fi in brute(rows, length):
        for w in range(i, i + length):
            want.setdefault(d, set()).add(w)
    got = {}
    spans = repeated_passages(spark.createDataFrame(rows, SCHEMA), length).collect()
    for s in spans:
        got.setdefault(s.doc_id, set()).update(range(s.start, s.stop))
        assert s.keep == ((s.first_doc, s.first_word) == (s.doc_id, s.start))
    assert got == want


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    assert {tuple(r) for r in repeated_suffixes(docs).collect()} == brute([tuple(r) for r in docs.collect()], 50)


def test_edges(spark):
    passage = " ".join(f"word{i}" for i in range(55))
    rows = [(1, None), (2, ""), (3, passage), (4, "x " + passage.upper() + " y"), (None, passage), (3, passage), (5, "short"), (6, "z " * 40_000)]
    docs = spark.createDataFrame([(*r, 1, None) for r in rows], SCHEMA + ", word int, bucket string")
    spans = {(r.doc_id, r.start, r.stop, r.keep) for r in repeated_passages(docs).collect()}
    assert spans == {(3, 0, 55, True), (4, 1, 56, False), (6, 0, 50, True), (6, 1, 40000, False)}
    assert repeated_passages(docs.limit(0)).count() == 0
    assert depths(25, 50) == [25] and depths(4, 50) == [4, 8, 16, 18]


def test_repeated_ids_with_other_texts(spark):
    """The row with the least text is the document."""
    passage = " ".join(f"word{i}" for i in range(120))
    docs = spark.createDataFrame([(1, "a b"), (1, passage), (2, passage), (3, "zz " + passage), (4, "y"), (4, "x")], SCHEMA)
    assert {tuple(r) for r in repeated_passages(docs).collect()} == {(2, 0, 120, True, 2, 0), (3, 1, 121, False, 2, 0)}


def test_salted_buckets(spark, monkeypatch):
    monkeypatch.setattr(_spark, "HOT", 2)
    monkeypatch.setattr(_spark, "SAMPLE", 2)
    monkeypatch.setattr(_spark, "SALTED", 16)
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    assert {tuple(r) for r in repeated_suffixes(docs, 12).collect()} == brute(rows, 12)


def test_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.sql(SQL).fetchall()
    assert {tuple(r) for r in repeated_passages(spark.read.parquet(f"{sf}/documents.parquet")).collect()} == set(want) and len(want) > 20
