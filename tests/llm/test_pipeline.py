"""Each stage of the pipeline against brute force on what the stage before kept."""

import sys

import tiktoken
from test_ngram_join import brute as near_pairs
from test_repetition import brute as repeats
from test_suffix_dedup import brute as shared

import corpus_pipeline
from foliospark.llm import bpe
from foliospark.llm.repetition import MAX_FRACTION, MAX_LONGEST, MIN_REPEAT

sys.setrecursionlimit(10_000)


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert docs.columns == columns
        kept.append({r.doc_id: r for r in docs.collect()})
        assert len(kept[-1]) == docs.count()
    first, second, third, fourth, last = kept
    source = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    # 1: a short document's repeats are counted here, the rules are those of the stage
    for d, r in source.items():
        if len(r.text) < 1500:
            n, covered, longest = repeats(r.text, MIN_REPEAT)
            assert (d in first) == (covered <= MAX_FRACTION * n and longest <= MAX_LONGEST)
    # 2: the lowest doc_id of each connected group stays
    parent = {d: d for d in first}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in near_pairs([(d, r.text) for d, r in first.items()], 0.5):
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    assert set(second) == {d for d in first if root(d) == d}
    # 3: passages that documents share go from all but the first; clean documents stay as they are
    assert {r[0] for r in shared([(d, r.text) for d, r in third.items()], 52)} == set()
    touched = {r[0] for r in shared([(d, r.text) for d, r in second.items()], 40)}
    for d, r in second.items():
        if d not in touched:
            assert third[d] == r
        elif d in third:
            assert third[d].n_chars == len(third[d].text) <= len(r.text)
    # 4: documents as they were, nine tenths of the tokens at most
    size = lambda rows: sum(len(r.text.split()) for r in rows.values())
    assert all(third[d] == r for d, r in fourth.items()) and 0.8 * size(third) <= size(fourth) <= 0.9 * size(third)
    # 5: exact BPE
    exact = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=bpe.vocabulary().ranks, special_tokens={})
    assert set(last) == set(fourth)
    for d, r in last.items():
        assert r.round_trip and r.tokens == exact.encode_ordinary(fourth[d].text)


def test_whole_run(spark, sf, tmp_path):
    assert corpus_pipeline.run(spark, sf).count() > 100


def test_edges_of_stages(spark, sf):
    """Nulls, empty and repeated rows, rows of one id with other texts, clashing names, empty tables: each stage on what the one before kept."""
    passage = " ".join(f"word{i}" for i in range(80))
    rows = [(1, None), (2, ""), (3, passage), (3, passage), (4, "x " + passage), (None, passage), (None, None), (5, "b " * 3), (5, "a short text"), (6, "é" * 50_000), (7, "so " + " ".join(f"w{i}" for i in range(9_000)))]
    names = "doc_id long, text string, lang string, source string, n_chars long, epoch int, repetition string, spans int, `a.b` int"
    docs = spark.createDataFrame([(d, t, "en" if d else None, "src1" if d else None, len(t or ""), 1, "r", 2, 3) for d, t in rows], names)
    for table in (docs, docs.limit(0)):
        now, ids = table, []
        for _, stage in corpus_pipeline.STAGES:
            found = stage(spark, now, sf)
            now = spark.createDataFrame(found.collect(), found.schema)
            ids.append(sorted(str(r.doc_id) for r in now.collect()))
            if len(ids) < 5:
                assert now.columns == docs.columns
        if table is docs:
            assert {"1", "2", "3", "4", "5", "7", "None"} <= set(ids[0]) and "6" not in ids[0]
            assert ids[1].count("3") == ids[1].count("5") == 1 and ids[1].count("None") == 2 and "4" not in ids[1]
            assert ids[2] == ids[1] and set(ids[3]) <= set(ids[2]) and ids[4] == ids[3]
        else:
            assert ids == [[]] * 5
