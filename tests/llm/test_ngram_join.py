import random
import re
from itertools import combinations

import numpy as np
import pytest

from foliospark.llm import ngram_join
from foliospark.llm.ngram_join import components, drop_duplicates, intersections, near_classes, needed_agreements

SCHEMA = "doc_id long, text string"


def grams(text, n=3):
    words = re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return set()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}


def brute(rows, threshold):
    sets = {d: grams(t) for d, t in rows}
    found = {}
    for a, b in combinations(sorted(sets), 2):
        if sets[a] and sets[b] and (j := len(sets[a] & sets[b]) / len(sets[a] | sets[b])) >= threshold:
            found[a, b] = j
    return found


def classes(pairs):
    """Lowest connected doc_id and number of pairs of each document of the pairs."""
    parent, links = {}, {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        links[a], links[b] = links.get(a, 0) + 1, links.get(b, 0) + 1
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    return {x: (root(x), n) for x, n in links.items()}


def check(got, want):
    """At least 0.95 of the links, no link too many, and no class that brute force doesn't have; nearly all classes whole."""
    got = {r.doc_id: (r.class_id, r.links) for r in got}
    assert set(got) <= set(want)
    assert sum(n for _, n in got.values()) >= 0.95 * sum(n for _, n in want.values())
    assert all(n <= want[d][1] and want[c][0] == want[d][0] for d, (c, n) in got.items())
    assert sum(got.get(d, (None, 0))[0] == c for d, (c, _) in want.items()) >= 0.95 * len(want)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(900)]
    rows = []
    for base in range(60):
        text = [rng.choice(words) for _ in range(rng.randrange(30, 400))]
        for _ in range(rng.randrange(1, 6)):
            copy = [rng.choice(words) if rng.random() < rng.choice([0, 0.01, 0.05, 0.1]) else w for w in text]
            rows.append((len(rows), " ".join(copy)))
    return rows


def test_links_and_classes(spark, corpus):
    check(near_classes(spark.createDataFrame(corpus, SCHEMA)).collect(), classes(brute(corpus, 0.5)))


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    check(near_classes(docs).collect(), classes(brute([tuple(r) for r in docs.collect()], 0.5)))


def test_blocks_of_a_large_bucket(spark, monkeypatch):
    """A cluster that is cut into blocks has all its links."""
    monkeypatch.setattr(ngram_join, "BLOCK", 7)
    rng = random.Random(6)
    text = [f"w{rng.randrange(500)}" for _ in range(120)]
    rows = [(d, " ".join(w if rng.random() > 0.02 else f"x{rng.randrange(500)}" for w in text)) for d in range(60)] + [(d, " ".join(text)) for d in range(60, 75)]
    want = classes(brute(rows, 0.5))
    got = {r.doc_id: (r.class_id, r.links) for r in near_classes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert set(got) == set(want) and all(c == 0 for c, _ in got.values())
    assert sum(n for _, n in got.values()) >= 0.98 * sum(n for _, n in want.values()) and all(got[d][1] <= want[d][1] for d in want)


def test_edges(spark):
    long = "many words " * 30_000
    rows = [(1, "a b"), (2, "A, b!"), (3, None), (4, ""), (5, "!!"), (None, "a b"), (6, long), (7, long + "end"), (1, "a b"), (8, "c"), (9, "c")]
    docs = spark.createDataFrame([(*r, 1, "y", 0) for r in rows], SCHEMA + ", bucket int, a string, `x.y` int")
    assert {tuple(r) for r in near_classes(docs).collect()} == {(1, 1, 1), (2, 1, 1), (6, 6, 1), (7, 6, 1), (8, 8, 1), (9, 8, 1)}
    kept = drop_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id) for r in kept.collect())) == ["1", "3", "4", "5", "6", "8", "None"]
    assert near_classes(docs.limit(0)).count() == 0 and drop_duplicates(docs.limit(0)).count() == 0


def test_repeated_ids_with_other_texts(spark):
    """The row with the least text is the document: what only the others have can't drop a document."""
    passage = " ".join(f"p{i}" for i in range(120))
    docs = spark.createDataFrame([(1, passage, {"k": 1}), (1, "a b", {"k": 2}), (2, passage, None), (3, "zz " + passage, {})], SCHEMA + ", extra map<string,int>")
    assert {tuple(r) for r in near_classes(docs).collect()} == {(2, 2, 1), (3, 2, 1)}
    assert {(r.doc_id, r.text, str(r.extra)) for r in drop_duplicates(docs).collect()} == {(1, "a b", "{'k': 2}"), (2, passage, "None")}


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 90)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(70)]
    parent = list(range(200))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    want = {x: root(x) for x in range(200) if root(x) != x}
    got = {r.doc_id: r.root for r in components(spark.createDataFrame(edges, "doc_a long, doc_b long")).collect()}
    assert got == want


def test_pruning_table():
    assert all(m <= n for n, m in needed_agreements(144, 0.5, 0.002, 16))
    assert needed_agreements(144, 0.5, 0.002, 16)[-1][1] > 50


def test_intersections():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 300_000, n).astype(np.uint64)) for n in (0, 5, 4000, 200_000, 200_000)] + [np.arange(150, dtype=np.uint64)] * 2
    a, b = np.array([0, 1, 2, 3, 5, 2]), np.array([1, 2, 3, 4, 6, 6])
    assert intersections(sets, a, b).tolist() == [len(np.intersect1d(sets[i], sets[j])) for i, j in zip(a, b, strict=True)]
