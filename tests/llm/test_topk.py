import math
import random
import re
from collections import Counter

import duckdb
import numpy as np

from foliospark.llm.topk import SQL, Index, search


def split(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, queries, k):
    rows = [(d, split(t)) for d, t in docs if d is not None]
    counts = [(d, Counter(w), len(w)) for d, w in rows]
    df = Counter(t for _, c, _ in counts for t in c)
    n, average = len(rows), sum(size for *_, size in counts) / len(rows)
    result = set()
    for q, text in queries:
        scores = {}
        for d, c, size in counts:
            s = 0
            for t, m in Counter(split(text)).items():
                if t in c:
                    idf = float(np.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)))
                    s += m * round(1_000_000 * idf * (c[t] * 2.2) / (c[t] + 1.2 * (1 - 0.75 + 0.75 * size / average)))
            scores[d] = max(s, scores.get(d, 0))
        ranked = sorted((-s, d) for d, s in scores.items() if s)[:k]
        result |= {(q, d, -s, i + 1) for i, (s, d) in enumerate(ranked)}
    return result


def test_against_brute_force(spark):
    rng = random.Random(7)
    words = [f"t{int(rng.paretovariate(0.6))}" for _ in range(3000)]
    docs = [(i // 2 if i % 9 == 0 else i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 60)))) for i in range(500)]
    docs += [(900, None), (901, ""), (None, docs[3][1]), (902, docs[3][1]), (903, docs[3][1]), (904, "t1 " * 30_000)]
    queries = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 12)))) for i in range(30)] + [(30, None), (31, ""), (32, "nowhere"), (33, docs[3][1])]
    d, q = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame([(*x, 1) for x in queries], "item_id long, text string, score int")
    want = brute(docs, queries, 7)
    assert {tuple(r) for r in search(d, q, 7).collect()} == want
    assert {tuple(r) for r in search(d, q, 7, block=9).collect()} == want
    assert search(d.limit(0), q).count() == 0 and search(d, q.limit(0)).count() == 0


def test_stops_early_only_on_proof():
    rng = np.random.default_rng(1)
    n = 4000
    term, doc = np.repeat(np.arange(5), n), np.tile(np.arange(n), 5)
    impact = rng.integers(1, 10_000, 5 * n)
    index = Index(term, doc, impact, 5, n)
    docs, scores, done = index.top(np.arange(5), np.ones(5, dtype=np.int64), 10, 0)
    exact = np.zeros(n, dtype=np.int64)
    np.add.at(exact, doc, impact)
    assert sorted(scores)[-10:] == sorted(exact)[-10:] and len(docs) < n
    assert done <= len(index.term)
    # ten documents far above the others: many segments are never looked at
    best = rng.choice(n, 10, replace=False)
    impact = np.where(np.isin(doc, best), 60_000, rng.integers(1, 20_000, 5 * n))
    index = Index(term, doc, impact, 5, n)
    docs, scores, done = index.top(np.arange(5), np.ones(5, dtype=np.int64), 10, 0)
    assert set(docs) >= set(best) and (scores[np.isin(docs, best)] == 300_000).all() and done < len(index.term)


def test_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = search(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet"))
    assert {tuple(r) for r in got.collect()} == set(con.sql(f"select item_id, doc_id, score, rank from ({SQL})").fetchall())
    assert math.isfinite(got.count())
