from collections import Counter

import numpy as np
import pytest

from foliospark.llm import sharding
from foliospark.llm.sharding import hypergeometric, matrix_row, shard, shard_sizes


def test_matrix_sums_and_law():
    counts, sizes = [5, 0, 7, 3], shard_sizes(15, 4)
    totals = np.zeros((4, 4))
    for seed in range(3000):
        rows = np.array([matrix_row(counts, sizes, p, seed) for p in range(4)])
        assert rows.sum(axis=1).tolist() == counts and rows.sum(axis=0).tolist() == sizes
        totals += rows
    assert np.allclose(totals / 3000, np.outer(counts, sizes) / 15, atol=0.08)


def test_large_hypergeometric(monkeypatch):
    """The sampler for large sizes has the law of numpy's."""
    rng = np.random.default_rng(5)
    want = rng.hypergeometric(4000, 6000, 900, 20_000)
    monkeypatch.setattr(sharding, "_NUMPY_LIMIT", 0)
    got = np.array([hypergeometric(rng, 4000, 6000, 900) for _ in range(20_000)])
    assert abs(got.mean() - want.mean()) < 0.5 and abs(got.std() / want.std() - 1) < 0.03
    few = np.array([hypergeometric(rng, 3, 500, 200) for _ in range(20_000)])
    assert abs(few.mean() - 3 * 200 / 503) < 0.03
    n = hypergeometric(rng, 10**11, 10**11, 10**9)
    assert abs(n - 5 * 10**8) < 10**6


def test_shards(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = shard(docs, 7, seed=3)
    rows = out.collect()
    assert sorted(Counter(r.shard for r in rows).values()) == sorted(shard_sizes(len(rows), 7))
    for s in range(7):
        assert sorted(r.position for r in rows if r.shard == s) == list(range(shard_sizes(len(rows), 7)[s]))
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.collect())
    assert sorted(map(str, out.collect())) == sorted(map(str, rows))  # the same at each run
    assert sorted(map(str, shard(docs, 7, seed=4).collect())) != sorted(map(str, rows))


def test_sections_change_nothing(spark):
    docs = spark.range(0, 9000, 1, 5).selectExpr("id as doc_id", "id % 7 as `a.b`", "id as section", "id as Key")
    whole, cut = ({tuple(r) for r in shard(docs, 2, 1, section).collect()} for section in (1 << 40, 10))
    assert whole == cut and {(r[-2], r[-1]) for r in cut} == {(s, i) for s in range(2) for i in range(4500)}
    assert shard(docs, 2).columns == ["doc_id", "a.b", "section", "Key", "shard", "position"]


def test_uniform(spark):
    """Each row is as likely in each shard."""
    docs = spark.range(12).withColumnRenamed("id", "doc_id").repartition(3)
    hits = np.zeros((12, 3))
    for seed in range(40):
        for r in shard(docs, 3, seed).collect():
            hits[r.doc_id, r.shard] += 1
    assert (hits.sum(axis=0) == 160).all()
    assert 0 < hits.min() and hits.max() < 30


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 5), (1, None, 5), (None, "", 6), (2, "x" * 100_000, None)], "doc_id long, text string, shard int")
    rows = shard(docs, 9).collect()
    assert len(rows) == 4 and len({(r.shard, r.position) for r in rows}) == 4 and {r.position for r in rows} == {0}
    assert shard(docs.limit(0), 3).count() == 0
    with pytest.raises(Exception, match="counted"):
        real = sharding._cards
        sharding._cards = lambda *a: (np.zeros(0, np.int32), np.zeros(0, np.int64))
        try:
            shard(docs, 9).collect()
        finally:
            sharding._cards = real
