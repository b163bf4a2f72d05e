import hashlib
import random
from fractions import Fraction

import duckdb
import pytest
from pyspark.sql import functions as F

from foliospark.llm import registry
from foliospark.llm.mixture import mix, quotas

SCHEMA = "doc_id long, text string, lang string, source string, tokens string"
WEIGHTS = {("a",): 5, ("b",): 2, ("c",): 0, ("a", "en"): 3, ("a", "de"): 1, ("b", "en", "s2"): 4}


def fill(amount, children):
    """children: name -> (capacity, weight); whole shares by repeated redistribution, the largest remainders last."""
    given, open_, left = {}, {c for c, (cap, _) in children.items() if cap > 0}, amount
    while open_:
        total = sum(children[c][1] for c in open_)
        over = {c for c in open_ if Fraction(left * children[c][1], total) >= children[c][0]}
        if not over:
            break
        for c in over:
            given[c] = children[c][0]
        left -= sum(given[c] for c in over)
        open_ -= over
    if open_:
        shares = {c: divmod(left * children[c][1], total) for c in open_}
        spare = left - sum(n for n, _ in shares.values())
        for c in sorted(open_, key=lambda c: (-shares[c][1], c)):
            given[c] = shares[c][0] + (spare > 0)
            spare -= 1
    return given


def brute(supply, budget, epochs):
    def weight(path):
        return WEIGHTS.get(path, 1)

    supply = {p: n for p, n in supply.items() if n > 0 and all(weight(p[:d]) > 0 for d in (1, 2, 3))}

    def down(prefix, amount):
        if len(prefix) == 3:
            return {prefix: amount}
        names = {p[: len(prefix) + 1] for p in supply if p[: len(prefix)] == prefix}
        children = {n: (sum(s for p, s in supply.items() if p[: len(n)] == n) * epochs, weight(n)) for n in names}
        result = {}
        for n, g in fill(amount, children).items():
            result |= down(n, g)
        return result

    return down((), budget)


def corpus():
    rng = random.Random(3)
    rows = []
    for i in range(400):
        source = f"{rng.choice('aab' 'bc')}{rng.choice('123')}"
        rows.append((i, " ".join("w" * rng.randrange(1, 4) for _ in range(rng.randrange(0, 50))), rng.choice(["en", "en", "de", None]), source, "x"))
    return [*rows, (400, None, "en", "a1", None), (401, "", "en", "a1", None), (None, "x y", "en", None, None)]


def leaf(r):
    return (r[3][0] if r[3] else "unknown", r[2] or "unknown", r[3] or "unknown")


@pytest.mark.parametrize(("numerator", "denominator", "epochs"), [(1, 2, 1), (9, 10, 1), (3, 2, 2), (3, 1, 2), (1, 50, 3)])
def test_against_brute_force(spark, numerator, denominator, epochs):
    weights = {k: v for k, v in WEIGHTS.items()}
    rows = corpus()
    supply = {}
    for r in rows:
        supply[leaf(r)] = supply.get(leaf(r), 0) + len((r[1] or "").split())
    budget = sum(n for p, n in supply.items() if p[0] != "c") * numerator // denominator
    want = brute(supply, budget, epochs)
    frame = spark.createDataFrame([(*p, n) for p, n in supply.items()], "domain string, language string, leaf_source string, supply long")
    got = {(r.domain, r.language, r.leaf_source): r.quota for r in quotas(frame, weights, numerator, denominator, epochs).collect()}
    assert got == want and sum(got.values()) == min(budget, sum(n for p, n in supply.items() if p in want) * epochs)
    docs = spark.createDataFrame(rows, SCHEMA)
    taken = mix(docs, F.substring("source", 1, 1), weights, numerator, denominator, epochs, seed=7)
    assert taken.columns == [*docs.columns, "epoch"]
    expected = []
    for p, quota in got.items():
        own = [r for r in rows if leaf(r) == p]
        full, rest = divmod(quota, supply[p])
        for epoch in range(full):
            expected += [(r[0], epoch) for r in own]
        size = 0
        for r in sorted(own, key=lambda r: hashlib.md5(f"7:{full}:{'null' if r[0] is None else r[0]}".encode()).hexdigest()):
            size += len((r[1] or "").split())
            if size > rest or full >= epochs:
                break
            expected.append((r[0], full))
    assert sorted(map(str, ((r.doc_id, r.epoch) for r in taken.collect()))) == sorted(map(str, expected))


def test_edges(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    assert mix(docs.limit(0), F.lit("a"), {}).count() == 0
    twice = docs.where("doc_id = 5").union(docs.where("doc_id = 5"))
    assert mix(twice, F.lit("a"), {}).count() == 2
    extra = docs.selectExpr("*", "1 as epoch", "2 as domain", "3 as supply")
    assert mix(extra, F.lit("a"), {}, 1, 2).columns == [*docs.columns, "domain", "supply", "epoch"]


def test_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.sql(registry.oracle_sql()["op8_mixture"]).fetchall()
    assert sorted(map(str, map(tuple, registry.op8_mixture(spark, sf).collect()))) == sorted(map(str, want)) and len(want) > 100


def test_long_text_and_dotted_name(spark):
    docs = spark.createDataFrame([(1, "a " * 300_000, "en", "s", 1), (2, "b", "en", "s", 2)], "doc_id long, text string, lang string, source string, `a.b` int")
    taken = mix(docs, F.lit("a"), {})
    assert taken.columns == [*docs.columns, "epoch"] and taken.count() == 2
