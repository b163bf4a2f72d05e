import random

import pyarrow as pa
import pytest

from foliospark.llm.repetition import filter_documents, measure, quality_rules

DOCS = "doc_id long, text string"


def brute(text, m):
    """Spans of all substrings that occur twice, tried length by length."""
    covered, longest = set(), 0
    for size in range(m, len(text)):
        seen = {}
        for i in range(len(text) - size + 1):
            seen.setdefault(text[i : i + size], []).append(i)
        found = [i for at in seen.values() if len(at) > 1 for i in at]
        if not found:
            break
        longest = size
        for i in found:
            covered.update(range(i, i + size))
    return len(text), len(covered), longest


@pytest.mark.parametrize("alphabet", ["ab", "abcdé", "a"])
def test_against_brute_force(alphabet):
    rng = random.Random(alphabet)
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 70))) for _ in range(60)]
    texts += [None, "", "日本語" * 9, "x" * 40 + "y"]
    for m in (1, 4, 9):
        got = list(zip(*(x.tolist() for x in measure(pa.array(texts), m)), strict=True))
        assert got == [brute(t or "", m) for t in texts]


def test_rules_and_edges(spark):
    clean = " ".join(f"word{i * i}" for i in range(300))
    rows = [(1, clean), (2, "Buy now! " * 60), (3, None), (4, ""), (1, clean), (None, "spam " * 100), (5, clean + clean[:1200])]
    docs = spark.createDataFrame(rows, DOCS)
    assert sorted(r.doc_id for r in quality_rules(docs).collect()) == [1, 1, 3, 4]
    assert quality_rules(docs.limit(0)).count() == 0
    extra = docs.selectExpr("*", "'x' as repetition", "1 as n_chars")
    kept = filter_documents(extra)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 1, 3, 4]
    assert kept.columns == ["doc_id", "text", "n_chars"]


def test_very_long_text(spark):
    text = "".join(chr(97 + (i * i * 7 + i // 3) % 26) if i % 11 else " " for i in range(3_000_000))
    row = quality_rules(spark.createDataFrame([(1, text[:5000] + text)], DOCS), max_fraction=1.1, max_longest=10**9).collect()[0]
    assert row.n_chars == 3_005_000 and row.longest_repeat >= 5000
