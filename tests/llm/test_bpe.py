import random

import pytest
import tiktoken

from foliospark.llm import bpe


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.vocabulary()


@pytest.fixture(scope="module")
def exact(vocabulary):
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


def texts():
    rng = random.Random(5)
    alphabet = list("aaabcdefghiiijknorstuy  THE'.,1290\n\t") + ["é", "ß", "日", "本", "🙂", " ", "́", "ing", "tion", "er"]
    made = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 120))) for _ in range(1500)]
    return [*made, "", "a" * 5000, "ab" * 700, "xyz!" * 300, " " * 900, "'s 'll it's", "<|endoftext|>"]


def test_same_as_exact_merging(vocabulary, exact):
    encoder, all_texts = bpe.Encoder(vocabulary), texts()
    tokens, counts = encoder.encode(all_texts)
    at = 0
    for text, n in zip(all_texts, counts, strict=True):
        assert tokens[at : at + n].tolist() == exact.encode_ordinary(text)
        at += n
    assert 0 < encoder.exact < len(encoder.known)  # some words fail, most don't


def test_forgetting_changes_nothing(vocabulary, exact, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    encoder = bpe.Encoder(vocabulary)
    for text in texts()[:60]:
        assert encoder.encode([text])[0].tolist() == exact.encode_ordinary(text)


def test_pair_check(vocabulary):
    import numpy as np

    rng, ranks = np.random.default_rng(3), vocabulary.ranks
    a, b = rng.integers(0, 50256, 3000), rng.integers(0, 50256, 3000)
    for x, y, good in zip(a, b, bpe.compatible(vocabulary, a, b), strict=True):
        whole = all(bpe.merge(vocabulary.tokens[t], ranks) == [t] for t in (x, y))
        if whole:
            assert (bpe.merge(vocabulary.tokens[x] + vocabulary.tokens[y], ranks) == [x, y]) == good


def test_round_trip_and_edges(spark, exact):
    rows = [(1, "Hello wörld", "x"), (2, None, "y"), (3, "", None), (1, "Hello wörld", "x"), (None, "long " * 50_000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    encoded = bpe.encode(docs)
    assert encoded.columns == ["doc_id", "text", "tokens", "n_tokens", "round_trip"]
    got = encoded.collect()
    for row in got:
        if row.text is None:
            assert (row.tokens, row.n_tokens, row.round_trip) == (None, None, None)
        else:
            assert row.round_trip and row.tokens == exact.encode_ordinary(row.text) and row.n_tokens == len(row.tokens)
    back = bpe.decode(encoded.drop("text"))
    assert sorted(map(str, (r.text for r in back.collect()))) == sorted(map(str, (r[1] for r in rows)))
    odd = spark.createDataFrame([([1, 999999],), ([200],), ([None],), ([],)], "tokens array<int>")
    assert [r.text for r in bpe.decode(odd).collect()][0] is None
    assert bpe.encode(docs.limit(0)).count() == 0


def test_documents(spark, sf, exact):
    for row in bpe.encode(spark.read.parquet(f"{sf}/documents.parquet")).collect():
        assert row.round_trip and row.tokens == exact.encode_ordinary(row.text)
