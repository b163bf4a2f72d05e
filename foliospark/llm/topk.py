"""Operator 4: exact BM25 top-k by an impact-ordered, score-at-a-time index.

Scores are integers: the impact of a term in a document is its BM25 part in
millionths, rounded, so sums don't depend on their order and ties are ties.

Statistics (document count and lengths, document frequency of each query term)
are counted over all documents.  Documents then stay where they were read: each
block of them is an index whose postings are grouped in segments of one term
and one quantised impact.  For each query the segments are processed by
descending impact, adding lower bounds; processing stops only once no document
without a lower bound can reach the k-th best score, and all documents that may
still belong to the top k are scored exactly.  The best of all blocks are
merged.  The documents aren't shuffled.

Every row of the queries is a query.  Queries are taken in blocks, each with at
most ``block`` queries, whose terms are broadcast; so the broadcast has a bound
that neither table's size moves.

Defined results: words are as in ``_text``; a query or document without words
(null, empty) has no score; only scores above 0 count, so there may be fewer
than k; ties go to the lower doc_id; rows with a null id take no part in the
result; of several rows with one doc_id the best counts (each counts in the
statistics); of queries with one id the least text counts; other columns are
not looked at; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import id_text
from ._text import U64, pieces, released, signed, Words

K, K1, B, SCALE, BLOCK = 10, 1.2, 0.75, 1_000_000, 256
RESULT = "item_id bigint, doc_id bigint, score bigint, rank int"


class Queries:
    """Distinct terms of a block of queries; terms and their numbers by query."""

    def __init__(self, ids: list[int], texts: list[str | None]) -> None:
        words = Words(pa.array(texts, pa.string()))
        self.ids = ids
        self.terms = np.unique(words.hash)
        self.of: list[tuple[np.ndarray, np.ndarray]] = []
        for i in range(len(ids)):
            own = np.searchsorted(self.terms, words.hash[words.first[i] : words.first[i + 1]])
            self.of.append(np.unique(own, return_counts=True))

    def find(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(term, row, frequency) of the words that are terms."""
        if not len(self.terms):
            return (np.zeros(0, np.int64),) * 3
        place = np.minimum(np.searchsorted(self.terms, words.hash), len(self.terms) - 1)
        hit = np.flatnonzero(self.terms[place] == words.hash)
        rows = len(words.first) - 1
        key, count = np.unique(place[hit] * rows + words.row[hit], return_counts=True)
        return key // max(1, rows), key % max(1, rows), count


def statistics(texts: DataFrame, queries) -> tuple[int, int, np.ndarray]:
    """(documents, words, document frequency by term): one pass, one row a term to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = queries.value
        frequency, documents, total = np.zeros(len(q.terms), dtype=np.int64), 0, 0
        for batch in batches:
            for part in pieces(batch, "text"):
                words = Words(part.column("text"))
                frequency += np.bincount(q.find(words)[0], minlength=len(q.terms))
                documents, total = documents + part.num_rows, total + len(words.hash)
        keys = np.concatenate([[-2, -1], np.flatnonzero(frequency)])
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.concatenate([[documents, total], frequency[frequency > 0]]))], ["term", "n"])

    frequency = np.zeros(len(queries.value.terms), dtype=np.int64)
    totals = {-2: 0, -1: 0}
    for term, n in texts.mapInArrow(released(run), "term bigint, n bigint").groupBy("term").agg(F.sum("n")).collect():
        if term < 0:
            totals[term] = n
        else:
            frequency[term] = n
    return totals[-2], totals[-1], frequency


def impacts(tf: np.ndarray, length: np.ndarray, idf: np.ndarray, average: float) -> np.ndarray:
    return np.rint(SCALE * idf * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * length / average))).astype(np.int64)


def inverse_frequency(documents: int, frequency: np.ndarray) -> np.ndarray:
    return np.log(1 + (documents - frequency + 0.5) / (frequency + 0.5))


class Index:
    """Postings of one block of documents, in segments of (term, impact level)."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, terms: int, docs: int) -> None:
        self.docs = docs
        # postings by document, for the exact scores: as many numbers as there are postings
        by = np.lexsort((doc, term))
        self.place, self.impact = term[by] * max(1, docs) + doc[by], impact[by]
        self.shift = max(0, int(impact.max(initial=0)).bit_length() - 6)
        level = impact >> self.shift
        by = np.lexsort((doc, -level, term))
        self.doc, key = doc[by], (term[by] << 20) | (63 - level[by])
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, dtype=np.int64)
        self.start = np.append(start, len(key))
        self.term, self.level = key[start] >> 20, 63 - (key[start] & 0xFFFFF)
        self.of = np.searchsorted(self.term, np.arange(terms + 1))

    def scores(self, terms: np.ndarray, weight: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Exact scores of some documents."""
        want = terms[:, None] * max(1, self.docs) + docs[None]
        at = np.minimum(np.searchsorted(self.place, want), len(self.place) - 1)
        return (np.where(self.place[at] == want, self.impact[at], 0) * weight[:, None]).sum(axis=0)

    def top(self, terms: np.ndarray, weight: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(documents, scores) among which are all of the best k with a score of at least floor; segments processed."""
        own = np.concatenate([np.arange(self.of[t], self.of[t + 1]) for t in terms]) if len(terms) else np.zeros(0, np.int64)
        if not len(own):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        factor = np.repeat(weight, self.of[terms + 1] - self.of[terms])
        which = np.repeat(np.arange(len(terms)), self.of[terms + 1] - self.of[terms])
        low, high = factor * (self.level[own] << self.shift), factor * ((self.level[own] + 1 << self.shift) - 1)
        order = np.argsort(-high, kind="stable")
        lower, seen = np.zeros(self.docs, dtype=np.int64), np.zeros(self.docs, dtype=bool)
        # the most that terms can still add: of each, its next segment
        first = np.flatnonzero(np.r_[True, which[1:] != which[:-1]])
        following = np.append(high[1:], 0)
        following[np.append(first[1:], len(own)) - 1] = 0
        remaining = int(high[first].sum())
        slack = int((weight * ((1 << self.shift) - 1)).sum())
        done = 0
        for i in order.tolist():
            segment = own[i]
            docs = self.doc[self.start[segment] : self.start[segment + 1]]
            lower[docs] += low[i]
            seen[docs] = True
            remaining += int(following[i] - high[i])
            done += 1
            if done % 16 == 0 and remaining < max(floor, 1) or done % 64 == 0 and len(lower) > k and remaining < np.partition(lower, -k)[-k]:
                break
        least = max(floor, 1, int(np.partition(lower, -k)[-k]) if len(lower) > k else 1)
        possible = np.flatnonzero((seen | (remaining >= least)) & (lower + slack + remaining >= least))
        scores = self.scores(terms, weight, possible)
        good = scores >= max(floor, 1)
        return possible[good], scores[good], done


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k distinct ids of the best scores, ties by id."""
    by = np.lexsort((ids, -scores))
    ids, scores = ids[by], scores[by]
    _, first = np.unique(ids, return_index=True)
    first = np.sort(first)[:k]
    return ids[first], scores[first]


def _block(texts: DataFrame, ids: list[int], query_texts: list[str | None], k: int) -> DataFrame:
    context = texts.sparkSession.sparkContext
    queries = context.broadcast(Queries(ids, query_texts))
    documents, total, frequency = statistics(texts, queries)
    idf, average = inverse_frequency(documents, frequency), total / documents if total else 1.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = queries.value
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(q.ids)
        for batch in batches:
            for part in pieces(batch, "text", 1 << 22):
                words = Words(part.column("text"))
                term, row, tf = q.find(words)
                length = np.diff(words.first)[row]
                index = Index(term, row, impacts(tf, length, idf[term], average), len(q.terms), part.num_rows)
                doc_ids = part.column("doc_id").to_numpy(zero_copy_only=False)
                copies = int(np.unique(doc_ids, return_counts=True)[1].max())
                for i, (terms, weight) in enumerate(q.of):
                    old_ids, old = found[i]
                    docs, scores, _ = index.top(terms, weight, k * copies, int(old[k - 1]) if len(old) == k else 0)
                    if len(docs):
                        found[i] = best(np.concatenate([old_ids, doc_ids[docs]]), np.concatenate([old, scores]), k)
        size = [len(x) for x, _ in found]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.array(q.ids, dtype=np.int64), size)), pa.array(np.concatenate([x for x, _ in found])), pa.array(np.concatenate([x for _, x in found]))], ["item_id", "doc_id", "score"]
        )

    return texts.mapInArrow(released(run), "item_id bigint, doc_id bigint, score bigint")


def search(docs: DataFrame, queries: DataFrame, k: int = K, query_id: str = "item_id", block: int = BLOCK) -> DataFrame:
    """item_id, doc_id, score (millionths), rank: the k best documents of each query."""
    texts = id_text(docs).where("doc_id is not null")
    asked = id_text(queries, query_id).where("doc_id is not null").groupBy("doc_id").agg(F.min("text").alias("text"))
    blocks = max(1, -(-asked.count() // block))
    results = []
    for i in range(blocks):
        rows = sorted(asked.where(F.pmod(F.xxhash64("doc_id"), F.lit(blocks)) == i).collect()) if blocks > 1 else sorted(asked.collect(), key=lambda r: r[0])
        if rows:
            results.append(_block(texts, [r[0] for r in rows], [r[1] for r in rows], k))
    if not results:
        return docs.sparkSession.createDataFrame([], RESULT)
    found = reduce(DataFrame.unionByName, results).groupBy("item_id", "doc_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


SQL = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\\x{80}-\\x{10FFFF}]+') AS w
  FROM documents WHERE doc_id IS NOT NULL),
q AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\\x{80}-\\x{10FFFF}]+')) AS term
  FROM benchmark WHERE item_id IS NOT NULL),
qt AS (SELECT item_id, term, count(*) AS qtf FROM q GROUP BY ALL),
n AS (SELECT count(*) AS n, sum(len(w)) / count(*) AS average FROM d),
p AS (SELECT doc_id, len(w) AS size, unnest(w) AS term FROM d),
tf AS (SELECT doc_id, size, term, count(*) AS tf FROM p WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
impact AS (
  SELECT doc_id, tf.term, CAST(round_even(1000000 * ln(1 + (n - df + CAST(0.5 AS DOUBLE)) / (df + CAST(0.5 AS DOUBLE)))
    * (tf * (CAST(1.2 AS DOUBLE) + 1)) / (tf + CAST(1.2 AS DOUBLE) * (1 - CAST(0.75 AS DOUBLE) + CAST(0.75 AS DOUBLE) * size / average)), 0) AS BIGINT) AS impact
  FROM tf JOIN df ON tf.term = df.term CROSS JOIN n),
s AS (SELECT item_id, doc_id, CAST(sum(qtf * impact) AS BIGINT) AS score FROM qt JOIN impact USING (term) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10
"""
