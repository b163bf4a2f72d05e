"""Operator 2: substring dedup by bucket-pointer refinement of a sampled suffix array.

Suffixes start at words.  The aim is every passage of at least ``length`` words
that occurs twice in the corpus.

1. Sampling: of the q-gram hashes in each run of length - q + 1 adjacent
   suffixes the least is sampled (minimizers), so every passage of ``length``
   words has a sampled suffix, at the same place in each of its occurrences.  A
   sampled suffix whose q-gram is there once drops out; what can begin a
   repeated passage are the suffixes within reach of those that are left.
2. Initial buckets: these suffixes are sorted by their q-gram.  The identifier
   of a bucket is a pointer to its first suffix, by (doc_id, word).  A suffix
   that is alone in its bucket is final and drops out.
3. Refinement: a bucket of depth d is split by sorting its suffixes on the
   pointers of the buckets that the suffixes d words later are in, which are in
   the same document; a suffix whose later one has dropped out drops out too.
   The new buckets have depth 2d (at most ``length``), and their pointers are
   what the next round sorts on, until the depth is ``length``.

In the last round, keys that point twice into one document, at the offset, are
final as they are: the bucket's first suffix is where they point.  Such suffixes
come in runs, and only the runs are exchanged, to tell the first ones that they
occur again.

Only the q-grams, and the pairs of pointers of the last round, are hashes, of 64
bits: that two different ones of n are equal has a chance of n**2 / 2**65.

Spans of adjacent repeated suffixes are united.  The result has for each span
the document, its words [start, stop), whether its passages occur there first
(``keep``), and where the passage at its start occurs first.

Defined results: words are as in ``_text``; a null or empty text, or one
shorter than ``length`` words, has no span; rows with a null doc_id take no
part; rows of one doc_id are one document, of which the row with the least
text counts; a passage repeated inside one document counts as repeated; other
columns are not looked at; an empty table gives no spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import cut, id_text, one_row_each, salted, sample
from ._text import U64, mix, ngrams, packed, pieces, released, signed, unpacked, Words
from .ngram_join import whole_units

LENGTH = 50


def _windowed_least(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each w adjacent values, by doubling."""
    size = 1
    while size * 2 <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (w - size)], x[w - size :]) if w > size else x


def minimizers(at: np.ndarray, grams: np.ndarray, row: np.ndarray, w: int) -> np.ndarray:
    """Indices into at of the sampled q-grams: those that are least in some w adjacent ones of a row."""
    m = len(at) - w + 1
    if m <= 0:
        return np.zeros(0, dtype=np.int64)
    whole = row[at[:m]] == row[at[w - 1 :]]
    least = np.zeros(len(at), dtype=U64)
    least[:m] = np.where(whole, _windowed_least(grams, w), U64(0))
    # a q-gram is sampled if it equals the least of one of the w windows that hold it
    starts = np.flatnonzero(whole)
    chosen = np.zeros(len(at), dtype=bool)
    current = least[starts]
    for shift in range(w):
        here = starts + shift
        chosen[here[grams[here] == current]] = True
    return np.flatnonzero(chosen)


def depths(q: int, length: int) -> list[int]:
    """Offsets at which the steps look: depth d becomes d + offset."""
    offsets = []
    while q < length:
        offsets.append(min(q, length - q))
        q += offsets[-1]
    return offsets


def _sampled(texts: DataFrame, q: int, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                words = Words(part.column("text"))
                at, grams = ngrams(words.hash, words.row, q)
                chosen = minimizers(at, grams, words.row, length - q + 1)
                place = at[chosen]
                row = words.row[place]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(grams[chosen])), part.column("doc_id").take(pa.array(row)), pa.array(place - words.first[row], pa.int32())], ["bucket", "doc_id", "word"]
                )

    return texts.mapInArrow(released(run), "bucket bigint, doc_id bigint, word int")


def _opened(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """doc_id, words and the text of packed texts."""
    at = 0
    for part in unpacked(batch):
        yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(at, part.num_rows) for c in ("doc_id", "words")), part.column("text")], ["doc_id", "words", "text"])
        at += part.num_rows


def _reached(docs: DataFrame, q: int, length: int, all_: bool = False) -> DataFrame:
    """Suffixes within reach of the sampled ones in ``words``, with their q-grams; or all suffixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in (pieces(batch, "text") if all_ else _opened(batch))):
            words = Words(part.column("text"))
            at, grams = ngrams(words.hash, words.row, q)
            if not all_:
                sampled = part.column("words")
                flat = sampled.flatten().to_numpy().astype(np.int64)
                owner = np.repeat(np.arange(len(sampled)), np.diff(np.asarray(sampled.offsets)))
                flat += words.first[owner]
                # from where a passage that holds the sampled q-gram may begin, to where its last q-gram may
                change = np.zeros(len(words.hash) + 1, dtype=np.int32)
                np.add.at(change, np.maximum(flat - (length - q), words.first[owner]), 1)
                np.add.at(change, np.minimum(flat + (length - q), words.first[owner + 1] - 1) + 1, -1)
                reach = (np.cumsum(change[:-1]) > 0)[at]
                at, grams = at[reach], grams[reach]
            row = words.row[at]
            yield pa.RecordBatch.from_arrays([pa.array(signed(grams)), part.column("doc_id").take(pa.array(row)), pa.array(at - words.first[row], pa.int32())], ["bucket", "doc_id", "word"])

    return docs.mapInArrow(released(run), "bucket bigint, doc_id bigint, word int")


def _pointed(rows: DataFrame, keys: list[str], spread: bool) -> DataFrame:
    """doc_id, word and ``to``, the first suffix of its bucket, of rows whose bucket (equal keys) has several."""
    # windows, not lists: a bucket may hold any number of suffixes, and its sort can spill; very large ones are spread over salts
    window = Window.partitionBy(*keys, "salt") if spread else Window.partitionBy(*keys)
    placed = rows.withColumns({"n": F.count("*").over(window), "to": F.min(F.struct("doc_id", "word")).over(window)})
    if spread:
        salted_ = placed.where("salts > 1 and doc_id = to.doc_id and word = to.word").groupBy(*keys).agg(F.min("to").alias("least"), F.sum("n").alias("total"))
        placed = placed.join(salted_, keys, "left").withColumns({"to": F.coalesce("least", "to"), "n": F.coalesce("total", "n")})
    kept = placed.where("n > 1").select("doc_id", "word", F.col("to.doc_id").alias("to_doc"), F.col("to.word").alias("to_word"), *(["salts", "salt"] if spread else []))
    return kept


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Batches of whole documents, sorted by (doc_id, word): the batch, doc_id, word, number of the document."""
    for batch in whole_units(batches, ["doc_id"]):
        doc, word = batch.column("doc_id").to_numpy(), batch.column("word").to_numpy().astype(np.int64)
        yield batch, doc, word, np.cumsum(np.r_[False, doc[1:] != doc[:-1]])


def _later(pointed: DataFrame, offset: int) -> DataFrame:
    """Of the suffixes whose later one, by the offset, is left too: the pointers of both buckets."""
    more = [c for c in pointed.columns if c in ("salts", "salt")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, word, number in _by_document(batches):
            key = number << 32 | word
            at = np.minimum(np.searchsorted(key, key + offset), len(key) - 1)
            here = np.flatnonzero(key[at] == key + offset)
            mine, later = batch.take(pa.array(here)), batch.take(pa.array(at[here]))
            columns = [mine.column(c) for c in ("doc_id", "word", "to_doc", "to_word", *more)]
            yield pa.RecordBatch.from_arrays([*columns, later.column("to_doc"), later.column("to_word")], ["doc_id", "word", "a_doc", "a_word", *more, "b_doc", "b_word"])

    schema = "doc_id bigint, word int, a_doc bigint, a_word int, " + "".join(f"{c} int, " for c in more) + "b_doc bigint, b_word int"
    return pointed.repartition("doc_id").sortWithinPartitions("doc_id", "word").mapInArrow(released(run), schema)


def _last(pointed: DataFrame, offset: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """_later in runs of n suffixes: kind 0 points twice into another place (to_doc, to_word), at the offset; 1 so to itself;
    2 are single suffixes of other keys, with both pointers as one identifier of 64 bits in to_doc.  A batch is one compressed value, for a table
    that is written and read three times."""
    more = [c for c in pointed.columns if c in ("salts", "salt")]
    names = ["kind", "doc_id", "word", "n", "to_doc", "to_word", *more]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, doc, word, number in _by_document(batches):
            key = number << 32 | word
            at = np.minimum(np.searchsorted(key, key + offset), len(key) - 1)
            here = np.flatnonzero(key[at] == key + offset)
            later = at[here]
            to_doc, to_word = batch.column("to_doc").to_numpy(), batch.column("to_word").to_numpy().astype(np.int64)
            a_doc, a_word, b_doc, b_word = to_doc[here], to_word[here], to_doc[later], to_word[later]
            doc, word, number = doc[here], word[here], number[here]
            final = (a_doc == b_doc) & (b_word == a_word + offset)
            kind = np.where(final, (a_doc == doc) & (a_word == word), 2).astype(np.int32)
            going = final[1:] & (kind[1:] == kind[:-1]) & (number[1:] == number[:-1]) & (word[1:] == word[:-1] + 1) & (a_doc[1:] == a_doc[:-1]) & (a_word[1:] == a_word[:-1] + 1)
            start = np.flatnonzero(np.r_[True, ~going]) if len(doc) else np.zeros(0, dtype=np.int64)
            n = np.diff(np.append(start, len(doc)))
            pair = np.zeros(len(doc), dtype=U64)
            for x in (a_doc, a_word, b_doc, b_word):
                pair = mix(pair * U64(5) + x.astype(np.int64).view(U64))
            to = np.where(kind == 2, signed(pair), a_doc)
            columns = [kind[start], doc[start], word[start].astype(np.int32), n.astype(np.int32), to[start], a_word[start].astype(np.int32)]
            made = pa.RecordBatch.from_arrays([*map(pa.array, columns), *(batch.column(c).take(pa.array(here[start])) for c in more)], names)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, made.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                stream.write_batch(made)
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["rows"])

    def opened(kind: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for value in batch.column("rows").to_pylist():
                    for made in pa.ipc.open_stream(value):
                        yield made.filter(pa.compute.equal(made.column("kind"), kind))

        return table.mapInArrow(run, "kind int, doc_id bigint, word int, n int, to_doc bigint, to_word int" + "".join(f", {c} int" for c in more))

    table = cut(pointed.repartition("doc_id").sortWithinPartitions("doc_id", "word").mapInArrow(released(run), "rows binary"))
    return opened(0), opened(1), opened(2)


def _told(rows: DataFrame) -> DataFrame:
    """Of the first suffixes (kind 1), in runs, those that a run elsewhere (kind 0: the place it points to) says occur again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, doc, word, number in _by_document(batches):
            kind, n = batch.column("kind").to_numpy(), batch.column("n").to_numpy().astype(np.int64)
            begin = number << 32 | word
            says, own = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
            if not len(says) or not len(own):
                continue
            until = np.maximum.accumulate(begin[says] + n[says])
            size = n[own]
            row = np.repeat(own, size)
            place = begin[row] + np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            at = np.searchsorted(begin[says], place, side="right") - 1
            good = (at >= 0) & (until[at] > place)
            place, row = place[good], row[good]
            start = np.flatnonzero(np.r_[True, place[1:] != place[:-1] + 1]) if len(place) else np.zeros(0, dtype=np.int64)
            columns = [doc[row[start]], (place[start] & 0xFFFFFFFF).astype(np.int32), np.diff(np.append(start, len(place))).astype(np.int32)]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["doc_id", "word", "n"])

    return rows.repartition("doc_id").sortWithinPartitions("doc_id", "word").mapInArrow(released(run), "doc_id bigint, word int, n int")


def repeated_runs(docs: DataFrame, length: int = LENGTH, q: int | None = None) -> DataFrame:
    """doc_id, word, n, first_doc, first_word: n adjacent suffixes whose first ``length`` words occur twice, and where the first of them occurs first."""
    q = q or max(1, length // 2)
    texts = one_row_each(id_text(docs))
    sampled, spread = salted(_sampled(texts, q, length), _sampled(sample(texts), q, length), "bucket")
    window = Window.partitionBy("bucket", "salt") if spread else Window.partitionBy("bucket")
    left = sampled.withColumn("n", F.count("*").over(window)).where("n > 1 or salts > 1" if spread else "n > 1").groupBy("doc_id").agg(F.collect_set("word").alias("words"))
    suffixes = _reached(left.join(packed(texts), "doc_id").select("doc_id", "words", "packed"), q, length)
    suffixes, spread = salted(suffixes, _reached(sample(texts), q, length, all_=True), "bucket")
    pointed, keys = _pointed(suffixes, ["bucket"], spread), ["a_doc", "a_word", "b_doc", "b_word"]
    offsets = depths(q, length)
    for offset in offsets[:-1]:
        pointed = _pointed(_later(pointed, offset), keys, spread)
    first = [F.col("to_doc").alias("first_doc"), F.col("to_word").alias("first_word")]
    if not offsets:
        return pointed.select("doc_id", "word", F.lit(1).alias("n"), *first)
    copies, own, loose = _last(pointed, offsets[-1])
    others = _pointed(loose.withColumnRenamed("to_doc", "bucket").drop("kind", "n", "to_word"), ["bucket"], spread).select("doc_id", "word", F.lit(1).alias("n"), *first)
    again = copies.select("doc_id", "word", "n", F.col("to_doc").alias("first_doc"), F.col("to_word").alias("first_word"))
    says = again.groupBy(F.col("first_doc").alias("doc_id"), F.col("first_word").alias("word")).agg(F.max("n").alias("n"), F.lit(0).alias("kind"))
    own = _told(own.select("doc_id", "word", "n", "kind").unionByName(says))
    return others.unionByName(again).unionByName(own.select("*", F.col("doc_id").alias("first_doc"), F.col("word").alias("first_word")))


def repeated_suffixes(docs: DataFrame, length: int = LENGTH, q: int | None = None) -> DataFrame:
    """doc_id, word, first_doc, first_word: each suffix whose first ``length`` words occur twice."""
    each = repeated_runs(docs, length, q).withColumn("i", F.explode(F.expr("sequence(0, n - 1)")))
    return each.select("doc_id", (F.col("word") + F.col("i")).alias("word"), "first_doc", (F.col("first_word") + F.col("i")).alias("first_word"))


def repeated_passages(docs: DataFrame, length: int = LENGTH, q: int | None = None) -> DataFrame:
    """doc_id, start, stop, keep, first_doc, first_word: spans of words that occur elsewhere too.

    Spans with keep hold first occurrences; the others repeat earlier text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, doc, word, number in _by_document(batches):
            first_doc, first_word = batch.column("first_doc").to_numpy(), batch.column("first_word").to_numpy()
            end = word + batch.column("n").to_numpy() - 1
            keep = (first_doc == doc) & (first_word == word)
            new = np.flatnonzero(np.r_[True, (number[1:] != number[:-1]) | (word[1:] > end[:-1] + length) | (keep[1:] != keep[:-1])])
            last = np.append(new[1:], len(doc)) - 1
            columns = [doc[new], word[new].astype(np.int32), (end[last] + length).astype(np.int32), keep[new], first_doc[new], first_word[new]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["doc_id", "start", "stop", "keep", "first_doc", "first_word"])

    found = repeated_runs(docs, length, q).repartition("doc_id").sortWithinPartitions("doc_id", "word")
    return found.mapInArrow(released(run), "doc_id bigint, start int, stop int, keep boolean, first_doc bigint, first_word int")


#: By the hashes of all runs of 50 words; ids don't repeat in the table.
SQL = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents WHERE doc_id IS NOT NULL),
p AS (SELECT doc_id, w, unnest(range(0, greatest(len(w) - {LENGTH - 1}, 0))) AS word FROM w),
g AS (SELECT doc_id, word, md5(array_to_string(w[word + 1:word + {LENGTH}], ' ')) AS gram FROM p),
f AS (SELECT doc_id, word, count(*) OVER (PARTITION BY gram) AS n, first_value(doc_id) OVER o AS first_doc, first_value(word) OVER o AS first_word FROM g WINDOW o AS (PARTITION BY gram ORDER BY doc_id, word)),
k AS (SELECT *, first_doc = doc_id AND first_word = word AS keep FROM f WHERE n > 1),
s AS (SELECT *, CASE WHEN word <= lag(word) OVER o + {LENGTH} AND keep = lag(keep) OVER o THEN 0 ELSE 1 END AS starts FROM k WINDOW o AS (PARTITION BY doc_id ORDER BY word)),
u AS (SELECT *, sum(starts) OVER (PARTITION BY doc_id ORDER BY word) AS span FROM s)
SELECT doc_id, CAST(min(word) AS INTEGER) AS start, CAST(max(word) + {LENGTH} AS INTEGER) AS stop, bool_and(keep) AS keep, arg_min(first_doc, word) AS first_doc, CAST(arg_min(first_word, word) AS INTEGER) AS first_word FROM u GROUP BY doc_id, span
"""
