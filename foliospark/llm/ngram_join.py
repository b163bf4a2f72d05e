"""Operator 7: near-duplicate documents by the Jaccard similarity of word n-grams.

1. Documents with equal n-gram sets are collapsed to the lowest doc_id, so a
   document copied a million times is compared once.
2. MinHash values in bands: documents that agree in a whole band meet in its
   bucket.  A large bucket is cut into blocks, and each pair of blocks is a unit
   of work of bounded size; pairs of documents are built inside a unit only,
   in slabs, and never exchanged.  A pair is looked at in its first common band.
3. The MinHash values of a pair are compared step by step.  With a uniform
   prior, m agreements in n values give a Beta(m+1, n-m+1) posterior of the
   similarity; a pair is dropped once the posterior probability of reaching the
   threshold is below the tolerance.  A first pass over the values alone finds
   the documents that a unit needs; only these bring their n-grams.
4. The pairs left are verified on their n-gram sets, by bitmaps of shared ones.
   A unit returns for each document its number of links and the least document
   that it is connected with.
5. Connected documents are a class, named by its lowest doc_id.

Every document is a query; nothing is capped.  The result has a row for each
document that has a near duplicate: its class and its number of links, copies
included.

The search is approximate in 2 (a pair of similarity 0.5 shares a band with a
chance of 0.90, one of 0.7 with 0.9999) and in 3 by the tolerance.  n-grams are
44-bit hashes: two documents of a thousand n-grams have a common value by
chance in one of 17 million pairs.

Defined results: words are as in ``_text``; a text of fewer than n words has
its whole word sequence as only n-gram; a text without words (null, empty,
punctuation) matches nothing; rows with a null doc_id take no part; rows of one
doc_id are one document, of which the row with the least text counts; other
columns are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import cut, id_text, one_row_each, quoted
from ._text import U64, lists, mix, ngrams, packed, pieces, released, signed, unpacked, Words

N, THRESHOLD, BANDS, ROWS, TOLERANCE, STEP = 3, 0.5, 36, 4, 0.002, 16
_BITS = U64(20)  # shingles are 44-bit hashes
#: A block of a bucket has about so many documents, and so many n-grams, at most.
BLOCK, BLOCK_GRAMS = 1024, 1 << 20
_SLAB = 1 << 15


def shingles(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct n-gram hashes of each row one after another, bounds by row)."""
    words = Words(column)
    at, grams = ngrams(words.hash, words.row, n)
    rows = words.row[at]
    count = np.diff(words.first)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        whole = [mix(words.hash[words.first[r] : words.first[r + 1]] * U64(3) + np.arange(count[r], dtype=U64)).sum(dtype=U64) for r in short]
        rows, grams = np.concatenate([rows, short]), np.concatenate([grams, np.array(whole, dtype=U64)])
    key = np.sort((rows.astype(U64) << U64(44)) | (grams >> _BITS))
    key = key[np.r_[True, key[1:] != key[:-1]]] if len(key) else key
    bounds = np.searchsorted(key, np.arange(len(column) + 1, dtype=U64) << U64(44))
    return key & U64((1 << 44) - 1), bounds


def signatures(values: np.ndarray, bounds: np.ndarray, functions: int, seed: int = 1) -> np.ndarray:
    """MinHash values (rows, functions), the lower 16 bits of the least hash; a row without shingles has zeros."""
    factors = np.random.default_rng(seed).integers(0, 1 << 63, (2, functions), dtype=np.int64).astype(U64) * U64(2) + U64(1)
    full = np.flatnonzero(np.diff(bounds))
    result = np.zeros((len(bounds) - 1, functions), dtype=np.uint16)
    if len(full):
        hashed = np.empty_like(values)
        for k in range(functions):
            np.multiply(values, factors[0, k], out=hashed)
            hashed += factors[1, k]
            result[full, k] = np.minimum.reduceat((hashed >> U64(32)).astype(np.uint32), bounds[full]).astype(np.uint16)
    return result


def needed_agreements(functions: int, threshold: float, tolerance: float, step: int) -> list[tuple[int, int]]:
    """(values compared, least agreements to go on): the posterior is the binomial P(Bin(n+1, t) <= m)."""
    needed = []
    for n in range(step, functions + 1, step):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        needed.append((n, m))
    return needed


def _signed_docs(texts: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, size and two hash sums of the n-gram set, and the bands: each is ``rows`` values of 16 bits in one word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                values, bounds = shingles(part.column("text"), n)
                size = np.diff(bounds)
                signature = signatures(values, bounds, bands * rows)
                sums = []
                for salt in (1, 1 << 50):
                    run_ = np.zeros(len(values) + 1, dtype=U64)
                    np.cumsum(mix(values + U64(salt)), out=run_[1:])
                    sums.append(run_[bounds[1:]] - run_[bounds[:-1]])
                wide = np.zeros((len(size), bands, 4), dtype=np.uint16)
                wide[:, :, :rows] = signature.reshape(len(size), bands, rows)
                full = size > 0
                banded = wide.view(U64).reshape(len(size), bands)[full]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").filter(pa.array(full)), pa.array(size[full], pa.int32()), *(pa.array(signed(s)[full]) for s in sums), lists(signed(banded.ravel()), np.full(len(banded), bands), pa.int64())],
                    ["doc_id", "size", "set_a", "set_b", "bands"],
                )

    return texts.mapInArrow(released(run), "doc_id bigint, size int, set_a bigint, set_b bigint, bands array<bigint>")


def slabs(start: np.ndarray, stop: np.ndarray, block: np.ndarray, two: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (a, b > a) of the rows of each unit [start, stop), some ten thousands at a time; where ``two`` is set, only pairs of two blocks."""
    size = stop - start
    rows = np.arange(len(block))
    partners = np.repeat(stop, size) - rows - 1
    upto = np.cumsum(partners)
    at = 0
    while at < len(rows):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + _SLAB, side="right")))
        count = partners[at:end]
        a = np.repeat(rows[at:end], count)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count)
        keep = ~two[a] | (block[a] != block[b])
        yield a[keep], b[keep]
        at = end


def survivors(bands: np.ndarray, rows: int, band: np.ndarray, a: np.ndarray, b: np.ndarray, needed: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs whose first common band is this one and whose posterior stays above the tolerance."""
    first = (bands[a] == bands[b]).argmax(axis=1) == band[a]
    a, b = a[first], b[first]
    values = bands.view(np.uint16).reshape(len(bands), -1, 4)[:, :, :rows].reshape(len(bands), -1)
    agree, done = np.zeros(len(a), dtype=np.int64), 0
    for n, least in needed:
        agree += (values[a, done:n] == values[b, done:n]).sum(axis=1)
        on = agree >= least
        a, b, agree, done = a[on], b[on], agree[on], n
    return a, b


def intersections(grams: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets a[i] and b[i], by bitmaps of the values that two sets have at least."""
    who = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
    flat = np.concatenate(grams)
    by = np.argsort(flat, kind="stable")
    flat, who = flat[by], who[by]
    edge = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1], True])
    count = np.diff(edge)
    many = np.repeat(count > 1, count)
    name = (np.cumsum(count > 1) - 1).repeat(count)[many]
    who = who[many]
    common = np.zeros(len(a), dtype=np.int64)
    for low in range(0, int(name[-1]) + 1 if len(name) else 0, 1 << 16):
        s, e = np.searchsorted(name, [low, low + (1 << 16)])
        width = -(-(int(name[e - 1]) - low + 1) // 64)
        bits = np.zeros((len(grams), width * 8), dtype=np.uint8)
        column = name[s:e] - low
        np.bitwise_or.at(bits, (who[s:e], column >> 3), (1 << (column & 7)).astype(np.uint8))
        bits = bits.view(U64)
        step = max(1, (1 << 20) // width)
        for at in range(0, len(a), step):
            common[at : at + step] += np.bitwise_count(bits[a[at : at + step]] & bits[b[at : at + step]]).sum(axis=1, dtype=np.int64)
    return common


def connected(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node that it is connected with."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def whole_units(batches: Iterator[pa.RecordBatch], keys: list[str], limit: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Batches that hold whole units (rows of equal keys are adjacent), of about ``limit`` bytes or one unit."""
    held: list[pa.RecordBatch] = []
    size = 0

    def key(batch: pa.RecordBatch, i: int) -> tuple:
        return tuple(batch.column(k)[i].as_py() for k in keys)

    def joined(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if parts:
            yield from pa.Table.from_batches(parts).combine_chunks().to_batches()

    for batch in batches:
        at = 0
        while at < batch.num_rows:
            if size < limit:
                take = max(1, min(batch.num_rows - at, int((limit - size) * (batch.num_rows / max(1, batch.nbytes)))))
                held.append(batch.slice(at, take))
                size += batch.nbytes * take // batch.num_rows + 1
                at += take
                continue
            last = key(held[-1], held[-1].num_rows - 1)
            end = at
            step = 1
            while end < batch.num_rows and key(batch, end) == last:  # doubling, then halving: rows of a unit are adjacent
                end, step = min(batch.num_rows, end + step), step * 2
            while end > at and key(batch, end - 1) != last:
                low, high = at, end
                while low < high:
                    middle = (low + high) // 2
                    low, high = (middle + 1, high) if key(batch, middle) == last else (low, middle)
                end = low
            if end > at:
                held.append(batch.slice(at, end - at))
                at = end
            if at < batch.num_rows:
                yield from joined(held)
                held, size = [], 0
    yield from joined(held)


_UNIT = ["band", "value", "low", "high"]


def _bounds(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    change = np.zeros(batch.num_rows, dtype=bool)
    change[0] = True
    for k in _UNIT:
        x = batch.column(k).to_numpy(zero_copy_only=False)
        change[1:] |= x[1:] != x[:-1]
    start = np.flatnonzero(change)
    return start, np.append(start[1:], batch.num_rows)


def _bands(batch: pa.RecordBatch) -> np.ndarray:
    return np.ascontiguousarray(batch.column("bands").flatten().to_numpy()).reshape(batch.num_rows, -1).view(U64)


def near_classes(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, class_id (the lowest doc_id that it is connected with), links (documents that are similar to it)."""
    if rows > 4:
        raise ValueError("a band has 4 values at most")
    return _classes(one_row_each(id_text(docs)), n, threshold, bands, rows, tolerance)


def _classes(texts: DataFrame, n: int = N, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, tolerance: float = TOLERANCE) -> DataFrame:
    """near_classes of texts (doc_id, text) that have each doc_id once."""
    signed_docs = cut(_signed_docs(texts, n, bands, rows))
    sets = ["set_a", "set_b", "size"]
    owner = cut(signed_docs.groupBy(*sets).agg(F.min("doc_id").alias("doc"), F.count("*").alias("copies"), F.first("bands").alias("bands")))
    needed = needed_agreements(bands * rows, threshold, tolerance, STEP)

    # units: buckets, or pairs of blocks of a bucket
    members = owner.select("doc", "size", F.posexplode("bands").alias("band", "value"))
    crowds = members.groupBy("band", "value").agg(F.count("*").alias("n"), F.sum("size").alias("grams")).where("n > 1")
    crowds = crowds.select("band", "value", F.expr(f"cast(ceil(greatest(n / {BLOCK}, grams / {BLOCK_GRAMS})) as int)").alias("blocks"))
    placed = members.select("doc", "band", "value").join(crowds, ["band", "value"]).withColumn("block", F.expr("cast(pmod(xxhash64(doc), blocks) as int)"))
    placed = placed.select("doc", "band", "value", "block", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other"))
    placed = placed.select("doc", "band", "value", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    met = placed.join(owner.select("doc", "bands"), "doc")

    def pairs_of(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        start, stop = _bounds(batch)
        word, band, block = _bands(batch), batch.column("band").to_numpy(), batch.column("block").to_numpy()
        two = batch.column("low").to_numpy() != batch.column("high").to_numpy()
        for a, b in slabs(start, stop, block, two):
            yield survivors(word, rows, band, a, b, needed)

    def needs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_units(batches, _UNIT):
            wanted = np.zeros(batch.num_rows, dtype=bool)
            for a, b in pairs_of(batch):
                wanted[a] = wanted[b] = True
            yield batch.filter(pa.array(wanted)).select(["doc", *_UNIT, "block"])

    unit_type = "band int, value bigint, low int, high int, block int"
    units = met.repartition(*_UNIT).sortWithinPartitions(*_UNIT).mapInArrow(released(needs), f"doc bigint, {unit_type}")
    brought = cut(units).join(owner.select("doc", "copies", "bands"), "doc").join(packed(texts).withColumnRenamed("doc_id", "doc"), "doc")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_units(batches, _UNIT):
            start, _ = _bounds(batch)
            copies, doc = batch.column("copies").to_numpy(), batch.column("doc").to_numpy()
            parts = [shingles(part.column("text"), n) for part in unpacked(batch)]
            values, size = np.concatenate([v for v, _ in parts]), np.concatenate([np.diff(b) for _, b in parts])
            bounds = np.r_[0, np.cumsum(size)]
            left, right = (np.concatenate(x) for x in zip(*pairs_of(batch), strict=True))
            of = np.searchsorted(start, left, side="right") - 1
            links, label = np.zeros(len(doc), dtype=np.int64), np.arange(len(doc))
            for unit in np.unique(of).tolist():
                mine = of == unit if len(start) > 1 else slice(None)
                a, b = left[mine], right[mine]
                used, place = np.unique(np.concatenate([a, b]), return_inverse=True)
                common = intersections([values[bounds[i] : bounds[i + 1]] for i in used.tolist()], place[: len(a)], place[len(a) :])
                good = common >= threshold * (size[a] + size[b] - common)
                x, y = place[: len(a)][good], place[len(a) :][good]
                links[used] += np.bincount(x, copies[used[y]], len(used)).astype(np.int64) + np.bincount(y, copies[used[x]], len(used)).astype(np.int64)
                least = np.argsort(doc[used], kind="stable")  # labels by doc_id
                rank = np.empty_like(least)
                rank[least] = np.arange(len(least))
                label[used] = used[least[connected(len(used), rank[x], rank[y])[rank]]]
            on = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(doc[on]), pa.array(links[on]), pa.array(doc[label[on]])], ["doc", "links", "root"])

    found = cut(brought.repartition(*_UNIT).sortWithinPartitions(*_UNIT).mapInArrow(released(verify), "doc bigint, links bigint, root bigint"))
    linked = found.groupBy("doc").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("doc").alias("doc_a"), F.col("root").alias("doc_b")))
    classes = (
        owner.select(*sets, "doc", "copies")
        .join(linked, "doc", "left")
        .join(roots.withColumnRenamed("doc_id", "doc"), "doc", "left")
        .where("copies > 1 or links is not null")
        .select(*sets, F.coalesce("root", "doc").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    )
    return signed_docs.select("doc_id", *sets).join(classes, sets).select("doc_id", "class_id", "links")


def components(edges: DataFrame) -> DataFrame:
    """(doc_id, root): the least doc_id that each doc_id of the edges (doc_a, doc_b) is connected with.

    Alternating large-star and small-star steps, each a shuffle of the edges,
    until nothing changes; lineage is cut in each round.
    """
    now = edges.select(F.greatest("doc_a", "doc_b").alias("u"), F.least("doc_a", "doc_b").alias("v")).where("u != v").distinct()

    def stars(graph: DataFrame) -> DataFrame:
        both = graph.select("u", "v").unionByName(graph.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        return joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v"))).distinct()

    mark = None
    while True:
        now = cut(stars(now))
        # stable when every node has one edge, to a root that has none
        new = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == mark:
            return now.select(F.col("u").alias("doc_id"), F.col("v").alias("root"))
        mark = new


def drop_duplicates(docs: DataFrame, **options) -> DataFrame:
    """docs without the near duplicates of another document: of each class the lowest doc_id stays.

    Rows with a null doc_id stay; of several rows with one doc_id, the one stays
    that the join compared, with the least text.
    """
    single = one_row_each(docs)
    losers = _classes(id_text(single), **options).where("doc_id != class_id").select("doc_id")
    return single.join(losers, "doc_id", "left_anti").select(*map(quoted, docs.columns)).unionByName(docs.where("doc_id is null"))
