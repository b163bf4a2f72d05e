"""Operator 6: near-duplicate passages by compact windows.

A document is a sequence of tokens, here the hashes of its runs of q words.
For one hash function, all its subsequences of at least t tokens are grouped by
the position c of their least value: the Cartesian tree of the values gives
*compact windows* (l, c, r), each standing for all subsequences that begin in
[l, c] and end in [c, r].  There are about 2n / (t + 1) of them.  A window goes
2t tokens to either side of c; a longer passage has several such c, and their
spans overlap.

1. Windows of several hash functions; those with an equal least value meet as a
   unit.  Equal windows are exact copies: one of them, with their number, goes on.
2. The distinct windows of a unit meet with their tokens.  Each is trimmed to
   where enough of its tokens are shared with other documents, so a passage in
   many surroundings is one version again; equal token sets are linked, and one of them goes on.
3. All pairs of versions of a unit are compared, by bitmaps of shared tokens.
   A pair that has enough equal tokens is verified: the exact Jaccard
   similarity of the two token sets as trimmed, or, below the threshold, of the
   parts around c where the tokens are shared with the other one.  Pairs are
   never exchanged: a window reports its links, the span of
   them, and the least window that it is connected with.
4. Interval join: spans of a document's windows, of all functions, that overlap are one
   passage; passages that are linked through their windows are a class.

Nothing is capped.  A unit with very many windows is cut into blocks; versions
that are left in each block meet once more in pairs of blocks, so that any two
are compared and no task has more than two blocks.  Values that very many
windows have are found in a sample of documents and salted before the first exchange.

Each passage has a row: its class, named by its first passage (lowest doc_id,
then start), and its links, the most occurrences in any document that one of
its windows is linked with, exact copies included.  The search is approximate
only in 1: near copies whose least tokens differ in all functions are missed.
A token that repeats in a window counts at its first place.

Defined results: words are as in ``_text``; null, empty and short texts have no
passage; rows with a null doc_id take no part; rows of one doc_id are one
document, of which the row with the least text counts; passages repeated within
one document don't count (operators 2 and 5 find them); other columns are not
looked at; an empty table gives no passages.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from ._spark import cut, id_text, map_rows, one_row_each, quoted, salted, sample, unused
from ._text import U64, mix, ngrams, packed, pieces, released, signed, unpacked, Words
from .ngram_join import components, connected, whole_units

Q, TOKENS, FUNCTIONS, THRESHOLD = 5, 44, 4, 0.7
_SEEDS = mix(np.arange(1, 65, dtype=U64) * U64(0x632BE59BD9B4E019))
SIDES = 2  # times t: so far a window goes to either side of c
TABLE_SIZE = 1 << 26  # places of a table; where a batch's has more, some versions are verified together, one group after the other
SMALL = 8  # units of so many versions are compared all together
TILE, DENSE, LEAST_CELLS = 128, 32, 512  # versions of a side of a grid of pairs; it is worked out as a whole where one in DENSE of its pairs, and LEAST_CELLS, are wanted
BLOCK = 4096  # windows of a block of a large unit


def compact_windows(values: np.ndarray, row: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r) of all compact windows of at least t tokens; equal least tokens share one window, c is the leftmost.

    All intervals of one depth of the Cartesian trees are split at once, at all
    their least tokens; so a text of few distinct tokens has shallow trees.
    """
    at = np.arange(len(values))
    fresh = np.r_[True, row[1:] != row[:-1]] if len(row) else np.zeros(0, dtype=bool)
    left, middle, right = [], [], []
    while len(at):
        start = np.flatnonzero(fresh)
        size = np.diff(np.append(start, len(at)))
        big = size >= t
        if not big.all():
            keep = np.repeat(big, size)
            at, fresh = at[keep], fresh[keep]
            if not len(at):
                break
            start, size = np.flatnonzero(fresh), size[big]
        v = values[at]
        hit = np.flatnonzero(v == np.repeat(np.minimum.reduceat(v, start), size))
        c = hit[np.searchsorted(hit, start)]  # index of the leftmost least value of each interval
        left.append(at[start])
        middle.append(at[c])
        right.append(at[start + size - 1])
        keep = np.ones(len(at), dtype=bool)
        keep[hit] = False
        after = hit + 1
        fresh[after[after < len(at)]] = True
        at, fresh = at[keep], fresh[keep]
    empty = [np.zeros(0, dtype=np.int64)]
    return np.concatenate(left or empty), np.concatenate(middle or empty), np.concatenate(right or empty)


def _tokens(column: pa.Array, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token hashes, row of each, bounds by row)."""
    words = Words(column)
    at, grams = ngrams(words.hash, words.row, q)
    row = words.row[at]
    return grams, row, np.searchsorted(row, np.arange(len(column) + 1))


def _windows(texts: DataFrame, q: int, t: int, functions: int) -> DataFrame:
    """key (its lowest bits are the function), doc_id, content (a hash of the window's tokens and of c in it), reach (l, c - l and r - c)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                tokens, row, first = _tokens(part.column("text"), q)
                if not len(tokens):
                    continue
                ids = part.column("doc_id")
                sums = np.zeros(len(tokens) + 1, dtype=U64)
                np.cumsum(mix(tokens), out=sums[1:])
                for f in range(functions):
                    values = mix(tokens ^ _SEEDS[f])
                    left, c, right = compact_windows(values, row, t)
                    if not len(c):
                        continue
                    left, right = np.maximum(left, c - SIDES * t), np.minimum(right, c + SIDES * t)
                    content = mix(sums[right + 1] - sums[left] + mix(((c - left).astype(U64) << U64(32)) | (right - left).astype(U64)))
                    base = first[row[c]]
                    key = (values[c] & ~U64(63)) | U64(f)
                    reach = ((left - base).astype(U64) << U64(32)) | ((c - left).astype(U64) << U64(16)) | (right - c).astype(U64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(signed(key)), ids.take(pa.array(row[c])), pa.array(signed(content)), pa.array(signed(reach))], ["key", "doc_id", "content", "reach"]
                    )

    return texts.mapInArrow(released(run), "key bigint, doc_id bigint, content bigint, reach bigint")


def _met(texts: DataFrame, q: int, t: int, functions: int) -> DataFrame:
    """Windows of values that several documents have: key, block, content, doc_id, reach; of the equal ones the first (doc, at), their number and their last document."""
    windows, spread = salted(_windows(texts, q, t, functions), _windows(sample(texts), q, t, functions), "key")
    own = ["key", "salt"] if spread else ["key"]
    unit = Window.partitionBy(*own)
    met = windows.withColumns({"low": F.min("doc_id").over(unit), "high": F.max("doc_id").over(unit), "n": F.count("*").over(unit)})
    met = met.where("low < high or salts > 1" if spread else "low < high")
    # 0: a unit of its own; others: blocks of a unit, by document
    block = f"cast(pmod(xxhash64(doc_id, 1), ceil(n / {BLOCK})) as int)"
    block = f"if(salts > 1 or n > {BLOCK}, salt * 1048576 + {block} + 1, 0)" if spread else f"if(n > {BLOCK}, {block} + 1, 0)"
    met = met.withColumn("block", F.expr(block))
    same = Window.partitionBy(*own, "block", "content")
    met = met.withColumns({"one": F.min(F.struct("doc_id", "reach")).over(same), "copies": F.count("*").over(same), "last": F.max("doc_id").over(same)})
    varied = Window.partitionBy(*own, "block")
    met = met.withColumn("varied", F.min("content").over(varied) < F.max("content").over(varied))
    return met.select("key", "block", "content", "doc_id", "reach", F.col("one.doc_id").alias("doc"), F.col("one.reach").alias("at"), "copies", "last", "varied")


def _contents(windows: DataFrame, texts: DataFrame, q: int) -> DataFrame:
    """windows (doc, at, key and others) with c, the place of the least token in the window, and words, two bytes of each of its words."""
    names = [x for x in windows.columns if x != "doc"]
    kinds = {x.name: x.dataType.simpleString() for x in windows.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in unpacked(batch, 1 << 20):
                mine = batch.slice(at, part.num_rows)
                at += part.num_rows
                all_ = Words(part.column("text"))
                lists_ = mine.column("windows")
                flat = lists_.flatten()
                row = np.repeat(np.arange(part.num_rows), np.diff(np.asarray(lists_.offsets)))
                reach = flat.field("at").to_numpy()
                c = reach >> 16 & 0xFFFF
                low = (reach >> 32) + all_.first[row]
                high = low + c + (reach & 0xFFFF) + q
                short = all_.hash.astype(np.uint16).tobytes()
                words = [short[2 * s : 2 * e] for s, e in zip(low.tolist(), high.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(flat.field(x) for x in names), mine.column("doc").take(pa.array(row)), pa.array(c.astype(np.int32)), pa.array(words, pa.binary())], [*names, "doc", "c", "words"])

    schema = ", ".join(f"{x} {kinds[x]}" for x in names) + ", doc bigint, c int, words binary"
    by_doc = windows.groupBy("doc").agg(F.collect_list(F.struct(*names)).alias("windows"))  # as many as a document has
    return by_doc.join(packed(texts).withColumnRenamed("doc_id", "doc"), "doc").select("doc", "windows", "packed").mapInArrow(released(run), schema)


def _around(score: np.ndarray, good: np.ndarray, begin: np.ndarray, end: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each interval [begin, end) of tokens the first and last good one that a run around c of no negative score has; c itself if there is none."""
    sums = np.r_[0, np.cumsum(score)]
    # sums[c + 1 .. end] and sums[begin .. c]
    most = np.maximum.reduceat(np.append(sums, sums[-1]), np.ravel([c + 1, end + 1], "F"))[::2]
    least = np.minimum.reduceat(np.append(sums, sums[-1]), np.ravel([begin, c + 1], "F"))[::2]
    size = end - begin
    row = np.repeat(np.arange(len(begin)), size)
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - begin, size)
    fit = good[at]
    left = np.where(fit & (at <= c[row]) & (most[row] >= sums[at]), at, c[row])
    right = np.where(fit & (at >= c[row]) & (sums[at + 1] >= least[row]), at, c[row])
    first = np.cumsum(size) - size
    return np.minimum.reduceat(left, first), np.maximum.reduceat(right, first)


class _Unit:
    """Windows of a batch of whole units, rows by unit and document, with their tokens."""

    def __init__(self, batch: pa.RecordBatch, start: np.ndarray, q: int, threshold: float) -> None:
        column = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
        self.doc, self.last, self.weight = column("doc"), column("last"), column("copies")
        n = len(self.doc)
        self.unit = np.repeat(np.arange(len(start)), np.diff(np.append(start, n)))
        raw = batch.column("words")
        offsets = np.frombuffer(raw.buffers()[1], dtype=np.int32)[raw.offset : raw.offset + n + 1].astype(np.int64)
        words = np.frombuffer(raw.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]].view(np.uint16).astype(U64)
        first = (offsets - offsets[0]) // 2
        self.size = np.diff(first) - (q - 1)
        self.begin = np.r_[0, np.cumsum(self.size)]
        self.row = np.repeat(np.arange(n), self.size)
        place = np.arange(self.begin[-1]) + np.repeat(first[:-1] - self.begin[:-1], self.size)
        token = np.zeros(len(place), dtype=U64)
        for i in range(q):
            token *= U64(0x9E3779B97F4A7C15)
            token += words[place + i]
        token = mix(token)
        # a token has 40 bits within its unit
        value = self.unit[self.row].astype(U64) << U64(40) | token >> U64(24)
        by = np.argsort(value)
        new = np.r_[True, value[by][1:] != value[by][:-1]]
        if len(by) < 1 << 31:  # a plain sort by (name, place) is quicker than a stable one
            by = (np.sort(np.cumsum(new) << 31 | by) & ((1 << 31) - 1)).astype(np.int64)
        row = self.row[by]
        edge = np.flatnonzero(new)
        self.name = np.empty(len(value), dtype=np.int64)
        self.by, self.name[by] = by, np.cumsum(new) - 1
        self.fresh = np.empty(len(value), dtype=bool)
        self.fresh[by] = new | np.r_[True, row[1:] != row[:-1]]
        low, high = np.minimum.reduceat(self.doc[row], edge), np.maximum.reduceat(self.last[row], edge)
        self.shared = (low != high)[self.name]
        self.c = self.begin[:-1] + column("c")
        self.scale(threshold)

    def scale(self, threshold: float) -> None:
        good = self.fresh & self.shared
        score = np.where(self.fresh, np.where(good, 1000, 0) - int(1000 * threshold), 0)
        self.s, self.e = _around(score, good, self.begin[:-1], self.begin[1:], self.c)
        names = np.r_[U64(0), np.cumsum(np.where(self.fresh, mix(self.name.astype(U64) + U64(1)), U64(0)))]
        self.hash = names[self.e + 1] - names[self.s]
        self.fresh_sum, self.good_sum = np.r_[0, np.cumsum(self.fresh)], np.r_[0, np.cumsum(good)]
        self.n = self.fresh_sum[self.e + 1] - self.fresh_sum[self.s]
        self.common = self.good_sum[self.e + 1] - self.good_sum[self.s]


class _Places:
    """Where each token of a unit is in each of its versions, as one flat table; and for each version its tokens as columns of that table."""

    def __init__(self, u: _Unit, firsts: np.ndarray) -> None:
        n, units = len(u.doc), int(u.unit[-1]) + 1
        self.u = u
        chosen = np.zeros(n, dtype=bool)
        chosen[firsts] = True
        inside = np.flatnonzero(chosen[u.row])
        inside = inside[(inside >= u.s[u.row[inside]]) & (inside <= u.e[u.row[inside]])]
        on = inside[(u.fresh & u.shared)[inside]]
        used = np.zeros(int(u.name.max(initial=0)) + 1, dtype=bool)
        used[u.name[on]] = True
        column = np.cumsum(used) - 1
        unit_of = np.zeros(len(used), dtype=np.int64)
        unit_of[u.name[on]] = u.unit[u.row[on]]
        width = np.bincount(unit_of[used], minlength=units)
        column -= (np.cumsum(width) - width)[unit_of]
        versions = np.bincount(u.unit[firsts], minlength=units)
        size = versions * (width + 1)  # the last column is of tokens that no other version has
        slot = np.arange(len(firsts)) - (np.cumsum(versions) - versions)[u.unit[firsts]]
        self.fits = int(size.sum()) <= TABLE_SIZE
        if not self.fits:
            return
        self.base, self.line = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        self.base[firsts] = (np.cumsum(size) - size)[u.unit[firsts]] + slot * (width[u.unit[firsts]] + 1)
        self.table = np.full(int(size.sum()), -1, dtype=np.int16)
        row = u.row[on]
        self.table[self.base[row] + column[u.name[on]]] = on - u.s[row]
        self.line[firsts] = np.arange(len(firsts))
        long = int((u.e - u.s)[firsts].max(initial=0)) + 1
        self.columns = np.repeat(width[u.unit[firsts]].astype(np.int32)[:, None], long, axis=1)
        self.fresh = np.zeros((len(firsts), long), dtype=np.int16)
        self.columns[self.line[row], on - u.s[row]] = column[u.name[on]]
        self.fresh[self.line[u.row[inside]], inside - u.s[u.row[inside]]] = u.fresh[inside]
        self.at = np.arange(long, dtype=np.int16)

    def _trimmed(self, hit: np.ndarray, fresh: np.ndarray, c: np.ndarray, density: float) -> tuple[np.ndarray, np.ndarray]:
        score = hit * np.int16(100) - fresh * np.int16(np.ceil(100 * density - 1e-9))
        upto = np.cumsum(score, axis=1, dtype=np.int16)
        before = upto - score
        left, right = self.at <= c[:, None], self.at >= c[:, None]
        most = np.where(right, upto, np.int16(-32768)).max(axis=1)
        least = np.where(left, before, np.int16(32767)).min(axis=1)
        left &= hit & (before <= most[:, None])
        right &= hit & (upto >= least[:, None])
        first, last = left.argmax(axis=1), len(self.at) - 1 - right[:, ::-1].argmax(axis=1)
        return np.where(left.any(axis=1), first, c), np.where(right.any(axis=1), last, c)

    def parts(self, a: np.ndarray, b: np.ndarray, t: int, threshold: float) -> tuple[np.ndarray, ...]:
        """(a's first and last token, b's, whether they are near copies) of the parts of windows a[i] and b[i] around c whose tokens the other one has.

        The parts are as dense with such tokens as the threshold needs of one
        of two windows, or if that is too little, as it needs of both.
        """
        u, least = self.u, int(2 * threshold * t / (1 + threshold))
        ends = np.zeros((4, len(a)), dtype=np.int64)
        good = np.zeros(len(a), dtype=bool)
        step = max(1, (1 << 17) // len(self.at))
        for i in range(0, len(a), step):
            x, y = a[i : i + step], b[i : i + step]
            sides = [(p, self.table[self.base[q][:, None] + self.columns[self.line[p]]], self.fresh[self.line[p]]) for p, q in ((x, y), (y, x))]
            index = np.arange(i, i + len(x))
            for density in (threshold, 2 * threshold / (1 + threshold)):
                (sa, ea), (sb, eb) = (self._trimmed(other >= 0, fresh, u.c[p] - u.s[p], density) for p, other, fresh in sides)
                p, other, _ = sides[0]
                here = (other >= sb[:, None]) & (other <= eb[:, None]) & (other >= 0) & (self.at >= sa[:, None]) & (self.at <= ea[:, None])
                common = here.sum(axis=1)
                sa, ea, sb, eb = sa + u.s[x], ea + u.s[x], sb + u.s[y], eb + u.s[y]
                na, nb = u.fresh_sum[ea + 1] - u.fresh_sum[sa], u.fresh_sum[eb + 1] - u.fresh_sum[sb]
                ok = (common >= threshold * (na + nb - common)) & (ea - sa + 1 >= t) & (eb - sb + 1 >= t)
                good[index[ok]] = True
                ends[:, index[ok]] = np.stack([sa, ea, sb, eb])[:, ok]
                on = ~ok & (common >= least)
                if not on.any():
                    break
                x, y, index = x[on], y[on], index[on]
                sides = [(p[on], other[on], fresh[on]) for p, other, fresh in sides]
        return (*ends, good)


def _common(who: np.ndarray, column: np.ndarray, n: int) -> np.ndarray:
    """Common tokens of n versions, for pairs of a lower and a higher row; ``column``[i] is a token of version ``who``[i], each once."""
    count = np.bincount(column)[column]
    both = np.zeros((n, n), dtype=np.int16)
    # rare tokens: by the distance of two rows in the sorted list of a token's rows
    rare = np.flatnonzero((count > 1) & (count <= n // 22))
    by = rare[np.lexsort((who[rare], column[rare]))]
    row, name = who[by], column[by]
    at, d = np.arange(len(by)), 0
    while len(at):
        d += 1
        at = at[at + d < len(by)]
        at = at[name[at + d] == name[at]]
        np.add.at(both, (row[at], row[at + d]), 1)
    # others by bitmaps
    often = (count > 1) & (count > n // 22)
    who, (names, column) = who[often], np.unique(column[often], return_inverse=True)
    for low in range(0, len(names), 1 << 15):
        part = (column >= low) & (column < low + (1 << 15))
        place = column[part] - low
        bits = np.zeros((n, -(-min(len(names) - low, 1 << 15) // 64) * 8), dtype=np.uint8)
        np.bitwise_or.at(bits, (who[part], place >> 3), (1 << (place & 7)).astype(np.uint8))
        bits = bits.view(U64)
        step = max(1, (1 << 17) // max(1, n * bits.shape[1]))
        for i in range(0, n - 1, step):
            both[i : i + step, i + 1 :] += np.bitwise_count(bits[i : i + step, None] & bits[None, i + 1 :]).sum(axis=2, dtype=np.int16)
    return both


class _Grid:
    """``_Places.parts`` of all pairs of two groups of versions of one unit at once, a place after the other.

    Places are counted in tokens that are the first of their kind, from c on.
    Where the shared tokens of versions follow one order (``ordered``; others
    are left to ``_Places``), the k-th common token from c is the same one in
    both, so common tokens of two parts are the lesser number on either side of c.
    """

    def __init__(self, u: _Unit, rows: np.ndarray, who: np.ndarray, at: np.ndarray) -> None:
        """who: the version, by its place in rows, of each token ``at`` from s to e."""
        self.u, self.rows = u, rows
        fresh = u.fresh[at]
        who, at = who[fresh], at[fresh]
        c = u.c[rows]
        rel = u.fresh_sum[at] - u.fresh_sum[c][who]
        self.lo, self.hi = int(-rel.min()), int(rel.max())
        self.place = np.zeros((len(rows), self.lo + self.hi + 1), dtype=np.int64)
        self.place[who, rel + self.lo] = at
        names, column, count = np.unique(u.name[at], return_inverse=True, return_counts=True)
        on = (u.shared[at]) & (count[column] > 1)
        used = np.zeros(len(names), dtype=bool)
        used[column[on]] = True
        self.width = int(used.sum())
        self.who, self.column, rel = who[on], (np.cumsum(used) - 1)[column[on]], rel[on]
        self.columns = np.full((self.lo + self.hi + 1, len(rows)), self.width, dtype=np.int64)
        self.columns[rel + self.lo, self.who] = self.column
        self.first = np.searchsorted(self.who, np.arange(len(rows) + 1))
        middle = self.columns[self.lo]
        most = np.bincount(middle, minlength=self.width + 1)[: self.width]
        self.ordered = u.fresh[c] & (middle == most.argmax() if self.width else False)
        # levels of tokens that rise along each version; if there are none, versions in another order than most are left out
        near = self.who[1:] == self.who[:-1]
        a, b, row = self.column[:-1][near], self.column[1:][near], self.who[1:][near]
        number = np.bincount(self.column, minlength=self.width)
        median = rel[np.lexsort((rel, self.column))][np.cumsum(number) - number // 2 - 1]
        usual = np.ones(len(rows), dtype=bool)
        for _ in range(2):
            edges = np.unique((a * (self.width + 1) + b)[usual[row]])
            x, y = edges // (self.width + 1), edges % (self.width + 1)
            level = median.copy()
            for _ in range(400):
                wrong = level[y] <= level[x]
                if not wrong.any():
                    break
                np.maximum.at(level, y[wrong], level[x[wrong]] + 1)
            else:
                usual[row[median[b] < median[a]]] = False
                continue
            break
        self.ordered[row[level[b] <= level[a]]] = False

    def _hits(self, rows: slice) -> np.ndarray:
        hits = np.zeros((self.width + 1, rows.stop - rows.start), dtype=np.int8)
        mine = slice(self.first[rows.start], self.first[rows.stop])
        hits[self.column[mine], self.who[mine] - rows.start] = 1
        return hits

    def _side(self, rows: slice, hits: np.ndarray, density: float) -> list[np.ndarray]:
        """For each of the rows and each version of the hits: places that its part goes to the left and right of c, and common tokens there (c on the right)."""
        cost = int(np.ceil(100 * density - 1e-9))
        table = hits * np.int16(100) - np.int16(cost)
        size = (rows.stop - rows.start, hits.shape[1])
        sums = []
        for columns in (self.columns[: self.lo, rows][::-1], self.columns[self.lo :, rows]):
            score = np.empty((len(columns) + 1, *size), dtype=np.int16)
            score[0] = 0
            for i, x in enumerate(columns):
                np.take(table, x, axis=0, out=score[i + 1], mode="clip")
                score[i + 1] += score[i]
            sums.append(score)
        left, right = sums
        least = -right[1:].max(axis=0), -left.max(axis=0)
        kind = np.uint8 if max(self.lo, self.hi) < 255 else np.uint16
        ok, hit = np.empty(size, dtype=bool), np.empty(size, dtype=bool)
        ends = []
        for score, low in zip(sums, least, strict=True):
            seen, end = np.zeros(size, dtype=bool), np.zeros(size, dtype=kind)
            for i in range(len(score) - 1, 0, -1):  # from the far end: places from the last one on that is a common token and not below
                np.greater_equal(score[i], low, out=ok)
                np.greater(score[i], score[i - 1], out=hit)
                ok &= hit
                seen |= ok
                end += seen.view(np.uint8)
            end = end.astype(np.int16)
            value = np.take_along_axis(score, end[None].astype(np.int64), axis=0)[0]
            ends.append((end, (value + end * np.int16(cost)) // np.int16(100)))
        return [ends[0][0], ends[1][0] - np.int16(1), ends[0][1], ends[1][1]]

    def parts(self, a: slice, b: slice, wanted: np.ndarray, t: int, threshold: float) -> tuple[np.ndarray, ...]:
        """(rows, rows, a's first and last token, b's) of the wanted pairs that are near copies in part; both slices are of ``rows``, wanted is a matrix."""
        least = int(2 * threshold * t / (1 + threshold))
        hits_b = self._hits(b)
        hits_a = hits_b if a == b else self._hits(a)
        found = []
        for density in (threshold, 2 * threshold / (1 + threshold)):
            mine = self._side(a, hits_b, density)
            other = [x.T for x in (mine if a == b else self._side(b, hits_a, density))]
            common = np.minimum(mine[2], other[2]) + np.minimum(mine[3], other[3])
            both = mine[0] + mine[1] + other[0] + other[1] + np.int16(2)
            x, y = np.nonzero(wanted & (common >= threshold * (both - common)))
            i, j = x + a.start, y + b.start
            ends = [self.place[i, self.lo - mine[0][x, y]], self.place[i, self.lo + mine[1][x, y]], self.place[j, self.lo - other[0][x, y]], self.place[j, self.lo + other[1][x, y]]]
            ok = (ends[1] - ends[0] + 1 >= t) & (ends[3] - ends[2] + 1 >= t)
            found.append([p[ok] for p in (self.rows[i], self.rows[j], *ends)])
            wanted = wanted & (common >= least)
            wanted[x[ok], y[ok]] = False
            if not wanted.any():
                break
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _links(batch: pa.RecordBatch, start: np.ndarray, parts: tuple[np.ndarray, np.ndarray, np.ndarray] | None, q: int, t: int, threshold: float) -> dict[str, np.ndarray]:
    """For each window of the units: ``lead`` (the first row of its version), links (occurrences linked with it), its linked span, the part of that span which
    a lower document has (tokens from l; -1 if none), and ``root``, the least row that it is connected with.  With ``parts`` (part, block, whether the unit is of two parts) rows are
    versions, and pairs of one block don't count, nor those of one part in a unit of two."""
    u = _Unit(batch, start, q, threshold)
    n = len(u.doc)
    # versions: equal sets of tokens
    least = int(2 * threshold * t / (1 + threshold))  # two passages of t tokens with fewer equal ones don't reach the threshold
    alive = (u.common >= least) & (u.e - u.s + 1 >= t)
    by = np.lexsort((np.arange(n), u.n, u.hash, u.unit))
    by = by[alive[by]]
    lead = np.arange(n)
    if len(by):
        new = np.r_[True, (u.hash[by][1:] != u.hash[by][:-1]) | (u.n[by][1:] != u.n[by][:-1]) | (u.unit[by][1:] != u.unit[by][:-1])]
        if parts is not None:
            new[:] = True
        lead[by] = np.repeat(by[new], np.diff(np.append(np.flatnonzero(new), len(by))))
    weight = np.bincount(lead, u.weight, n).astype(np.int64)
    last = u.last.copy()
    np.maximum.at(last, lead, u.last)
    links = np.zeros(n, dtype=np.int64)
    far = np.iinfo(np.int64).max
    s, e, ls, le = np.full(n, far), np.full(n, -1), np.full(n, far), np.full(n, -1)

    def add(i: np.ndarray, low: np.ndarray, high: np.ndarray, lower: np.ndarray) -> None:
        np.minimum.at(s, i, low)
        np.maximum.at(e, i, high)
        np.minimum.at(ls, i[lower], low[lower])
        np.maximum.at(le, i[lower], high[lower])

    firsts = np.flatnonzero(alive & (lead == np.arange(n)))
    edges: list[tuple[np.ndarray, np.ndarray]] = []
    waiting = 0

    def link(a: np.ndarray, b: np.ndarray, sa: np.ndarray, ea: np.ndarray, sb: np.ndarray, eb: np.ndarray) -> None:
        links[:] += np.bincount(a, weight[b], n).astype(np.int64) + np.bincount(b, weight[a], n).astype(np.int64)
        add(a, sa, ea, u.doc[b] < u.doc[a])
        add(b, sb, eb, u.doc[a] < u.doc[b])
        edges.append((a, b))
        nonlocal waiting
        waiting += len(a)
        if waiting > 1 << 19:  # a forest takes the place of the links
            root = connected(n, *(np.concatenate(x) for x in zip(*edges, strict=True)))
            edges[:] = [(np.flatnonzero(root != np.arange(n)), root[root != np.arange(n)])]
            waiting = 0

    places = _Places(u, firsts)

    def compared(a: np.ndarray, b: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Link pairs of versions with enough common tokens as wholes; the pairs that may be linked in part."""
        ok = ~((u.doc[a] == last[a]) & (u.doc[b] == last[b]) & (u.doc[a] == u.doc[b]))
        if parts is not None:
            part, block, two = parts
            ok &= (block[a] != block[b]) & (~two[a] | (part[a] != part[b]))
        a, b, common = a[ok], b[ok], common[ok]
        whole = common >= threshold * (u.n[a] + u.n[b] - common)
        link(a[whole], b[whole], u.s[a[whole]], u.e[a[whole]], u.s[b[whole]], u.e[b[whole]])
        return a[~whole], b[~whole]

    def in_part(a: np.ndarray, b: np.ndarray) -> None:
        """Link pairs of versions in part."""
        if not len(a):
            return
        # where a batch has too large a table, tables of some versions take its place, one after the other
        rows = np.unique(np.concatenate([a, b]))
        most = max(2, isqrt(TABLE_SIZE // (2 * SIDES * t + 2)))
        groups = [rows] if places.fits or len(rows) <= most else np.array_split(rows, -(-len(rows) // (most // 2)))
        for i, one in enumerate(groups):
            for other in groups[i:]:
                mine = np.ones(len(a), dtype=bool) if len(groups) == 1 else (np.isin(a, one) & np.isin(b, other)) | (np.isin(a, other) & np.isin(b, one))
                if mine.any():
                    x, y = a[mine], b[mine]
                    *ends, good = (places if places.fits else _Places(u, np.union1d(one, other))).parts(x, y, t, threshold)
                    link(x[good], y[good], *(p[good] for p in ends))

    # common tokens of small units: by the distance of two rows in the sorted list of a token's rows
    which = u.unit[firsts]
    edge = np.r_[0, np.flatnonzero(which[1:] != which[:-1]) + 1, len(firsts)]
    k = np.diff(edge)
    small, slot = np.zeros(n, dtype=bool), np.zeros(n, dtype=np.int64)
    few = np.repeat((k > 1) & (k <= SMALL), k)
    small[firsts[few]] = True
    slot[firsts] = np.arange(len(firsts)) - np.repeat(edge[:-1], k)
    row = u.row[u.by]
    token = u.by[small[row] & (u.fresh & u.shared)[u.by] & (u.by >= u.s[row]) & (u.by <= u.e[row])]
    row, name = u.row[token], u.name[token]
    common = np.zeros(len(np.unique(u.unit)) * SMALL * SMALL if len(token) else 0, dtype=np.int64)
    for d in range(1, SMALL):
        pair = np.flatnonzero(name[d:] == name[:-d]) if len(name) > d else np.zeros(0, np.int64)
        if not len(pair):
            break
        x, y = row[pair], row[pair + d]
        common += np.bincount((u.unit[x] * SMALL + slot[x]) * SMALL + slot[y], minlength=len(common))
    pair = np.flatnonzero(common >= least)
    if len(pair):
        begin = np.zeros(int(which[-1]) + 1, dtype=np.int64)
        begin[which[edge[:-1]]] = edge[:-1]
        base = begin[pair // (SMALL * SMALL)]
        in_part(*compared(firsts[base + pair // SMALL % SMALL], firsts[base + pair % SMALL], common[pair]))
    # and of others, by bitmaps
    for f, g in zip(edge[:-1][k > SMALL].tolist(), edge[1:][k > SMALL].tolist(), strict=True):
        rows = firsts[f:g]
        size = u.e[rows] - u.s[rows] + 1
        who = np.repeat(np.arange(g - f), size)
        at = np.arange(len(who)) - np.repeat(np.cumsum(size) - size - u.s[rows], size)
        on = u.fresh[at] & u.shared[at]
        both = _common(who[on], np.unique(u.name[at[on]], return_inverse=True)[1], g - f)
        grid = None
        for i in range(0, g - f, TILE):
            for j in range(i, g - f, TILE):
                x, y = np.nonzero(both[i : i + TILE, j : j + TILE] >= least)
                x, y = x[x + i < y + j] + i, y[x + i < y + j] + j
                if not len(x):
                    continue
                a, b = compared(rows[x], rows[y], both[x, y].astype(np.int64))
                p, q_ = slice(i, min(i + TILE, g - f)), slice(j, min(j + TILE, g - f))
                if len(a) >= max(LEAST_CELLS, (p.stop - i) * (q_.stop - j) // DENSE):
                    grid = grid or _Grid(u, rows, who, at)
                    x, y = np.searchsorted(rows, a), np.searchsorted(rows, b)
                    on = grid.ordered[x] & grid.ordered[y]
                    wanted = np.zeros((p.stop - i, q_.stop - j), dtype=bool)
                    wanted[x[on] - i, y[on] - j] = True
                    link(*grid.parts(p, q_, wanted, t, threshold))
                    a, b = a[~on], b[~on]
                in_part(a, b)
    # members of versions
    member = np.flatnonzero((weight[lead] > u.weight) & (last[lead] != u.doc[lead]))
    has_low = le >= 0
    add(member, u.s[member], u.e[member], (u.doc[lead[member]] < u.doc[member]) | has_low[lead[member]])
    edges.append((lead[member], member))
    pairs = [np.concatenate(x) for x in zip(*edges, strict=True)]
    root = connected(n, *pairs)
    total = links[lead]
    spread = np.flatnonzero((lead != np.arange(n)) & (links[lead] > 0))  # a version's other links are those of its first
    add(spread, u.s[spread], u.e[spread], (u.doc[lead[spread]] < u.doc[spread]) | has_low[lead[spread]])
    if parts is None:
        total = total + np.where(last[lead] != u.doc[lead], weight[lead] - 1, 0)
    base = u.begin[:-1]
    none = e < 0
    low = le < 0
    return {
        "lead": lead, "links": total, "weight": weight, "s": np.where(none, 0, s - base), "e": np.where(none, -1, e - base), "ls": np.where(low, 0, ls - base), "le": np.where(low, -1, le - base), "root": root,
    }


_OUT = "key bigint, block int, content bigint, first bigint, weight bigint, links bigint, c int, s int, e int, ls int, le int, root_doc bigint, root_at bigint, words binary"


def _meet(contents: DataFrame, unit: list[str], q: int, t: int, threshold: float) -> DataFrame:
    """_OUT of contents, by units; ``first`` is the content of the first window of a version.  First windows in blocks keep their words."""
    pairs = unit != ["key", "block"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_units(batches, unit, 1 << 20):
            change = np.zeros(batch.num_rows, dtype=bool)
            change[0] = True
            for k in unit:
                x = batch.column(k).to_numpy()
                change[1:] |= x[1:] != x[:-1]
            parts = (batch.column("part").to_numpy(), batch.column("block").to_numpy(), batch.column("low").to_numpy() != batch.column("high").to_numpy()) if pairs else None
            got = _links(batch, np.flatnonzero(change), parts, q, t, threshold)
            content, c, doc = batch.column("content").to_numpy(), batch.column("c").to_numpy(), batch.column("doc").to_numpy()
            where = (batch.column("at").to_numpy() >> 32) + c
            root = got["root"]
            columns = [batch.column("key"), batch.column("block"), pa.array(content), pa.array(content[got["lead"]]), pa.array(got["weight"]), pa.array(got["links"]), pa.array(c)]
            columns += [pa.array(got[x].astype(np.int32)) for x in ("s", "e", "ls", "le")] + [pa.array(doc[root]), pa.array(where[root])]
            kept = np.zeros(len(doc), dtype=bool) if pairs else (batch.column("block").to_numpy() > 0) & (got["lead"] == np.arange(len(doc)))
            columns.append(batch.column("words").take(pa.array(np.arange(len(doc)), mask=~kept)))
            keep = (got["links"] > 0) if pairs else (got["links"] > 0) | (batch.column("block").to_numpy() > 0)
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _OUT.split(", ")]).filter(pa.array(keep))

    return contents.repartition(*unit).sortWithinPartitions(*unit, "doc", "at").mapInArrow(released(run), _OUT)


def linked_windows(docs: DataFrame, q: int = Q, t: int = TOKENS, functions: int = FUNCTIONS, threshold: float = THRESHOLD) -> DataFrame:
    """Windows with a near copy in another document: doc_id, s and e (first and last token), ls and le (of the part that a lower document has,
    le < ls if none), links, anchor (a token of it), and root_doc and root_at, a window that it is connected with."""
    texts = one_row_each(id_text(docs))
    met = cut(_met(texts, q, t, functions))
    firsts = met.where("(varied or block > 0) and doc_id = doc and reach = at").select("key", "block", "content", "doc", "at", "copies", "last")
    found = cut(_meet(_contents(firsts, texts, q), ["key", "block"], q, t, threshold))
    same = ["key", "block", "content"]
    edges = None
    leads = found.where("block > 0 and content = first")
    parts = leads.groupBy("key").agg(F.count("*").alias("n")).select("key", F.expr(f"cast(ceil(n / {BLOCK}) as int)").alias("parts"))
    if not leads.isEmpty():  # versions that are left in the blocks of a large unit
        again = firsts.drop("copies").join(leads.select(*same, F.col("weight").alias("copies"), "c", "words"), same).join(parts, "key")
        again = again.withColumn("part", F.expr("cast(pmod(xxhash64(doc, 2), parts) as int)")).withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
        again = again.withColumn("low", F.least("part", "other")).withColumn("high", F.greatest("part", "other")).drop("parts", "other")
        across = cut(_meet(again, ["key", "low", "high"], q, t, threshold))
        summed = across.groupBy(*same).agg(F.sum("links").alias("more"), F.min("s").alias("s2"), F.max("e").alias("e2"), F.min(F.expr("if(le >= ls, ls, null)")).alias("ls2"), F.max("le").alias("le2"))
        edges = across.select(*same, "root_doc", "root_at")
        found = found.join(summed.select("key", "block", F.col("content").alias("first"), "more"), ["key", "block", "first"], "left").join(summed.drop("more"), same, "left")
        found = found.select(
            *same, "first", "weight", (F.col("links") + F.coalesce("more", F.lit(0))).alias("links"), "c", F.expr("if(s2 is null, s, if(e < s, s2, least(s, s2)))").alias("s"), F.expr("greatest(e, coalesce(e2, -1))").alias("e"),
            F.expr("if(ls2 is null, ls, if(le < ls, ls2, least(ls, ls2)))").alias("ls"), F.expr("greatest(le, coalesce(le2, -1))").alias("le"), "root_doc", "root_at",
        ).where("links > 0")
    # every occurrence of a window, with what was found for its content
    placed = met.join(found.drop("first", "weight", "words"), same, "left").where("links > 0 or doc < last")
    l, r = F.expr("cast(shiftright(reach, 32) as int)"), F.expr("cast(shiftright(reach, 32) + (shiftright(reach, 16) & 65535) + (reach & 65535) as int)")
    copied, later = F.expr("doc < last"), F.expr("doc_id > doc")
    first = F.expr("cast(shiftright(at, 32) as bigint)")
    rows = placed.select(
        "doc_id",
        F.when(copied, l).otherwise(l + F.col("s")).alias("s"), F.when(copied, r).otherwise(l + F.col("e")).alias("e"),
        F.when(later, l).otherwise(l + F.coalesce("ls", F.lit(0))).alias("ls"), F.when(later, r).otherwise(l + F.coalesce("le", F.lit(-1))).alias("le"),
        F.coalesce("links", F.col("copies") - 1).alias("links"), (l + F.coalesce("c", F.lit(0))).cast("bigint").alias("anchor"),
        F.coalesce("root_doc", "doc").alias("root_doc"), F.coalesce("root_at", first).alias("root_at"),
    ).where("e >= s")
    if edges is not None:
        more = edges.join(firsts.select(*same, "doc", "at"), same).join(found.select(*same, "c", "s", "e", "links"), same)
        begin = F.expr("cast(shiftright(at, 32) as int)")
        rows = rows.unionByName(
            more.select(
                F.col("doc").alias("doc_id"), (begin + F.col("s")).alias("s"), (begin + F.col("e")).alias("e"), begin.alias("ls"), (begin - 1).alias("le"),
                "links", (begin + F.col("c")).cast("bigint").alias("anchor"), "root_doc", "root_at",
            )
        )
    return rows


def near_passages(docs: DataFrame, q: int = Q, t: int = TOKENS, functions: int = FUNCTIONS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, start, stop (words of a passage), class_doc, class_start (the first passage of its class), links."""
    rows = linked_windows(docs, q, t, functions, threshold)
    by = Window.partitionBy("doc_id").orderBy("s", "e")
    before = F.max("e").over(by.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("new", F.when(F.col("s") <= before, 0).otherwise(1))
    rows = rows.withColumn("passage", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    rows = cut(rows.select("doc_id", "passage", "s", "e", "links", "root_doc", "root_at"))
    # numbers in a table that is written, so that they stay; 64 bits for the rounds of the components
    passages = rows.groupBy("doc_id", "passage").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.max("links").alias("links"))
    passages = cut(passages.withColumn("id", F.monotonically_increasing_id()))
    anchors = rows.select("root_doc", "root_at").distinct()
    named = anchors.join(passages.select(F.col("doc_id").alias("root_doc"), "s", "e", F.col("id").alias("root")), "root_doc").where("root_at between s and e").select("root_doc", "root_at", "root")
    linked = rows.select("doc_id", "passage", "root_doc", "root_at").distinct().join(passages.select("doc_id", "passage", "id"), ["doc_id", "passage"])
    roots = components(linked.join(named, ["root_doc", "root_at"]).select(F.col("id").alias("doc_a"), F.col("root").alias("doc_b")))
    of = passages.join(roots.withColumnRenamed("doc_id", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    least = of.groupBy("root").agg(F.min(F.struct("doc_id", "s")).alias("first"))
    return of.join(least, "root").select("doc_id", F.col("s").alias("start"), (F.col("e") + q).alias("stop"), F.col("first.doc_id").alias("class_doc"), F.col("first.s").alias("class_start"), "links")


def _runs(mask: np.ndarray, gap: int) -> list[tuple[int, int]]:
    """[start, stop) of the runs of true values, bridged over up to gap false ones."""
    at = np.flatnonzero(mask)
    if not len(at):
        return []
    breaks = np.flatnonzero(np.diff(at) > gap + 1)
    return list(zip(at[np.r_[0, breaks + 1]].tolist(), (at[np.r_[breaks, len(at) - 1]] + 1).tolist(), strict=True))


def cut_passages(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs without the words [start, stop) of spans (doc_id, start, stop), by doc_id.

    What lies between the first word cut and the next one kept goes too.  A row
    that loses its last word is dropped; n_chars, if there is such a column,
    is the new length of changed rows.
    """
    at = unused("spans", docs)
    by_doc = spans.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias(at))
    sized = "n_chars" in docs.columns
    names, kept = docs.columns, StructType(list(docs.schema))
    joined = docs.join(by_doc, "doc_id", "left").select(*map(quoted, names), at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                words = Words(part.column("text"))
                texts = part.column("text").to_pylist()
                keep = np.ones(len(texts), dtype=bool)
                for i, cuts in enumerate(part.column(at).to_pylist()):
                    if not cuts or texts[i] is None:
                        continue
                    base, last = words.first[i], words.first[i + 1]
                    gone = np.zeros(last - base, dtype=bool)
                    for x in cuts:
                        gone[x["start"] : x["stop"]] = True
                    if gone.all():
                        keep[i] = False
                        continue
                    left, here, raw = [], words.offsets[i], words.data
                    for s, e in _runs(gone, 0):
                        left.append(raw[here : words.start[base + s]].tobytes())
                        here = words.start[base + e] if base + e < last else words.offsets[i + 1]
                    left.append(raw[here : words.offsets[i + 1]].tobytes())
                    texts[i] = b"".join(left).decode("utf-8", "replace")
                columns = {c: part.column(c) for c in names}
                changed = pa.array(texts, pa.string())
                if sized:
                    old = columns["n_chars"].to_pylist()
                    spans_at = part.column(at).is_valid().to_pylist()
                    columns["n_chars"] = pa.array([len(t) if s and t is not None else n for t, s, n in zip(texts, spans_at, old, strict=True)], columns["n_chars"].type)
                columns["text"] = changed
                yield pa.RecordBatch.from_arrays(list(columns.values()), names).filter(pa.array(keep))

    return map_rows(joined.withColumn("text", F.col("text").cast(StringType())), run, kept)


def drop_passages(docs: DataFrame, q: int = Q, **options) -> DataFrame:
    """docs, each passage that is nearly in a document of lower doc_id cut out."""
    found = linked_windows(docs, q, **options).where("le >= ls")
    return cut_passages(docs, found.select("doc_id", F.col("ls").alias("start"), (F.col("le") + q).alias("stop")))
