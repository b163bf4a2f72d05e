"""Operator 5: quality rules on the repetition inside one document.

The suffix array of a document and its longest-common-prefix (LCP) values give
its maximal repeated substrings; their spans are united, and a document is
rejected when too large a fraction of it is covered or its longest repeat is
too long.  Suffixes are compared by characters (code points).

A first pass hashes all windows of ``min_repeat`` characters: a document in
which no window occurs twice has no repeat of that length, so only the others
need a suffix array.

Defined results: a null or empty text has 0 characters and 0 repeats and is
kept; rows with equal doc_id are measured one by one; a null doc_id stays null;
an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import map_rows, unused
from ._text import U64, buffers, _grams, mix, pieces, released

MIN_REPEAT, MAX_FRACTION, MAX_LONGEST = 60, 0.5, 1000
SCHEMA = "doc_id bigint, n_chars bigint, repeated_chars bigint, longest_repeat bigint"


def _code_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = buffers(column)
    starts = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=starts[1:])
    codes = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return codes, starts[offsets]


def suffix_ranks(codes: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """ranks[k][i]: rank of the first 2**k characters of suffix i among those of its row.

    Prefix doubling: a bucket of equal prefixes is refined by the rank of what
    follows; buckets of one suffix are final.  The last array has no ties.
    """
    n = len(codes)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    end = first[1:][row]
    key = (row.astype(np.int64) << 21) | codes
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    fresh = np.r_[True, sorted_key[1:] != sorted_key[:-1]]
    start = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank = np.empty(n, dtype=np.int32)
    rank[order] = start
    ranks, step = [rank], 1
    single = fresh & np.r_[fresh[1:], True]
    active = order[~single]
    while len(active):
        rank = ranks[-1].copy()
        later = active + step
        inside = later < end[active]
        follow = np.zeros(len(active), dtype=np.int64)
        follow[inside] = rank[later[inside]].astype(np.int64) + 1
        pair = rank[active].astype(np.int64) * (n + 1) + follow
        by = np.argsort(pair, kind="stable")
        active, pair = active[by], pair[by]
        bucket = pair // (n + 1)
        at = np.arange(len(active))
        new_bucket = np.r_[True, bucket[1:] != bucket[:-1]]
        fresh = np.r_[True, pair[1:] != pair[:-1]]
        offset = np.maximum.accumulate(np.where(fresh, at, 0)) - np.maximum.accumulate(np.where(new_bucket, at, 0))
        rank[active] = bucket + offset
        ranks.append(rank)
        active = active[~(fresh & np.r_[fresh[1:], True])]
        step *= 2
    return ranks


def neighbour_lcp(ranks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, LCP of each suffix with the next), by halving steps through the ranks."""
    n = len(ranks[-1])
    suffixes = np.empty(n, dtype=np.int64)
    suffixes[ranks[-1]] = np.arange(n)
    a, b = suffixes[:-1].copy(), suffixes[1:].copy()
    lcp = np.zeros(max(0, n - 1), dtype=np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        rank = ranks[k]
        ok = np.flatnonzero((a < n) & (b < n))
        ok = ok[rank[a[ok]] == rank[b[ok]]]
        lcp[ok] += 1 << k
        a[ok] += 1 << k
        b[ok] += 1 << k
    return suffixes, lcp


def measure(column: pa.Array, min_repeat: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(characters, characters in repeats of at least min_repeat, longest such repeat) by row."""
    codes, first = _code_points(column)
    size = np.diff(first)
    covered, longest = np.zeros_like(size), np.zeros_like(size)
    m = len(codes) - min_repeat + 1
    if m <= 1:
        return size, covered, longest
    row = np.repeat(np.arange(len(size), dtype=np.int32), size)
    up, down = _grams.get(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, dtype=U64)
    np.cumsum(mix(codes.astype(U64) + U64(1)) * up[: len(codes)], out=sums[1:])
    keys = mix(mix((sums[min_repeat:] - sums[:-min_repeat]) * down[:m]) + row[:m].astype(U64))
    keys, at = (x[row[:m] == row[min_repeat - 1 :]] for x in (keys, row[:m]))
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return size, covered, longest
    place = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    rows = np.unique(at[twice[place] == keys])
    del keys, ordered, place, sums
    part = np.concatenate([codes[first[r] : first[r + 1]] for r in rows])
    begins = np.r_[0, np.cumsum(size[rows])]
    suffixes, lcp = neighbour_lcp(suffix_ranks(part, begins))
    reach = np.zeros(len(part), dtype=np.int64)  # longest prefix of each suffix that occurs elsewhere in the row
    np.maximum.at(reach, suffixes[:-1], lcp)
    np.maximum.at(reach, suffixes[1:], lcp)
    starts = np.flatnonzero(reach >= min_repeat)
    change = np.zeros(len(part) + 1, dtype=np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + reach[starts], -1)
    inside = np.r_[0, np.cumsum(np.cumsum(change[:-1]) > 0)]
    covered[rows] = inside[begins[1:]] - inside[begins[:-1]]
    most = np.maximum.reduceat(reach, begins[:-1])
    longest[rows] = np.where(most >= min_repeat, most, 0)
    return size, covered, longest


def repetition(docs: DataFrame, min_repeat: int = MIN_REPEAT, *, keep_columns: bool = False, into: str = "repetition") -> DataFrame:
    """doc_id, n_chars, repeated_chars, longest_repeat of every row; repeats are of min_repeat characters or more.

    keep_columns: all columns of docs and the three measures instead, as the
    struct column ``into`` (it takes the place of one of that name).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                size, covered, longest = (pa.array(x, pa.int64()) for x in measure(part.column("text"), min_repeat))
                if not keep_columns:
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), size, covered, longest], ["doc_id", "n_chars", "repeated_chars", "longest_repeat"])
                    continue
                struct = pa.StructArray.from_arrays([size, covered, longest], ["n_chars", "repeated_chars", "longest_repeat"])
                names = [x for x in part.schema.names if x != into]
                yield pa.RecordBatch.from_arrays([*(part.column(x) for x in names), struct], [*names, into])

    if not keep_columns:
        return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(released(run), SCHEMA)
    from pyspark.sql.types import StructType

    kept = StructType([x for x in docs.schema if x.name != into])
    return map_rows(docs, run, kept.add(into, StructType.fromDDL(SCHEMA.split(", ", 1)[1])))


def _good(at: str, max_fraction: float, max_longest: int) -> F.Column:
    return (F.col(f"{at}repeated_chars") <= max_fraction * F.col(f"{at}n_chars")) & (F.col(f"{at}longest_repeat") <= max_longest)


def quality_rules(docs: DataFrame, min_repeat: int = MIN_REPEAT, max_fraction: float = MAX_FRACTION, max_longest: int = MAX_LONGEST) -> DataFrame:
    """doc_id and measures of the documents that the rules keep."""
    return repetition(docs, min_repeat).where(_good("", max_fraction, max_longest))


def filter_documents(docs: DataFrame, min_repeat: int = MIN_REPEAT, max_fraction: float = MAX_FRACTION, max_longest: int = MAX_LONGEST) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns."""
    into = unused("repetition", docs)
    measured = repetition(docs, min_repeat, keep_columns=True, into=into)
    return measured.where(_good(f"{into}.", max_fraction, max_longest)).drop(into)
