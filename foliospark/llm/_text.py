"""Vectorised tokenisation and hashing over Arrow string buffers.

A *word* is a maximal run of ASCII letters, ASCII digits and non-ASCII
characters; ASCII letters are folded to lower case.  Everything below works on
the raw UTF-8 buffers that Arrow hands over, so no Python string is built.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

U64 = np.uint64
_byte = np.arange(256, dtype=np.uint8)
IS_WORD = ((_byte >= 48) & (_byte <= 57)) | ((_byte >= 65) & (_byte <= 90)) | ((_byte >= 97) & (_byte <= 122)) | (_byte >= 128)
_BASE, _BASE_N = U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, a bijection of 64-bit words."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_FOLDED = np.where((_byte >= 65) & (_byte <= 90), _byte + 32, _byte).astype(np.uint64)
BYTE_CODE = mix((_FOLDED + U64(1)) * U64(0xA24BAED4963EE407))


class _Powers:
    """base**i and base**-i modulo 2**64, grown on demand."""

    def __init__(self, base: np.uint64) -> None:
        self.base, self.inverse = base, U64(pow(int(base), -1, 1 << 64))
        self.up = self.down = np.ones(1, dtype=U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            for name, b in (("up", self.base), ("down", self.inverse)):
                x = getattr(self, name)
                setattr(self, name, np.concatenate([x, x * U64(pow(int(b), len(x), 1 << 64))]))
        return self.up, self.down


_bytes, _grams = _Powers(_BASE), _Powers(_BASE_N)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which a worker gives memory that it doesn't use back to the system: workers go on from task to task."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
        if trim is not None:
            trim(0)

    return whole


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty string."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batch: pa.RecordBatch, column: str, limit: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with about ``limit`` bytes of text; a longer text has a slice of its own."""
    n = batch.num_rows
    if n == 0:
        return
    _, offsets = buffers(batch.column(column))
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield batch.slice(at, end - at)
        at = end


class Words:
    """Words of a batch of texts: byte spans, 64-bit hashes and the row of each."""

    __slots__ = ("data", "offsets", "start", "end", "hash", "row", "first")

    def __init__(self, column: pa.Array) -> None:
        self.data, self.offsets = data, offsets = buffers(column)
        n = len(data)
        inside = IS_WORD[data]
        edge = np.zeros(n + 1, dtype=bool)
        edge[offsets] = True
        before = np.zeros(n, dtype=bool)
        before[1:] = inside[:-1]
        after = np.zeros(n, dtype=bool)
        after[:-1] = inside[1:]
        self.start = np.flatnonzero(inside & (~before | edge[:-1]))
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        up, down = _bytes.get(n + 1)
        sums = np.zeros(n + 1, dtype=U64)
        np.cumsum(BYTE_CODE[data] * up[:n], out=sums[1:])
        self.hash = mix((sums[self.end] - sums[self.start]) * down[self.start] + (self.end - self.start).astype(U64))
        #: words of row r are first[r] : first[r + 1]
        self.first = np.searchsorted(self.start, offsets)
        self.row = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))


def ngrams(hashes: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the runs of n words that lie in one row."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    up, down = _grams.get(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, dtype=U64)
    np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
    grams = mix((sums[n:] - sums[:-n]) * down[:m] + U64(n))
    at = np.flatnonzero(row[:m] == row[n - 1 :])
    return at, grams[at]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64) if x.dtype == U64 else x.astype(np.int64)


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column with counts[i] of the values in row i."""
    offsets = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


_ZSTD = pa.Codec("zstd", compression_level=6)
#: Bytes of words, folded; all others are blanks.
_PLAIN = np.where(IS_WORD, _FOLDED, 32).astype(np.uint8)


def pack(raw: bytes) -> bytes:
    return len(raw).to_bytes(4, "little") + _ZSTD.compress(raw, asbytes=True)


def unpack(packed_: bytes, raw: bool = False) -> str | bytes:
    data = pa.decompress(packed_[4:], int.from_bytes(packed_[:4], "little"), codec="zstd", asbytes=True)
    return data if raw else data.decode("utf-8", "replace")


def packed(texts: DataFrame) -> DataFrame:
    """(doc_id, packed): compressed texts, for exchanges; only their words, at the same places, are what they were."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                data, offsets = buffers(part.column("text"))
                raw = _PLAIN[data].tobytes()
                made = [pack(raw[s:e]) for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(made, pa.binary())], ["doc_id", "packed"])

    return texts.mapInArrow(released(run), "doc_id bigint, packed binary")


def unpacked(batch: pa.RecordBatch, limit: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The texts of the column ``packed``, as ``text``, in slices of about ``limit`` bytes."""
    column = batch.column("packed")
    held: list[str] = []
    size = 0
    for i in range(len(column)):
        raw = column[i].as_py()
        held.append(unpack(raw))
        size += int.from_bytes(raw[:4], "little")
        if size >= limit or i == len(column) - 1:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.large_string())], ["text"])
            held, size = [], 0
