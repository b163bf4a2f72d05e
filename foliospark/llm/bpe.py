"""Operator 1: byte-level BPE encoding and decoding by speculation and verification.

Texts are split into words by the vocabulary's pattern.  For the distinct words
of a batch, a greedy longest-match walk over a trie (all words at once, in
numpy) proposes tokens.  A token sequence is the BPE encoding of its bytes
exactly when each token encodes to itself and each adjacent pair, encoded
together, gives that pair again; this is tested for all adjacent pairs at once
by undoing merges.  Only words with a failing pair are merged step by step.

Defined results: a null text has null tokens and a null count; an empty text
has no tokens; all other columns stay as they are, and one called ``tokens``,
``n_tokens`` or ``round_trip`` is replaced.  Decoding null gives null, ids
outside the vocabulary give null, bytes that aren't UTF-8 become U+FFFD.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructType

from ._spark import map_rows
from ._text import buffers, lists, pieces

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NONE = np.iinfo(np.int64).max
#: Words that one Python worker remembers; beyond it the memory starts anew, results stay the same.
REMEMBERED = 100_000


def read_ranks(path: str) -> list[bytes]:
    """Tokens by id, from lines of a base64 token and its id."""
    with open(path, "rb") as file:
        pairs = [line.split() for line in file if line.strip()]
    tokens: list[bytes] = [b""] * (max(int(i) for _, i in pairs) + 1)
    for token, i in pairs:
        tokens[int(i)] = base64.b64decode(token)
    return tokens


def merge(word: bytes, ranks: dict[bytes, int], below: int = NONE) -> list[int]:
    """Exact BPE: the leftmost adjacent pair of the lowest id is merged until none is left."""
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        best, at = below, -1
        for i in range(len(parts) - 1):
            found = ranks.get(parts[i] + parts[i + 1], NONE)
            if found < best:
                best, at = found, i
        if at < 0:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[x] for x in parts]


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """merge() with a heap, for words whose length makes rescans slow."""
    import heapq

    n = len(word)
    if n < 64:
        return merge(word, ranks)
    part = [word[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, part[i], part[i + 1]) for i in range(n - 1) if (r := ranks.get(part[i] + part[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if part[i] != a or j >= n or part[j] != b:
            continue
        part[i], part[j] = a + b, b""
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        for k in (before[i], i):
            if k >= 0 and after[k] < n and (r := ranks.get(part[k] + part[after[k]])) is not None:
                heapq.heappush(heap, (r, k, part[k], part[after[k]]))
    return [ranks[x] for x in part if x]


class Vocabulary:
    """Tables of a byte-level BPE vocabulary, in numpy arrays that can be broadcast."""

    def __init__(self, tokens: list[bytes], pattern: str = PATTERN) -> None:
        self.tokens, self.pattern = tokens, pattern
        ranks = {t: i for i, t in enumerate(tokens) if t}
        size = len(tokens)
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks the bytes {missing[:5]}")
        self.left, self.right = np.arange(size), np.arange(size)
        whole = np.zeros(size, dtype=bool)
        keys, made = [], []
        for i, token in enumerate(tokens):
            if len(token) > 1:
                halves = merge(token, ranks, i)
                whole[i] = len(halves) == 2
                if whole[i]:
                    self.left[i], self.right[i] = halves
                    keys.append(halves[0] * size + halves[1])
                    made.append(i)
            else:
                whole[i] = len(token) == 1
        by = np.argsort(np.array(keys, dtype=np.int64))
        self.pair_keys, self.pair_made = np.array(keys, dtype=np.int64)[by], np.array(made, dtype=np.int64)[by]
        # trie of the tokens that encode to themselves
        nodes: dict[int, int] = {}
        value = [-1]
        for i in np.flatnonzero(whole):
            at = 0
            for b in tokens[i]:
                child = nodes.get(at << 8 | b)
                if child is None:
                    child = nodes[at << 8 | b] = len(value)
                    value.append(-1)
                at = child
            value[at] = int(i)
        edges = np.fromiter(nodes.keys(), np.int64, len(nodes))
        by = np.argsort(edges)
        self.edges, self.children, self.value = edges[by], np.fromiter(nodes.values(), np.int64, len(nodes))[by], np.array(value)
        self.size = np.array([len(t) for t in tokens], dtype=np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        self.bytes = np.frombuffer(b"".join(tokens), dtype=np.uint8)

    @property
    def ranks(self) -> dict[bytes, int]:
        return {t: i for i, t in enumerate(self.tokens) if t}


def propose(v: Vocabulary, data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, number by word) of the greedy longest match; all words advance together."""
    n = len(first) - 1
    end = first[1:]
    position, words = first[:-1].copy(), np.arange(n)
    live = np.flatnonzero(position < end)
    found_word, found_token = [], []
    while len(live):
        node = np.zeros(len(live), dtype=np.int64)
        at = position[live]
        best, best_end = np.full(len(live), -1), at.copy()
        walking = np.arange(len(live))
        while len(walking):
            key = node[walking] << 8 | data[at[walking]]
            place = np.minimum(np.searchsorted(v.edges, key), len(v.edges) - 1)
            ok = v.edges[place] == key
            walking, place = walking[ok], place[ok]
            node[walking] = v.children[place]
            at[walking] += 1
            token = v.value[node[walking]]
            hit = walking[token >= 0]
            best[hit], best_end[hit] = token[token >= 0], at[hit]
            walking = walking[at[walking] < end[live[walking]]]
        found_word.append(words[live])
        found_token.append(best)
        position[live] = best_end
        live = live[best_end < end[live]]
    if not found_word:
        return np.zeros(0, np.int64), np.zeros(n, np.int64)
    word, token = np.concatenate(found_word), np.concatenate(found_token)
    by = np.argsort(word, kind="stable")
    return token[by], np.bincount(word, minlength=n)


def compatible(v: Vocabulary, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the bytes of token a and then of token b encode to just (a, b)."""
    size = len(v.left)
    good = np.ones(len(a), dtype=bool)
    live, a, b = np.arange(len(a)), a.copy(), b.copy()
    limit = np.full(len(a), NONE)
    while len(live):
        key = a * size + b
        place = np.minimum(np.searchsorted(v.pair_keys, key), len(v.pair_keys) - 1)
        made = np.where(v.pair_keys[place] == key, v.pair_made[place], NONE)
        bad = made < limit
        good[live[bad]] = False
        # undo the later of the two last merges; what is left of it at the seam may merge across only after it was made
        first = a > b
        bound_a, bound_b = a, b + 1
        part_a, part_b = v.right[a], v.left[b]
        single_a, single_b = part_a == a, part_b == b
        split_a = (first & ~single_a) | (~first & single_b)
        split_b = (~first & ~single_b) | (first & single_a)
        done = (single_a & single_b) | bad
        limit = np.where(split_a, bound_a, bound_b)
        a, b = np.where(split_a, part_a, a), np.where(split_b & ~split_a, part_b, b)
        live, a, b, limit = live[~done], a[~done], b[~done], limit[~done]
    return good


class Encoder:
    def __init__(self, v: Vocabulary) -> None:
        self.v, self.find, self.ranks = v, regex.compile(v.pattern).findall, v.ranks
        self.exact = 0
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.first, self.tokens = np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.int32)

    def learn(self, words: list[str]) -> None:
        """Encode words that aren't known yet."""
        raw = [w.encode("utf-8") for w in words]
        first = np.zeros(len(raw) + 1, dtype=np.int64)
        np.cumsum([len(x) for x in raw], out=first[1:])
        tokens, counts = propose(self.v, np.frombuffer(b"".join(raw), dtype=np.uint8), first)
        word = np.repeat(np.arange(len(raw)), counts)
        seam = np.flatnonzero(word[1:] == word[:-1])
        pairs, which = np.unique(tokens[seam] * len(self.v.left) + tokens[seam + 1], return_inverse=True)
        good = compatible(self.v, pairs // len(self.v.left), pairs % len(self.v.left))
        failing = np.unique(word[seam[~good[which]]])
        self.exact += len(failing)
        if len(failing):
            redone = {int(i): merge_long(raw[i], self.ranks) for i in failing}
            bounds = np.concatenate([[0], np.cumsum(counts)])
            keep = np.ones(len(raw), dtype=bool)
            keep[failing] = False
            order = np.concatenate([word[keep[word]], np.repeat(failing, [len(redone[int(i)]) for i in failing])])
            flat = np.concatenate([tokens[keep[word]], np.array([t for i in failing for t in redone[int(i)]], dtype=np.int64)])
            tokens = flat[np.argsort(order, kind="stable")]
            counts[failing] = [len(redone[int(i)]) for i in failing]
            del bounds
        base = len(self.first) - 1
        self.known.update(zip(words, range(base, base + len(words)), strict=True))
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(counts)])
        self.tokens = np.concatenate([self.tokens, tokens.astype(np.int32)])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, number by text); a null counts as an empty text."""
        found = [self.find(t) if t else [] for t in texts]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        coded = pa.array([w for ws in found for w in ws], pa.string()).dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.known) + len(distinct) > REMEMBERED:
            self._forget()
        if new := [w for w in distinct if w not in self.known]:
            self.learn(new)
        known = self.known
        place = np.fromiter((known[w] for w in distinct), np.int64, len(distinct))
        where = place[coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)] if len(distinct) else np.zeros(0, np.int64)
        start, count = self.first[where], self.first[where + 1] - self.first[where]
        ends = np.cumsum(count)
        tokens = self.tokens[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - count), count)]
        total = np.concatenate([[0], ends])
        bounds = total[np.concatenate([[0], np.cumsum(sizes)])]
        return tokens, np.diff(bounds)


def decode_bytes(v: Vocabulary, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, number of bytes before each token and in all)."""
    size = v.size[tokens]
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return v.bytes[np.arange(total) + np.repeat(v.at[tokens] - (ends - size), size)], np.concatenate([[0], ends])


@lru_cache(maxsize=4)
def vocabulary(path: str = VOCABULARY, pattern: str = PATTERN) -> Vocabulary:
    return Vocabulary(read_ranks(path), pattern)


_encoders: dict[str, Encoder] = {}


def _encoder(name: str, shared) -> Encoder:
    """The encoder of this Python worker, kept from task to task; another vocabulary takes its place."""
    if name not in _encoders:
        _encoders.clear()
        _encoders[name] = Encoder(shared.value)
    return _encoders[name]


def encode(docs: DataFrame, path: str = VOCABULARY, pattern: str = PATTERN, text_col: str = "text", *, keep_text: bool = True) -> DataFrame:
    """docs with tokens array<int>, n_tokens and round_trip (decoding gives the text's bytes again).

    The vocabulary is read once, on the driver; its tables (some MB, a size
    that doesn't depend on the data) are broadcast.
    """
    made = {"tokens": ArrayType(IntegerType()), "n_tokens": IntegerType(), "round_trip": BooleanType()}
    kept = [x for x in docs.schema if x.name not in made and (keep_text or x.name != text_col)]
    schema = StructType(list(kept))
    for column, kind in made.items():
        schema = schema.add(column, kind)
    names = [x.name for x in kept]
    v = vocabulary(path, pattern)
    name, shared = hashlib.sha256(repr((pattern, v.tokens)).encode()).hexdigest(), docs.sparkSession.sparkContext.broadcast(v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(name, shared)
        for batch in batches:
            for part in pieces(batch, text_col):
                column = part.column(text_col)
                tokens, counts = encoder.encode(column.to_pylist())
                data, offsets = buffers(column)
                again, before = decode_bytes(encoder.v, tokens)
                bounds = before[np.concatenate([[0], np.cumsum(counts)])]
                same = bounds[1:] == offsets[1:]
                if len(again) == len(data):
                    wrong = np.concatenate([[0], np.cumsum(again != data)])
                    same &= wrong[offsets[1:]] == wrong[offsets[:-1]]
                null = np.asarray(column.is_null())
                ids = lists(tokens, counts, pa.int32())
                if null.any():
                    ids = pa.ListArray.from_arrays(pa.array(np.asarray(ids.offsets), pa.int32(), mask=np.append(null, False)), ids.values)
                yield pa.RecordBatch.from_arrays([*(part.column(x) for x in names), ids, pa.array(counts, pa.int32(), mask=null), pa.array(same, pa.bool_(), mask=null)], [*names, *made])

    return map_rows(docs, run, schema)


def decode(encoded: DataFrame, path: str = VOCABULARY, tokens_col: str = "tokens", text_col: str = "text") -> DataFrame:
    """encoded with the text of its tokens in text_col (a column of that name is replaced)."""
    kept = [x for x in encoded.schema if x.name != text_col]
    names = [x.name for x in kept]
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for batch in batches:
            texts: list[str | None] = []
            for ids in batch.column(tokens_col).to_pylist():
                if ids is None or any(i is None or not 0 <= i < len(v.tokens) for i in ids):
                    texts.append(None)
                else:
                    texts.append(b"".join([v.tokens[i] for i in ids]).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), pa.array(texts, pa.string())], [*names, text_col])

    return map_rows(encoded.withColumn(tokens_col, F.col(tokens_col).cast("array<int>")), run, StructType(kept).add(text_col, StringType()))
