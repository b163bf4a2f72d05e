"""Text quality metrics of a transcription against its reference text.

Edit distance, tail repetition and BLEU need whole texts in Python; one Arrow
function computes all three in one exchange with the workers.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StringType, StructType

from .batches import in_slices
from .text import comparable


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance in code points.

    An alignment found from left to right says how large it is at most, the
    characters' counts how large it is at least.  Where the two are equal that
    is the distance; else it is worked out bit-parallel (Myers 1999), with a
    column of the table as two big integers.
    """
    if a == b:
        return 0
    if len(a) < len(b):
        a, b = b, a
    start, most = 0, len(b)
    step = 1 << 12
    while start < most and a[start : start + step] == b[start : start + step]:
        start += step
    while start < most and a[start] == b[start]:
        start += 1
    start = min(start, most)
    end = 0
    while end < most - start and a[len(a) - 1 - end] == b[most - 1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : most - end]
    if not b:
        return len(a)
    m = len(b)
    if m >= _ALIGN_FROM and (most := _aligned(a, b, m // 4)) <= m // 4:
        if most == _least(a, b):
            return most
        if m >= _BAND_FROM:
            return _banded(a, b, most) if 2 * most + 2 < m // 2 else _whole(a, b)
    if m < _BAND_FROM:
        return _whole(a, b)
    # the error rate at the beginning says how wide a band is tried first
    bound = max(64, len(a) - m, _whole(a[:_PROBE], b[:_PROBE]) * m * 5 // (4 * _PROBE) + 32)
    while 2 * bound + 2 < m // 2:
        if (found := _banded(a, b, bound)) <= bound:
            return found
        bound *= 2
    return _whole(a, b)


_ALIGN_FROM, _BAND_FROM, _PROBE = 64, 1024, 512
#: So many equal characters end a difference; a difference has so many edits at most before the alignment goes on where it came farthest.
_RUN, _EDITS = 6, 12


def _least(a: str, b: str) -> int:
    """A lower bound of the distance: an edit takes away one surplus character on either side at most."""
    more = fewer = 0
    for c in {*a, *b}:
        surplus = a.count(c) - b.count(c)
        if surplus > 0:
            more += surplus
        else:
            fewer -= surplus
    return max(more, fewer)


def _aligned(a: str, b: str, most: int) -> int:
    """The number of edits of one alignment, so at least the distance; anything above most once it is beyond that.

    At each difference the diagonals around are followed with one edit more a
    round (Ukkonen 1985), until one of them has a run of equal characters.
    """
    n, m = len(a), len(b)
    i = j = cost = 0
    while cost <= most:
        while i < n and j < m and a[i : i + 16] == b[j : j + 16]:
            i, j = i + 16, j + 16
        while i < n and j < m and a[i] == b[j]:
            i, j = i + 1, j + 1
        if i >= n or j >= m:
            return cost + max(n - i, 0) + max(m - j, 0)
        if a[i + 1 : i + 1 + _RUN] == b[j + 1 : j + 1 + _RUN]:
            i, j, cost = i + 1, j + 1, cost + 1
            continue
        # front[q]: the farthest place in a on the diagonal q - 2 - edits from (i, j), -1 if there is none
        front = [-1, -1, i, -1, -1]
        for edits in range(1, _EDITS + 1):
            new, longest, farthest, at, edge = [-1, -1], -1, -1, None, (i, j)
            for q in range(1, 2 * edits + 2):
                x = max(front[q] + 1 if front[q] >= 0 else -1, front[q - 1] + 1 if front[q - 1] >= 0 else -1, front[q + 1])
                y = x - i + j - (q - 1 - edits)
                if x < 0 or x > n or y > m:
                    new.append(-1)
                    continue
                began = x
                while x < n and y < m and a[x] == b[y] and x - began < 32:
                    x, y = x + 1, y + 1
                new.append(x)
                if x + y > farthest:
                    farthest, edge = x + y, (x, y)
                if x - began > longest and (x - began >= _RUN or x == n and y == m):
                    longest, at = x - began, (x, y)
            if at:
                break
            front = [*new, -1, -1]
        i, j = at or edge
        cost += edits
    return cost


def _places(b: str) -> dict[str, int]:
    """A bit for each place of each character."""
    found: dict[str, list[int]] = {}
    for i, c in enumerate(b):
        found.setdefault(c, []).append(i)
    size = len(b) // 8 + 1
    bits = {}
    for c, at in found.items():
        raw = bytearray(size)
        for i in at:
            raw[i >> 3] |= 1 << (i & 7)
        bits[c] = int.from_bytes(raw, "little")
    return bits


def _whole(a: str, b: str) -> int:
    where, m = _places(b), len(b)
    full, last = (1 << m) - 1, 1 << (m - 1)
    up, down, distance = full, 0, m
    for c in a:
        eq = where.get(c, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        plus = down | (full & ~(diagonal | up))
        minus = up & diagonal
        if plus & last:
            distance += 1
        elif minus & last:
            distance -= 1
        plus = (plus << 1 | 1) & full
        minus = (minus << 1) & full
        up = minus | (full & ~(diagonal | plus))
        down = plus & diagonal
    return distance


def _banded(a: str, b: str, bound: int) -> int:
    """The distance if it is at most bound (else something larger): only the cells near the diagonal (Hyyro 2003).

    The band moves down by one row with each character of a; its top bit is
    followed until it comes to the last row, then the last row is.
    """
    where, m = _places(b), len(b)
    width = 2 * bound + 2
    full, top = (1 << width) - 1, width - 1
    up, down, distance, start = ((1 << (bound + 1)) - 1) << (width - bound - 1), 0, bound, bound + 1 - width
    for i, c in enumerate(a):
        eq = where.get(c, 0)
        eq = (eq >> start if start >= 0 else eq << -start) & full
        start += 1
        diagonal = ((((eq & up) + up) ^ up) | eq | down) & full
        plus = down | (full & ~(diagonal | up))
        minus = diagonal & up
        if i < m - bound:
            distance += not diagonal >> top & 1
        else:
            row = top - 1 - (i - (m - bound))
            distance += (plus >> row & 1) - (minus >> row & 1)
        shifted = diagonal >> 1
        up = minus | (full & ~(shifted | plus))
        down = shifted & plus
    return distance


def tail_repeats(text: str) -> bool:
    """Whether a suffix of at least a fifth of the text, but not all of it, is two or more copies of one block."""
    n = len(text)
    low = max(2, n - int(0.8 * n))

    def copies(d: int) -> bool:
        size = d * max(2, -(-low // d))
        return size <= n - 1 and text[n - size : n - d] == text[n - size + d :]

    probe = min(16, n)
    if any(copies(d) for d in range(1, min(probe, (n - 1) // 2) + 1)):
        return True
    # longer blocks: the last characters must occur one block earlier
    tail, at = text[n - probe :], n - probe
    while (at := text.rfind(tail, 0, at + probe - 1)) >= 0:
        d = n - probe - at
        if d > (n - 1) // 2:
            return False
        if copies(d):
            return True
    return False


_TOKEN_RULES = (
    (re.compile(r"([ -&(-+:-@/\[-`{-~])"), r" \1 "),
    (re.compile(r"([^0-9])([,.])"), r"\1 \2 "),
    (re.compile(r"([,.])([^0-9])"), r" \1 \2"),
    (re.compile(r"([0-9])(-)"), r"\1 \2 "),
)
_ESCAPED = (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"))


def bleu_tokens(text: str) -> list[str]:
    """The public "13a" tokenisation."""
    text = text.replace("<skipped>", "").replace("-\n", "").replace("\n", " ")
    for name, character in _ESCAPED:
        text = text.replace(name, character)
    text = f" {text} "
    for pattern, spaced in _TOKEN_RULES:
        text = pattern.sub(spaced, text)
    return text.split()


def bleu(prediction: str, reference: str, order: int = 4) -> float:
    """BLEU of one text against one reference, without smoothing; 0 if either has no tokens."""
    mine, theirs = bleu_tokens(prediction), bleu_tokens(reference)
    if not mine or not theirs:
        return 0.0
    logs = 0.0
    for n in range(1, order + 1):
        own, other = (Counter(zip(*(x[i:] for i in range(n)), strict=False)) for x in (mine, theirs))
        common = sum(min(k, other[gram]) for gram, k in own.items() if gram in other)
        if not common:
            return 0.0
        logs += math.log(common / (len(mine) - n + 1))
    ratio = len(mine) / len(theirs)
    return math.exp(logs / order) * (1.0 if ratio > 1 else math.exp(1 - 1 / ratio))


SCORES = {"distance": (IntegerType(), pa.int32()), "repetition": (BooleanType(), pa.bool_()), "bleu": (DoubleType(), pa.float64())}
_SCORE = {"distance": edit_distance, "repetition": lambda p, _: tail_repeats(p), "bleu": lambda p, g: bleu(p, g) if p.strip() else 0.0}


def text_scores(prediction: Column, reference: Column, arabic: Column, wanted: tuple[str, ...] = tuple(SCORES)) -> Column:
    """A struct of both normal forms (mine, theirs) and the wanted ones of distance, repetition, bleu, in one exchange with the workers; a null is an empty text.

    arabic: whether a row's Arabic letters are folded.
    """
    kind = StructType().add("mine", StringType()).add("theirs", StringType())
    for name in wanted:
        kind = kind.add(name, SCORES[name][0])

    def some(predictions: list, references: list, folds: list) -> pa.Array:
        mine, theirs = ([comparable(t, f) for t, f in zip(ts, folds, strict=True)] for ts in (predictions, references))
        found = [pa.array([_SCORE[name](p, g) for p, g in zip(mine, theirs, strict=True)], SCORES[name][1]) for name in wanted]
        return pa.StructArray.from_arrays([pa.array(mine, pa.string()), pa.array(theirs, pa.string()), *found], ["mine", "theirs", *wanted])

    @F.arrow_udf(kind)
    def scores(prediction: pa.Array, reference: pa.Array, arabic: pa.Array) -> pa.Array:
        return in_slices(some, prediction, reference, arabic)

    return scores(prediction, reference, arabic)


@F.arrow_udf(IntegerType())
def _distance(a: pa.Array, b: pa.Array) -> pa.Array:
    return in_slices(lambda xs, ys: pa.array([None if x is None or y is None else edit_distance(x, y) for x, y in zip(xs, ys, strict=True)], pa.int32()), a, b)


@F.arrow_udf(BooleanType())
def has_long_repetition(text: pa.Array) -> pa.Array:
    return in_slices(lambda ts: pa.array([None if t is None else tail_repeats(t) for t in ts], pa.bool_()), text)


def levenshtein_distance(a: Column, b: Column, cutoff: int | None = None) -> Column:
    """Edit distance of any texts; one more than cutoff stands for all that is beyond it."""
    found = _distance(a, b)
    return found if cutoff is None else F.least(found, F.lit(cutoff + 1))


def similarity(distance: Column, a: Column, b: Column) -> Column:
    """1 - distance / longer length; two empty texts are equal."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).otherwise(1 - distance / longer)


@F.arrow_udf(DoubleType())
def round_metric(value: pa.Array) -> pa.Array:
    """One decimal place, half to even on the exact binary value, for reports."""
    return pa.array([None if v is None else float(f"{v:.1f}") for v in value.to_pylist()], pa.float64())


def percentage(value: Column) -> Column:
    return round_metric(value.cast("double") * 100)
