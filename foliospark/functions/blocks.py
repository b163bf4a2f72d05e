"""Cleaning of the contents of recognised blocks: tables, formulas, running text."""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .batches import in_slices
from .dialect import let, strip

_CELL = re.compile("(<(?:nl|[felux]cel)>)")
_RIGHT, _DOWN, _NL = {"<lcel>", "<xcel>"}, {"<ucel>", "<xcel>"}, "<nl>"


def _run(cells: list[str], kinds: set[str]) -> int:
    """How many of the first cells are of these kinds."""
    return next((i for i, c in enumerate(cells) if c not in kinds), len(cells))


def otsl_to_html(text: str) -> str:
    """HTML of a table in cell tokens; a table that is HTML already, or a text without rows, stays."""
    if text.startswith("<table") and text.endswith("</table>"):
        return text
    parts = [p for p in _CELL.split(text) if p.strip()]
    rows: list[list[str]] = [[]]
    for part in parts:
        if part == _NL:
            rows.append([])
        elif _CELL.fullmatch(part):
            rows[-1].append(part)
    rows = [r for r in rows if r]
    if not rows:
        return text.strip()
    width = max(map(len, rows))
    rows = [r + ["<ecel>"] * (width - len(r)) for r in rows]
    # a cell's text follows its token; reading stops where tokens and rows part ways
    at, made = 0, []
    for i, row in enumerate(rows):
        cells = []
        for j, token in enumerate(row):
            content = ""
            if at < len(parts) and parts[at] == token:
                at += 1
                if at < len(parts) and not _CELL.fullmatch(parts[at]):
                    content, at = parts[at].strip(), at + 1
            if token in ("<fcel>", "<ecel>"):
                down, right = 1 + _run([r[j] for r in rows[i + 1 :]], _DOWN), 1 + _run(row[j + 1 :], _RIGHT)
                spans = "".join(f' {name}="{n}"' for name, n in (("rowspan", down), ("colspan", right)) if n > 1)
                cells.append(f"<td{spans}>{html.escape(content)}</td>")
        if at < len(parts) and parts[at] == _NL:
            at += 1
        made.append(f"<tr>{''.join(cells)}</tr>")
    return f"<table>{''.join(made)}</table>"


def _between(left: str, right: str, body: str, whole: bool = False) -> re.Pattern:
    """What is between two delimiters, or with them, as a group."""
    a, b = re.escape(left), re.escape(right)
    return re.compile(f"({a}{body}{b})" if whole else f"{a}({body}){b}", re.DOTALL)


_EQ = _between("<eq>", "</eq>", ".*?", whole=True)
_ROUND, _SQUARE = (r"\(", r"\)"), (r"\[", r"\]")
_DELIMITED = (_between(*_ROUND, ".+?"), _between(*_SQUARE, ".+?"))


def formula_tags(text: str) -> str:
    r"""\(..\) and \[..\] outside of <eq> tags become such tags."""
    parts = _EQ.split(text)
    for i in range(0, len(parts), 2):
        for pattern in _DELIMITED:
            parts[i] = pattern.sub(lambda m: f"<eq>{m[1].strip()}</eq>", parts[i])
    return "".join(parts)


def image_tags(text: str, sources: dict[str, str]) -> str:
    """[ABCD], for each token of sources, becomes an image of its source."""
    for token, source in sources.items():
        text = re.sub(rf"\[\s*{re.escape(token.strip('[]'))}\s*\]", lambda _, s=source: f'<img src="{s}"/>', text)
    return text


_NUMBERS = re.compile(r"[\s\d,–-]+")
_MACRO = [re.compile(rf"(\\{name})([A-Za-z])(?![A-Za-z])") for name in ("cong", "to", "times", "subset", "in")]
_KNOWN = {f"\\{name}" for name in ("inf", "int", "top")}
_INLINE, _DISPLAY = _between(*_ROUND, ".*?", whole=True), _between(*_SQUARE, ".*?")


def display_to_inline(text: str) -> str:
    r"""\[..\] in running text becomes \(..\), unless it holds numbers only, as a citation does."""
    return _DISPLAY.sub(lambda m: m[0] if _NUMBERS.fullmatch(m[1]) else rf"\({m[1]}\)", text)


def space_macros(text: str) -> str:
    r"""A blank between some macros and a single letter, inside \(..\)."""
    parts = _INLINE.split(text)
    for i in range(1, len(parts), 2):
        inner = parts[i][2:-2]
        for pattern in _MACRO:
            inner = pattern.sub(lambda m: m[0] if m[0] in _KNOWN else f"{m[1]} {m[2]}", inner)
        parts[i] = rf"\({inner}\)"
    return "".join(parts)


def underscores_outside(text: str) -> str:
    r"""Runs of three or more underscores move out of \(..\)."""

    def split(m: re.Match) -> str:
        parts = re.split("(_{3,})", m[1])
        if len(parts) == 1:
            return m[0]
        return " ".join(p if i % 2 else rf"\({p}\)" for i, p in enumerate(parts) if i % 2 or p.strip())

    return _DELIMITED[0].sub(split, text)


def clean(kind: str | None, content: str | None, sources: dict[str, str] | None, formulas: bool) -> str | None:
    """A block's content by its kind (equations are dealt with in expressions); blank becomes null."""
    content_ = (content or "").strip()
    if not content_:
        return None
    if kind == "table":
        content_ = image_tags(otsl_to_html(content_), sources or {})
        return formula_tags(content_) if formulas else content_
    return underscores_outside(space_macros(display_to_inline(content_))) if kind == "text" else content


@F.arrow_udf(ArrayType(StringType()))
def clean_contents(kinds: pa.Array, contents: pa.Array, sources: pa.Array, formulas: pa.Array) -> pa.Array:
    """Contents of the blocks of a page, given their kinds and image sources (JSON of {token: source} or null)."""
    import json

    def some(*columns: list) -> pa.Array:
        rows = zip(*columns, strict=True)
        return pa.array([None if k is None else [clean(a, b, json.loads(s) if s else None, bool(f)) for a, b, s in zip(k, c, ss, strict=True)] for k, c, ss, f in rows], pa.list_(pa.string()))

    return in_slices(some, kinds, contents, sources, formulas)


@F.arrow_udf(StringType())
def table_html(text: pa.Array) -> pa.Array:
    return in_slices(lambda ts: pa.array([None if t is None else otsl_to_html(t) for t in ts], pa.string()), text)


def fix_equation(text: Column) -> Column:
    """Without the delimiters of display math."""
    return strip(F.regexp_replace(F.regexp_replace(strip(text), r"\A\\\[", ""), r"\\\]\z", ""))


def wrap_equation(text: Column) -> Column:
    """As display math on lines of its own; blank stays empty."""
    return let(strip(text), lambda t: F.when(t == "", "").otherwise(F.concat(F.lit("\\[\n"), strip(F.regexp_replace(strip(F.regexp_replace(t, r"\A\\\[", "")), r"\\\]\z", "")), F.lit("\n\\]"))))
