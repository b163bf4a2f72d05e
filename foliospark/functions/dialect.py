"""Regular-expression rules that run in Spark (Java) and can be spelled in SQL (RE2).

Python's notions of blank, digit and word character are written out as explicit
classes, so both dialects agree with it.  A replacement refers to a group as $1.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Inside brackets: what Python's \s matches, and the same without the line feed and other line breaks.
BLANKS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
INLINE = r"\t\x1f\x20\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}"
W, H = f"[{BLANKS}]", f"[{INLINE}]"
BLANK_CHARACTERS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x20\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
INLINE_CHARACTERS = "".join(c for c in BLANK_CHARACTERS if c not in "\n\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029")
DIGIT, WORD = r"\p{Nd}", r"[\p{L}\p{N}_]"
LINE_BREAK = r"\r\n|[\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


class Rule(NamedTuple):
    pattern: str
    replacement: str = ""
    flags: str = ""  # of i, m, s
    needs: tuple[str, ...] = ()  # a text without any of these has no match

    @property
    def java(self) -> str:
        # d: only a line feed ends a line; U: Unicode case folding and word boundaries
        return f"(?{self.flags}{'d' if 'm' in self.flags else ''}U)" + self.pattern

    @property
    def python(self) -> re.Pattern:
        pattern = self.pattern.replace(W, r"\s").replace(WORD, r"\w").replace(DIGIT, r"\d").replace(r"\z", r"\Z")
        pattern = re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: f"\\u{int(m[1], 16):04x}", pattern)
        return re.compile((f"(?{self.flags})" if self.flags else "") + pattern)

    @property
    def re2(self) -> str:
        return (f"(?{self.flags})" if self.flags else "") + self.pattern


def replace_all(text: Column, rules: Iterable[Rule]) -> Column:
    """text after all rules in turn; a search for what a rule needs spares most texts its pattern."""
    for rule in rules:
        if rule.needs:
            text = let(text, _sparing(rule))
        else:
            text = F.regexp_replace(text, rule.java, rule.replacement)
    return text


def in_python(rules: Iterable[Rule]) -> Callable[[str], str]:
    """replace_all() of one text in Python."""
    ready = [(rule.needs, rule.python.sub, rule.replacement.replace("$", "\\")) for rule in rules]

    def replaced(text: str) -> str:
        for needs, sub, new in ready:
            if not needs or any(x in text for x in needs):
                text = sub(new, text)
        return text

    return replaced


def _sparing(rule: Rule) -> Callable[[Column], Column]:
    def replaced(text: Column) -> Column:
        there = reduce(Column.__or__, [F.contains(text, F.lit(x)) for x in rule.needs])
        return F.when(there, F.regexp_replace(text, rule.java, rule.replacement)).otherwise(text)

    return replaced


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(BLANK_CHARACTERS))


STRIP = (Rule(rf"\A{W}+"), Rule(rf"{W}+\z"))


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_replace_all(text: str, rules: Iterable[Rule]) -> str:
    for rule in rules:
        new = rule.replacement.replace("$", "\\")
        text = f"regexp_replace({text}, {quote(rule.re2)}, {quote(new)}, 'g')"
    return text


def sql_strip(text: str) -> str:
    return sql_replace_all(text, STRIP)
