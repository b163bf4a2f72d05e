"""Plain text out of transcription responses, and its normal form for comparison.

The steps on wrappers and front matter are built-in expressions.  Plain text of
markup and the normal form are one Arrow function each: their rules are the
same as in SQL, but Python finds out faster that a text needs few of them.
A null text stays null throughout.
"""

from __future__ import annotations

import html
import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .batches import in_slices
from .dialect import DIGIT, INLINE_CHARACTERS, LINE_BREAK, WORD, H, Rule, W, in_python, let, replace_all, strip
from .xml import flatten

OUTPUT_TAG = "output"

# --- wrappers -----------------------------------------------------------------


def tag_patterns(tag: str = OUTPUT_TAG) -> tuple[Rule, Rule]:
    """(the tag around a whole text, any stray tag)."""
    return Rule(rf"\A{W}*<{tag}>{W}*(.*?){W}*</{tag}>{W}*\z", "$1", "s"), Rule(rf"</?{tag}\b[^>]*>", "", "i")


def strip_output_tag(text: Column, tag: str = OUTPUT_TAG) -> Column:
    """The body if one tag wraps the whole text, else the text without stray tags."""
    whole, stray = tag_patterns(tag)
    return F.when(text.rlike(whole.java), strip(F.regexp_extract(text, whole.java, 1))).otherwise(strip(replace_all(text, [stray])))


FENCE = Rule(r"\A(`{3,}|~{3,})[^\n]*\n(.*)\n\1\z", "", "s")


def strip_outer_fence(text: Column) -> Column:
    """The body of a fenced code block that is the whole text."""
    return let(strip(text), lambda t: F.when(t.rlike(FENCE.java), strip(F.regexp_extract(t, FENCE.java, 2))).otherwise(t))


def strip_code_fence(text: Column) -> Column:
    """Without a first line that opens a fence and a last line that begins with one; JSON answers come so."""
    text = strip(text)
    lines = F.split(F.regexp_replace(text, LINE_BREAK, "\n"), "\n")
    rest = F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))
    rest = F.when(F.try_element_at(rest, F.lit(-1)).startswith("```"), F.slice(rest, 1, F.greatest(F.size(rest) - 1, F.lit(0)))).otherwise(rest)
    body = F.when(F.size(lines) >= 2, strip(F.array_join(rest, "\n"))).otherwise(text)
    return F.when(text.startswith("```"), body).otherwise(text)


def strip_trailing_tokens(text: Column, tokens: tuple[str, ...], rounds: int | None = 8) -> Column:
    """Without special tokens at the end, of which at most ``rounds`` go (None: all)."""
    many = f"{{1,{rounds}}}" if rounds else "+"
    return F.regexp_replace(text, rf"(?:{W}*(?:{'|'.join(map(re.escape, tokens))})){many}\z", "")


def trim_stop_strings(text: Column, stops: tuple[str, ...] = ("<|endoftext|>", "<|im_end|>")) -> Column:
    for stop in stops:
        text = F.substring_index(text, stop, 1)
    return strip(text)


ROLES = ("assistant", "system", "user")
#: A first line that only names a role.
ROLE_LINE = Rule(r"\A(?:(?:assistant|system|user):?|<\|?(?:assistant|system|user)\|?>|<[|｜](?:assistant|system|user)[|｜]>:?)\z", "", "i")


def strip_chat_scaffold(text: Column, prompts: tuple[str, ...] = (), rounds: int = 8) -> Column:
    """Without an echo of a prompt and role names at the beginning, in at most ``rounds`` steps.

    In each step the first prompt that begins the text (in any case) goes, else
    a first line that only names a role.
    """
    prompts = tuple(p.strip() for p in prompts if p and p.strip())

    def step(state: Column) -> Column:
        lowered, cut = F.lower(state), F.lit(None).cast("string")
        for prompt in reversed(prompts):
            begins = lowered.startswith(prompt.lower())
            cut = F.when(begins, F.regexp_replace(F.substring(state, len(prompt) + 1, 2**31 - 1), rf"\A{W}+", "")).otherwise(cut)
        line = strip(F.regexp_extract(state, r"\A([^\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]*)", 1))
        rest = F.regexp_replace(F.regexp_replace(state, r"\A[^\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]*", ""), rf"\A{W}+", "")
        return F.coalesce(cut, F.when(line.rlike(ROLE_LINE.java), rest).otherwise(state))

    # a fold over the steps, so that the expression doesn't double in each one
    return strip(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), strip(text), lambda state, _: step(state)))


# --- front matter -------------------------------------------------------------


def split_front_matter(text: Column) -> tuple[Column, Column]:
    """(front matter: map of strings, body) of a text that begins with --- and has a line beginning with --- later.

    Values are trimmed; ``null`` is null, true and false are in lower case; a
    later key replaces an equal one.  Without front matter the map is empty.
    """
    def value_of(line: Column) -> Column:
        value = strip(F.substring(line, F.locate(":", line) + 1, F.lit(2**31 - 1)))
        return let(value, lambda v: F.when(F.lower(v) == "null", None).when(F.lower(v).isin("true", "false"), F.lower(v)).when(v.rlike(r"\A-?[0-9]+\z"), F.regexp_replace(v, r"\A(-?)0+([0-9])", "$1$2")).otherwise(v))

    def fields(block: Column) -> Column:
        lines = F.filter(F.split(F.regexp_replace(block, LINE_BREAK, "\n"), "\n"), lambda x: x.contains(":"))
        pairs = F.transform(lines, lambda x: F.struct(strip(F.substring_index(x, ":", 1)).alias("key"), value_of(x).alias("value")))
        last = let(pairs, lambda ps: F.filter(ps, lambda p, i: ~F.exists(F.slice(ps, i + 2, F.size(ps) + 1), lambda q: q["key"] == p["key"])))
        return F.map_from_entries(last)

    def end(t: Column) -> Column:
        return F.when(t.startswith("---\n"), F.locate("\n---", t, 5)).otherwise(0)  # from 1, or 0

    def front(t: Column) -> Column:
        return let(end(t), lambda e: F.when(e > 0, fields(F.substring(t, F.lit(5), F.greatest(e - 5, F.lit(0))))).otherwise(F.create_map().cast("map<string,string>")))

    # the body has no nested lambdas: as an argument of a Python function such an expression isn't planned
    body = let(strip(text), lambda t: F.when(end(t) > 0, strip(F.substring(t, end(t) + 4, F.lit(2**31 - 1)))).otherwise(t))
    return let(strip(text), front), body


# --- markup -------------------------------------------------------------------


def _opening(names: str, more: str = "") -> str:
    return rf"<{W}*(?:{names})\b{more}[^>]*>"


_VALUE = "|".join((r'"[^"]*"', r"'[^']*'", rf"[^{W[1:-1]}>]+"))
_LINES = "caption|div|h[1-6]|li|ol|p|pre|table|tr|ul"
_INLINE = "a|b|big|caption|chem|code|div|em|h[1-6]|i|math|ol|p|pre|small|span|strong|sub|sup|table|tbody|td|tfoot|th|thead|tr|u|ul"

_TAG, _LINE = ("<",), ("\n",)

BEFORE_ENTITIES = (
    Rule(r"!\[[^\]]*\]\([^)]+\)", needs=("![",)),
    Rule(r"\[([^\]]+)\]\([^)]+\)", "$1", needs=("](",)),
    Rule(_opening("input", rf"[^>]*\bchecked(?:=(?:{_VALUE}))?"), "[x]", "is", _TAG),
    Rule(_opening("input"), "[ ]", "is", _TAG),
    *(Rule(rf"<{W}*{name}{W}*/?{W}*>", "\n", "i", _TAG) for name in ("br", "hr")),
    Rule(rf"</{W}*(?:{_LINES}){W}*>", "\n", "i", _TAG),
    Rule(rf"</{W}*t[dh]{W}*>", " | ", "i", _TAG),
    Rule(_opening("li"), "", "i", _TAG),
    Rule(rf"</?{W}*(?:{_INLINE})\b[^>]*>", "", "i", _TAG),
    Rule(_opening("img"), "", "i", _TAG),
)
_LETTER = "[a-z]"
_MARKUP = (
    Rule(rf"</?{_LETTER}[^>]*>", "", "is", _TAG),
    Rule(rf"^{W}{{0,3}}#{{1,6}}{W}*", "", "m", ("#",)),
    Rule(rf"^{W}*[-+*]{W}+", "", "m", ("-", "+", "*")),
    Rule(rf"^{W}*>{W}?", "", "m", (">",)),
    *(Rule(mark, needs=(mark.replace("\\", ""),)) for mark in ("```", r"\*\*", "__", "`")),
    Rule(r"[\t\x20]+\n", "\n", needs=_LINE),
    Rule(r"[\t\x20]{2,}", " ", needs=("  ", "\t")),
    Rule(LINE_BREAK, "\n", needs=tuple("\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029")),
)
# by line: blanks and pipes at its ends, blanks around pipes; one empty line at most
_ENDS = (Rule(rf"^{H}+", "", "m"), Rule(rf"{H}+$", "", "m"))
_PIPES = (
    Rule(rf"{H}*\|{H}*$", "", "m", ("|",)),
    Rule(rf"^\|{H}*", "", "m", ("|",)),
    Rule(rf"{H}*\|{H}*", " | ", needs=("|",)),
    Rule(r"\n{3,}", "\n\n", needs=("\n\n\n",)),
)
AFTER_ENTITIES = (*_MARKUP, *_ENDS, *_PIPES)
_before, _markup, _pipes = in_python(BEFORE_ENTITIES), in_python(_MARKUP), in_python(_PIPES)


def plain(text: str) -> str:
    """markup_to_text() of one text."""
    text = _before(text.strip())
    if "&" in text:
        text = html.unescape(text)
    text = _markup(text)
    text = "\n".join([line.strip(INLINE_CHARACTERS) for line in text.split("\n")])  # _ENDS
    return _pipes(text).strip()


@F.arrow_udf(StringType())
def _plain(text: pa.Array) -> pa.Array:
    return in_slices(lambda ts: pa.array([None if t is None else plain(t) for t in ts], pa.string()), text)


def markup_to_text(text: Column) -> Column:
    """Plain text of Markdown and HTML: links and cells keep their text, tables become lines with ``|``."""
    return _plain(text)


# --- normal form --------------------------------------------------------------

GLYPHS = {"\ueada": "st", "\ueba2": "si", "\ueba3": "sl", "\ueba6": "ss", "\ueba7": "ssi", "\ueec5": "ct", "\u00ac": "-", "\u2019": "'"}
_FRACTIONS = "¼-¾⅐-⅞↉"
LONG_S, STAND_IN = "\u017f", "\ue000"


@F.arrow_udf(StringType())
def compatible(text: pa.Array) -> pa.Array:
    """Unicode normal form KC; ASCII texts are left as they are."""
    some = pc.fill_null(pc.invert(pc.string_is_ascii(text)), False)
    if not pc.any(some).as_py():
        return text
    return pc.replace_with_mask(text, some, pa.array([unicodedata.normalize("NFKC", t) for t in text.filter(some).to_pylist()], text.type))


GLYPH_RULES = tuple(Rule(a, b, needs=(a,)) for a, b in GLYPHS.items())
FRACTION_RULE = Rule(f"({DIGIT})([{_FRACTIONS}])", "$1 $2")
TILDE_RULE = Rule(rf"(\A|{W})~({WORD})", "$1$2", needs=("~",))


def normalize_characters(text: Column, *, keep_long_s: bool = True) -> Column:
    """Compatibility forms and special glyphs replaced, a blank between a digit and a fraction, no tilde at a word's start."""
    text = replace_all(text, [FRACTION_RULE])
    text = F.replace(text, F.lit(LONG_S), F.lit(STAND_IN)) if keep_long_s else text
    text = compatible(text)
    text = F.replace(text, F.lit(STAND_IN), F.lit(LONG_S)) if keep_long_s else text
    return replace_all(text, [*GLYPH_RULES, TILDE_RULE])


# vowel signs U+064B to U+0652, tatweel U+0640; hamza on its carriers
_MARKS = Rule(r"[\x{64b}-\x{652}\x{640}]")
_HAMZA, _MADDA = "ء", "آ"
_CARRIED = Rule(r"[\x{623}-\x{626}\x{654}\x{655}]", _HAMZA)


def fold_arabic(text: Column) -> Column:
    """Without vowel signs and tatweel, all forms of hamza as one; written from public descriptions of these folds."""
    text = replace_all(text, [_MARKS])
    short = text.startswith(_MADDA) & (F.length(text) == 3)
    text = F.when(short, F.concat(F.lit(_HAMZA + "ا"), F.substring(text, 2, 2))).otherwise(text)
    return replace_all(F.replace(text, F.lit(_MADDA), F.lit(_HAMZA * 2)), [_CARRIED])


NORMAL_RULES = (
    Rule("[#*_`~]"),
    Rule(r"[\x{2010}-\x{2012}\x{2013}-\x{2015}\x{2212}]", "-"),
    Rule(rf"\[figure{W}+{DIGIT}+\]", needs=("[figure",)),
    Rule("-{3,}", needs=("---",)),
    Rule(rf"{W}+([!,.:;?])", "$1"),
    Rule(rf"({WORD})-{W}*\n{W}*({WORD}+)", "$1$2", needs=_LINE),
    Rule(r"\A-+", needs=("-",)),
    Rule(r"-+\z", needs=("-",)),
)
ONE_BLANK = Rule(f"{W}+", " ")
# the first of NORMAL_RULES takes single characters out, the second is for texts beyond ASCII, the sixth for lines that end in a hyphen
_dashes, _stops, _joined, _hyphens = (in_python(NORMAL_RULES[a:b]) for a, b in ((1, 2), (2, 5), (5, 6), (6, None)))
_line_ends_in_hyphen = re.compile(r"-\s*\n").search
_fractions, _glyphs = in_python([FRACTION_RULE]), in_python((*GLYPH_RULES, TILDE_RULE))
_marks, _carried = in_python([_MARKS]), in_python([_CARRIED])


def folded(text: str) -> str:
    """fold_arabic() of one text."""
    text = _marks(text)
    if text.startswith(_MADDA) and len(text) == 3:
        text = _HAMZA + "ا" + text[1:]
    return _carried(text.replace(_MADDA, _HAMZA * 2))


def normal(text: str, arabic: bool = False) -> str:
    """normalize_text() of one text."""
    text = plain(text)
    if arabic:
        text = folded(text)
    text = text.lower()
    for mark in "#*_`~":
        if mark in text:
            text = text.replace(mark, "")
    text = _stops(text if text.isascii() else _dashes(text))
    if "-" in text and _line_ends_in_hyphen(text):
        text = _joined(text)
    text = _hyphens(text)
    if not text.isascii():
        text = _glyphs(unicodedata.normalize("NFKC", _fractions(text)))
    return " ".join(text.split())


@F.arrow_udf(StringType())
def _normal(text: pa.Array, arabic: pa.Array) -> pa.Array:
    return in_slices(lambda ts, folds: pa.array([None if t is None else normal(t, bool(f)) for t, f in zip(ts, folds, strict=True)], pa.string()), text, arabic)


def normalize_text(text: Column, arabic: Column | None = None) -> Column:
    """Normal form for comparison: plain text in lower case without marks, one blank between words.

    arabic: whether a row's Arabic letters are folded.
    """
    return _normal(text, F.lit(False) if arabic is None else arabic)


def untagged(text: str) -> str:
    """strip_output_tag() of one text."""
    bare = text.strip()
    if bare.startswith(_OPEN) and bare.endswith(_CLOSE):
        return bare[len(_OPEN) : -len(_CLOSE)].strip()
    return _stray(text).strip() if "<" in text else bare


_OPEN, _CLOSE, _stray = f"<{OUTPUT_TAG}>", f"</{OUTPUT_TAG}>", in_python(tag_patterns()[1:])


def comparable(text: str | None, arabic: bool | None = False) -> str:
    """A transcription as it is compared: without output tags, flattened if it is XML, in normal form; null is empty."""
    return normal(flatten(untagged(text or "")), bool(arabic))


@F.arrow_udf(StringType())
def _comparable(text: pa.Array, arabic: pa.Array) -> pa.Array:
    return in_slices(lambda ts, folds: pa.array(list(map(comparable, ts, folds)), pa.string()), text, arabic)


def comparable_text(text: Column, arabic: Column) -> Column:
    return _comparable(text, arabic)


# --- names and prompts --------------------------------------------------------

@lru_cache(1)
def _foldings() -> dict[str, str]:
    """What full case folding changes in lower-case letters."""
    lowered = {c.lower() for c in map(chr, (*range(0xD800), *range(0xE000, 0x30000)))}
    return {c: c.casefold() for c in sorted(lowered) if len(c) == 1 and c.casefold() != c}




def filter_value(text: Column) -> Column:
    """A value for caseless comparison: trimmed, folded by Unicode's full case folding, null if blank."""
    folds = _foldings()
    single = {c: f for c, f in folds.items() if len(f) == 1}

    def fold(t: Column) -> Column:
        made = F.translate(t, "".join(single), "".join(single.values()))
        for c, f in folds.items():
            made = made if c in single else F.replace(made, F.lit(c), F.lit(f))
        return F.when(t.rlike(r"[^\x00-\x7F]"), made).otherwise(t)

    return F.nullif(let(F.lower(strip(text)), fold), F.lit(""))


def merge_prompts(*parts: Column) -> Column:
    """The parts that aren't blank, trimmed, with an empty line between; an error if there is none."""
    good = F.filter(F.array(*[strip(p) for p in parts]), lambda p: p.isNotNull() & (p != ""))
    return F.when(F.size(good) > 0, F.array_join(good, "\n\n")).otherwise(F.raise_error(F.lit("no instruction prompt that isn't blank")))
