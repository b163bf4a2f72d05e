"""SQL of the text rules, for the equivalents of the queries."""

from __future__ import annotations

from ..functions import text as T
from ..functions.dialect import Rule, quote, sql_replace_all, sql_strip
from ..functions.metrics import _ESCAPED

#: The named characters that occur in the tables; SQL has no function for all of them.
ENTITIES = (("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))


def entities(text: str) -> str:
    for name, character in ENTITIES:
        text = f"replace({text}, {quote(name)}, {quote(character)})"
    return text


def markup(text: str) -> str:
    return sql_strip(sql_replace_all(entities(sql_replace_all(sql_strip(text), T.BEFORE_ENTITIES)), T.AFTER_ENTITIES))


def output_tag(text: str) -> str:
    whole, stray = T.tag_patterns()
    return f"CASE WHEN regexp_matches({text}, {quote(whole.re2)}) THEN {sql_strip(f'regexp_extract({text}, {quote(whole.re2)}, 1)')} ELSE {sql_strip(sql_replace_all(text, [stray]))} END"


def normal(text: str, arabic: bool = False) -> str:
    """The normal form of a text that compatibility forms leave as it is."""
    text = markup(text)
    if arabic:
        text = sql_replace_all(f"replace({sql_replace_all(text, [T._MARKS])}, {quote(T._MADDA)}, {quote(T._HAMZA * 2)})", [T._CARRIED])
    rules = (*T.NORMAL_RULES, T.FRACTION_RULE, *T.GLYPH_RULES, T.TILDE_RULE, T.ONE_BLANK)
    return sql_strip(sql_replace_all(f"lower({text})", rules))


def bleu_words(text: str) -> str:
    """List of the 13a tokens of a text without line feeds."""
    for name, character in _ESCAPED:
        text = f"replace({text}, {quote(name)}, {quote(character)})"
    rules = (Rule(r"([ -&(-+:-@/\[-`{-~])", " $1 "), Rule("([^0-9])([,.])", "$1 $2 "), Rule("([,.])([^0-9])", " $1 $2"), Rule("([0-9])(-)", "$1 $2 "))
    return f"regexp_extract_all({sql_replace_all(f'(chr(32) || {text} || chr(32))', rules)}, '[^ ]+')"


#: Each letter beyond ASCII that the tables have in normal form as a capital: normal forms have none, and byte distances become distances of characters.
ACCENTED = "äçèéêíñóöüßáàâîïôùûúëœæåøìòãõ"


def one_byte(text: str) -> str:
    return f"translate({text}, {quote(ACCENTED[:26])}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"
