"""Golden values of the text functions."""

import html
import random
import unicodedata

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliospark.functions import text as T
from foliospark.functions.batches import in_slices
from foliospark.operators import evaluation as E

TABLE = "<table><tr><th>Place</th><th>Count</th></tr><tr><td>Rome</td><td>17</td></tr></table>"


@pytest.fixture(scope="module")
def apply(spark):
    def run(function, *texts):
        rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
        got = [r.v for r in rows.select("i", function(F.col("t")).alias("v")).orderBy("i").collect()]
        return got[0] if len(texts) == 1 else got

    return run


def test_output_tag(apply):
    assert apply(T.strip_output_tag, "<output>\nhello\n</output>", "<output> hello", "hello </output>", "plain text", "<OUTPUT x>a", None, "") == ["hello", "hello", "hello", "plain text", "a", None, ""]


def test_markup(apply):
    front = f"# Heading\n\n{TABLE}\n\n![Figure alt text](page_0_0_100_100.png)\nParagraph with [reference](https://example.test)."
    assert apply(T.markup_to_text, front) == "Heading\n\nPlace | Count\nRome | 17\n\nParagraph with reference."
    html = (
        '<div data-label="Head"><h1>Name</h1></div>\n<div data-label="Text"><p>A text with <a href="https://b.test">source</a>.</p> </div>\n'
        f'<div data-label="Boxes"><p><input checked type="checkbox"> Checked item</p></div>\n<div data-label="Table">{TABLE}</div>'
    )
    assert apply(T.markup_to_text, html) == "Name\n\nA text with source.\n\n[x] Checked item\n\nPlace | Count\nRome | 17"
    assert apply(T.markup_to_text, "a &lt;b&gt;c&lt;/b&gt; &amp;lt; &notit;", "- x\n\n\n\n> q z", "<input>&nbsp;", "a|b||", "", None) == ["a c &lt; ¬it;", "x\nq\nz", "[ ]", "a | b |", "", None]


def test_normal_form(apply):
    assert apply(T.normalize_text, "A~word\n![pic](y)\n[figure 12]\nfoo-\nbar – baz ſ ") == "aword foobar - baz s st"
    assert apply(T.normalize_text, f"# Heading\n\n{TABLE}\n\n- Bullet item") == "heading place | count rome | 17 bullet item"
    assert apply(T.normalize_text, "1½ ﬁn ---- a , b", "\x1c\x85", None) == ["1 1⁄2 fin a, b", "", None]
    assert apply(lambda c: T.normalize_characters(c), "ſo ~word a~b ﬂ", "3⅓") == ["ſo word a~b fl", "3 1⁄3"]
    arabic = "أَحْمَد ـ مؤمن"
    assert apply(lambda c: T.normalize_text(c, F.lit(True)), arabic) == "ءحمد مءمن"
    assert apply(lambda c: T.normalize_text(c, F.lit(False)), arabic) == arabic


def test_front_matter(apply):
    text = f"---\nprimary_language: en\nis_rotation_valid: True\nrotation_correction: 0\nnone: null\nno colon\n---\n# Heading\n\n{TABLE}"
    assert apply(lambda c: T.split_front_matter(c)[0], text, "---\nopen", "x") == [{"primary_language": "en", "is_rotation_valid": "true", "rotation_correction": "0", "none": None}, {}, {}]
    assert apply(lambda c: T.split_front_matter(c)[1], text, " ---\nopen", "---\n\n---") == [f"# Heading\n\n{TABLE}", "---\nopen", ""]
    assert apply(lambda c: T.split_front_matter(c)[0], "---\na: 1\na: 02\n---\n") == {"a": "2"}


def test_fences_and_tokens(apply):
    assert apply(T.strip_outer_fence, "```markdown\n169\n\nžigjejch;\n```", "~~~~\na\n~~~\n~~~~", "```\na", "a") == ["169\n\nžigjejch;", "a\n~~~", "```\na", "a"]
    assert apply(T.strip_code_fence, '```json\n{"a": 1}\n```', "```\nx", "```", " y ") == ['{"a": 1}', "x", "```", "y"]
    tokens = ("<|im_end|>", "<|user|>")
    assert apply(lambda c: T.strip_trailing_tokens(c, tokens), "a <|user|>\n<|im_end|>", "a" + "<|user|>" * 9, "<|user|>b", "a ") == ["a", "a<|user|>", "<|user|>b", "a "]
    assert apply(lambda c: T.strip_trailing_tokens(c, tokens, None), "a" + "<|user|>" * 9) == "a"
    assert apply(T.trim_stop_strings, " a<|im_end|>b", "x<|endoftext|>y<|im_end|>") == ["a", "x"]


def test_scaffold(apply):
    assert apply(lambda c: T.strip_chat_scaffold(c, ("<image>\nFree OCR.", "Free OCR.")), "<image>\nFREE OCR.\n<｜Assistant｜>\nplain text", "assistant:\nplain text", "users\nx", "<|USER|>", "", None) == [
        "plain text", "plain text", "users\nx", "", "", None,
    ]
    assert apply(lambda c: T.strip_chat_scaffold(c), "user\n" * 9 + "a") == "user\na"


def test_filter_value_and_prompts(apply):
    assert apply(T.filter_value, " Chinese ", "STRAßE", "  ", None) == ["chinese", "strasse", None, None]
    names = ["ﬁNLAND", "ΣΊΣΥΦΟΣ", "ΐ", "ſo", "Ᏸ", "ŉ", "plain"]
    assert apply(T.filter_value, *names) == [n.casefold() for n in names]
    assert apply(lambda c: T.merge_prompts(c, F.lit("  "), F.lit(" b ")), " a") == "a\n\nb"


def test_one_function_as_the_rules_say(apply):
    """The function of one text gives what the rules of the SQL give in their order; memory follows slices, not batches."""
    rng = random.Random(2)
    bits = ["<b>", "</td>", "< br/>", "<input checked>", "![a](b)", "[t](u)", "&lt;i&gt;", "# ", "- ", "> ", "**", "`", "~w", "  ", "\t", "\n", "\n\n\n", "\r\n", "\x1c", "\xa0", "|", "word", "Foo-", "---", "–", "[figure 12]", "1½", "ſ", "ﬁ", "’", "É", " ,", "\n!", "آمن", "ؤ"]
    texts = ["".join(rng.choices(bits, k=rng.randrange(1, 20))) for _ in range(400)]
    assert apply(T.markup_to_text, *texts) == [T.plain(t) for t in texts]
    for text, found in zip(texts, apply(T.normalize_text, *texts), strict=True):
        want = text.strip()
        for rule in T.BEFORE_ENTITIES:
            want = rule.python.sub(rule.replacement.replace("$", "\\"), want)
        want = html.unescape(want)
        for rule in T.AFTER_ENTITIES:
            want = rule.python.sub(rule.replacement.replace("$", "\\"), want)
        want = want.strip().lower()
        for rule in (*T.NORMAL_RULES, T.FRACTION_RULE):
            want = rule.python.sub(rule.replacement.replace("$", "\\"), want)
        want = unicodedata.normalize("NFKC", want)
        for rule in (*T.GLYPH_RULES, T.TILDE_RULE, T.ONE_BLANK):
            want = rule.python.sub(rule.replacement.replace("$", "\\"), want)
        assert found == want.strip() == T.normal(text), text


def test_slices():
    sizes = []

    def run(texts, numbers):
        sizes.append(len(texts))
        return pa.array([f"{t}{n}" for t, n in zip(texts, numbers, strict=True)], pa.string())

    texts, numbers = pa.array(["a", None, "b"] * 100), pa.array(range(300))
    assert in_slices(run, texts, numbers, rows=64).to_pylist() == [f"{t}{n}" for t, n in zip(texts.to_pylist(), range(300), strict=True)] and max(sizes) == 64
    assert in_slices(run, texts[:0], numbers[:0]).to_pylist() == []


def test_one_exchange_for_scores(spark):
    """Normal forms and scores come from one function, so a task has one worker."""
    pairs = spark.createDataFrame([("<output>A b</output>", "a b", "en")], "predicted_text string, gold_text string, main_language string")
    scored = E.page_scores(pairs)
    assert [scored.first()[c] for c in ("normalized_predicted_text", "normalized_gold_text", E.MAIN)] == ["a b", "a b", 1.0]
    assert scored._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert pairs.select(E.normalized(F.col("predicted_text")))._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_formulas_are_cleaned_in_slices(monkeypatch):
    from foliospark.plans import box_queries

    seen = []

    def spy(run, *columns):
        return in_slices(lambda *lists: (seen.append(len(lists[0])), run(*lists))[1], *columns)

    monkeypatch.setattr(box_queries, "in_slices", spy)
    found = box_queries._cleaned.func(pa.array([r"\[v\]", None] * 200))
    assert found.to_pylist() == [r"\(v\)", None] * 200 and max(seen) <= 128
