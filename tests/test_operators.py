"""Golden values and brute-force checks of the operators."""

import json
import random

import pytest
from pyspark.sql import functions as F

from foliospark.functions import blocks as B
from foliospark.functions import geometry as G
from foliospark.functions import metrics as M
from foliospark.functions.xml import flatten
from foliospark.operators import detection as D
from foliospark.operators import evaluation as E
from foliospark.operators import inference as I
from foliospark.operators import layout as L
from foliospark.operators import leaderboard, profiles, selection

TABLE = "<table><tr><td>Place</td><td>Count</td></tr><tr><td>Rome</td><td>17</td></tr></table>"


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


# --- metrics ------------------------------------------------------------------


def slow_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def slow_repeats(t):
    n = len(t)
    return any(size % d == 0 and t[n - size :] == t[n - d :] * (size // d) for size in range(max(2, n - int(0.8 * n)), n) for d in range(1, size // 2 + 1))


def test_metrics_against_brute_force():
    rng = random.Random(1)
    for _ in range(1500):
        a, b = ("".join(rng.choices("abé𝄞", k=rng.randrange(14))) for _ in range(2))
        assert M.edit_distance(a, b) == slow_distance(a, b)
        t = "".join(rng.choices("ab", k=rng.randrange(24))) + "".join(rng.choices("abc", k=3)) * rng.randrange(4)
        assert M.tail_repeats(t) == slow_repeats(t), t
    block = "".join(rng.choices("abcdef", k=40))
    assert M.tail_repeats("x" + block * 3) and not M.tail_repeats(block * 2) and not M.tail_repeats("y" * 200 + block)
    assert [M.tail_repeats(t) for t in ("a", "abcdef", "xyzxyzxyz", "abab", "aaa", "")] == [False, False, True, False, True, False]
    assert M.bleu("the cat sat on the mat", "the cat sat on the mat") == 1.0
    assert M.bleu("the cat", "the cat") == M.bleu("a b c d", "") == M.bleu("", "a") == 0.0
    assert M.bleu("the cat sat on a mat.", "the cat sat on the mat today.") == pytest.approx((6 / 7 * 3 / 6 * 2 / 5 * 1 / 4) ** 0.25 * 2.718281828459045 ** (1 - 8 / 7))


def test_rounding(spark):
    rows = spark.createDataFrame([(81.25,), (81.35,), (None,)], "v double")
    assert [r[0] for r in rows.select(M.round_metric(F.col("v"))).collect()] == [81.2, 81.3, None]
    assert one(spark, M.percentage(F.lit(0.756))) == 75.6
    assert one(spark, M.levenshtein_distance(F.lit("abc"), F.lit("adc"), 1)) == 1
    assert one(spark, M.levenshtein_distance(F.lit("abc"), F.lit("xyz"), 1)) == 2


def test_xml():
    text = "<HistoricalDocument xmlns='urn:x'><Metadata>no</Metadata><Page><Header>Top line</Header><Body><Paragraph> Body <Gap/>line</Paragraph><Figure><Description>no</Description></Figure></Body><Footer>Footer line</Footer></Page></HistoricalDocument>"
    assert flatten(text) == "Top line\nBody line\nFooter line"
    assert flatten("plain") == "plain" and flatten("<HistoricalDocument>") == ""
    assert flatten("<HistoricalDocument><Page><Body>a<Gap/>b</Body></Page><Page><Body>c<Gap></Gap></Body></Page></HistoricalDocument>") == "a"
    assert flatten("<HistoricalDocument><Page><Body>a <i>b</i></Body></Page><Page><Body>c</Body></Page></HistoricalDocument>") == "a\nb\n\nc"


# --- blocks and layout --------------------------------------------------------


def test_block_contents(spark):
    assert B.otsl_to_html("<fcel>Place<fcel>Count<nl><fcel>Rome<fcel>17<nl>") == TABLE
    assert B.otsl_to_html("<fcel>a<lcel><nl><ucel><fcel>b&c<nl><fcel>d") == '<table><tr><td rowspan="2" colspan="2">a</td></tr><tr><td>b&amp;c</td></tr><tr><td>d</td><td></td></tr></table>'
    assert B.otsl_to_html("lost<fcel>a<nl>") == "<table><tr><td></td></tr></table>"
    assert B.otsl_to_html(" no rows ") == "no rows" and B.otsl_to_html(TABLE) == TABLE
    assert B.display_to_inline(r"\[x\] \[1, 2–3\]") == r"\(x\) \[1, 2–3\]"
    assert B.space_macros(r"\(a\inB \top \cupx \toab \timesx\) \inB") == r"\(a\in B \top \cupx \toab \times x\) \inB"
    assert B.underscores_outside(r"\(a ____ b\) \(c\)") == r"\(a \) ____ \( b\) \(c\)"
    assert B.formula_tags(r"\( a \)<eq>\(b\)</eq>\[c\]") == r"<eq>a</eq><eq>\(b\)</eq><eq>c</eq>"
    assert B.image_tags("x [ A2CD ] [A2C]", {"[A2CD]": r"data:\1"}) == r'x <img src="data:\1"/> [A2C]'
    assert one(spark, B.wrap_equation(F.lit(" \\[ u + v "))) == "\\[\nu + v\n\\]" and one(spark, B.wrap_equation(F.lit(" "))) == ""


def found_box(left, top, right, bottom, kind, more=""):
    return f"<|box_start|>{left} {top} {right} {bottom}<|box_end|><|ref_start|>{kind}<|ref_end|>{more}\n"


OUTPUT = "".join(
    found_box(*b)
    for b in (
        (0, 0, 990, 90, "header"), (0, 110, 990, 390, "text"), (0, 410, 990, 490, "text", "txt_contd_tgt"), (0, 510, 990, 790, "table"),
        (0, 810, 990, 1000, "equation", "<|rotate_right|>"), (1001, 0, 1100, 10, "bad"),
    )
)


def test_layout_golden(spark):
    rows = spark.createDataFrame([(1, OUTPUT), (2, None), (3, ""), (4, "<|box_start|>1 2 3" + found_box(9, 9, 1, 1, "Image"))], "id int, output string")
    parsed = rows.select("id", L.parse_layout(F.col("output")).alias("blocks"))
    found = {r.id: r.blocks for r in parsed.collect()}
    assert " ".join(b.type for b in found[1]) == "header text text table equation"
    assert found[1][2].merge_prev and found[1][4].angle == 90 and found[2] is None and found[3] == []
    assert [(b.idx, b.type, tuple(b.bbox)) for b in found[4]] == [(0, "image", (0.001, 0.001, 0.009, 0.009))]
    contents = F.array(*map(F.lit, ("Page header", "Body", "text", "<fcel>Place<fcel>Count<nl><fcel>Rome<fcel>17<nl>", "u + v")))
    cleaned = parsed.select("id", L.clean_blocks(L.with_contents(F.col("blocks"), contents)).alias("blocks"))
    text = {r.id: r.m for r in cleaned.select("id", L.to_markdown(L.post_process(F.col("blocks"))).alias("m")).collect()}
    assert text[1] == f"Page header\n\nBody text\n\n{TABLE}\n\n\\[\nu + v\n\\]" and text[3] == "" and text[2] is None


def test_tokens_and_cjk(spark):
    page = F.expr("array(named_struct('idx', 0, 'type', 'text', 'content', '一', 'merge_prev', false), named_struct('idx', 1, 'type', 'table', 'content', 't', 'merge_prev', false), named_struct('idx', 2, 'type', 'text', 'content', '二', 'merge_prev', true))")
    assert one(spark, L.to_markdown(page)) == "一二\n\nt"
    token = one(spark, L.image_token(F.lit(7), F.lit(1)))
    assert len(token) == 4 and token == one(spark, L.image_token(F.lit(7), F.lit(1)))


# --- geometry -----------------------------------------------------------------


def slow_grid(width, height):
    if width <= 0 or height <= 0:
        return width, height
    low, most = 1792 * 28, 3072 * 2048
    scale = (most / (width * height)) ** 0.5 if width * height > most else (low / (width * height)) ** 0.5 if width * height < low else 1.0
    w, h = (max(1, round(x * scale / 28)) for x in (width, height))
    while w * h * 784 > most and (w, h) != (1, 1):
        if h == 1 or w > 1 and abs((w - 1) / h - width / height) < abs(w / (h - 1) - width / height):
            w -= 1
        else:
            h -= 1
    return w * 28, h * 28


def test_grid_sizes(spark):
    rng = random.Random(2)
    sizes = [(rng.randrange(1, 9000), rng.randrange(1, 9000)) for _ in range(300)] + [(1, 90000), (90000, 1), (0, 5), (3072, 2048)]
    rows = spark.createDataFrame(sizes, "w int, h int").select("w", "h", G.grid_size(F.col("w"), F.col("h")).alias("s")).collect()
    assert all(tuple(r.s) == slow_grid(r.w, r.h) for r in rows)


def test_geometry_golden(spark):
    lit = lambda *v: G.box(*[F.lit(float(x)) for x in v])
    assert tuple(one(spark, G.crop(lit(5, 5, 25, 25), F.lit(40), F.lit(30), 0))) == (5, 5, 25, 25)
    assert tuple(one(spark, G.crop(lit(5.9, 5, 25, 25), F.lit(40), F.lit(30)))) == (0, 0, 40, 30)
    assert [tuple(p) for p in one(spark, G.normalize_polygon(F.expr("array(0d, 0d, 4d, 0d, 4d, 3d, 0d, 0d)")))] == [(0, 0), (4, 0), (4, 3)]
    assert one(spark, G.normalize_polygon(F.expr("array(1d, 2d)"))) == [] == one(spark, G.normalize_polygon(F.expr("cast(null as array<double>)")))
    assert tuple(one(spark, G.polygon_box(G.box_polygon(lit(1, 2, 3, 4))))) == (1, 2, 3, 4)
    assert [one(spark, G.clamp(F.lit(float(x)))) for x in (0, 45.4, 500.5, 501.5, 1000)] == [45, 45, 500, 502, 955]
    assert tuple(one(spark, G.rotate_box(lit(1, 2, 3, 4), F.lit(10), F.lit(20), F.lit(90)))) == (2, 7, 4, 9)
    kind, pixels = G.materialize(F.lit(None).cast("binary"), G.normalize_polygon(F.expr("array(0d, 0d, 4d, 0d, 4d, 3d)")), F.lit(None).cast("struct<left:double,top:double,right:double,bottom:double>"), F.lit(40), F.lit(30), 1)
    assert one(spark, kind) == "polygon" and tuple(one(spark, pixels)) == (0, 0, 5, 4)


# --- detection and review -----------------------------------------------------


def test_answers(spark):
    parse = lambda t: one(spark, D.parse_page_boxes(F.lit(t)))
    found = parse('```json\n{"pages":[{"left":11,"page_index":2,"top":22,"right":33,"bottom":44},{"top":200,"left":100,"page_index":1,"right":300,"bottom":400}]}\n```')
    assert [b.page_index for b in found.boxes] == [1, 2] and tuple(found.boxes[0])[1:] == (100, 200, 300, 400) and found.error is None
    assert parse("no").error == "invalid JSON" and parse('{"x": 1}').error == "no list of pages" and parse('{"pages": [{"page_index": 1}]}').error == "invalid page box" and parse('{"pages": []}').boxes == []
    target = lambda t: one(spark, D.parse_target_box(F.lit(t)))
    box = '{"top": 100, "left": 100, "bottom": 200, "right": 200}'
    assert all(target(t).found for t in (box, f'{{"block": {box}}}', f'{{"block": null, "bbox": {box}}}'))
    assert all((x := target(t)).error is None and not x.found for t in ('{"block_found": false}', '{"found": false}', '{"block": null}', '{"bbox": null}'))
    assert target("{").error == "invalid JSON" and target('{"block": 3}').error and target('{"a": 1}').error and target('{"block": {"left": "x"}}').error
    edge = lambda t: one(spark, D.parse_edge_decision(F.lit(t)))
    assert tuple(edge('{"amount": 99, "edge": " LEFT ", "action": "no_change", "page_index": 1}')) == (1, "left", "no_change", 0, None)
    assert tuple(edge('{"edge": "top", "page_index": 1, "decision": {"decision": "Expand", "amount": 1200}}'))[1:4] == ("top", "expand", 1000)
    assert edge('{"edge": "top", "action": "grow"}').error == "unknown action" and edge('{"edge": "up"}').error == "unknown edge" and edge("x").error == "invalid JSON"
    assert one(spark, D.strip_delta(F.lit(200), F.lit(50), F.lit(100))) == 100 and one(spark, D.moved(F.lit(100), F.lit("expand"), F.lit(10), "left")) == 90


def slow_review(start, rounds):
    clamp = lambda v: max(45, min(955, v))
    pages = {p: list(b) for p, b in start.items()}
    state = {p: [[False, 0, None, None] for _ in range(4)] for p in start}
    n = 0
    for proposals in rounds:
        if all(e[0] for s in state.values() for e in s):
            break
        before = {p: list(b) for p, b in pages.items()}
        for p, box in pages.items():
            if all(e[0] for e in state[p]) or p not in proposals:
                continue
            new = list(proposals[p])
            for i, e in enumerate(state[p]):
                delta = new[i] - box[i]
                if e[0] or abs(delta) <= 6:
                    if not e[0]:
                        e[1] += 1
                        e[0] = e[1] >= 2
                    new[i] = box[i]
                    continue
                e[1], sign = 0, 1 if delta > 0 else -1
                if e[2] and e[2] != sign and e[3] > 6 and 0.5 <= abs(delta) / e[3] <= 2:
                    new[i], e[0] = (min if i < 2 else max)(box[i], new[i]), True
                else:
                    e[2:] = sign, abs(delta)
            for a, b in ((0, 2), (1, 3)):
                if new[a] >= new[b]:
                    c = (new[a] + new[b]) // 2
                    new[a], new[b] = max(0, c - 1), min(1000, c + 1)
            pages[p] = [clamp(v) for v in new]
        if pages == before:
            break
        n += 1
    return pages, n


def test_review_against_brute_force(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for k in range(60):
        start = {p: [100, 100, 900, 900] for p in range(1, rng.randrange(2, 4))}
        rounds = [{p: [b + rng.choice((0, 3, -30, 25, 50, -400, 800)) for b in box] for p, box in start.items() if rng.random() < 0.8} for _ in range(rng.randrange(0, 9))]
        want[k] = slow_review(start, rounds)
        rows.append((k, [(p, *b) for p, b in start.items()], [[(p, *b) for p, b in r.items()] for r in rounds]))
    schema = f"k int, boxes array<{D.PAGE_BOX}>, rounds array<array<{D.PAGE_BOX}>>"
    for r in spark.createDataFrame(rows, schema).select("k", D.review(F.col("boxes"), F.col("rounds")).alias("r")).collect():
        pages, n = want[r.k]
        assert {b.page_index: list(b)[1:] for b in r.r.boxes} == pages and r.r.rounds == n


# --- evaluation ---------------------------------------------------------------


def test_scores(spark):
    rows = [("1", "<output> Pred", "pred", "en", "print"), ("2", None, "", "en", "handwriting"), ("3", "<output>\nxyzxyzxyz\n</output>", None, "es", None), ("4", "", "gold", "es", "print")]
    pairs = spark.createDataFrame(rows, "example_id string, predicted_text string, gold_text string, main_language string, document_type string").withColumn("bleu", F.lit("clash"))
    found = {r.example_id: r for r in E.page_scores(pairs).collect()}
    assert [found[i].normalized_levenshtein_similarity for i in "1234"] == [1, 1, 0, 0] and [found[i].is_empty for i in "1234"] == [0, 1, 0, 1]
    assert [found[i].repetition for i in "1234"] == [0, 0, 1, 0] and found["1"].normalized_predicted_text == "pred"
    scores = E.page_scores(pairs)
    groups = {(r.level, r.main_language, r.document_type): r["mean"] for r in E.grouped_scores(scores).collect()}
    assert groups[("all", None, None)] == 0.5 and groups[("language", "es", None)] == 0 and groups[("language_type", "es", "None")] == 0 and len(groups) == 10
    maps = E.metric_maps(scores, 1.25).first()
    assert maps.type_metrics == {"print": 50.0, "handwriting": 100.0, "None": 0.0} and maps.aggregate_metrics["elapsed_time (s)"] == 1.2 and maps.main_language_and_type_metrics["en_print"] == 100.0
    empty = E.metric_maps(scores.where("false")).first()
    assert empty.type_metrics == {"print": 0.0, "handwriting": 0.0} and "bleu" not in empty.aggregate_metrics and E.aggregate_scores(scores.where("false")).count() == 0
    E.check_counts(pairs, pairs)
    with pytest.raises(ValueError):
        E.check_counts(pairs, pairs.where("example_id != '1'"))


def test_selection(spark):
    rows = [(i, lang, kind) for i, (lang, kind) in enumerate([("English", "print"), ("Chinese", "print"), ("Chinese", "handwriting"), ("chinese ", "Print"), (None, "print")])]
    data = spark.createDataFrame(rows, "example_id int, main_language string, document_type string")
    pick = lambda **k: [r.example_id for r in selection.select_subset(data, "example_id", **k).collect()]
    assert pick(language=" chinese ", document_type="PRINT", offset=1, limit=1) == [3] and pick(offset=1, limit=2) == [1, 2] and pick(offset=9) == [] and sorted(pick(language=" ")) == [0, 1, 2, 3, 4]
    assert selection.output_directory("azure", None, "Chinese Simplified", "print") == "azure_language_chinese simplified_document_type_print".replace("chinese simplified", "chinese_simplified")


def test_leaderboard(spark):
    rows = [("b", "print", "en", 0.5), ("b", "handwriting", "de", 0.7), ("a", "print", "en", 0.5), ("c", "handwriting", "de", None)]
    board = leaderboard.pivot(spark.createDataFrame(rows, "model string, document_type string, main_language string, score double"))
    assert board.columns == ["model", "printed", "printed:de", "printed:en", "handwritten", "handwritten:de", "handwritten:en", "total"]
    order = lambda **k: [r.model for r in leaderboard.rank(board, **k).orderBy("rank").collect()]
    assert order() == ["b", "a", "c"] and order(by="handwritten", descending=False) == ["b", "a", "c"] and order(by="printed") == ["a", "b", "c"] and order(by="model") == ["c", "b", "a"]
    assert {r.model: r.total for r in leaderboard.display(board).collect()} == {"a": "50.0", "b": "60.0", "c": "—"}


# --- profiles and inference ---------------------------------------------------


def test_profiles(spark):
    md = "# Heading\n\n" + TABLE + "\n\nParagraph with [note](https://example.test)."
    plain = "Heading\n\nPlace | Count\nRome | 17\n\nParagraph with note."
    post = lambda t, p: one(spark, profiles.postprocess(F.lit(t), p))
    assert tuple(post(f"You are a helpful assistant.\nassistant:\n```markdown\n{md}\n```\n<|im_end|>", "nanonets")) == (plain, {"raw_markdown": md})
    assert post("<image>\nFree OCR.\n<｜User｜>\nplain text<｜end▁of▁sentence｜>", "deepseek").text == "plain text"
    assert post("Text Recognition:\n<|system|>\nsome text\n<|user|>\n<|endoftext|>", "glm").text == "some text"
    assert post("assistant:\n<output>\ndecoded text\n</output>", "lfm").text == "decoded text" and post(" <output>x</output>", "xml").text == " <output>x</output>"
    olm = post(f"---\nprimary_language: en\nis_table: true\n---\n{md}", "olmocr")
    assert olm.text == plain and json.loads(olm.metadata["front_matter"]) == {"primary_language": "en", "is_table": "true"} and olm.metadata["raw_markdown"] == md
    rows = [(n, f"assistant\n{md}") for n in profiles.PROFILES] + [(None, "<output>a"), ("nothing known", None)]
    found = spark.createDataFrame(rows, "profile string, response string").select("profile", profiles.postprocess_by(F.col("response"), F.col("profile")).alias("p")).collect()
    for r in found[: len(profiles.PROFILES)]:
        assert r.p == post(f"assistant\n{md}", r.profile), r.profile
    assert found[-2].p.text == "a" and found[-1].p.text is None
    assert profiles.resolve(model="allenai/olmOCR-2-7B-1025-FP8").longest == 1288 and profiles.resolve() is profiles.PROFILES["default"]
    with pytest.raises(ValueError):
        profiles.resolve("unknown")
    assert [m.role for m in one(spark, profiles.conversation("read", F.lit(b"x"), "be good", True))] == ["system", "user"]


def test_inference(spark):
    class Flaky:
        def __call__(self, batch):
            if len(batch) > 1 or batch["id"].iloc[0] == 3:
                raise ValueError("bad page")
            return [(f"page {i}", {"n": i}) for i in batch["id"]]

    pages = spark.range(6).withColumn("text", F.lit("clash"))
    found = {r.id: r for r in I.transcribe(pages, Flaky, batch_size=4).collect()}
    assert found[3].text == "" and found[3].ocr_metadata["benchmark_error_type"] == "ValueError" and found[5].text == "page 5" and found[5].ocr_metadata == {"n": "5"}
    assert I.not_yet_done(pages, pages.where("id < 4"), "id").count() == 2
    boxes = I.detect(pages.select("id", "text"), lambda: lambda batch: [[(0, 0, 1, 1)] * int(i) for i in batch["id"]])
    whole = boxes.select("id", F.size(D.candidates_or_full_image(F.col("candidates"), F.lit(4), F.lit(5))).alias("n")).collect()
    assert {r.id: r.n for r in whole} == {i: max(1, i) for i in range(6)}


def test_retry():
    waits, calls = [], []

    class RateLimitError(Exception):
        retry_after = None

    def call():
        calls.append(1)
        if len(calls) < 4:
            raise RateLimitError
        return "ok"

    assert I.retry(call, sleep=waits.append) == "ok" and waits == [1, 2, 4]
    with pytest.raises(ValueError):
        I.retry(lambda: (_ for _ in ()).throw(ValueError()), sleep=waits.append)
    late, limited = RateLimitError(), RateLimitError()
    late.retry_after, limited.status_code = 7, 429
    assert I.wait_seconds(late, 1) == 7 and I.wait_seconds(limited, 9) == 16 and I.transient(limited) and I.transient(TimeoutError())




def test_edit_distance_by_bounds(monkeypatch):
    """Confusions of letters in a long text need no table; what the bounds leave open has the right distance too."""
    rng = random.Random(7)
    gold = " ".join("".join(rng.choices("etaonhrdlcuiswmb", k=rng.randrange(2, 9))) for _ in range(900))
    read = gold.replace("rn", "m").replace("cl", "d").replace("h", "b")
    want = M._whole(gold, read)
    for x, y in ((gold, read), (read, gold), (gold, gold[:700] + gold[760:]), (gold, "x" + gold)):
        assert M._least(x, y) <= M._whole(max(x, y, key=len), min(x, y, key=len)) <= M._aligned(x, y, 10**6)
    moved = read[:2000] + read[2003:2600] + read[2000:2003] + read[2600:]
    assert M.edit_distance(gold, moved) == M._whole(gold, moved)
    for _ in range(200):
        a = "".join(rng.choices("abcd", k=150))
        b = "".join(c if rng.random() < 0.9 else rng.choice(("", "a", "xy")) for c in a)
        assert M.edit_distance(a, b) == M._whole(*sorted((a, b), key=len, reverse=True))
    clear = gold.replace("m", "o").replace("d", "o").replace("b", "o")
    monkeypatch.setattr(M, "_whole", None)
    monkeypatch.setattr(M, "_banded", None)
    clear_read = clear.replace("rn", "m").replace("cl", "d").replace("h", "b")
    assert M.edit_distance(clear, clear_read) == M.edit_distance(clear_read, clear) == len(clear) - len(clear_read) + clear_read.count("b") + clear_read.count("m") + clear_read.count("d")
    assert want > 100


def test_seeded_types_name_their_groups_once(spark):
    """Scores are worked out once, and a type without pages has 0."""
    pairs = spark.createDataFrame([("1", "pred", "pred", "en", "book"), ("2", "a", "b", "en", "print")], "example_id string, predicted_text string, gold_text string, main_language string, document_type string")
    seeded = E.seeded_types(E.grouped_scores(E.page_scores(pairs, metrics=(E.MAIN,))))
    assert {r.document_type: r["mean"] for r in seeded.collect()} == {"book": 1.0, "print": 0.0, "handwriting": 0.0}
    plan = seeded._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("gold_text#") and plan.count("LogicalRDD") + plan.count("LocalRelation") <= 1 and "Join" not in plan


def test_blocks_are_read_some_pages_at_a_time(spark):
    """The reader's requests are those of a slice of pages; columns of any kind go to it and stay."""
    from foliospark.functions.batches import ROWS

    n = 2 * ROWS + 5
    rows = [(i, {"k": str(i)}, None if i == 3 else [(0, "text", None), (1, "text", "kept")], [(0,)] if i != 3 else None) for i in range(n)]
    pages = spark.createDataFrame(rows, "page long, meta map<string,string>, blocks array<struct<idx:int,type:string,content:string>>, wanted array<struct<idx:int>>").coalesce(1)
    most = spark.sparkContext.accumulator(0)

    def reader():
        def read(requests):
            most.add(1)
            return [f"{r['page']} {r['meta']['k']} {r['type']}" for r in requests]

        return read

    got = {r.page: r for r in I.read_blocks(pages, reader, batch_size=10**6).collect()}
    assert len(got) == n and got[3].blocks is None and most.value >= 3
    assert all([b.content for b in got[i].blocks] == [f"{i} {i} text", "kept"] and got[i].meta == {"k": str(i)} for i in got if i != 3)
