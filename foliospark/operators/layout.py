"""Layout blocks of pages: parsing, containment, cleaning, reading order.

A page keeps its blocks in one array column, so every join between blocks of a
page is a function of a row: no shuffle, whatever the number of pages.
explode_blocks() gives one row a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.blocks import clean_contents, fix_equation, wrap_equation
from ..functions.dialect import DIGIT, W, let

TYPES = sorted(
    "text title table equation code list image chart header footer unknown phonetic algorithm ref_text list_item aside_text page_number page_footnote "
    "image_block equation_block table_caption image_caption code_caption table_footnote image_footnote".split()
)
PARATEXT = ("aside_text", "footer", "header", "page_footnote", "page_number", "unknown")
CONTAINERS = ("chart", "image", "image_block")
COVERED = 0.9
BLOCK = "struct<idx:int,type:string,bbox:struct<left:double,top:double,right:double,bottom:double>,angle:int,content:string,merge_prev:boolean>"

HEAD = rf"\A({DIGIT}+){W}+({DIGIT}+){W}+({DIGIT}+){W}+({DIGIT}+)<\|box_end\|><\|ref_start\|>([\p{{L}}\p{{N}}_]+?)<\|ref_end\|>(<\|rotate_(?:down|left|right|up)\|>)?"
_ANGLES = {"up": 0, "right": 90, "down": 180, "left": 270}


def parse_layout(output: Column) -> Column:
    """array of BLOCK of a layout model's output.

    Boxes beyond 1000 or without area, and unknown types, are left out;
    reversed corners are swapped.  A null output gives null.
    """

    def block(part: Column) -> Column:
        x1, y1, x2, y2 = (F.get(part, F.lit(i)).try_cast("int") for i in range(4))
        kind, turned = F.lower(F.get(part, F.lit(4))), F.get(part, F.lit(5))
        angle = F.lit(None).cast("int")
        for name, degrees in _ANGLES.items():
            angle = F.when(turned == f"<|rotate_{name}|>", degrees).otherwise(angle)
        bbox = G.box(*[c / 1000.0 for c in (F.least(x1, x2), F.least(y1, y2), F.greatest(x1, x2), F.greatest(y1, y2))])
        good = (F.size(part) == 7) & (F.greatest(x1, y1, x2, y2) <= 1000) & x1.isNotNull() & y1.isNotNull() & x2.isNotNull() & y2.isNotNull() & (x1 != x2) & (y1 != y2) & kind.isin(*TYPES)
        merge = (kind == "text") & F.get(part, F.lit(6)).contains("txt_contd_tgt")
        return F.struct(F.coalesce(good, F.lit(False)).alias("good"), kind.alias("type"), bbox.alias("bbox"), angle.alias("angle"), F.lit(None).cast("string").alias("content"), merge.alias("merge_prev"))

    pieces = F.split(output, r"<\|box_start\|>")
    # one match a piece: its seven parts, or the piece as it is
    marked = F.transform(F.slice(pieces, 2, F.size(pieces)), lambda p: F.split(F.regexp_replace(p, rf"(?s){HEAD}(.*)\z", "$1\x01$2\x01$3\x01$4\x01$5\x01$6\x01$7"), "\x01", 7))
    parsed = F.filter(F.transform(marked, block), lambda b: b["good"])
    return renumber(parsed)


def renumber(blocks: Column) -> Column:
    """blocks with idx from 0 in their order."""
    fields = ("type", "bbox", "angle", "content", "merge_prev")
    return F.transform(blocks, lambda b, i: F.struct(i.cast("int").alias("idx"), *[b[f].alias(f) for f in fields])).cast(f"array<{BLOCK}>")


def with_contents(blocks: Column, contents: Column) -> Column:
    """blocks with the contents of the same places."""
    return F.transform(blocks, lambda b: b.withField("content", F.get(contents, b["idx"])))


def explode_blocks(pages: DataFrame, key: str, blocks: str = "blocks") -> DataFrame:
    return pages.select(key, F.inline(blocks))


# --- containment --------------------------------------------------------------


def drop_covered_captions(blocks: Column) -> Column:
    """Without the image captions that lie in another image, chart or image block."""
    holds = lambda b: F.exists(blocks, lambda c: c["type"].isin(*CONTAINERS) & (c["idx"] != b["idx"]) & (G.cover_ratio(b["bbox"], c["bbox"]) >= COVERED))
    return F.filter(blocks, lambda b: (b["type"] != "image_caption") | ~holds(b))


def best_table(blocks: Column, image: Column) -> Column:
    """idx of the table that covers an image best: then the smallest, then the first; null if none covers it."""
    tables = F.filter(blocks, lambda t: (t["type"] == "table") & (G.cover_ratio(image["bbox"], t["bbox"]) >= COVERED))
    ranked = F.transform(tables, lambda t: F.struct((-G.cover_ratio(image["bbox"], t["bbox"])).alias("r"), G.area(t["bbox"]).alias("a"), t["idx"].alias("idx")))
    return F.array_min(ranked)["idx"]


def table_images(blocks: Column) -> Column:
    """array of (table, images): the images that each table takes in, from top to bottom and left to right."""
    taken = F.filter(
        F.transform(F.filter(blocks, lambda b: b["type"] == "image"), lambda i: F.struct(best_table(blocks, i).alias("table"), i["bbox"]["top"].alias("top"), i["bbox"]["left"].alias("left"), i["idx"].alias("idx"))),
        lambda x: x["table"].isNotNull(),
    )

    def of(taken: Column) -> Column:
        tables = F.filter(blocks, lambda b: b["type"] == "table")
        return F.transform(
            tables,
            lambda t: F.struct(t["idx"].alias("table"), F.transform(F.array_sort(F.transform(F.filter(taken, lambda x: x["table"] == t["idx"]), lambda x: F.struct(x["top"], x["left"], x["idx"]))), lambda x: x["idx"]).alias("images")),
        )

    return let(taken, of)


def absorbed_images(blocks: Column) -> Column:
    """idx of the images that a table takes in."""
    images = F.filter(blocks, lambda b: b["type"] == "image")
    return F.transform(F.filter(images, lambda i: best_table(blocks, i).isNotNull()), lambda i: i["idx"])


def image_token(page: Column, idx: Column) -> Column:
    """The 4 characters that stand for an image in a table; a hash, so a rerun gives the same."""
    letters = "ACDGHKTWXYZ2345678"
    digest = F.xxhash64(page.cast("string"), idx)
    return F.concat(*[F.substring(F.lit(letters), (F.pmod(F.shiftrightunsigned(digest, 12 * k), F.lit(len(letters))) + 1).cast("int"), F.lit(1)) for k in range(4)])


def to_extract(blocks: Column, image_analysis: bool = False, left_out: tuple[str, ...] = ()) -> Column:
    """The blocks whose contents a model has to read, of those that drop_covered_captions() leaves."""
    skipped = {"list", "equation_block", "image_block", *left_out} | (set() if image_analysis else {"image", "chart"})
    kept = lambda b: ~b["type"].isin(*sorted(skipped))
    if "image" in skipped:
        return F.filter(blocks, kept)
    absorbed = F.array().cast("array<int>") if "table" in skipped else absorbed_images(blocks)
    return let(absorbed, lambda gone: F.filter(blocks, lambda b: kept(b) & ~F.array_contains(gone, b["idx"])))


# --- cleaning and order -------------------------------------------------------


def merge_equations(blocks: Column) -> Column:
    """An equation block that two or more equations each cover becomes one equation of them; other such blocks go."""
    equations = F.filter(blocks, lambda b: b["type"] == "equation")
    # here it is the container that has to lie in the equation's box
    groups = F.transform(F.filter(blocks, lambda b: b["type"] == "equation_block"), lambda b: F.struct(b["idx"].alias("idx"), F.filter(equations, lambda e: G.cover_ratio(b["bbox"], e["bbox"]) > COVERED).alias("parts")))
    groups = F.filter(groups, lambda g: F.size(g["parts"]) > 1)

    def joined(parts: Column) -> Column:
        texts = F.transform(parts, lambda e: F.coalesce(e["content"], F.lit("")))
        tags = F.aggregate(F.transform(texts, lambda t: F.regexp_count(t, F.lit(rf"\\tag{W}*\{{[^}}]*\}}"))), F.lit(0), lambda a, n: a + n)
        plain = F.transform(texts, lambda t: F.when(tags > 1, F.regexp_replace(t, rf"\\tag{W}*\{{([^}}]*)\}}", "($1)")).otherwise(t))
        trimmed = F.transform(plain, lambda t: F.regexp_replace(F.regexp_replace(t, rf"\A{W}+", ""), rf"{W}+\z", ""))
        return F.concat(F.lit("\\begin{array}{l} "), F.array_join(trimmed, " \\\\ "), F.lit(" \\end{array}"))

    def merged(groups: Column) -> Column:
        gone = F.flatten(F.transform(groups, lambda g: F.transform(g["parts"], lambda e: e["idx"])))
        kept = F.filter(blocks, lambda b: ~F.array_contains(gone, b["idx"]) & ((b["type"] != "equation_block") | F.exists(groups, lambda g: g["idx"] == b["idx"])))

        def one(b: Column) -> Column:
            parts = F.try_element_at(F.filter(groups, lambda g: g["idx"] == b["idx"]), F.lit(1))["parts"]
            new = F.struct(b["idx"].alias("idx"), F.lit("equation").alias("type"), b["bbox"].alias("bbox"), b["angle"].alias("angle"), joined(parts).alias("content"), F.lit(False).alias("merge_prev"))
            return F.when(b["type"] == "equation_block", new).otherwise(b)

        return F.transform(kept, one)

    return let(groups, merged)


def clean_blocks(blocks: Column, sources: Column | None = None, table_formulas: bool = True) -> Column:
    """blocks with their contents cleaned by type; sources: for each block JSON of {image token: source}, or null."""
    kinds, contents = F.transform(blocks, lambda b: b["type"]), F.transform(blocks, lambda b: b["content"])
    sources = F.transform(blocks, lambda _: F.lit(None).cast("string")) if sources is None else sources
    cleaned = clean_contents(kinds, contents, sources, F.lit(table_formulas))
    return F.zip_with(blocks, cleaned, lambda b, c: b.withField("content", F.when((b["type"] == "equation") & c.isNotNull(), wrap_equation(fix_equation(c))).otherwise(c)))


def post_process(blocks: Column, *, merge: bool = True, drop_lists: bool = False, drop_paratext: bool = False) -> Column:
    """Cleaned blocks as they are rendered: equations merged, images inside tables and containers left out."""
    absorbed = absorbed_images(blocks)
    rendered = merge_equations(blocks) if merge else blocks
    left_out = ("equation_block", *(("list",) if drop_lists else ()), *(PARATEXT if drop_paratext else ()))
    return let(absorbed, lambda gone: F.filter(rendered, lambda b: ~b["type"].isin(*left_out) & ~((b["type"] == "image") & F.array_contains(gone, b["idx"]))))


def to_markdown(blocks: Column) -> Column:
    """Contents in order with empty lines between; a continued text is added to the last text block, however far back."""
    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(-1).alias("last"))

    def step(state: Column, b: Column) -> Column:
        parts, last, content = state["parts"], state["last"], b["content"]
        glue = F.when(content.rlike(r"[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}]"), "").otherwise(" ")
        continued = F.coalesce(b["merge_prev"], F.lit(False)) & (last >= 0)
        longer = F.transform(parts, lambda p, i: F.when(i == last, F.concat(p, glue, content)).otherwise(p))
        after = F.when(b["type"] == "text", F.size(parts)).otherwise(last)
        return F.when(F.coalesce(content, F.lit("")) == "", state).when(continued, F.struct(longer.alias("parts"), last.alias("last"))).otherwise(F.struct(F.concat(parts, F.array(content)).alias("parts"), after.alias("last")))

    joined = F.aggregate(blocks, start, step, lambda s: F.array_join(s["parts"], "\n\n"))
    return F.regexp_replace(F.regexp_replace(joined, rf"\A{W}+", ""), rf"{W}+\z", "")
