"""Queries of layout blocks: a layout response is made for each document, its blocks' contents are the text in as many pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import inference
from ..operators import layout as L
from ..plans.tables import expression, spread


def _spot(k: int, size: int) -> str:
    return f"((doc_id * {37 + 2 * k} + {101 * k}) % {size})"


# (type, left, top, right, bottom, what follows): integer expressions of doc_id
_BOXES = [
    ("header", "0", "0", "1000", "50", ""),
    ("text", "0", "50", "1000", "200", ""),
    ("table", "100", "200", "700", "600", "<|rotate_right|>"),
    ("table", "100", "200", f"700 - {_spot(1, 3)} * 50", "600", ""),
    ("image", f"100 + {_spot(2, 300)}", "250", f"300 + {_spot(2, 300)}", "350", "<|rotate_up|>"),
    ("image", f"{_spot(3, 800)}", "400", f"200 + {_spot(3, 800)}", "500", ""),
    ("image_caption", f"{_spot(4, 900)}", "420", f"100 + {_spot(4, 900)}", "460", ""),
    ("text", "0", "600", "1000", f"{_spot(5, 1000)}", "txt_contd_tgt"),
    ("equation_block", "100", "700", "500", "800", ""),
    ("equation", f"{90 + 0} + {_spot(6, 2)} * 60", "690", "510", "810", ""),
    ("equation", "100", "700", "505", "800", ""),
    ("inline_formula", "1", "1", "5", "5", ""),
    ("TEXT", "900", "900", "100", "950", ""),
    ("text", "0", "950", f"990 + {_spot(7, 40)}", "1000", " txt_contd_tgt "),
    ("list", "0", "0", "10", "10", ""),
]
_C = "CAST({} AS STRING)"
RESPONSE = " || ".join(
    f"'<|box_start|>' || {_C.format(a)} || ' ' || {_C.format(b)} || ' ' || {_C.format(c)} || ' ' || {_C.format(e)} || '<|box_end|><|ref_start|>{kind}<|ref_end|>{tail}' || chr(10)" for kind, a, b, c, e, tail in _BOXES
)
#: Content of block idx: its part of the text, of which the blocks have all.
_PIECE = "CAST(ceil(length(text) / CAST(count(*) OVER (PARTITION BY doc_id) AS DOUBLE)) AS INTEGER)"
CONTENT = f"substr(text, idx * {_PIECE} + 1, {_PIECE})"


def _pages(spark: SparkSession, d: str) -> DataFrame:
    rows = spread(spark, d, "documents").select("doc_id", "text", L.parse_layout(expression(RESPONSE)).alias("blocks"))
    rows = rows.withColumn("piece", F.ceil(F.length("text") / F.size("blocks")).cast("int"))
    contents = F.transform("blocks", lambda b: F.substring("text", b["idx"] * F.col("piece") + 1, F.col("piece")))
    return rows.select("doc_id", L.with_contents(F.col("blocks"), contents).alias("blocks"))


def layout_blocks(spark: SparkSession, d: str) -> DataFrame:
    rows = spread(spark, d, "documents").select("doc_id", L.parse_layout(expression(RESPONSE)).alias("blocks"))
    return L.explode_blocks(rows, "doc_id").select("doc_id", "idx", "type", "bbox.*", "angle", "merge_prev")


def layout_table_images(spark: SparkSession, d: str) -> DataFrame:
    found = _pages(spark, d).select("doc_id", F.inline(L.table_images(F.col("blocks"))))
    return found.select("doc_id", F.col("table").alias("table_idx"), F.array_join(F.transform("images", lambda i: i.cast("string")), ",").alias("images"))


def layout_captions(spark: SparkSession, d: str) -> DataFrame:
    """The blocks that are left when captions inside images are dropped."""
    rows = _pages(spark, d).select("doc_id", F.inline(L.drop_covered_captions(F.col("blocks"))))
    return rows.select("doc_id", "idx", "type")


def layout_equations(spark: SparkSession, d: str) -> DataFrame:
    rows = _pages(spark, d).select("doc_id", F.inline(L.merge_equations(F.col("blocks"))))
    return rows.where("type = 'equation'").select("doc_id", "idx", "content")


def layout_markdown(spark: SparkSession, d: str) -> DataFrame:
    rows = _pages(spark, d).select("doc_id", L.clean_blocks(F.col("blocks")).alias("blocks"))
    return rows.select("doc_id", L.to_markdown(L.post_process(F.col("blocks"), merge=False, drop_paratext=True)).alias("markdown"))


class Echo:
    """A reader that answers with the block's type and place."""

    def __call__(self, requests: list[dict]) -> list[str]:
        return [f"{r['type']} {r['idx']}" for r in requests]


def two_step(spark: SparkSession, d: str) -> DataFrame:
    """Layout, captions inside images dropped, reading of each block by a model (an echo here), text."""
    rows = spread(spark, d, "documents").select("doc_id", L.parse_layout(expression(RESPONSE)).alias("blocks"))
    rows = rows.withColumn("blocks", L.drop_covered_captions(F.col("blocks"))).withColumn("wanted", L.to_extract(F.col("blocks")))
    read = inference.read_blocks(rows, Echo).select("doc_id", L.clean_blocks(F.col("blocks")).alias("blocks"))
    return read.select("doc_id", L.to_markdown(L.post_process(F.col("blocks"), merge=False)).alias("markdown"))


QUERIES = {f.__name__: f for f in (layout_blocks, layout_table_images, layout_captions, layout_equations, layout_markdown, two_step)}

_HEAD = r"\A" + " +".join(["([0-9]+)"] * 4) + r"<\|box_end\|>" + r"<\|ref_start\|>([A-Za-z_]+)<\|ref_end\|>(<\|rotate_(?:down|left|right|up)\|>)?"
_TYPES = ", ".join(f"'{t}'" for t in L.TYPES)
BLOCKS_SQL = f"""r AS (SELECT doc_id, text, string_split({RESPONSE}, '<|box_start|>') AS pieces FROM documents),
x AS (SELECT doc_id, text, i, regexp_extract(pieces[i], '{_HEAD}', ['a', 'b', 'c', 'd', 'k', 'r']) AS m, pieces[i] AS piece FROM (SELECT *, unnest(range(2, len(pieces) + 1)) AS i FROM r)),
y AS (SELECT doc_id, text, i, lower(m.k) AS type, CAST(m.a AS INTEGER) AS a, CAST(m.b AS INTEGER) AS b, CAST(m.c AS INTEGER) AS c, CAST(m.d AS INTEGER) AS d, m.r AS r, piece LIKE '%txt_contd_tgt%' AS tail FROM x WHERE m.a <> ''),
z AS (SELECT * FROM y WHERE greatest(a, b, c, d) <= 1000 AND a <> c AND b <> d AND type IN ({_TYPES})),
blocks AS (SELECT doc_id, text, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS idx, type, least(a, c) / CAST(1000 AS DOUBLE) AS "left", least(b, d) / CAST(1000 AS DOUBLE) AS top, greatest(a, c) / CAST(1000 AS DOUBLE) AS "right", greatest(b, d) / CAST(1000 AS DOUBLE) AS bottom,
  CASE r WHEN '<|rotate_up|>' THEN 0 WHEN '<|rotate_right|>' THEN 90 WHEN '<|rotate_down|>' THEN 180 WHEN '<|rotate_left|>' THEN 270 END AS angle, type = 'text' AND tail AS merge_prev FROM z),
cover AS (SELECT a.doc_id, a.idx AS inner_idx, b.idx AS outer_idx, a.type AS inner_type, b.type AS outer_type, a.top AS inner_top, a."left" AS inner_left, (b."right" - b."left") * (b.bottom - b.top) AS outer_area,
  CASE WHEN least(a."right", b."right") - greatest(a."left", b."left") > 0 AND least(a.bottom, b.bottom) - greatest(a.top, b.top) > 0
    THEN (least(a."right", b."right") - greatest(a."left", b."left")) * (least(a.bottom, b.bottom) - greatest(a.top, b.top)) ELSE 0.0 END / ((a."right" - a."left") * (a.bottom - a.top)) AS ratio
  FROM blocks a JOIN blocks b ON a.doc_id = b.doc_id AND a.idx <> b.idx),
best AS (SELECT doc_id, inner_idx, inner_top, inner_left, outer_idx FROM cover WHERE inner_type = 'image' AND outer_type = 'table' AND ratio >= 0.9
  QUALIFY row_number() OVER (PARTITION BY doc_id, inner_idx ORDER BY ratio DESC, outer_area, outer_idx) = 1)"""


_COVERED = "type = 'image_caption' AND EXISTS (SELECT 1 FROM cover WHERE cover.doc_id = blocks.doc_id AND inner_idx = idx AND outer_type IN ('image', 'chart', 'image_block') AND ratio >= 0.9)"


def _markdown_sql(content: str, dropped: str, left_out: str = "false") -> str:
    return f"""WITH {BLOCKS_SQL},
c AS (SELECT *, {content} AS raw FROM blocks WHERE NOT ({left_out})),
w AS (SELECT doc_id, idx, type, merge_prev, CASE WHEN trim(raw, ' ' || chr(10) || chr(9) || chr(13)) = '' THEN NULL WHEN type = 'text' OR type = 'table' THEN trim(raw, ' ' || chr(10) || chr(9) || chr(13)) WHEN type = 'equation' THEN '\\[' || chr(10) || trim(raw, ' ' || chr(10) || chr(9) || chr(13)) || chr(10) || '\\]' ELSE raw END AS content FROM c),
v AS (SELECT * FROM w WHERE content IS NOT NULL AND type NOT IN ({dropped}) AND NOT (type = 'image' AND EXISTS (SELECT 1 FROM best WHERE best.doc_id = w.doc_id AND best.inner_idx = w.idx))),
t AS (SELECT *, type = 'text' AND (NOT merge_prev OR row_number() OVER (PARTITION BY doc_id, type ORDER BY idx) = 1) AS starts FROM v),
u AS (SELECT *, CASE WHEN type = 'text' AND NOT starts THEN max(CASE WHEN starts THEN idx END) OVER (PARTITION BY doc_id ORDER BY idx) ELSE idx END AS home FROM t),
g AS (SELECT doc_id, home, string_agg(content, ' ' ORDER BY idx) AS part FROM u GROUP BY ALL),
p AS (SELECT doc_id, string_agg(part, chr(10) || chr(10) ORDER BY home) AS markdown FROM g GROUP BY doc_id)
SELECT documents.doc_id, coalesce(trim(markdown, ' ' || chr(10) || chr(9) || chr(13)), '') AS markdown FROM documents LEFT JOIN p ON documents.doc_id = p.doc_id"""


SQL = {
    "layout_blocks": f'WITH {BLOCKS_SQL} SELECT doc_id, idx, type, "left", top, "right", bottom, CAST(angle AS INTEGER) AS angle, merge_prev FROM blocks',
    "layout_table_images": f"WITH {BLOCKS_SQL} SELECT t.doc_id, t.idx AS table_idx, coalesce(string_agg(CAST(inner_idx AS VARCHAR), ',' ORDER BY inner_top, inner_left, inner_idx), '') AS images FROM blocks t LEFT JOIN best ON t.doc_id = best.doc_id AND t.idx = best.outer_idx WHERE t.type = 'table' GROUP BY ALL",
    "layout_captions": f"WITH {BLOCKS_SQL} SELECT doc_id, idx, type FROM blocks WHERE NOT ({_COVERED})",
    "layout_equations": f"""WITH {BLOCKS_SQL}, c AS (SELECT *, {CONTENT} AS content FROM blocks),
m AS (SELECT doc_id, inner_idx, list(outer_idx) AS parts FROM cover WHERE inner_type = 'equation_block' AND outer_type = 'equation' AND ratio > 0.9 GROUP BY ALL HAVING count(*) > 1)
SELECT doc_id, idx, content FROM c WHERE type = 'equation' AND NOT EXISTS (SELECT 1 FROM m WHERE m.doc_id = c.doc_id AND list_contains(parts, idx))
UNION ALL SELECT m.doc_id, inner_idx AS idx, '\\begin{{array}}{{l}} ' || string_agg(trim(content, ' ' || chr(10)), ' \\\\ ' ORDER BY idx) || ' \\end{{array}}' FROM m JOIN c ON m.doc_id = c.doc_id AND list_contains(parts, idx) GROUP BY m.doc_id, inner_idx""",
    "layout_markdown": _markdown_sql(CONTENT, "'equation_block', 'aside_text', 'footer', 'header', 'page_footnote', 'page_number', 'unknown'"),
    "two_step": _markdown_sql("CASE WHEN type IN ('list', 'equation_block', 'image_block', 'image', 'chart') THEN '' ELSE type || ' ' || CAST(idx AS VARCHAR) END", "'equation_block'", _COVERED),
}
