"""Queries of polygons, page candidates, turned boxes, review answers, formulas and rounding; inputs are made from ids and columns."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import blocks as B
from ..functions import geometry as G
from ..functions.batches import in_slices
from ..functions.metrics import percentage
from ..operators import detection as D
from .page_queries import BOX, EDGES, HEIGHT, WIDTH
from .tables import expression, spread, table

#: Three corners, of which the first is repeated at the end in every second row; every seventh row has two corners only.
_X = ("(event_id % 97)", "(event_id % 89 + 100)", "(event_id % 83 + 50)")
_Y = ("(event_id % 79)", "(event_id % 73 + 5)", "(event_id % 71 + 200)")
_PAGE_WIDTH = "(CASE event_id % 3 WHEN 0 THEN 0 ELSE 850 END)"


def _events(spark: SparkSession, d: str) -> DataFrame:
    w, h = (F.expr(f"CAST({x} AS INT)") for x in (WIDTH, HEIGHT))
    box = G.box(*[F.expr(f"CAST({BOX[e]} AS INT)") for e in EDGES])
    flat = [F.expr(f"CAST({v} AS DOUBLE)") for pair in zip(_X, _Y, strict=True) for v in pair]
    closed, opened, short = F.array(*flat, *flat[:2]), F.array(*flat), F.array(*flat[:4])
    numbers = F.when(F.expr("event_id % 7 = 0"), short).when(F.expr("event_id % 2 = 0"), closed).otherwise(opened)
    return table(spark, d, "events").select("event_id", "value", w.alias("w"), h.alias("h"), box.alias("b"), numbers.alias("numbers"))


def polygon_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Corners of a flat array in page units, scaled to pixels, and their bounds."""
    rows = _events(spark, d).withColumn("polygon", G.normalize_polygon(F.col("numbers")))
    scaled = G.scale_polygon(F.col("polygon"), F.expr(f"CAST({_PAGE_WIDTH} AS DOUBLE)"), F.lit(1100.0), F.col("w"), F.col("h"))
    rows = rows.select("event_id", F.size("polygon").alias("corners"), G.polygon_box(scaled).alias("b"))
    return rows.select("event_id", "corners", *[F.round(f"b.{e}", 6).alias(e) for e in EDGES])


def page_candidates(spark: SparkSession, d: str) -> DataFrame:
    """What a candidate with an image, a polygon, a box or none of these is made of; pixels with a margin of 30."""
    image = F.when(F.expr("event_id % 5 = 0"), F.lit(b"x"))
    polygon = F.when(F.expr("event_id % 5 = 1"), G.normalize_polygon(F.col("numbers")))
    bbox = F.when(F.expr("event_id % 5 <= 3"), F.col("b"))
    kind, pixels = G.materialize(image, polygon, bbox, F.col("w"), F.col("h"))
    return _events(spark, d).select("event_id", kind.alias("kind"), pixels.alias("p")).select("event_id", "kind", "p.*")


def turned_boxes(spark: SparkSession, d: str) -> DataFrame:
    angle = F.expr("CAST(event_id % 5 AS INT) * 90")
    return _events(spark, d).select("event_id", G.rotate_box(F.col("b"), F.lit(1000), F.lit(1001), angle).alias("b")).select("event_id", "b.*")


def block_pixels(spark: SparkSession, d: str) -> DataFrame:
    parts = G.box(*[F.col("b")[e] / 1001.0 for e in EDGES])
    return _events(spark, d).select("event_id", G.block_pixels(parts, F.col("w"), F.col("h")).alias("p")).select("event_id", "p.*")


def strip_deltas(spark: SparkSession, d: str) -> DataFrame:
    delta = D.strip_delta(F.expr("CAST(event_id % 1100 AS INT) - 50"), F.expr("CAST(event_id % 300 AS INT)"), F.col("w"))
    return _events(spark, d).select("event_id", delta.alias("delta"))


_JSON_BOX = "'\"left\": ' || CAST(doc_id % 480 AS STRING) || ', \"top\": ' || CAST(doc_id % 450 AS STRING) || ', \"right\": ' || CAST(520 + doc_id % 400 AS STRING) || ', \"bottom\": \"' || CAST(500 + doc_id % 430 AS STRING) || '\"'"
TARGET = (
    "CASE doc_id % 6 WHEN 0 THEN '{' || BOX || '}' WHEN 1 THEN '{\"block\": {' || BOX || '}}' WHEN 2 THEN '```json' || chr(10) || '{\"bbox\": {' || BOX || '}}' || chr(10) || '```' "
    "WHEN 3 THEN '{\"block_found\": false}' WHEN 4 THEN '{\"block\": null}' ELSE 'no JSON' END"
).replace("BOX", _JSON_BOX)


def target_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Answers with a box at the top, under a key, fenced, or without one."""
    rows = table(spark, d, "documents").select("doc_id", D.parse_target_box(expression(TARGET)).alias("t"))
    return rows.select("doc_id", "t.found", "t.error", *[F.col(f"t.box.{e}").alias(e) for e in EDGES])


@F.arrow_udf(StringType())
def _cleaned(text: pa.Array) -> pa.Array:
    return in_slices(lambda ts: pa.array([B.clean("text", t, None, False) for t in ts], pa.string()), text)


#: Before and after cleaning; between the parts comes a column.
_MATH = (r"\[v + ", r" = w\] as in \[12, 3\], for \(a\inB_1\), \(x ____ y\) and \(\inf Z\) ", ".")
_CLEAN = (r"\(v + ", r" = w\) as in \[12, 3\], for \(a\in B_1\), \(x \) ____ \( y\) and \(\inf Z\) ", ".")


def _joined(parts: tuple[str, ...]) -> str:
    return f"'{parts[0]}' || source || '{parts[1]}' || replace(replace(text, chr(92), '/'), chr(10), ' ') || '{parts[2]}'"


def inline_formulas(spark: SparkSession, d: str) -> DataFrame:
    """Running text with display math, a citation, macros and blanks to fill in."""
    return spread(spark, d, "documents").select("doc_id", _cleaned(expression(_joined(_MATH))).alias("text"))


def rounded_percentages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", percentage(F.col("l_quantity").cast("double") / F.lit(173.0)).alias("rounded"))


QUERIES = {f.__name__: f for f in (polygon_boxes, page_candidates, turned_boxes, block_pixels, strip_deltas, target_boxes, inline_formulas, rounded_percentages)}

_D = "CAST({} AS DOUBLE)"
_EVENTS = f"e AS (SELECT event_id, CAST({WIDTH} AS INTEGER) AS w, CAST({HEIGHT} AS INTEGER) AS h, " + ", ".join(f'CAST({BOX[e]} AS INTEGER) AS "{e}"' for e in EDGES) + ", " + ", ".join(f"{_D.format(v)} AS x{i}" for i, v in enumerate(_X)) + ", " + ", ".join(f"{_D.format(v)} AS y{i}" for i, v in enumerate(_Y)) + " FROM events)"
_SCALE = f"w / CAST(CASE {_PAGE_WIDTH} WHEN 0 THEN w ELSE 850 END AS DOUBLE)", "h / CAST(1100 AS DOUBLE)"
_CROPPED = "greatest(CAST(trunc({left} - 30) AS INTEGER), 0) AS \"left\", greatest(CAST(trunc({top} - 30) AS INTEGER), 0) AS top, least(CAST(trunc({right} + 30) AS INTEGER), w) AS \"right\", least(CAST(trunc({bottom} + 30) AS INTEGER), h) AS bottom"
_KIND = "CASE WHEN event_id % 5 = 0 THEN 'image' WHEN event_id % 5 = 1 AND event_id % 7 <> 0 THEN 'polygon' WHEN event_id % 5 <= 3 THEN 'box' ELSE 'whole' END"
SQL = {
    "polygon_boxes": f"""WITH {_EVENTS}, s AS (SELECT event_id, event_id % 7 = 0 AS short, {_SCALE[0]} AS sx, {_SCALE[1]} AS sy, * EXCLUDE (event_id) FROM e)
SELECT event_id, CASE WHEN short THEN 0 ELSE 3 END AS corners, """
    + ", ".join(f'CASE WHEN NOT short THEN round({f}({a}0 * s{a}, {a}1 * s{a}, {a}2 * s{a}), 6) END AS "{e}"' for e, f, a in (("left", "least", "x"), ("top", "least", "y"), ("right", "greatest", "x"), ("bottom", "greatest", "y")))
    + " FROM s",
    "page_candidates": f"""WITH {_EVENTS}, k AS (SELECT *, {_KIND} AS kind FROM e)
SELECT event_id, kind, NULL AS "left", NULL AS top, NULL AS "right", NULL AS bottom FROM k WHERE kind = 'image'
UNION ALL SELECT event_id, kind, {_CROPPED.format(left='least(x0, x1, x2)', top='least(y0, y1, y2)', right='greatest(x0, x1, x2)', bottom='greatest(y0, y1, y2)')} FROM k WHERE kind = 'polygon'
UNION ALL SELECT event_id, kind, {_CROPPED.format(left='"left"', top='top', right='"right"', bottom='bottom')} FROM k WHERE kind = 'box'
UNION ALL SELECT event_id, kind, 0, 0, w, h FROM k WHERE kind = 'whole'""",
    "turned_boxes": f"""WITH {_EVENTS} SELECT event_id,
  CASE event_id % 5 WHEN 1 THEN top WHEN 2 THEN 1000 - "right" WHEN 3 THEN 1001 - bottom ELSE "left" END AS "left", CASE event_id % 5 WHEN 1 THEN 1000 - "right" WHEN 2 THEN 1001 - bottom WHEN 3 THEN "left" ELSE top END AS top,
  CASE event_id % 5 WHEN 1 THEN bottom WHEN 2 THEN 1000 - "left" WHEN 3 THEN 1001 - top ELSE "right" END AS "right", CASE event_id % 5 WHEN 1 THEN 1000 - "left" WHEN 2 THEN 1001 - top WHEN 3 THEN "right" ELSE bottom END AS bottom FROM e""",
    "block_pixels": f"""WITH {_EVENTS}, p AS (SELECT event_id, w, h, greatest(0, least(w - 1, CAST(floor("left" / CAST(1001 AS DOUBLE) * w) AS INTEGER))) AS l, greatest(0, least(h - 1, CAST(floor(top / CAST(1001 AS DOUBLE) * h) AS INTEGER))) AS t,
  least(w, CAST(ceil("right" / CAST(1001 AS DOUBLE) * w) AS INTEGER)) AS r, least(h, CAST(ceil(bottom / CAST(1001 AS DOUBLE) * h) AS INTEGER)) AS b FROM e)
SELECT event_id, l AS "left", t AS top, greatest(l + 1, r) AS "right", greatest(t + 1, b) AS bottom FROM p""",
    "strip_deltas": f"""WITH {_EVENTS}, d AS (SELECT event_id, CAST(event_id % 1100 AS INTEGER) - 50 AS delta, CAST(event_id % 300 AS INTEGER) AS pixels, w FROM e)
SELECT event_id, CASE WHEN delta > 0 AND pixels > 0 THEN greatest(0, least(1000, CAST(round_even(delta * pixels / CAST(1000 AS DOUBLE) * 1000 / w, 0) AS INTEGER))) ELSE 0 END AS delta FROM d""",
    "target_boxes": """SELECT doc_id, doc_id % 6 < 3 AS found, CASE doc_id % 6 WHEN 5 THEN 'invalid JSON' END AS error,
  CASE WHEN doc_id % 6 < 3 THEN greatest(45, least(955, CAST(doc_id % 480 AS INTEGER))) END AS "left", CASE WHEN doc_id % 6 < 3 THEN greatest(45, least(955, CAST(doc_id % 450 AS INTEGER))) END AS top,
  CASE WHEN doc_id % 6 < 3 THEN greatest(45, least(955, CAST(520 + doc_id % 400 AS INTEGER))) END AS "right", CASE WHEN doc_id % 6 < 3 THEN greatest(45, least(955, CAST(500 + doc_id % 430 AS INTEGER))) END AS bottom FROM documents""",
    "inline_formulas": f"SELECT doc_id, trim({_joined(_CLEAN)}, ' ' || chr(9) || chr(13)) AS text FROM documents",
    "rounded_percentages": "SELECT l_orderkey, l_linenumber, CAST(printf('%.1f', CAST(l_quantity AS DOUBLE) / CAST(173 AS DOUBLE) * 100) AS DOUBLE) AS rounded FROM lineitem",
}
