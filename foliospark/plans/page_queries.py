"""Queries of geometry, detection, review and inference; box coordinates are made from the ids of documents and events."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import detection as D
from ..operators import inference
from .tables import expression, table

EDGES = G.EDGES
WIDTH, HEIGHT = "(300 + (event_id * 37) % 5000)", "(200 + (event_id * 91) % 4000)"
#: A box in thousandths, left of right and above bottom.
BOX = {"left": "((event_id * 7) % 480)", "top": "((event_id * 11) % 450)", "right": "(520 + (event_id * 13) % 480)", "bottom": "(500 + (event_id * 17) % 501)"}


def _images(spark: SparkSession, d: str) -> DataFrame:
    w, h = (F.expr(f"CAST({x} AS INT)") for x in (WIDTH, HEIGHT))
    box = G.box(*[F.expr(f"CAST({BOX[e]} AS INT)") for e in EDGES])
    return table(spark, d, "events").select("event_id", w.alias("w"), h.alias("h"), box.alias("b"))


def crop_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Crops of boxes in pixels with fractions, with a margin of 30."""
    b = F.col("b")
    size = {"left": "w", "top": "h", "right": "w", "bottom": "h"}
    pixels = G.box(*[b[e] * F.col(size[e]) / 1000.0 for e in EDGES])
    return _images(spark, d).select("event_id", G.crop(pixels, F.col("w"), F.col("h")).alias("c")).select("event_id", "c.*")


def denormalized_boxes(spark: SparkSession, d: str) -> DataFrame:
    return _images(spark, d).select("event_id", G.denormalize(G.clamp_box(F.col("b")), F.col("w"), F.col("h")).alias("c")).select("event_id", "c.*")


def original_boxes(spark: SparkSession, d: str) -> DataFrame:
    rows = _images(spark, d).withColumn("t", G.detection_transform(F.col("w"), F.col("h")))
    found = rows.select("event_id", "t.border_x", "t.border_y", "t.processed_width", "t.processed_height", G.map_to_original(G.clamp_box(F.col("b")), F.col("t")).alias("c"))
    return found.select("event_id", "border_x", "border_y", "processed_width", "processed_height", *[F.round(f"c.{e}", 6).alias(e) for e in EDGES])


def edge_strips(spark: SparkSession, d: str) -> DataFrame:
    rows = _images(spark, d).withColumn("edge", F.explode(F.array(*map(F.lit, EDGES))))
    return rows.select("event_id", "edge", G.edge_strip(F.col("b"), F.col("edge"), F.col("w"), F.col("h")).alias("c")).select("event_id", "edge", "c.*")


def crop_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of the source in a review crop, and back."""
    rows = _images(spark, d).withColumn("crop", G.review_crop(F.col("b"), F.col("w"), F.col("h")))
    rows = rows.withColumn("inside", G.to_crop(F.col("b"), F.col("crop"), F.col("w"), F.col("h")))
    rows = rows.withColumn("back", G.from_crop(F.col("inside"), F.col("crop"), F.col("w"), F.col("h")))
    return rows.select("event_id", *[F.col(f"{c}.{e}").alias(f"{c}_{e}") for c in ("crop", "inside", "back") for e in EDGES])


def target_sizes(spark: SparkSession, d: str) -> DataFrame:
    w, h = F.col("w"), F.col("h")
    rows = _images(spark, d).select("event_id", G.fit_size(w, h).alias("fit"), G.fit_size(w, h, 1288).alias("small"), G.budget_size(w, h).alias("budget"), G.needed_size(F.ceil(w / 200).cast("int"), h).alias("needed"), G.tiling(w, h).alias("tiles"))
    return rows.select("event_id", *[F.col(f"{c}.{x}").alias(f"{c}_{x}") for c in ("fit", "small", "budget", "needed") for x in ("width", "height")], "tiles.columns", "tiles.rows", "tiles.images")


def grid_sizes(spark: SparkSession, d: str) -> DataFrame:
    return _images(spark, d).select("event_id", G.grid_size(F.col("w"), F.col("h")).alias("s")).select("event_id", "s.*")


ANSWER = "'```json' || chr(10) || '{\"pages\": [{\"page_index\": 2, \"left\": 1, \"top\": \"' || CAST(doc_id % 1001 AS STRING) || '\", \"right\": 999.5, \"bottom\": 700}, {\"page_index\": 1, \"left\": ' || CAST(doc_id % 500 AS STRING) || ', \"top\": 2.5, \"right\": 600, ' || CASE lang WHEN 'fr' THEN '\"low\"' ELSE '\"bottom\"' END || ': 46.5}]}' || chr(10) || '```'"


def page_boxes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", D.parse_page_boxes(expression(ANSWER)).alias("p"))
    return rows.select("doc_id", F.col("p.error").isNotNull().alias("bad"), F.explode_outer("p.boxes").alias("b")).select("doc_id", "bad", "b.*")


def edge_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Decisions with the amounts of the events' props, applied to boxes."""
    answer = "'{\"page_index\": ' || CAST(user_id AS STRING) || ', \"edge\": \"' || CASE event_type WHEN 'click' THEN 'Left' WHEN 'view' THEN 'top ' WHEN 'error' THEN 'middle' ELSE 'right' END || '\", \"decision\": {\"action\": \"' || CASE WHEN value < 5 THEN 'expand' WHEN value < 10 THEN 'SHRINK' ELSE 'no_change' END || '\", \"amount\": ' || regexp_extract(props, '([0-9]+)', 1) || '}}'"
    rows = table(spark, d, "events").select("event_id", D.parse_edge_decision(expression(answer)).alias("x"), G.box(*[F.expr(f"CAST({BOX[e]} AS INT)") for e in EDGES]).alias("b"))
    none = F.struct(F.lit("no_change").alias("action"), F.lit(0).alias("amount"))
    by_edge = F.struct(*[F.when(F.col("x.edge") == e, F.struct(F.col("x.action"), F.col("x.amount"))).otherwise(none).alias(e) for e in EDGES])
    return rows.select("event_id", "x.edge", "x.action", "x.amount", D.apply_decisions(F.col("b"), by_edge).alias("c")).select("event_id", "edge", "action", "amount", "c.*")


#: Proposal of an event for an edge of its user's page: near the start at first, then swinging.
PROPOSED = {e: f"({base} + CAST(floor(value * {k}) AS INT) % {span} * CASE event_id % 3 WHEN 0 THEN -1 ELSE 1 END)" for e, base, k, span in (("left", 120, 3, 90), ("top", 100, 7, 13), ("right", 880, 5, 40), ("bottom", 900, 2, 7))}
START = {"left": 100, "top": 110, "right": 900, "bottom": 890}


def edge_review(spark: SparkSession, d: str) -> DataFrame:
    """Each user's page, reviewed by the user's events in order."""
    rows = table(spark, d, "events").select("user_id", F.struct("event_id", F.struct(F.lit(1).alias("page_index"), *[F.expr(PROPOSED[e]).cast("int").alias(e) for e in EDGES]).alias("p")).alias("x"))
    rounds = rows.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: F.array(x["p"])).alias("rounds"))
    start = F.array(F.struct(F.lit(1).alias("page_index"), *[F.lit(START[e]).alias(e) for e in EDGES]))
    found = rounds.select("user_id", D.review(start, F.col("rounds")).alias("r"))
    return found.select("user_id", *[F.col("r.boxes")[0][e].alias(e) for e in EDGES], "r.frozen", "r.rounds")


def page_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Line items as page candidates of their orders."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_extendedprice").alias("price"))
    rows = rows.withColumn("position", F.struct("l_partkey", "l_suppkey", "price"))
    return D.number_pages(rows, "l_orderkey", "l_linenumber", "position").select("l_orderkey", "l_linenumber", "l_partkey", F.col("page_index").cast("int").alias("page_index"))


class Echo:
    """A backend that answers with the page's place and size, and fails for pages of one width."""

    def __call__(self, batch: pd.DataFrame) -> list[str]:
        if (batch["w"] == 337).any():
            raise ValueError("no such page")
        return [f"{i}:{w}x{h}" for i, w, h in zip(batch["event_id"], batch["w"], batch["h"], strict=True)]


def echo_transcriptions(spark: SparkSession, d: str) -> DataFrame:
    rows = inference.transcribe(_images(spark, d).select("event_id", "w", "h"), Echo)
    return rows.select("event_id", "text", F.col("ocr_metadata")["benchmark_error_type"].alias("error"))


QUERIES = {
    f.__name__: f
    for f in (crop_boxes, denormalized_boxes, original_boxes, edge_strips, crop_round_trip, target_sizes, grid_sizes, page_boxes, edge_decisions, edge_review, page_numbers, echo_transcriptions)
}

_DOUBLE = "CAST({} AS DOUBLE)"
_LEAST, _MOST = f"CAST({G.LEAST!r} AS DOUBLE)", f"CAST({G.MOST!r} AS DOUBLE)"
_AXIS = {"left": "w", "top": "h", "right": "w", "bottom": "h"}


def _rint(text: str) -> str:
    return f"CAST(round_even(CAST({text} AS DOUBLE), 0) AS INTEGER)"


def _within(text: str, low: str, high: str) -> str:
    return f"greatest({low}, least({high}, {text}))"


def _clamp(text: str) -> str:
    return _within(_rint(_within(f"CAST({text} AS DOUBLE)", _LEAST, _MOST)), "0", "1000")


def _pixels(value: str, size: str) -> str:
    return _within(_rint(f"{value} * {size} / CAST(1000 AS DOUBLE)"), "0", size)


def _thousandths(value: str, size: str) -> str:
    return _within(_rint(f"({value}) * 1000 / CAST({size} AS DOUBLE)"), "0", "1000")


def _columns(make, prefix: str = "") -> str:
    return ", ".join(f'{make(e)} AS "{prefix}{e}"' for e in EDGES)


_IMAGES = f"im AS (SELECT event_id, CAST({WIDTH} AS INTEGER) AS w, CAST({HEIGHT} AS INTEGER) AS h, {_columns(lambda e: f'CAST({BOX[e]} AS INTEGER)', 'b_')} FROM events)"
_PIXELS = f"px AS (SELECT *, {_columns(lambda e: _pixels(f'b_{e}', _AXIS[e]), 'p_')} FROM im)"


def _crop_edge(e: str) -> str:
    v, s = f"b_{e} * {_AXIS[e]} / CAST(1000 AS DOUBLE)", _AXIS[e]
    return f"greatest(CAST(trunc({v} - 30) AS INTEGER), 0)" if e in ("left", "top") else f"least(CAST(trunc({v} + 30) AS INTEGER), {s})"


def _original(e: str) -> str:
    a = "x" if _AXIS[e] == "w" else "y"
    processed, padded = ("pw", "w + 2 * bx") if a == "x" else ("ph", "h + 2 * by_")
    border = "bx" if a == "x" else "by_"
    return f"round({_within(f'{_pixels(_clamp(f"b_{e}"), processed)} / ({processed} / CAST({padded} AS DOUBLE)) - {border}', '0.0', f'CAST({_AXIS[e]} AS DOUBLE)')}, 6)"


def _fit(size: str) -> str:
    return f"CASE WHEN longest <= 2500 THEN {size} ELSE greatest(1, {_rint(f'({size}) * (CAST(2500 AS DOUBLE) / longest)')}) END"


_STRIP = {
    "left": ("p_left - hx", "p_top - py", "p_left + hx", "p_bottom + py"), "right": ("p_right - hx", "p_top - py", "p_right + hx", "p_bottom + py"),
    "top": ("p_left - px", "p_top - hy", "p_right + px", "p_top + hy"), "bottom": ("p_left - px", "p_bottom - hy", "p_right + px", "p_bottom + hy"),
}
_NEAR = {"left": "left", "top": "top", "right": "left", "bottom": "top"}


def _strips() -> str:
    parts = []
    for edge, values in _STRIP.items():
        cut = [f"greatest(0, {v})" if e in ("left", "top") else f"least({_AXIS[e]}, {v})" for e, v in zip(EDGES, values, strict=True)]
        parts.append(f"SELECT event_id, '{edge}' AS edge, " + ", ".join(f'{c} AS "{e}"' for c, e in zip(cut, EDGES, strict=True)) + " FROM s")
    empty = lambda e: f'CASE WHEN "left" < "right" AND top < bottom THEN "{e}" END'
    return f"""WITH {_IMAGES}, {_PIXELS}, z AS (SELECT *, greatest(1, p_right - p_left) AS bw, greatest(1, p_bottom - p_top) AS bh FROM px),
s AS (SELECT *, greatest(30, {_rint('bw * CAST(0.18 AS DOUBLE)')}) AS hx, greatest(30, {_rint('bh * CAST(0.18 AS DOUBLE)')}) AS hy, greatest(20, {_rint('bw * CAST(0.06 AS DOUBLE)')}) AS px, greatest(20, {_rint('bh * CAST(0.06 AS DOUBLE)')}) AS py FROM z),
u AS ({' UNION ALL '.join(parts)}) SELECT event_id, edge, {_columns(empty)} FROM u"""


def _round_trip() -> str:
    inside = lambda e: _clamp(_thousandths(_within(f"p_{e} - crop_{_NEAR[e]}", "0", f"c{_AXIS[e]}"), f"c{_AXIS[e]}"))
    back = lambda e: _clamp(_thousandths(_within(f"crop_{_NEAR[e]} + {_pixels(f'inside_{e}', f'c{_AXIS[e]}')}", "0", _AXIS[e]), _AXIS[e]))
    margin = {"w": f"greatest(20, {_rint('greatest(1, p_right - p_left) * CAST(0.12 AS DOUBLE)')})", "h": f"greatest(20, {_rint('greatest(1, p_bottom - p_top) * CAST(0.12 AS DOUBLE)')})"}
    grown = lambda e: f"greatest(0, p_{e} - {margin[_AXIS[e]]})" if e in ("left", "top") else f"least({_AXIS[e]}, p_{e} + {margin[_AXIS[e]]})"
    return f"""WITH {_IMAGES}, {_PIXELS}, c AS (SELECT *, {_columns(grown, 'crop_')} FROM px), d AS (SELECT *, greatest(1, crop_right - crop_left) AS cw, greatest(1, crop_bottom - crop_top) AS ch FROM c),
i AS (SELECT *, {_columns(inside, 'inside_')} FROM d) SELECT event_id, {', '.join(f'{c}_{e}' for c in ('crop', 'inside') for e in EDGES)}, {_columns(back, 'back_')} FROM i"""


def _sizes() -> str:
    fit = lambda x, n: f"CASE WHEN w <= {n} AND h <= {n} THEN {x} ELSE greatest(1, CAST(trunc({x} * least(CAST({n} AS DOUBLE) / w, CAST({n} AS DOUBLE) / h)) AS INTEGER)) END"
    most = G.GRID**2 * 2 * 6084
    grid = lambda x: f"round_even({x} / CAST(28 AS DOUBLE), 0) * 28"
    budget = lambda x: f"CASE WHEN fw < 28 OR fh < 28 OR 2 * {grid('fw')} * {grid('fh')} <= {most} THEN {x} ELSE greatest(28, CAST(floor({x} / sqrt(2 * CAST(fw AS DOUBLE) * fh / {most}) / 28) * 28 AS INTEGER)) END"
    grids = ", ".join(f"({i}, {w}, {h})" for i, (w, h) in enumerate(G._GRIDS))
    return f"""WITH {_IMAGES}, f AS (SELECT *, {fit('w', 2500)} AS fw, {fit('h', 2500)} AS fh, {fit('w', 1288)} AS sw, {fit('h', 1288)} AS sh, CAST(ceil(w / CAST(200 AS DOUBLE)) AS INTEGER) AS nw FROM im),
pad AS (SELECT *, CASE WHEN greatest(nw, h) / CAST(least(nw, h) AS DOUBLE) > 50 AND nw <= h THEN CAST(ceil(h / CAST(50 AS DOUBLE)) AS INTEGER) ELSE nw END AS w1, CASE WHEN greatest(nw, h) / CAST(least(nw, h) AS DOUBLE) > 50 AND nw > h THEN CAST(ceil(nw / CAST(50 AS DOUBLE)) AS INTEGER) ELSE h END AS h1 FROM f),
grids(i, c, r) AS (VALUES {grids}),
near AS (SELECT event_id, i, c, r, abs(w / CAST(h AS DOUBLE) - c / CAST(r AS DOUBLE)) AS gap, CAST(w AS BIGINT) * h > 0.5 * 448 * 448 * c * r AS large FROM im CROSS JOIN grids),
ties AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY i) AS n FROM near QUALIFY gap = min(gap) OVER (PARTITION BY event_id)),
tiles AS (SELECT event_id, arg_max(c, i) FILTER (n = 1 OR large) AS c, arg_max(r, i) FILTER (n = 1 OR large) AS r FROM (SELECT event_id, i, c, r, large, row_number() OVER (PARTITION BY event_id ORDER BY i) AS n FROM ties) GROUP BY event_id)
SELECT pad.event_id, fw AS fit_width, fh AS fit_height, sw AS small_width, sh AS small_height, {budget('fw')} AS budget_width, {budget('fh')} AS budget_height,
  CASE WHEN least(w1, h1) < 28 THEN CAST(ceil(w1 * (CAST(28 AS DOUBLE) / least(w1, h1))) AS INTEGER) ELSE w1 END AS needed_width, CASE WHEN least(w1, h1) < 28 THEN CAST(ceil(h1 * (CAST(28 AS DOUBLE) / least(w1, h1))) AS INTEGER) ELSE h1 END AS needed_height,
  c AS "columns", r AS "rows", CASE WHEN c * r > 1 THEN c * r + 1 ELSE c * r END AS images FROM pad JOIN tiles ON pad.event_id = tiles.event_id"""


def _decisions() -> str:
    edge = "CASE event_type WHEN 'click' THEN 'left' WHEN 'view' THEN 'top' WHEN 'error' THEN NULL ELSE 'right' END"
    move = lambda e: f"CAST({BOX[e]} AS INTEGER) + CASE WHEN edge = '{e}' AND action = 'expand' THEN {'-' if e in ('left', 'top') else ''}amount WHEN edge = '{e}' AND action = 'shrink' THEN {'' if e in ('left', 'top') else '-'}amount ELSE 0 END"
    fix = {e: (f"CASE WHEN m_{a} >= m_{b} THEN {'greatest(0, CAST(floor((m_' + a + ' + m_' + b + ') / CAST(2 AS DOUBLE)) AS INTEGER) - 1)' if e == a else 'least(1000, CAST(floor((m_' + a + ' + m_' + b + ') / CAST(2 AS DOUBLE)) AS INTEGER) + 1)'} ELSE m_{e} END") for a, b in (("left", "right"), ("top", "bottom")) for e in (a, b)}
    return f"""WITH x AS (SELECT event_id, {edge} AS edge, CASE WHEN event_type = 'error' THEN NULL WHEN value < 5 THEN 'expand' WHEN value < 10 THEN 'shrink' ELSE 'no_change' END AS action, CASE WHEN event_type = 'error' THEN NULL WHEN value >= 10 THEN 0 ELSE least(1000, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER)) END AS amount FROM events),
m AS (SELECT *, {_columns(move, 'm_')} FROM x) SELECT event_id, edge, action, amount, {_columns(lambda e: _clamp(fix[e]))} FROM m"""


def _review() -> str:
    """A round a step: the state of each edge is (v, f: frozen, s: stable rounds, g: sign, m: magnitude)."""
    names = {e: e[0] for e in EDGES}
    steady, swing, first = {}, {}, []
    for e, k in names.items():
        delta = f"(r.p{k} - w.v{k})"
        steady[e] = f"(abs{delta} <= 6)"
        swing[e] = f"coalesce(w.g{k} <> sign{delta} AND w.m{k} > 6 AND abs{delta} >= 0.5 * w.m{k} AND abs{delta} <= 2.0 * w.m{k}, false)"
        pick = "least" if e in ("left", "top") else "greatest"
        first += [
            f"CASE WHEN w.f{k} OR {steady[e]} THEN w.v{k} WHEN {swing[e]} THEN {pick}(w.v{k}, r.p{k}) ELSE r.p{k} END AS n{k}",
            f"CASE WHEN w.f{k} THEN true WHEN {steady[e]} THEN w.s{k} + 1 >= 2 WHEN {swing[e]} THEN true ELSE false END AS f{k}",
            f"CASE WHEN w.f{k} THEN w.s{k} WHEN {steady[e]} THEN w.s{k} + 1 ELSE 0 END AS s{k}",
            f"CASE WHEN w.f{k} OR {steady[e]} OR {swing[e]} THEN w.g{k} ELSE CAST(sign{delta} AS INTEGER) END AS g{k}",
            f"CASE WHEN w.f{k} OR {steady[e]} OR {swing[e]} THEN w.m{k} ELSE abs{delta} END AS m{k}",
            f"w.v{k} AS was_{k}",
        ]
    middle = lambda a, b: f"CAST(floor((n{a} + n{b}) / CAST(2 AS DOUBLE)) AS INTEGER)"
    fixed = {
        "l": f"CASE WHEN nl >= nr THEN greatest(0, {middle('l', 'r')} - 1) ELSE nl END", "r": f"CASE WHEN nl >= nr THEN least(1000, {middle('l', 'r')} + 1) ELSE nr END",
        "t": f"CASE WHEN nt >= nb THEN greatest(0, {middle('t', 'b')} - 1) ELSE nt END", "b": f"CASE WHEN nt >= nb THEN least(1000, {middle('t', 'b')} + 1) ELSE nb END",
    }
    state = ", ".join(f"v{k}, f{k}, s{k}, g{k}, m{k}" for k in names.values())
    start = ", ".join(f"{START[e]} AS v{k}, false AS f{k}, 0 AS s{k}, CAST(NULL AS INTEGER) AS g{k}, CAST(NULL AS INTEGER) AS m{k}" for e, k in names.items())
    new = ", ".join(f"{_clamp(fixed[k])} AS v{k}, f{k}, s{k}, g{k}, m{k}" for k in names.values())
    same = " AND ".join(f"{_clamp(fixed[k])} = was_{k}" for k in names.values())
    frozen = " AND ".join(f"w.f{k}" for k in names.values())
    return f"""WITH RECURSIVE r AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, {', '.join(f'CAST({PROPOSED[e]} AS INTEGER) AS p{k}' for e, k in names.items())} FROM events),
w AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS n, false AS done, CAST(0 AS INTEGER) AS rounds, {start} FROM events
UNION ALL SELECT user_id, n, {same} AS done, rounds + CASE WHEN {same} THEN 0 ELSE 1 END AS rounds, {new} FROM (
  SELECT w.user_id, r.n, w.rounds, {', '.join(first)} FROM w JOIN r ON r.user_id = w.user_id AND r.n = w.n + 1 WHERE NOT w.done AND NOT ({frozen}))),
z AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC) = 1)
SELECT user_id, vl AS "left", vt AS top, vr AS "right", vb AS bottom, {' + '.join(f'CAST(f{k} AS INTEGER)' for k in names.values())} AS frozen, rounds FROM z"""


_HALF = "CAST(2.5 AS DOUBLE)"
SQL = {
    "crop_boxes": f"WITH {_IMAGES} SELECT event_id, {_columns(_crop_edge)} FROM im",
    "denormalized_boxes": f"WITH {_IMAGES} SELECT event_id, {_columns(lambda e: _pixels(_clamp(f'b_{e}'), _AXIS[e]))} FROM im",
    "original_boxes": f"""WITH {_IMAGES}, b AS (SELECT *, greatest(1, {_rint('w * CAST(0.05 AS DOUBLE)')}) AS bx, greatest(1, {_rint('h * CAST(0.05 AS DOUBLE)')}) AS by_ FROM im), l AS (SELECT *, greatest(w + 2 * bx, h + 2 * by_) AS longest FROM b),
p AS (SELECT *, {_fit('w + 2 * bx')} AS pw, {_fit('h + 2 * by_')} AS ph FROM l) SELECT event_id, bx AS border_x, by_ AS border_y, pw AS processed_width, ph AS processed_height, {_columns(_original)} FROM p""",
    "edge_strips": _strips(),
    "crop_round_trip": _round_trip(),
    "target_sizes": _sizes(),
    "page_boxes": f"""SELECT doc_id, false AS bad, 2 AS page_index, {_clamp('1')} AS "left", {_clamp('doc_id % 1001')} AS top, {_clamp('999.5')} AS "right", {_clamp('700')} AS bottom FROM documents WHERE lang <> 'fr'
UNION ALL SELECT doc_id, false, 1, {_clamp('doc_id % 500')}, {_clamp('2.5')}, {_clamp('600')}, {_clamp('46.5')} FROM documents WHERE lang <> 'fr' UNION ALL SELECT doc_id, true, NULL, NULL, NULL, NULL, NULL FROM documents WHERE lang = 'fr'""",
    "edge_decisions": _decisions(),
    "edge_review": _review(),
    "page_numbers": "SELECT l_orderkey, l_linenumber, l_partkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS INTEGER) AS page_index FROM lineitem",
    "echo_transcriptions": f"WITH {_IMAGES} SELECT event_id, CASE WHEN w = 337 THEN '' ELSE event_id || ':' || w || 'x' || h END AS text, CASE WHEN w = 337 THEN 'ValueError' END AS error FROM im",
}
