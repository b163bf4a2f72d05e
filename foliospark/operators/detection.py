"""Detected boxes: parsing of model answers, edge decisions, the review of boxes round by round.

Parsers give a struct with ``error``, null if the answer is good, so one bad
answer never stops a job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.dialect import let, strip
from ..functions.text import strip_code_fence

EDGES = G.EDGES
PAGE_BOX = "struct<page_index:int,left:int,top:int,right:int,bottom:int>"
_RAW = "left:string,top:string,right:string,bottom:string"
_NAMED = "struct<page_index:string," + _RAW + ">"


def _number(text: Column) -> Column:
    return strip(text).try_cast("double")


def _page_box(page_index: Column, raw: Column) -> Column:
    """PAGE_BOX of text fields; null if one isn't a number."""
    values = {e: _number(raw[e]) for e in EDGES}
    good = page_index.isNotNull()
    for v in values.values():
        good = good & v.isNotNull()
    return F.when(good, F.struct(page_index.try_cast("int").alias("page_index"), *[G.clamp(values[e]).alias(e) for e in EDGES]))


def parse_page_boxes(answer: Column) -> Column:
    """struct (boxes, error) of {"pages": [{page_index, left, top, right, bottom}, ...]}, which may be fenced; by page_index."""

    def of(json: Column) -> Column:
        parsed = F.from_json(json, f"struct<pages:array<{_NAMED}>>")["pages"]
        boxes = F.transform(parsed, lambda p: _page_box(_number(p["page_index"]), p))
        bad = F.exists(boxes, lambda b: b.isNull())
        # a stable order: the place in the answer decides between equal numbers
        placed = F.array_sort(F.transform(boxes, lambda b, i: F.struct(b["page_index"], i.alias("at"), b.alias("box"))))
        error = F.when(F.try_variant_get(F.try_parse_json(json), "$", "string").isNull(), "invalid JSON").when(parsed.isNull(), "no list of pages").when(bad, "invalid page box")
        return F.struct(F.when(error.isNull(), F.transform(placed, lambda x: x["box"])).alias("boxes"), error.alias("error"))

    return let(strip_code_fence(answer), of)


def parse_target_box(answer: Column, key: str = "block", found: str = "block_found") -> Column:
    """struct (box, found, error): the box at the top level, under ``key`` or under bbox; or none if the answer says so."""

    def of(json: Column) -> Column:
        flat = F.from_json(json, f"struct<{_RAW}>")
        nested = F.from_json(json, f"struct<`{key}`:struct<{_RAW}>,bbox:struct<{_RAW}>>")
        variant = F.try_parse_json(json)
        value = lambda name: F.try_variant_get(variant, f"$.{name}", "string")
        top = flat["left"].isNotNull() & flat["top"].isNotNull() & flat["right"].isNotNull() & flat["bottom"].isNotNull()
        raw = F.when(top, flat).otherwise(F.coalesce(nested[key], nested["bbox"]))
        box = _page_box(F.lit(1), raw)
        said_no = F.array_contains(F.transform(F.array(value(found), value("found")), lambda v: F.coalesce(v == "false", F.lit(False))), True)
        keys = F.json_object_keys(json)
        null_target = F.coalesce(F.array_contains(keys, key) | F.array_contains(keys, "bbox"), F.lit(False)) & value(key).isNull() & value("bbox").isNull()
        error = (
            F.when(keys.isNull(), "invalid JSON")
            .when(box.isNotNull(), None)
            .when(raw.isNotNull(), "invalid box")
            .when(value(key).isNotNull() | value("bbox").isNotNull(), f"{key} is neither an object nor null")
            .when(~(said_no | null_target), f"neither {key} nor {found}")
        )
        return F.struct(box.alias("box"), (box.isNotNull() & error.isNull()).alias("found"), error.alias("error"))

    return let(strip_code_fence(answer), of)


ACTIONS = ("expand", "no_change", "shrink")


def parse_edge_decision(answer: Column) -> Column:
    """struct (page_index, edge, action, amount, error); the decision is nested or at the top level, amounts are 0 to 1000."""

    def of(json: Column) -> Column:
        parsed = F.from_json(json, "struct<page_index:string,edge:string,action:string,amount:string,decision:string>")
        nested = F.from_json(parsed["decision"], "struct<action:string,decision:string,amount:string>")
        inside = F.coalesce(parsed["decision"].startswith("{"), F.lit(False))
        action = F.lower(strip(F.when(inside, F.coalesce(nested["action"], nested["decision"])).otherwise(parsed["action"])))
        raw = F.when(inside, nested["amount"]).otherwise(parsed["amount"])
        amount = F.when(raw.isNull(), 0.0).otherwise(_number(raw))
        edge = F.lower(strip(parsed["edge"]))
        error = (
            F.when(F.json_object_keys(json).isNull(), "invalid JSON")
            .when(~F.coalesce(edge.isin(*EDGES), F.lit(False)), "unknown edge")
            .when(~F.coalesce(action.isin(*ACTIONS), F.lit(False)), "unknown action")
            .when(amount.isNull(), "amount isn't a number")
        )
        clean = F.when(action == "no_change", 0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1000.0), F.rint(amount))).cast("int"))
        good = lambda c: F.when(error.isNull(), c)
        return F.struct(_number(parsed["page_index"]).try_cast("int").alias("page_index"), good(edge).alias("edge"), good(action).alias("action"), good(clean).alias("amount"), error.alias("error"))

    return let(strip_code_fence(answer), of)


# --- decisions ----------------------------------------------------------------


def repaired(left: Column, top: Column, right: Column, bottom: Column) -> Column:
    """A box with a span of 2 around the centre where its edges cross, clamped."""

    def pair(a: Column, b: Column) -> tuple[Column, Column]:
        centre = F.floor((a + b) / 2).cast("int")
        crossed = a >= b
        return F.when(crossed, F.greatest(F.lit(0), centre - 1)).otherwise(a), F.when(crossed, F.least(F.lit(1000), centre + 1)).otherwise(b)

    (l, r), (t, d) = pair(left, right), pair(top, bottom)  # noqa: E741
    return G.box(*[G.clamp(x) for x in (l, t, r, d)])


def moved(value: Column, action: Column, amount: Column, edge: str) -> Column:
    """A coordinate after a decision: an edge expands away from the box."""
    outwards = -1 if edge in ("left", "top") else 1
    sign = F.when(action == "expand", outwards).when(action == "shrink", -outwards).otherwise(0)
    return value + F.when(amount > 0, sign * amount).otherwise(0)


def apply_decisions(b: Column, decisions: Column) -> Column:
    """A box after a struct of (action, amount) by edge."""
    return repaired(*[moved(b[e], decisions[e]["action"], decisions[e]["amount"], e) for e in EDGES])


def strip_delta(delta: Column, strip_pixels: Column, local_pixels: Column) -> Column:
    """A distance in thousandths of a strip, in thousandths of the local axis."""
    good = (delta > 0) & (strip_pixels > 0) & (local_pixels > 0)
    return F.when(good, F.greatest(F.lit(0), F.least(F.lit(1000), F.rint(delta * strip_pixels / 1000 * 1000 / local_pixels).cast("int")))).otherwise(0)


# --- review -------------------------------------------------------------------

DEADBAND, STABLE_ROUNDS, RATIO = 6, 2, (0.5, 2.0)
_EDGE = "struct<value:int,frozen:boolean,stable:int,sign:int,magnitude:int>"
_STATE = f"struct<pages:array<struct<page_index:int,edges:array<{_EDGE}>>>,done:boolean,rounds:int>"


def _next_edge(e: Column, proposed: Column, outer: Column) -> Column:
    """State of an edge after a round; outer: whether its lower coordinate is the more expansive one."""
    delta = proposed - e["value"]
    size = F.abs(delta)
    sign = F.when(delta > 0, 1).otherwise(-1)
    steady = size <= DEADBAND
    swings = e["sign"].isNotNull() & (e["sign"] != sign) & (e["magnitude"] > DEADBAND) & (size >= RATIO[0] * e["magnitude"]) & (size <= RATIO[1] * e["magnitude"])
    swings = F.coalesce(swings, F.lit(False))
    state = lambda value, frozen, stable, s, m: F.struct(value.alias("value"), frozen.alias("frozen"), stable.alias("stable"), s.alias("sign"), m.alias("magnitude"))
    expansive = F.when(outer, F.least(e["value"], proposed)).otherwise(F.greatest(e["value"], proposed))
    return (
        F.when(e["frozen"], e)
        .when(steady, state(e["value"], e["stable"] + 1 >= STABLE_ROUNDS, e["stable"] + 1, e["sign"], e["magnitude"]))
        .when(swings, state(expansive, F.lit(True), F.lit(0), e["sign"], e["magnitude"]))
        .otherwise(state(proposed, F.lit(False), F.lit(0), sign, size))
        .cast(_EDGE)
    )


def _next_page(page: Column, proposal: Column) -> Column:
    """A page after a round; without a proposal (a failed review) it stays."""
    values = F.array(*[proposal[e] for e in EDGES])
    edges = F.transform(page["edges"], lambda e, i: _next_edge(e, F.get(values, i), i < 2))

    def fixed(edges: Column) -> Column:
        box = repaired(*[edges[i]["value"] for i in range(4)])
        final = F.array(*[box[e] for e in EDGES])
        return F.transform(edges, lambda e, i: e.withField("value", F.get(final, i)))

    all_frozen = F.forall(page["edges"], lambda e: e["frozen"])
    return F.when(all_frozen | proposal.isNull(), page).otherwise(F.struct(page["page_index"], let(edges, fixed).alias("edges")))


def review(boxes: Column, rounds: Column) -> Column:
    """struct (boxes, frozen, rounds): PAGE_BOX array after review rounds, all in one row.

    rounds: array (one a round) of arrays of proposed PAGE_BOXes; pages that a
    round leaves out keep their box.  An edge that moves by 6 or less stays and
    is frozen the second time; one that swings back by half to twice its last
    move takes the more expansive place and is frozen.  The review ends when
    all edges are frozen or a round changes no box; ``rounds`` counts the rounds
    that changed one.
    """
    fresh = lambda b: F.struct(b["page_index"], F.array(*[F.struct(b[e].alias("value"), F.lit(False).alias("frozen"), F.lit(0).alias("stable"), F.lit(None).cast("int").alias("sign"), F.lit(None).cast("int").alias("magnitude")) for e in EDGES]).alias("edges"))
    start = F.struct(F.transform(boxes, fresh).alias("pages"), F.lit(False).alias("done"), F.lit(0).alias("rounds")).cast(_STATE)
    values = lambda pages: F.transform(pages, lambda p: F.transform(p["edges"], lambda e: e["value"]))

    def step(state: Column, proposals: Column) -> Column:
        new = F.transform(state["pages"], lambda p: _next_page(p, F.try_element_at(F.filter(proposals, lambda q: q["page_index"] == p["page_index"]), F.lit(-1))))
        frozen = F.forall(state["pages"], lambda p: F.forall(p["edges"], lambda e: e["frozen"]))

        def after(new: Column) -> Column:
            same = values(new) == values(state["pages"])
            return F.struct(new.alias("pages"), same.alias("done"), (state["rounds"] + (~same).cast("int")).alias("rounds")).cast(_STATE)

        return F.when(state["done"] | frozen, state.withField("done", F.lit(True))).otherwise(let(new, after))

    def finish(state: Column) -> Column:
        # a stable sort by page
        placed = F.array_sort(F.transform(state["pages"], lambda p, i: F.struct(p["page_index"], i.alias("at"), F.struct(p["page_index"], *[p["edges"][k]["value"].alias(e) for k, e in enumerate(EDGES)]).alias("box"))))
        frozen = F.aggregate(state["pages"], F.lit(0), lambda n, p: n + F.size(F.filter(p["edges"], lambda e: e["frozen"])))
        return F.struct(F.transform(placed, lambda x: x["box"]).alias("boxes"), frozen.alias("frozen"), state["rounds"].alias("rounds"))

    return F.aggregate(rounds, start, step, finish)


# --- pages --------------------------------------------------------------------


def number_pages(candidates: DataFrame, document: str, source_index: str, position: str) -> DataFrame:
    """candidates with page_index: the running number of a page in its document, from 0."""
    order = Window.partitionBy(document).orderBy(source_index, position)
    return candidates.withColumn("page_index", F.row_number().over(order) - 1)


def candidates_or_full_image(candidates: Column, width: Column, height: Column) -> Column:
    """The detected boxes of an image, or one box of all of it."""
    return F.when(F.coalesce(F.size(candidates), F.lit(0)) > 0, candidates).otherwise(F.array(G.full_image(width, height)))
