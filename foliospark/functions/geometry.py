"""Boxes, crops and target sizes: arithmetic on dimensions, never on pixels.

A box is a struct (left, top, right, bottom).  ``rint`` rounds half to even, as
the exact results need; casts to int truncate.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dialect import let

EDGES = tuple("left top right bottom".split())
BORDER, LONGEST = 0.05, 2500
_SCALED = 1 + 2 * BORDER
LEAST, MOST = BORDER / _SCALED * 1000, (1 + BORDER) / _SCALED * 1000


def _int(value: Column) -> Column:
    return value.cast("int")


def _round(value: Column) -> Column:
    return F.rint(value).cast("int")


def _within(value: Column, low: Column | float, high: Column | float) -> Column:
    low, high = (x if isinstance(x, Column) else F.lit(x) for x in (low, high))
    return F.greatest(low, F.least(high, value))


def box(left: Column, top: Column, right: Column, bottom: Column) -> Column:
    return F.struct(left.alias("left"), top.alias("top"), right.alias("right"), bottom.alias("bottom"))


# --- overlap ------------------------------------------------------------------


def area(b: Column) -> Column:
    return F.greatest(b["right"] - b["left"], F.lit(0.0)) * F.greatest(b["bottom"] - b["top"], F.lit(0.0))


def intersection_area(a: Column, b: Column) -> Column:
    width = F.least(a["right"], b["right"]) - F.greatest(a["left"], b["left"])
    height = F.least(a["bottom"], b["bottom"]) - F.greatest(a["top"], b["top"])
    return F.when((width > 0) & (height > 0), width * height).otherwise(0.0)


def cover_ratio(inner: Column, outer: Column) -> Column:
    """The part of inner that lies in outer; 0 if inner has no area."""
    return F.when(area(inner) == 0, 0.0).otherwise(intersection_area(inner, outer) / area(inner))


# --- crops --------------------------------------------------------------------


def crop(b: Column, width: Column, height: Column, margin: Column | int = 30) -> Column:
    """Pixels of b with a margin, cut off at the image."""
    margin = margin if isinstance(margin, Column) else F.lit(margin)
    return box(
        F.greatest(_int(b["left"] - margin), F.lit(0)), F.greatest(_int(b["top"] - margin), F.lit(0)),
        F.least(_int(b["right"] + margin), width), F.least(_int(b["bottom"] + margin), height),
    )


def polygon_box(polygon: Column) -> Column:
    """Bounds of an array of (x, y) structs; null if it is empty."""
    xs, ys = F.transform(polygon, lambda p: p["x"].cast("double")), F.transform(polygon, lambda p: p["y"].cast("double"))
    return F.when(F.size(polygon) > 0, box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)))


def box_polygon(b: Column) -> Column:
    corners = (("left", "top"), ("right", "top"), ("right", "bottom"), ("left", "bottom"))
    return F.array(*[F.struct(b[x].alias("x"), b[y].alias("y")) for x, y in corners])


def normalize_polygon(numbers: Column) -> Column:
    """(x, y) structs of a flat array of numbers, without a closing point; empty for fewer than 6 numbers."""
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size(numbers) / 2).cast("int") - 1), lambda i: F.struct(F.get(numbers, i * 2).cast("double").alias("x"), F.get(numbers, i * 2 + 1).cast("double").alias("y")))
    opened = let(pairs, lambda p: F.when((F.size(p) > 1) & (p[0] == F.element_at(p, -1)), F.slice(p, 1, F.size(p) - 1)).otherwise(p))
    empty = F.array().cast("array<struct<x:double,y:double>>")
    return F.when(F.coalesce(F.size(numbers), F.lit(0)) < 6, empty).otherwise(opened)


def scale_polygon(polygon: Column, page_width: Column, page_height: Column, width: Column, height: Column) -> Column:
    """From page units to pixels; a page size that is missing or 0 is that of the image."""
    sx, sy = (image / F.coalesce(F.when(page != 0, page), image.cast("double")) for page, image in ((page_width, width), (page_height, height)))
    return F.transform(polygon, lambda p: F.struct((p["x"] * sx).alias("x"), (p["y"] * sy).alias("y")))


def materialize(image: Column, polygon: Column, bbox: Column, width: Column, height: Column, margin: int = 30) -> tuple[Column, Column]:
    """(kind, pixels) of a page candidate: its own image, else its polygon, else its box, else the whole image."""
    has_polygon = F.coalesce(F.size(polygon), F.lit(0)) > 0
    whole = box(F.lit(0), F.lit(0), width.cast("int"), height.cast("int"))
    kind = F.when(image.isNotNull(), "image").when(has_polygon, "polygon").when(bbox.isNotNull(), "box").otherwise("whole")
    pixels = F.when(image.isNotNull(), F.lit(None)).when(has_polygon, crop(polygon_box(polygon), width, height, margin)).when(bbox.isNotNull(), crop(bbox, width, height, margin)).otherwise(whole)
    return kind, pixels


def full_image(width: Column, height: Column) -> Column:
    return box(F.lit(0.0), F.lit(0.0), width.cast("double"), height.cast("double"))


# --- normalized coordinates ---------------------------------------------------


def clamp(value: Column) -> Column:
    """A coordinate in thousandths inside the image's border: 45 to 955."""
    return _within(_round(_within(value.cast("double"), LEAST, MOST)), 0, 1000)


def clamp_box(b: Column) -> Column:
    return box(*[clamp(b[e]) for e in EDGES])


def denormalize(b: Column, width: Column, height: Column) -> Column:
    """Pixels of a box in thousandths."""
    size = {"left": width, "top": height, "right": width, "bottom": height}
    return box(*[_within(_round(b[e] * size[e] / 1000), 0, size[e].cast("int")) for e in EDGES])


def normalize_pixel(value: Column, size: Column) -> Column:
    return F.when(size <= 0, 0).otherwise(_within(_round(value * 1000 / size), 0, 1000))


def detection_transform(width: Column, height: Column) -> Column:
    """struct (width, height, border_x, border_y, processed_width, processed_height, scale_x, scale_y): a white border, then at most 2500 pixels."""
    bx, by = (F.greatest(F.lit(1), _round(x * BORDER)) for x in (width, height))
    pw, ph = width + 2 * bx, height + 2 * by
    longest = F.greatest(pw, ph)
    fit = lambda x: F.when(longest <= LONGEST, x).otherwise(F.greatest(F.lit(1), _round(x * (F.lit(float(LONGEST)) / longest)))).cast("int")
    return F.struct(
        width.cast("int").alias("width"), height.cast("int").alias("height"), bx.alias("border_x"), by.alias("border_y"),
        fit(pw).alias("processed_width"), fit(ph).alias("processed_height"), (fit(pw) / pw).alias("scale_x"), (fit(ph) / ph).alias("scale_y"),
    )


def map_to_original(b: Column, transform: Column) -> Column:
    """Pixels of the original image of a box in thousandths of the processed one."""

    def back(d: Column) -> Column:
        def one(edge: str) -> Column:
            across = edge in ("left", "right")
            scale, border, size = (transform[x] for x in (("scale_x", "border_x", "width") if across else ("scale_y", "border_y", "height")))
            return _within(d[edge] / scale - border, 0.0, size.cast("double"))

        return box(*[one(e) for e in EDGES])

    return let(denormalize(b, transform["processed_width"], transform["processed_height"]), back)


# --- review crops -------------------------------------------------------------


def review_crop(b: Column, width: Column, height: Column, margin: float = 0.12, outline: int = 10) -> Column:
    """Pixels around a box that a reviewer sees."""

    def grown(d: Column) -> Column:
        mx, my = (F.greatest(F.lit(outline * 2), _round(F.greatest(F.lit(1), d[b_] - d[a]) * margin)) for a, b_ in (("left", "right"), ("top", "bottom")))
        return box(F.greatest(F.lit(0), d["left"] - mx), F.greatest(F.lit(0), d["top"] - my), F.least(width, d["right"] + mx), F.least(height, d["bottom"] + my))

    return let(denormalize(b, width, height), grown)


def edge_strip(b: Column, edge: Column, width: Column, height: Column, outline: int = 10) -> Column:
    """Pixels of the band around one edge of a box; null if it is empty."""

    def band(d: Column) -> Column:
        w, h = (F.greatest(F.lit(1), d[b_] - d[a]) for a, b_ in (("left", "right"), ("top", "bottom")))
        half_x, half_y = (F.greatest(F.lit(outline * 3), _round(x * 0.18)) for x in (w, h))
        pad_x, pad_y = (F.greatest(F.lit(outline * 2), _round(x * 0.06)) for x in (w, h))
        upright = edge.isin("left", "right")
        x, y = F.when(edge == "left", d["left"]).otherwise(d["right"]), F.when(edge == "top", d["top"]).otherwise(d["bottom"])
        left, right = F.when(upright, x - half_x).otherwise(d["left"] - pad_x), F.when(upright, x + half_x).otherwise(d["right"] + pad_x)
        top, bottom = F.when(upright, d["top"] - pad_y).otherwise(y - half_y), F.when(upright, d["bottom"] + pad_y).otherwise(y + half_y)
        found = box(F.greatest(F.lit(0), left), F.greatest(F.lit(0), top), F.least(width, right), F.least(height, bottom))
        return let(found, lambda s: F.when((s["left"] < s["right"]) & (s["top"] < s["bottom"]), s))

    return F.when(edge.isin(*EDGES), let(denormalize(b, width, height), band))


def _sizes(crop_: Column) -> dict[str, Column]:
    w, h = (F.greatest(F.lit(1), crop_[b] - crop_[a]) for a, b in (("left", "right"), ("top", "bottom")))
    return {"left": w, "top": h, "right": w, "bottom": h}


def to_crop(b: Column, crop_: Column, width: Column, height: Column) -> Column:
    """A box in thousandths of the source, in thousandths of a crop of it."""
    size = _sizes(crop_)
    near = {"left": "left", "top": "top", "right": "left", "bottom": "top"}
    return let(denormalize(b, width, height), lambda d: box(*[clamp(normalize_pixel(_within(d[e] - crop_[near[e]], 0, size[e]), size[e])) for e in EDGES]))


def from_crop(b: Column, crop_: Column, width: Column, height: Column) -> Column:
    """A box in thousandths of a crop, in thousandths of the source."""
    size, whole = _sizes(crop_), {"left": width, "top": height, "right": width, "bottom": height}
    near = {"left": "left", "top": "top", "right": "left", "bottom": "top"}
    return let(denormalize(b, size["left"], size["top"]), lambda d: box(*[clamp(normalize_pixel(_within(crop_[near[e]] + d[e], 0, whole[e]), whole[e])) for e in EDGES]))


# --- target sizes -------------------------------------------------------------


def size(width: Column, height: Column) -> Column:
    return F.struct(width.cast("int").alias("width"), height.cast("int").alias("height"))


def fit_size(width: Column, height: Column, most: int = LONGEST) -> Column:
    """The size of an image that fits into a square; images aren't enlarged."""
    scale = F.least(F.lit(float(most)) / width, F.lit(float(most)) / height)
    small = (width <= most) & (height <= most)
    return F.when(small, size(width, height)).otherwise(size(*[F.greatest(F.lit(1), _int(x * scale)) for x in (width, height)]))


GRID = 28


def budget_size(width: Column, height: Column, items: int = 6084, patch: int = 2) -> Column:
    """fit_size, then the largest size on a grid of 28 pixels within a budget of patches."""
    most = GRID**2 * patch * items

    def fitted(s: Column) -> Column:
        w, h = s["width"], s["height"]
        on_grid = F.rint(w / GRID) * GRID * F.rint(h / GRID) * GRID
        scale = F.sqrt(patch * w.cast("double") * h / most)
        smaller = size(*[F.greatest(F.lit(GRID), (F.floor(x / scale / GRID) * GRID).cast("int")) for x in (w, h)])
        return F.when((w < GRID) | (h < GRID) | (patch * on_grid <= most), s).otherwise(smaller)

    return let(fit_size(width, height), fitted)


_AREA = (1792 * 28, 3072 * 2048)


def grid_size(width: Column, height: Column) -> Column:
    """A size on a grid of 28 pixels, of an area within bounds, of nearly the same aspect; sizes below 1 stay."""
    pixels = width.cast("double") * height
    scale = F.when(pixels > _AREA[1], F.sqrt(_AREA[1] / pixels)).when(pixels < _AREA[0], F.sqrt(_AREA[0] / pixels)).otherwise(1.0)
    aspect = width / height
    start = F.struct(*[F.greatest(F.lit(1), _round(x * scale / GRID)).alias(n) for x, n in ((width, "w"), (height, "h"))])

    def shrink(s: Column, _: Column) -> Column:
        w, h = s["w"], s["h"]
        narrower = F.when(w == 1, False).when(h == 1, True).otherwise(F.abs((w - 1) / h - aspect) < F.abs(w / (h - 1) - aspect))
        too_large = (w.cast("long") * h * GRID**2 > _AREA[1]) & ((w > 1) | (h > 1))
        return F.when(too_large, F.struct((w - narrower.cast("int")).alias("w"), (h - (~narrower).cast("int")).alias("h"))).otherwise(s)

    # rounding puts a side half a cell beyond the bound at most: for extreme aspects many cells of the short side's length
    steps = F.sequence(F.lit(1), F.greatest(start["w"], start["h"]))
    found = F.aggregate(steps, start, shrink, lambda s: size(s["w"] * GRID, s["h"] * GRID))
    return F.when((width <= 0) | (height <= 0), size(width, height)).otherwise(found)


TILE, TILES = 448, 12
_GRIDS = sorted({(w, h) for w in range(1, TILES + 1) for h in range(1, TILES // w + 1)}, key=lambda r: r[0] * r[1])


def tiling(width: Column, height: Column) -> Column:
    """struct (columns, rows, images): the tile grid of the nearest aspect, and its number of images with the thumbnail.

    Of grids equally near, a larger one is taken if the image has more than
    half of its pixels.
    """
    aspect = width / F.greatest(height, F.lit(1))
    pixels = width.cast("long") * height
    grids = F.array(*[F.struct(F.lit(w).alias("columns"), F.lit(h).alias("rows"), F.lit(w / h).alias("aspect")) for w, h in _GRIDS])
    start = F.struct(F.lit(1).alias("columns"), F.lit(1).alias("rows"), F.lit(float("inf")).alias("gap"))

    def step(best: Column, g: Column) -> Column:
        gap = F.abs(aspect - g["aspect"])
        better = (gap < best["gap"]) | ((gap == best["gap"]) & (pixels > 0.5 * TILE * TILE * g["columns"] * g["rows"]))
        return F.when(better, F.struct(g["columns"], g["rows"], gap.alias("gap"))).otherwise(best)

    def finish(s: Column) -> Column:
        n = s["columns"] * s["rows"]
        return F.struct(s["columns"], s["rows"], F.when(n > 1, n + 1).otherwise(n).alias("images"))

    return F.aggregate(grids, start, step, finish)


def block_pixels(b: Column, width: Column, height: Column) -> Column:
    """Whole pixels that hold a box in parts of the image, one at least."""
    left, top = (_within(F.floor(b[e] * s).cast("int"), 0, s - 1) for e, s in (("left", width), ("top", height)))
    right, bottom = (F.greatest(a + 1, F.least(s, F.ceil(b[e] * s).cast("int"))) for e, s, a in (("right", width, left), ("bottom", height, top)))
    return box(left, top, right, bottom)


def needed_size(width: Column, height: Column, least_edge: int = 28, most_ratio: int = 50) -> Column:
    """The size of a block's image: padded if it is too oblong, enlarged if it is too small."""
    ratio = F.greatest(width, height) / F.least(width, height)
    padded = F.when(ratio > most_ratio, F.when(width > height, size(width, F.ceil(width / most_ratio))).otherwise(size(F.ceil(height / most_ratio), height))).otherwise(size(width, height))

    def enlarged(s: Column) -> Column:
        shorter = F.least(s["width"], s["height"])
        scale = F.lit(float(least_edge)) / shorter
        return F.when(shorter < least_edge, size(F.ceil(s["width"] * scale), F.ceil(s["height"] * scale))).otherwise(s)

    return let(padded, enlarged)


def rotate_box(b: Column, width: Column, height: Column, angle: Column) -> Column:
    """A box after the image is turned by 90, 180 or 270 degrees; other angles leave it."""
    l, t, r, d = (b[e] for e in EDGES)  # noqa: E741
    return (
        F.when(angle == 90, box(t, width - r, d, width - l))
        .when(angle == 180, box(width - r, height - d, width - l, height - t))
        .when(angle == 270, box(height - d, l, height - t, r))
        .otherwise(box(l, t, r, d))
    )
