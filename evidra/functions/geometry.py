"""Box geometry as columns: a bounding-box text becomes a struct with its bounds or an error code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOX = "struct<shape:string,x_min:double,y_min:double,x_max:double,y_max:double,center_x:double,center_y:double,width:double,height:double,error:string>"


def let(value: Column, body) -> Column:
    """body of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def bounds(bbox: Column) -> Column:
    """Geometry of a JSON text [l, t, r, b] or [[x, y], ...]; `error` says what is wrong with others.

    Numbers in quotes and booleans are not numbers; what is not JSON is of an invalid type.
    """
    is_list = lambda x: F.schema_of_variant(x).startswith("ARRAY")
    is_number = lambda x: F.schema_of_variant(x).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*|INT|SMALLINT|TINYINT)$")
    value = lambda x: F.try_variant_get(x, "$", "double")
    finite = lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))

    def parsed(s):
        items = F.try_variant_get(s.v, "$", "array<variant>")
        return let(F.struct(s.v.alias("v"), s.t.alias("t"), items.alias("items"), F.exists(items, is_list).alias("nested"), F.exists(items, lambda x: ~is_list(x)).alias("scalar")), checked)

    def checked(p):
        points = F.transform(p["items"], lambda x: F.try_variant_get(x, "$", "array<variant>"))
        return let(F.struct(p.v.alias("v"), p.t.alias("t"), p["items"].alias("items"), p.nested.alias("nested"), p.scalar.alias("scalar"), points.alias("points"), F.when(~p.nested, F.transform(p["items"], value)).alias("flat")), measured)

    def measured(p):
        wide = F.exists(p.points, lambda q: q.isNull() | (F.size(q) != 2))
        error = (
            F.when(p.t.isNull() | (F.trim(p.t) == "null"), "bbox_missing").when(p.v.isNull() | ~is_list(p.v), "bbox_invalid_type").when(F.size(p["items"]) == 0, "bbox_empty")
            .when(p.nested & p.scalar, "bbox_mixed_format").when(~p.nested & (F.size(p["items"]) != 4), "bbox_invalid_flat_count").when(~p.nested & F.exists(p["items"], lambda x: ~is_number(x)), "bbox_invalid_number")
            .when(~p.nested & F.exists(p.flat, lambda x: ~finite(x)), "bbox_non_finite").when(~p.nested & ((p.flat[2] < p.flat[0]) | (p.flat[3] < p.flat[1])), "bbox_negative_size")
            .when(p.nested & wide, "bbox_invalid_point").when(p.nested & F.exists(p.points, lambda q: F.exists(q, lambda x: ~is_number(x))), "bbox_invalid_number")
        )
        xs, ys = (F.when(p.nested & ~wide, F.transform(p.points, at)) for at in (lambda q: value(q[0]), lambda q: value(q[1])))
        return let(F.struct(error.alias("error"), p.nested.alias("nested"), p.flat.alias("flat"), xs.alias("xs"), ys.alias("ys")), framed)

    def framed(m):
        ok = m.error.isNull()
        side = lambda flat, polygon: F.when(ok, F.when(m.nested, polygon).otherwise(flat))
        four = (side(m.flat[0], F.array_min(m.xs)), side(m.flat[1], F.array_min(m.ys)), side(m.flat[2], F.array_max(m.xs)), side(m.flat[3], F.array_max(m.ys)))
        return let(F.struct(F.when(ok, F.when(m.nested, "polygon").otherwise("ltrb")).alias("shape"), *(c.alias(n) for c, n in zip(four, ("x0", "y0", "x1", "y1"))), m.error.alias("error")), whole)

    def whole(r):
        return F.struct(
            r["shape"].alias("shape"), r.x0.alias("x_min"), r.y0.alias("y_min"), r.x1.alias("x_max"), r.y1.alias("y_max"),
            ((r.x0 + r.x1) / 2).alias("center_x"), ((r.y0 + r.y1) / 2).alias("center_y"), (r.x1 - r.x0).alias("width"), (r.y1 - r.y0).alias("height"), r.error.alias("error"),
        )

    return let(F.struct(bbox.alias("t"), F.try_parse_json(bbox).alias("v")), parsed)


def effective_height(g: Column) -> Column:
    return F.greatest(F.lit(1.0), g.height)


def _axis(a0, a1, b0, b1) -> Column:
    overlap = F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))
    smaller = F.least(a1 - a0, b1 - b0)
    return F.when(smaller > 0, overlap / F.nullif(smaller, F.lit(0.0))).when((a0 == b0) & (a1 == b1), 1.0).otherwise(0.0)


def _alike(a: Column, b: Column) -> Column:
    top = F.greatest(a, b)
    return F.when((a == 0) & (b == 0), 1.0).when(top <= 0, 0.0).otherwise(F.least(a, b) / F.nullif(top, F.lit(0.0)))


def pair_scores(a: Column, b: Column, median_height: Column) -> Column:
    """How alike two boxes lie: iou, overlaps by axis, distances of centres, likeness of sizes."""
    w = F.greatest(F.lit(0.0), F.least(a.x_max, b.x_max) - F.greatest(a.x_min, b.x_min))
    h = F.greatest(F.lit(0.0), F.least(a.y_max, b.y_max) - F.greatest(a.y_min, b.y_min))
    union = a.width * a.height + b.width * b.height - w * h
    far = F.hypot(a.center_x - b.center_x, a.center_y - b.center_y)
    unit = F.least(*(F.sqrt(F.greatest(F.lit(1.0), g.width) * effective_height(g)) for g in (a, b)))
    ws, hs = _alike(a.width, b.width), _alike(a.height, b.height)
    return F.struct(
        F.when(union > 0, w * h / F.nullif(union, F.lit(0.0))).otherwise(0.0).alias("iou"),
        _axis(a.x_min, a.x_max, b.x_min, b.x_max).alias("horizontal_overlap_ratio"),
        _axis(a.y_min, a.y_max, b.y_min, b.y_max).alias("vertical_overlap_ratio"),
        (far / F.greatest(F.lit(1.0), median_height)).alias("center_distance_ratio"),
        (far / F.greatest(F.lit(1.0), unit)).alias("center_distance_size_ratio"),
        ws.alias("width_similarity"), hs.alias("height_similarity"), F.least(ws, hs).alias("size_similarity"),
    )


def pair_decision(a: Column, b: Column, s: Column, c: dict) -> Column:
    """confirmed, gray or retained for two boxes with equal text and scores `s`."""
    flat = (a.width * a.height <= 0) | (b.width * b.height <= 0)
    same = (a.x_min == b.x_min) & (a.y_min == b.y_min) & (a.x_max == b.x_max) & (a.y_max == b.y_max)
    first = (s.iou >= c["duplicate_confirm_iou"]) & (s.size_similarity >= c["duplicate_confirm_size_similarity"])
    second = (s.iou >= c["duplicate_secondary_iou"]) & (s.center_distance_ratio <= c["duplicate_confirm_center_ratio"]) & (s.size_similarity >= c["duplicate_secondary_size_similarity"])
    gray = (s.iou >= c["duplicate_gray_iou"]) | ((s.center_distance_ratio <= c["duplicate_gray_center_ratio"]) & (s.size_similarity >= c["duplicate_gray_size_similarity"]))
    return F.when(flat & same | ~flat & (first | second), "confirmed").when(gray, "gray").otherwise("retained")


def line_tolerance(median_height: Column, c: dict) -> Column:
    return F.least(F.lit(c["line_tolerance_max_px"]), F.greatest(F.lit(c["line_tolerance_min_px"]), median_height * c["line_tolerance_height_ratio"]))


def region(x0: Column, y0: Column, x1: Column, y1: Column, least: int = 1) -> Column:
    """The rectangle of two corners (left, top, width, height), null if a side is under `least`."""
    w, h = F.abs(x1 - x0), F.abs(y1 - y0)
    return F.when((w >= least) & (h >= least), F.struct(F.least(x0, x1).alias("left"), F.least(y0, y1).alias("top"), w.alias("width"), h.alias("height")))


def usable_confidence(c: Column) -> Column:
    return F.when(c.between(0.0, 1.0) & ~F.isnan(c), c)
