"""Geometry over columns: affine transforms as structs, curves as arrays of strokes, boxes."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import STROKE

PLAUSIBLE = 1e7
CIRCLE_STROKES, ELLIPSE_STROKES, MAX_ARC_STROKES, ARC_STEP = 72, 96, 720, math.pi / 60
RAY_LENGTH = 1e6


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def affine(a, b, c, d, tx, ty) -> Column:
    """x' = a x + b y + tx, y' = c x + d y + ty."""
    return F.struct(*[(v if isinstance(v, Column) else F.lit(float(v))).cast("double").alias(n) for n, v in zip(("a", "b", "c", "d", "tx", "ty"), (a, b, c, d, tx, ty))])


IDENTITY = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def insert_affine(x: Column, y: Column, sx: Column, sy: Column, rotation: Column) -> Column:
    """Scale, then rotate, then move; a block's base point is not subtracted."""
    c, s = F.cos(rotation), F.sin(rotation)
    return affine(sx * c, -(sy * s), sx * s, sy * c, x, y)


def compose(t: Column, u: Column) -> Column:
    """First u, then t."""
    return affine(
        t["a"] * u["a"] + t["b"] * u["c"], t["a"] * u["b"] + t["b"] * u["d"],
        t["c"] * u["a"] + t["d"] * u["c"], t["c"] * u["b"] + t["d"] * u["d"],
        t["a"] * u["tx"] + t["b"] * u["ty"] + t["tx"], t["c"] * u["tx"] + t["d"] * u["ty"] + t["ty"],
    )


def apply_x(t: Column, x: Column, y: Column) -> Column:
    return t["a"] * x + t["b"] * y + t["tx"]


def apply_y(t: Column, x: Column, y: Column) -> Column:
    return t["c"] * x + t["d"] * y + t["ty"]


def apply_point(t: Column, p: Column) -> Column:
    return point(apply_x(t, p["x"], p["y"]), apply_y(t, p["x"], p["y"]))


def stroke(x1, y1, x2, y2) -> Column:
    return F.struct(*[v.cast("double").alias(n) for n, v in (("x1", x1), ("y1", y1), ("x2", x2), ("y2", y2))])


def apply_strokes(t: Column, strokes: Column) -> Column:
    return F.transform(strokes, lambda s: stroke(apply_x(t, s["x1"], s["y1"]), apply_y(t, s["x1"], s["y1"]), apply_x(t, s["x2"], s["y2"]), apply_y(t, s["x2"], s["y2"])))


def no_strokes() -> Column:
    return F.array().cast(f"array<{STROKE}>")


def path_strokes(points: Column, closed: Column | None = None) -> Column:
    """Neighbouring points joined; closed: the last to the first as well."""
    n = F.size(points)
    open_path = F.zip_with(F.slice(points, 1, F.greatest(n - 1, F.lit(0))), F.slice(points, 2, F.greatest(n - 1, F.lit(0))), lambda p, q: stroke(p["x"], p["y"], q["x"], q["y"]))
    if closed is not None:
        last, first = F.element_at(points, -1), F.element_at(points, 1)
        open_path = F.when(closed & (n >= 2), F.concat(open_path, F.array(stroke(last["x"], last["y"], first["x"], first["y"])))).otherwise(open_path)
    return F.when(n >= 2, open_path).otherwise(no_strokes())


def _arc(cx: Column, cy: Column, rx: Column, ry: Column, start: Column, span: Column, n: Column) -> Column:
    def at(i: Column) -> tuple[Column, Column]:
        angle = start + span * i / n
        return cx + rx * F.cos(angle), cy + ry * F.sin(angle)

    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: stroke(*at(i), *at(i + 1)))


def circle_strokes(cx: Column, cy: Column, r: Column) -> Column:
    return _arc(cx, cy, r, r, F.lit(0.0), F.lit(2 * math.pi), F.lit(CIRCLE_STROKES))


def arc_strokes(cx: Column, cy: Column, r: Column, a0: Column, a1: Column) -> Column:
    """Counter-clockwise from a0 to a1 in steps of about three degrees; values that aren't finite give none."""
    finite = ~F.isnan(a0 + a1 + r) & (F.abs(a0 + a1 + r) < 1e300)
    span = F.pmod(a1 - a0, F.lit(2 * math.pi))
    n = F.least(F.floor(span / ARC_STEP).cast("int") + 1, F.lit(MAX_ARC_STROKES))
    return F.when(finite, _arc(cx, cy, r, r, a0, span, n)).otherwise(no_strokes())


def ellipse_strokes(cx: Column, cy: Column, mx: Column, my: Column, ratio: Column, a0: Column, a1: Column) -> Column:
    """Major axis vector (mx, my), minor axis by ratio; parameters a0 to a1, the whole ellipse if they are equal."""
    span = F.pmod(a1 - a0, F.lit(2 * math.pi))
    span = F.when(span < 1e-9, F.lit(2 * math.pi)).otherwise(span)

    def at(i: Column) -> tuple[Column, Column]:
        u = a0 + span * i / ELLIPSE_STROKES
        return cx + mx * F.cos(u) - my * ratio * F.sin(u), cy + my * F.cos(u) + mx * ratio * F.sin(u)

    return F.transform(F.sequence(F.lit(0), F.lit(ELLIPSE_STROKES - 1)), lambda i: stroke(*at(i), *at(i + 1)))


def bulge_strokes(points: Column, bulges: Column, closed: Column) -> Column:
    """A polyline whose segments are arcs where a bulge (the tangent of a quarter of the signed sweep) isn't zero."""
    n = F.size(points)
    count = F.when(closed, n).otherwise(n - 1)

    def segment(i: Column) -> Column:
        p, q = F.get(points, i), F.get(points, F.when(i + 1 < n, i + 1).otherwise(0))
        b = F.coalesce(F.get(bulges, i), F.lit(0.0))
        sweep = 4 * F.atan(b)
        dx, dy = q["x"] - p["x"], q["y"] - p["y"]
        k = F.when(F.abs(b) > 1e-12, (1 - b * b) / (4 * b)).otherwise(0.0)
        cx, cy = (p["x"] + q["x"]) / 2 - dy * k, (p["y"] + q["y"]) / 2 + dx * k
        r, start = F.hypot(p["x"] - cx, p["y"] - cy), F.atan2(p["y"] - cy, p["x"] - cx)
        steps = F.least(F.floor(F.abs(sweep) / ARC_STEP).cast("int") + 1, F.lit(MAX_ARC_STROKES))
        return F.when(F.abs(b) > 1e-9, _arc(cx, cy, r, r, start, sweep, steps)).otherwise(F.array(stroke(p["x"], p["y"], q["x"], q["y"])))

    return F.when(n >= 2, F.flatten(F.transform(F.sequence(F.lit(0), count - 1), segment))).otherwise(no_strokes())


def plausible(x: Column, y: Column) -> Column:
    return F.coalesce(~F.isnan(x) & ~F.isnan(y) & (F.abs(x) < PLAUSIBLE) & (F.abs(y) < PLAUSIBLE), F.lit(False))


def finite(v: Column) -> Column:
    return F.coalesce(~F.isnan(v) & (v > -1e308) & (v < 1e308), F.lit(False))


def degrees(radians: Column) -> Column:
    """Degrees in [0, 360); 0 for what isn't a number."""
    d = F.pmod(F.degrees(radians), F.lit(360.0))
    return F.when(finite(radians), F.when(d >= 360.0, 0.0).otherwise(d)).otherwise(0.0)


def closed_by_geometry(points: Column) -> Column:
    p, q = F.element_at(points, 1), F.element_at(points, -1)
    return (F.size(points) > 1) & (F.abs(p["x"] - q["x"]) + F.abs(p["y"] - q["y"]) < 1e-9)


def contains(box_min_x: Column, box_min_y: Column, box_max_x: Column, box_max_y: Column, x: Column, y: Column) -> Column:
    return x.between(box_min_x, box_max_x) & y.between(box_min_y, box_max_y)


def overlap_area(a: dict[str, Column], b: dict[str, Column]) -> Column:
    w = F.least(a["max_x"], b["max_x"]) - F.greatest(a["min_x"], b["min_x"])
    h = F.least(a["max_y"], b["max_y"]) - F.greatest(a["min_y"], b["min_y"])
    return F.when((w > 0) & (h > 0), w * h).otherwise(0.0)


def gap(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """The distance of two boxes; 0 where they meet."""
    gx = F.greatest(a["min_x"] - b["max_x"], b["min_x"] - a["max_x"], F.lit(0.0))
    gy = F.greatest(a["min_y"] - b["max_y"], b["min_y"] - a["max_y"], F.lit(0.0))
    return F.hypot(gx, gy)


def text_width(n_chars: Column, height: Column) -> Column:
    return F.least(F.greatest(n_chars, F.lit(1)) * height * 0.8, height * 80)


def text_anchor(h_align: Column, attachment: Column) -> Column:
    """start, middle or end, of the alignment or, if set, the attachment column."""
    by_column = F.element_at(F.array(F.lit("start"), F.lit("middle"), F.lit("end")), (F.pmod(attachment - 1, F.lit(3)) + 1).cast("int"))
    return F.when(attachment.between(1, 9), by_column).when(h_align.isin(1, 4), "middle").when(h_align == 2, "end").otherwise("start")


def hookline_on(annotation_type: Column, path_type: Column, points: Column) -> Column:
    """Whether a leader has a hook line: no annotation, straight path, and a last leg more than 15 degrees off the horizontal."""
    p, q = F.element_at(points, -2), F.element_at(points, -1)
    angle = F.when(F.size(points) > 2, F.atan2(p["y"] - q["y"], p["x"] - q["x"])).otherwise(F.lit(math.pi / 2))
    flat = (F.abs(angle) <= math.pi / 12) | (F.abs(angle - math.pi) <= math.pi / 12)
    return (annotation_type.bitwiseAND(3) == 0) & (path_type.bitwiseAND(1) == 0) & ~flat
