"""Sheets: assignment of points, overlaps, titles, residual content, and detection.

Boxes of a drawing are few, points many: points are joined to boxes on the drawing and the cells of a grid that a box
covers, so the join stays an equi-join whatever the number of either.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import contains, gap, overlap_area
from ..functions.text import is_cjk_name, is_readable, is_sheet_number
from . import bounds
from .expand import cut

#: Boxes are filed under at most so many cells a side of their drawing's extent.
CELLS = 32
MAX_OVERLAP = 0.3
MIN_PIXELS = 8.0
MIN_WIDTH, MAX_WIDTH = 4096, 16384
#: Residual content. Quantile that is clipped, coarse and fine grid, points of a cell and of a component,
#: gap that is closed, share of texts, density, sheets, margin.
CLIP, COARSE, FINE, CELL, MIN_CELL, MIN_DOTS, MERGE_GAP, MIN_TEXT, MIN_DENSITY, MOST, MARGIN = 0.005, 64, 512, 10_000.0, 5, 50, 0.3, 0.3, 100 / 1e10, 16, 0.05
#: Auto-rerendering: least share of readable texts, greatest width and pixels.
MIN_PASS, HARD_WIDTH, MAX_PIXELS = 0.6, 32_768, 4e8
TITLE_WIDTH, TITLE_HEIGHT = 1 / 4, 1 / 6


def _hits(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """points with the boxes that contain them, by grid cell."""
    extent = boxes.groupBy("doc_id").agg(F.min("min_x").alias("__x"), F.min("min_y").alias("__y"), F.greatest(F.max("max_x") - F.min("min_x"), F.lit(1e-9)).alias("__w"), F.greatest(F.max("max_y") - F.min("min_y"), F.lit(1e-9)).alias("__h"))

    def cell(v, lo, size):
        return F.least(F.greatest(F.floor((v - F.col(lo)) / F.col(size) * CELLS), F.lit(0)), F.lit(CELLS - 1))

    b = boxes.join(extent, "doc_id")
    b = b.withColumn("__i", F.explode(F.sequence(cell(F.col("min_x"), "__x", "__w"), cell(F.col("max_x"), "__x", "__w")))).withColumn("__j", F.explode(F.sequence(cell(F.col("min_y"), "__y", "__h"), cell(F.col("max_y"), "__y", "__h"))))
    p = points.join(extent, "doc_id").withColumns({"__i": cell(F.col("x"), "__x", "__w"), "__j": cell(F.col("y"), "__y", "__h")}).drop("__x", "__y", "__w", "__h")
    b = b.select("doc_id", "__i", "__j", "sheet_index", "min_x", "min_y", "max_x", "max_y")
    return p.join(b, ["doc_id", "__i", "__j"]).where(contains(F.col("min_x"), F.col("min_y"), F.col("max_x"), F.col("max_y"), F.col("x"), F.col("y")))


def assign(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """points (doc_id, handle, x, y, …) with sheet: the smallest index of a closed box around them, else 0."""
    first = _hits(points.select("doc_id", "handle", "x", "y"), boxes).groupBy("doc_id", "handle").agg(F.min("sheet_index").alias("__s"))
    return points.join(first, ["doc_id", "handle"], "left").withColumn("sheet", F.coalesce("__s", F.lit(0))).drop("__s")


def dots_per_sheet(points: DataFrame, boxes: DataFrame) -> DataFrame:
    n = _hits(points.select("doc_id", "x", "y"), boxes).groupBy("doc_id", "sheet_index").agg(F.count("*").alias("n"))
    return boxes.select("doc_id", "sheet_index").join(n, ["doc_id", "sheet_index"], "left").select("doc_id", "sheet_index", F.coalesce("n", F.lit(0)).alias("n"))


def residual(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """The points in no box."""
    return assign(points, boxes).where("sheet = 0").drop("sheet")


def _pairs(boxes: DataFrame) -> tuple[DataFrame, dict, dict]:
    names = ("min_x", "min_y", "max_x", "max_y")
    a = boxes.select("doc_id", F.col("sheet_index").alias("a"), *[F.col(c).alias(f"a_{c}") for c in names])
    b = boxes.select("doc_id", F.col("sheet_index").alias("b"), *[F.col(c).alias(f"b_{c}") for c in names])
    j = a.join(b, "doc_id").where("a < b")
    return j, *({c: F.col(f"{k}_{c}") for c in names} for k in "ab")


def overlaps(boxes: DataFrame) -> DataFrame:
    j, a, b = _pairs(boxes)
    return j.withColumn("area", overlap_area(a, b)).where("area > 0")


def gaps(boxes: DataFrame) -> DataFrame:
    j, a, b = _pairs(boxes)
    return j.withColumn("gap", gap(a, b))


def pass_rate(texts: DataFrame, scale: float) -> DataFrame:
    """Share of texts that are at least eight pixels high."""
    return texts.groupBy("doc_id").agg(F.avg(F.when(F.col("height") * scale >= MIN_PIXELS, 1.0).otherwise(0.0)).alias("pass_rate"))


def width(texts: DataFrame, world_width: float) -> DataFrame:
    """Pixel width at which the text height at place n div 4 of the sorted ones is eight pixels, within limits."""
    w = Window.partitionBy("doc_id")
    ranked = texts.select("doc_id", "height", F.row_number().over(w.orderBy("height")).alias("r"), F.count("*").over(w).alias("n"))
    h = ranked.where(F.col("r") - 1 == F.floor(F.col("n") / 4)).select("doc_id", "height")
    return h.select("doc_id", F.least(F.greatest(F.floor(world_width * MIN_PIXELS / F.col("height") + 0.5), F.lit(MIN_WIDTH)), F.lit(MAX_WIDTH)).cast("int").alias("width"))


_BOX = "doc_id string, sheet_index int, name string, min_x double, min_y double, max_x double, max_y double"


def without_overlaps(boxes: DataFrame) -> DataFrame:
    """Boxes by falling area, without those that overlap a kept one by more than 0.3 of the smaller area.

    Keeping depends on what was kept before, so a drawing's boxes (at most hundreds) are handled together.
    """

    def run(b: pd.DataFrame) -> pd.DataFrame:
        b = b.assign(area=(b.max_x - b.min_x) * (b.max_y - b.min_y)).sort_values(["area", "sheet_index"], ascending=[False, True], kind="stable")
        kept: list = []
        for r in b.itertuples():
            def over(k) -> float:
                w, h = min(r.max_x, k.max_x) - max(r.min_x, k.min_x), min(r.max_y, k.max_y) - max(r.min_y, k.min_y)
                return w * h if w > 0 and h > 0 else 0.0

            if all(over(k) <= MAX_OVERLAP * min(r.area, k.area) for k in kept):
                kept.append(r)
        return b.loc[[k.Index for k in kept], ["doc_id", "sheet_index", "name", "min_x", "min_y", "max_x", "max_y"]]

    return boxes.groupBy("doc_id").applyInPandas(run, _BOX)


def grid_components(cells: DataFrame) -> DataFrame:
    """(doc_id, i, j, n, component): filled cells (a bounded grid) joined to their eight neighbours, numbered row by row."""

    def run(c: pd.DataFrame) -> pd.DataFrame:
        c = c.sort_values(["j", "i"]).reset_index(drop=True)
        at = {(i, j): k for k, (i, j) in enumerate(zip(c.i, c.j))}
        label, n = [-1] * len(c), 0
        for k in range(len(c)):
            if label[k] < 0:
                stack = [k]
                label[k] = n
                while stack:
                    i, j = c.i[q := stack.pop()], c.j[q]
                    for di in (-1, 0, 1):
                        for dj in (-1, 0, 1):
                            o = at.get((i + di, j + dj), -1)
                            if o >= 0 and label[o] < 0:
                                label[o] = n
                                stack.append(o)
                n += 1
        return c.assign(component=label)[["doc_id", "i", "j", "n", "component"]]

    return cells.groupBy("doc_id").applyInPandas(run, "doc_id string, i long, j long, n long, component int")


def _gridded(points: DataFrame, by: list[str], most: int, cell: float | None) -> DataFrame:
    """points with i, j: cells of the given size, or as wide as ``most`` of them cut the group's box, and at most as many."""
    box = points.groupBy(*by).agg(F.min("x").alias("__x"), F.min("y").alias("__y"), F.max("x").alias("__u"), F.max("y").alias("__v"))

    def index(v: str, lo: str, hi: str) -> Column:
        span = F.col(hi) - F.col(lo)
        size = F.lit(cell) if cell else F.when(span > 0, span / most).otherwise(F.lit(1.0))
        count = F.least(F.floor(span / cell) + 1, F.lit(most)) if cell else F.lit(most)
        return F.least(F.floor((F.col(v) - F.col(lo)) / size), count - 1).cast("long")

    return points.join(box, by).withColumns({"i": index("x", "__x", "__u"), "j": index("y", "__y", "__v")}).drop("__x", "__y", "__u", "__v")


def _bridged(cells: DataFrame, by: list[str]) -> DataFrame:
    """cells (by, i, j) with component, numbered row by row: neighbours are the eight around a cell and, straight on or
    one aside, cells two away behind an empty one. A group has at most FINE * FINE cells."""
    steps = [(a, b) for a in range(-2, 3) for b in range(-2, 3) if (a or b) and not (abs(a) > 1 and abs(b) > 1)]

    def run(c: pd.DataFrame) -> pd.DataFrame:
        c = c.sort_values(["j", "i"]).reset_index(drop=True)
        at = {cell: k for k, cell in enumerate(zip(c.i.tolist(), c.j.tolist()))}
        label, n = [-1] * len(c), 0
        for first, k in at.items():
            if label[k] < 0:
                label[k], todo = n, [first]
                for x, y in todo:
                    for a, b in steps:
                        q = at.get((x + a, y + b), -1)
                        far = abs(a) > 1 or abs(b) > 1
                        if q >= 0 and label[q] < 0 and not (far and (x + int(a / 2), y + int(b / 2)) in at):
                            label[q] = n
                            todo.append((x + a, y + b))
                n += 1
        return c.assign(component=label)[[*by, "i", "j", "component"]]

    types = dict(cells.dtypes)
    return cells.groupBy(*by).applyInPandas(run, ", ".join(f"{c} {types[c]}" for c in [*by, "i", "j"]) + ", component int")


def _clusters(points: DataFrame, by: list[str], most: int, cell: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Points of dense cells with their component, and the components' boxes, those with enough points."""
    keyed = cut(_gridded(points, by, most, cell))
    dense = keyed.groupBy(*by, "i", "j").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_CELL)
    inside = keyed.join(_bridged(dense.select(*by, "i", "j"), by), [*by, "i", "j"]).drop("i", "j")
    boxes = cut(inside.groupBy(*by, "component").agg(*[f(c).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in "xy"], F.count("*").alias("dots"), F.sum(F.col("is_text").cast("long")).alias("texts")).where(F.col("dots") >= MIN_DOTS))
    return inside.join(boxes.select(*by, "component"), [*by, "component"], "left_semi"), boxes


_SIDES = ("min_x", "min_y", "max_x", "max_y")


def merged(boxes: DataFrame, by: list[str], part: float = MERGE_GAP) -> DataFrame:
    """boxes (by, component, sides, dots, texts) united where the gap is below ``part`` of the smaller box's smaller side,
    also by way of others. A union bears the place of its first member by falling dots."""

    def run(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["dots", "component"], ascending=[False, True]).reset_index(drop=True)
        side = [min(r.max_x - r.min_x, r.max_y - r.min_y) for r in b.itertuples()]
        root = list(range(len(b)))
        rows = list(b.itertuples())
        for i, p in enumerate(rows):
            for j in range(i + 1, len(rows)):
                q = rows[j]
                gap_x, gap_y = max(p.min_x - q.max_x, q.min_x - p.max_x, 0.0), max(p.min_y - q.max_y, q.min_y - p.max_y, 0.0)
                if math.hypot(gap_x, gap_y) < part * min(side[i], side[j]) and root[i] != root[j]:
                    low, high = sorted((root[i], root[j]))
                    root = [low if r == high else r for r in root]
        return b.assign(component=root)

    out = boxes.groupBy(*by).applyInPandas(run, boxes.schema)
    return out.groupBy(*by, "component").agg(*[(F.min if c.startswith("min") else F.max)(c).alias(c) for c in _SIDES], F.sum("dots").alias("dots"), F.sum("texts").alias("texts"))


def residual_sheets(points: DataFrame, frames: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """Sheets of what lies in no frame.

    The outermost points are clipped; components of a coarse grid that a fine one splits give their parts, close ones
    united, those with few texts as one block, others stay whole. Dense ones remain, of those the 16 with most points,
    without those that overlap a frame. points: doc_id, x, y, is_text and handle; texts (doc_id, handle, x, y, text,
    height) give the names.
    """
    left = cut(residual(points, frames).select("doc_id", "x", "y", "is_text"))
    count = left.groupBy("doc_id").agg(F.count("*").alias("__n"))
    edge = cut(bounds.quantiles(left, CLIP, 1 - CLIP).join(count, "doc_id"))
    inside = (F.col("__n") < 4) | (F.col("x").between(F.col("low_x"), F.col("high_x")) & F.col("y").between(F.col("low_y"), F.col("high_y")))
    clipped = bounds.beside(left, edge, ["doc_id"]).where(inside).select(left.columns)
    pts, coarse = _clusters(clipped, ["doc_id"], COARSE)
    _, fine = _clusters(pts.withColumnRenamed("component", "part"), ["doc_id", "part"], FINE, CELL)
    split = fine.groupBy("doc_id", "part").count().where(F.col("count") > 1).select("doc_id", "part")
    whole = coarse.withColumnRenamed("component", "part").join(split, ["doc_id", "part"], "left_anti").withColumn("component", F.lit(0))
    units = cut(merged(fine.join(split, ["doc_id", "part"], "left_semi"), ["doc_id", "part"]))
    wordy = F.col("texts") >= MIN_TEXT * F.col("dots")
    block = units.where(~wordy).groupBy("doc_id", "part").agg(*[(F.min if c.startswith("min") else F.max)(c).alias(c) for c in _SIDES], F.sum("dots").alias("dots"), F.sum("texts").alias("texts")).withColumn("component", F.lit(FINE * FINE))
    finals = whole.unionByName(units.where(wordy)).unionByName(block.where(F.col("dots") >= MIN_DOTS))
    finals = finals.join(coarse.select("doc_id", F.col("component").alias("part"), F.col("dots").alias("__of")), ["doc_id", "part"])
    area = (F.col("max_x") - F.col("min_x")) * (F.col("max_y") - F.col("min_y"))
    order = Window.partitionBy("doc_id").orderBy(F.desc("dots"), F.desc("__of"), "part", "component")
    top = finals.where((area > 0) & (F.col("dots") >= MIN_DENSITY * area)).withColumn("place", F.row_number().over(order)).where(F.col("place") <= MOST)
    f = frames.select(F.col("doc_id").alias("__doc"), *[F.col(c).alias(f"f_{c}") for c in _SIDES])
    over = overlap_area({c: F.col(c) for c in _SIDES}, {c: F.col(f"f_{c}") for c in _SIDES})
    free = top.join(f, (F.col("doc_id") == F.col("__doc")) & (over > MAX_OVERLAP * area), "left_anti")
    dx, dy = (F.col("max_x") - F.col("min_x")) * MARGIN, (F.col("max_y") - F.col("min_y")) * MARGIN
    numbered = free.withColumn("sheet_index", F.row_number().over(Window.partitionBy("doc_id").orderBy("place")))
    boxes = cut(numbered.select("doc_id", "sheet_index", (F.col("min_x") - dx).alias("min_x"), (F.col("min_y") - dy).alias("min_y"), (F.col("max_x") + dx).alias("max_x"), (F.col("max_y") + dy).alias("max_y")))
    names = residual_titles(boxes, texts) if texts is not None else boxes.select("doc_id", "sheet_index", F.lit(None).cast("string").alias("title"))
    named = boxes.join(names, ["doc_id", "sheet_index"], "left").withColumn("name", F.coalesce("title", F.concat(F.lit("补充区域 "), F.col("sheet_index"))))
    return named.select("doc_id", "sheet_index", "name", *_SIDES)


def residual_titles(boxes: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc_id, sheet_index, title): of the readable texts of at least nine tenths of the greatest height the one closest
    to the vertical middle line."""
    hit = _hits(texts.where(is_readable(F.col("text"))).select("doc_id", "handle", "x", "y", "text", "height"), boxes)
    of = ["doc_id", "sheet_index"]
    tall = bounds.beside(hit, hit.groupBy(*of).agg(F.max("height").alias("__top")), of).where(F.col("height") >= 0.9 * F.col("__top"))
    far = F.abs(F.col("x") - (F.col("min_x") + F.col("max_x")) / 2)
    return tall.groupBy(*of).agg(F.trim(F.min_by("text", F.struct(far.alias("far"), "handle"))).alias("title"))


def planned_widths(texts: DataFrame, boxes: DataFrame, widths: DataFrame) -> DataFrame:
    """(doc_id, sheet_index, width, pass_rate, rerenders): each sheet's width doubled while too few of its texts are
    readable and neither width nor pixels pass their limit; found without rendering, as the share follows from heights."""
    hit = _hits(texts.select("doc_id", "handle", "x", "y", "height"), boxes)
    sheet = boxes.join(widths, ["doc_id", "sheet_index"]).select("doc_id", "sheet_index", F.col("width").alias("w0"), (F.col("max_x") - F.col("min_x")).alias("__w"), (F.col("max_y") - F.col("min_y")).alias("__h"))
    steps = sheet.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn("width", F.col("w0") * F.pow(F.lit(2), "k").cast("int"))
    allowed = (F.col("k") == 0) | ((F.col("width") <= 2 * HARD_WIDTH - 1) & (F.col("w0") * F.pow(F.lit(2), F.col("k") - 1) < HARD_WIDTH) & (F.col("width") * F.floor(F.col("width") * F.col("__h") / F.col("__w")) <= MAX_PIXELS))
    rate = F.avg(F.when(F.col("height") * F.col("width") / F.col("__w") >= MIN_PIXELS, 1.0).otherwise(0.0))
    rated = steps.where(allowed).join(hit.select("doc_id", "sheet_index", "height"), ["doc_id", "sheet_index"]).groupBy("doc_id", "sheet_index", "k", "width").agg(rate.alias("pass_rate"))
    enough = F.min(F.when(F.col("pass_rate") >= MIN_PASS, F.col("k"))).over(Window.partitionBy("doc_id", "sheet_index"))
    last = F.max("k").over(Window.partitionBy("doc_id", "sheet_index"))
    return rated.withColumn("__k", F.coalesce(enough, last)).where("k = __k").select("doc_id", "sheet_index", "width", "pass_rate", F.col("k").alias("rerenders"))


def titles(boxes: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc_id, sheet_index, title): of the texts in the lower right corner a sheet number, else a CJK name, else the
    tallest readable text, each by height then distance to the corner's centre; else '图 n'."""
    w, h = F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y")
    corner = boxes.select("doc_id", "sheet_index", (F.col("max_x") - w * TITLE_WIDTH).alias("min_x"), "min_y", "max_x", (F.col("min_y") + h * TITLE_HEIGHT).alias("max_y"))
    hit = _hits(texts.where(is_readable(F.col("text"))), corner)
    rank = F.when(is_sheet_number(F.col("text")), 0).when(is_cjk_name(F.col("text")), 1).otherwise(2)
    far = F.hypot(F.col("x") - (F.col("min_x") + F.col("max_x")) / 2, F.col("y") - (F.col("min_y") + F.col("max_y")) / 2)
    best = Window.partitionBy("doc_id", "sheet_index").orderBy(rank, F.desc("height"), far, "handle")
    picked = hit.withColumn("__n", F.row_number().over(best)).where("__n = 1").select("doc_id", "sheet_index", F.trim("text").alias("title"))
    return boxes.select("doc_id", "sheet_index").join(picked, ["doc_id", "sheet_index"], "left").withColumn("title", F.coalesce("title", F.concat(F.lit("图 "), F.col("sheet_index"))))
