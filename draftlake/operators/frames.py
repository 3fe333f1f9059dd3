"""Sheet detection: blocks that look like sheet frames, placed where content lies, then what is left.

A frame's block has few children, an outer rectangle and a paper-like ratio; long formats count only if their
instances form a grid; most instances must hold content. Boxes of a drawing's frames are thinned by overlap, named by
their corner's texts, and followed by sheets of residual content.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from . import sheets
from .bounds import clusters_1d
from .expand import MODEL, cut, primitives
from .tessellate import expanded, parts

#: Ratio window of the A formats with 5 % slack, of long formats, smallest side, children, contents.
MIN_RATIO, MAX_RATIO, MAX_LONG_RATIO = 1.29 * 0.95, 1.41 * 1.05, 3.2
MIN_SIDE, MAX_CHILDREN, MIN_DOTS, PASS_RATE = 500.0, 512, 8, 0.8
EDGE, EDGE_TOLERANCE, GRID_TOLERANCE = 0.8, 0.01, 0.02
WHOLE = "整图"


def _corners(prims: DataFrame) -> DataFrame:
    """One row a point that counts for bounds: stroke ends, and label corners along their baseline."""
    n = F.char_length("text")
    c, s = F.cos("rotation"), F.sin("rotation")
    w = g.text_width(n, F.col("height"))
    x, y = F.col("at.x"), F.col("at.y")
    label = F.array(g.point(x, y), g.point(x + w * c, y + w * s), g.point(x - F.col("height") * s, y + F.col("height") * c))
    strokes = F.flatten(F.transform("strokes", lambda k: F.array(g.point(k["x1"], k["y1"]), g.point(k["x2"], k["y2"]))))
    points = F.when(F.col("text").isNotNull() & F.col("at").isNotNull(), label).otherwise(strokes)
    return prims.select("*", F.explode(points).alias("p")).where(g.plausible(F.col("p.x"), F.col("p.y")))


def _box(df: DataFrame, *keys: str, x: Column, y: Column) -> DataFrame:
    return df.groupBy(*keys).agg(F.min(x).alias("min_x"), F.min(y).alias("min_y"), F.max(x).alias("max_x"), F.max(y).alias("max_y"))


def framed(local: DataFrame, boxes: DataFrame) -> DataFrame:
    """(doc_id, root): blocks with a long stroke on each side of their box, or a rectangle that covers most of it."""
    j = local.join(boxes, ["doc_id", "root"])
    w, h = F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y")
    tol = F.greatest(w, h) * EDGE_TOLERANCE

    def side(axis: str, edge: str):
        other = "y" if axis == "x" else "x"
        size = w if axis == "x" else h
        return F.exists("strokes", lambda s: (F.abs(s[f"{other}2"] - s[f"{other}1"]) <= tol) & (F.abs(s[f"{axis}2"] - s[f"{axis}1"]) >= size * EDGE) & (F.abs(s[f"{other}1"] - F.col(edge)) <= tol))

    xs = F.flatten(F.transform("strokes", lambda s: F.array(s["x1"], s["x2"])))
    ys = F.flatten(F.transform("strokes", lambda s: F.array(s["y1"], s["y2"])))
    on_edges = F.forall(xs, lambda v: (v == F.array_min(xs)) | (v == F.array_max(xs))) & F.forall(ys, lambda v: (v == F.array_min(ys)) | (v == F.array_max(ys)))
    area = (F.array_max(xs) - F.array_min(xs)) * (F.array_max(ys) - F.array_min(ys))
    rectangle = (F.col("type_name") == "LWPOLYLINE") & F.col("n_points").between(4, 5) & on_edges & (area >= w * h * EDGE)
    sides = [F.max(side(a, e)) for a, e in (("x", "min_y"), ("x", "max_y"), ("y", "min_x"), ("y", "max_x"))]
    ok = j.groupBy("doc_id", "root").agg((sides[0] & sides[1] & sides[2] & sides[3]).alias("sides"), F.max(rectangle).alias("rectangle"))
    return ok.where("sides OR coalesce(rectangle, false)").select("doc_id", "root")


def _grid_aligned(instances: DataFrame) -> DataFrame:
    """(doc_id, block): two or more instances of one size in a column, a row or a spaced grid."""
    first = Window.partitionBy("doc_id", "block").orderBy("seq")
    w, h = F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y")
    x = instances.withColumns({"w": w, "h": h}).withColumns({c + "0": F.first(c).over(first) for c in ("w", "h", "min_x", "min_y")})
    near = lambda a, b, size: F.min(F.abs(F.col(a) - F.col(b)) <= F.col(size) * GRID_TOLERANCE)
    agg = x.groupBy("doc_id", "block").agg(F.count("*").alias("n"), F.first("w0").alias("w0"), F.first("h0").alias("h0"), (near("w", "w0", "w0") & near("h", "h0", "h0")).alias("sized"), (near("min_x", "min_x0", "w0") | near("min_y", "min_y0", "h0")).alias("lined"))
    key = F.concat_ws("#", "doc_id", "block").alias("doc_id")

    def centres(a: str, b: str, size: str) -> DataFrame:
        c = clusters_1d(x.select(key, ((F.col(a) + F.col(b)) / 2).alias("v")), GRID_TOLERANCE)
        step = F.col("mean") - F.lag("mean").over(Window.partitionBy("doc_id").orderBy("mean"))
        return c.withColumn("step", step).groupBy("doc_id").agg(F.count("*").alias(f"n_{size}"), F.min("step").alias(f"step_{size}"))

    grid = agg.withColumn("k", F.concat_ws("#", "doc_id", "block"))
    for a, b, size in (("min_x", "max_x", "w"), ("min_y", "max_y", "h")):
        grid = grid.join(centres(a, b, size).withColumnRenamed("doc_id", "k"), "k")
    spaced = F.coalesce((F.col("step_w") >= F.col("w0") * 0.5), F.lit(True)) & F.coalesce((F.col("step_h") >= F.col("h0") * 0.5), F.lit(True))
    return grid.where((F.col("n") >= 2) & F.col("sized") & (F.col("lined") | ((F.col("n_w") * F.col("n_h") >= F.col("n")) & spaced))).select("doc_id", "block")


def content_dots(entities: DataFrame) -> DataFrame:
    """(doc_id, handle, x, y, is_text): points that stand for model space's own entities."""
    kinds = ("LINE", "LWPOLYLINE", "TEXT", "MTEXT", "ATTRIB", "CIRCLE", "ARC", "POINT")
    e = entities.where(F.col("space") == "model").where(F.col("type_name").isin(*kinds))
    p = e.select("doc_id", "handle", F.posexplode("points").alias("n", "p"), F.col("type_name").isin("TEXT", "MTEXT", "ATTRIB").alias("is_text"))
    p = p.select("doc_id", F.xxhash64("handle", "n").alias("handle"), "p.x", "p.y", "is_text")
    return p.where(g.plausible(F.col("x"), F.col("y")))


def candidates(entities: DataFrame) -> DataFrame:
    """(doc_id, block, seq, box): instances of blocks that are sheet frames."""
    leaves, inserts = parts(entities)
    children = entities.where("space = 'block'").groupBy("doc_id", F.col("owner").alias("root")).agg(F.count("*").alias("n")).where(F.col("n") <= MAX_CHILDREN)
    direct = inserts.where(F.col("owner") == MODEL).drop("owner")
    roots = direct.select("doc_id", F.col("block").alias("root")).distinct().join(children.select("doc_id", "root"), ["doc_id", "root"])
    local = cut(primitives(leaves, inserts, roots=roots))
    corners = _corners(local)
    boxes = _box(corners, "doc_id", "root", x=F.col("p.x"), y=F.col("p.y"))
    t = F.col("it")
    placed = direct.withColumnRenamed("t", "it").join(boxes.withColumnRenamed("root", "block"), ["doc_id", "block"])
    w = (F.col("max_x") - F.col("min_x")) * F.hypot(t["a"], t["c"])
    h = (F.col("max_y") - F.col("min_y")) * F.hypot(t["b"], t["d"])
    placed = placed.withColumns({"w": w, "h": h}).where((F.least("w", "h") >= MIN_SIDE) & (F.greatest("w", "h") / F.least("w", "h")).between(MIN_RATIO, MAX_LONG_RATIO))
    placed = placed.join(framed(local, boxes).withColumnRenamed("root", "block"), ["doc_id", "block"])
    first = F.min_by(F.greatest("w", "h") / F.least("w", "h"), "seq").over(Window.partitionBy("doc_id", "block"))
    placed = placed.withColumn("first_ratio", first).drop("min_x", "min_y", "max_x", "max_y")
    at = corners.select("doc_id", F.col("root").alias("block"), "p").join(placed, ["doc_id", "block"])
    world = _box(at, "doc_id", "block", "seq", "handle", "first_ratio", x=g.apply_x(t, F.col("p.x"), F.col("p.y")), y=g.apply_y(t, F.col("p.x"), F.col("p.y")))
    aligned = _grid_aligned(world).withColumn("aligned", F.lit(True))
    world = world.join(aligned, ["doc_id", "block"], "left").where((F.col("first_ratio") <= MAX_RATIO) | F.col("aligned"))
    numbered = cut(world).withColumn("sheet_index", F.row_number().over(Window.partitionBy("doc_id").orderBy("seq", "handle")))
    held = numbered.join(sheets.dots_per_sheet(content_dots(entities), numbered), ["doc_id", "sheet_index"]).withColumn("ok", F.col("n") >= MIN_DOTS)
    rate = F.avg(F.col("ok").cast("double")).over(Window.partitionBy("doc_id", "block"))
    return held.withColumn("rate", rate).where((F.col("rate") >= PASS_RATE) & F.col("ok")).select("doc_id", "block", "seq", "min_x", "min_y", "max_x", "max_y")


def detect(entities: DataFrame, layers: DataFrame) -> DataFrame:
    """(doc_id, sheet_index, name, box): frames by falling area, then residual content; without frames one whole sheet."""
    numbered = Window.partitionBy("doc_id").orderBy("seq", "block")
    found = candidates(entities).withColumn("sheet_index", F.row_number().over(numbered)).withColumn("name", F.lit(""))
    names = ["doc_id", "sheet_index", "name", "min_x", "min_y", "max_x", "max_y"]
    kept = cut(sheets.without_overlaps(found.select(names)))
    area = (F.col("max_x") - F.col("min_x")) * (F.col("max_y") - F.col("min_y"))
    frames = kept.withColumn("sheet_index", F.row_number().over(Window.partitionBy("doc_id").orderBy(area.desc(), "sheet_index")))
    from .tessellate import sheet_texts

    texts = cut(sheet_texts(expanded(entities), layers, frames))
    titled = frames.drop("name").join(sheets.titles(frames, texts), ["doc_id", "sheet_index"]).withColumnRenamed("title", "name").select(names)
    dots = content_dots(entities).join(frames.select("doc_id").distinct(), "doc_id", "left_semi")
    count = frames.groupBy("doc_id").agg(F.max("sheet_index").alias("k"))
    rest = sheets.residual_sheets(dots, frames, texts).join(count, "doc_id").withColumn("sheet_index", F.col("sheet_index") + F.col("k")).select(names)
    whole = _box(content_dots(entities), "doc_id", x=F.col("x"), y=F.col("y")).join(count, "doc_id", "left_anti")
    whole = whole.select("doc_id", F.lit(1).alias("sheet_index"), F.lit(WHOLE).alias("name"), "min_x", "min_y", "max_x", "max_y")
    return titled.unionByName(rest).unionByName(whole)
