"""Entities to local-space strokes and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.curves import clip_frame, helix_strokes, spline_strokes
from ..functions.text import expand_percent, strip_mtext
from ..schema import P2
from .expand import primitives

TEXTS = ("TEXT", "MTEXT", "ATTRIB")
#: Columns that only some sources have; taken as null where they are missing.
OPTIONAL = {
    "axis": P2, "ratio": "double", "degree": "int", "knots": "array<double>", "control": f"array<{P2}>", "weights": "array<double>",
    "turns": "double", "end_radius": "double", "paths": f"array<struct<points:array<{P2}>,bulges:array<double>>>",
}


def complete(entities: DataFrame) -> DataFrame:
    return entities.withColumns({c: F.lit(None).cast(t) for c, t in OPTIONAL.items() if c not in entities.columns})


def local_strokes() -> Column:
    """Strokes of an entity row with type_name, points, radius, a0, a1, bulges, closed and the optional columns.

    Splines are left to ``parts``: their curve needs Arrow.
    """
    kind, pts, axis = F.col("type_name"), F.col("points"), F.col("axis")
    p = F.element_at(pts, 1)
    quad = F.array(*[F.get(pts, i) for i in range(4)])
    way = F.get(pts, 1)
    ray = g.stroke(p["x"], p["y"], p["x"] + way["x"] * g.RAY_LENGTH, p["y"] + way["y"] * g.RAY_LENGTH)
    back = g.stroke(p["x"], p["y"], p["x"] - way["x"] * g.RAY_LENGTH, p["y"] - way["y"] * g.RAY_LENGTH)
    r = F.lit(0.02)
    cross = F.array(g.stroke(p["x"] - r, p["y"], p["x"] + r, p["y"]), g.stroke(p["x"], p["y"] - r, p["x"], p["y"] + r))
    none = F.array().cast("array<double>")
    hatch = F.flatten(F.transform("paths", lambda h: g.bulge_strokes(h["points"], F.coalesce(h["bulges"], none), F.lit(True))))
    return (
        F.when(kind.isin("HATCH", "MPOLYGON"), F.coalesce(hatch, g.no_strokes()))
        .when(F.coalesce(F.size(pts), F.lit(0)) < 1, g.no_strokes())
        .when(kind == "CIRCLE", g.circle_strokes(p["x"], p["y"], F.col("radius")))
        .when(kind == "ARC", g.arc_strokes(p["x"], p["y"], F.col("radius"), F.col("a0"), F.col("a1")))
        .when(kind == "ELLIPSE", F.when(axis.isNotNull(), g.ellipse_strokes(p["x"], p["y"], axis["x"], axis["y"], F.coalesce("ratio", F.lit(1.0)), F.coalesce("a0", F.lit(0.0)), F.coalesce("a1", F.lit(0.0)))).otherwise(g.no_strokes()))
        .when(kind == "HELIX", helix_strokes(p["x"], p["y"], F.col("radius"), F.coalesce("end_radius", "radius"), F.col("turns")))
        .when(kind.isin("LWPOLYLINE", "POLYLINE_2D"), g.bulge_strokes(pts, F.coalesce("bulges", none), F.coalesce("closed", F.lit(False))))
        .when(kind.isin("SOLID", "TRACE", "3DFACE") & (F.size(pts) >= 4), g.path_strokes(quad, F.lit(True)))
        .when((kind == "RAY") & (F.size(pts) >= 2), F.array(ray))
        .when((kind == "XLINE") & (F.size(pts) >= 2), F.array(ray, back))
        .when(kind.endswith("UNDERLAY"), clip_frame(pts))
        .when(kind == "POINT", cross)
        .when(kind.isin(*TEXTS, "INSERT"), g.no_strokes())
        .otherwise(g.path_strokes(pts))
    )


def label_text() -> Column:
    return F.when(F.col("type_name") == "MTEXT", expand_percent(strip_mtext(F.col("text")))).when(F.col("type_name").isin(*TEXTS), expand_percent(F.col("text")))


def parts(entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Leaves with local strokes and labels, and inserts with their transforms, of entity rows (doc_id, owner, handle,
    seq, type_name, points, …, block, sx, sy). ``owner`` is 0 in model space, else the block that holds the row.

    A dimension shows its block, whose content is in world coordinates; without content, the path of its points.
    """
    p = F.element_at("points", 1)
    rows = complete(entities).where("space <> 'paper'")
    ins = rows.where("type_name = 'INSERT' AND block IS NOT NULL").select("doc_id", "owner", "handle", "seq", "block", g.insert_affine(p["x"], p["y"], F.col("sx"), F.col("sy"), F.col("rotation")).alias("t"))
    filled = rows.where("owner <> 0").select("doc_id", F.col("owner").alias("block")).distinct()
    dims = rows.where("type_name = 'DIMENSION' AND block IS NOT NULL")
    ins = ins.unionByName(dims.join(filled, ["doc_id", "block"], "left_semi").select("doc_id", "owner", "handle", "seq", "block", g.affine(*g.IDENTITY).alias("t")))
    of_dim = F.when(F.col("type_name") == "DIMENSION", F.col("block"))
    shown = rows.where("type_name <> 'INSERT' AND type_name NOT LIKE 'VERTEX%'").withColumn("__dim", of_dim).join(filled.withColumnRenamed("block", "__dim"), ["doc_id", "__dim"], "left_anti")

    def leaf(r: DataFrame, strokes: Column) -> DataFrame:
        return r.select("doc_id", "owner", "handle", "seq", "type_name", "layer", "height", "rotation", label_text().alias("text"), strokes.alias("strokes"), F.when(F.size("points") >= 1, p).alias("at"), F.size("points").alias("n_points"))

    if "knots" not in entities.columns:
        return leaf(shown, local_strokes()), ins
    curve = spline_strokes(F.coalesce("degree", F.lit(0)), F.col("knots"), F.col("control"), F.col("weights"), F.col("points"))
    return leaf(shown.where("type_name <> 'SPLINE'"), local_strokes()).unionByName(leaf(shown.where("type_name = 'SPLINE'"), curve)), ins


def expanded(entities: DataFrame) -> DataFrame:
    """World-space primitives of entity rows. Labels have text, at (anchor), world height and rotation."""
    out = primitives(*parts(entities))
    c, s, t = F.cos("rotation"), F.sin("rotation"), F.col("t")
    ux, uy = t["a"] * c + t["b"] * s, t["c"] * c + t["d"] * s
    return out.withColumns({"height": F.hypot(ux, uy) * F.col("height"), "rotation": F.atan2(uy, ux)}).drop("t", "root", "n_points")


def sheet_texts(prims: DataFrame, layers: DataFrame, sheets: DataFrame) -> DataFrame:
    """Every label with text, its layer's name and the first sheet around its anchor (0: none)."""
    from .sheets import assign

    labels = prims.where("text IS NOT NULL AND at IS NOT NULL").withColumns({"text": F.trim("text"), "x": F.col("at.x"), "y": F.col("at.y")}).where("text <> ''").where(g.plausible(F.col("x"), F.col("y")))
    labels = labels.withColumns({"source": F.col("handle"), "handle": F.xxhash64("handle", "order")})
    named = labels.join(layers.select("doc_id", F.col("layer_handle").alias("layer"), F.col("name").alias("layer_name")), ["doc_id", "layer"], "left")
    out = assign(named, sheets)
    return out.select("doc_id", "text", "x", "y", "height", g.degrees(F.col("rotation")).alias("rotation"), F.coalesce("layer_name", F.lit("")).alias("layer"), "sheet", F.col("source").alias("handle"))
