"""ASCII DXF writer: rows to group-code pairs, pairs to one text a drawing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import dxf_sanitize
from ..operators.bounds import aabb
from ..operators.tessellate import complete


def _pair(code: int, value: Column) -> Column:
    return F.concat(F.format_string("%3d", F.lit(code)), F.lit("\n"), value)


def _number(v: Column) -> Column:
    return F.coalesce(v, F.lit(0.0)).cast("string")


def _pairs(*pairs: tuple[int, Column]) -> Column:
    return F.array_join(F.array(*[_pair(c, v) for c, v in pairs]), "\n")


def _points(points: Column, code: int = 10) -> Column:
    return F.array_join(F.transform(points, lambda p: F.concat(_pair(code, _number(p["x"])), F.lit("\n"), _pair(code + 10, _number(p["y"])))), "\n")


def _numbers(values: Column, code: int) -> Column:
    return F.array_join(F.transform(values, lambda v: _pair(code, _number(v))), "\n")


def _bulged(points: Column, bulges: Column) -> Column:
    """Points, each with its bulge where there are bulges."""
    one = lambda p, i: F.concat(_pair(10, _number(p["x"])), F.lit("\n"), _pair(20, _number(p["y"])), F.lit("\n"), _pair(42, _number(F.coalesce(F.get(bulges, i), F.lit(0.0)))))
    return F.when(F.coalesce(F.size(bulges), F.lit(0)) > 0, F.array_join(F.transform(points, one), "\n")).otherwise(_points(points))


def _loops(paths: Column) -> Column:
    """A hatch's boundary: closed polyline loops with bulges."""
    loop = lambda h: F.concat_ws("\n", _pairs((92, F.lit("2")), (72, F.lit("1")), (73, F.lit("1")), (93, F.size(h["points"]).cast("string"))), _bulged(h["points"], F.transform(h["points"], lambda p, i: F.coalesce(F.get(h["bulges"], i), F.lit(0.0)))), _pair(97, F.lit("0")))
    return F.concat_ws("\n", _pairs((2, F.lit("SOLID")), (70, F.lit("1")), (91, F.size(paths).cast("string"))), F.array_join(F.transform(paths, loop), "\n"), _pairs((75, F.lit("0")), (76, F.lit("1"))))


def entity_text(layer_name: Column) -> Column:
    """The record of an entity row; types that the writer doesn't know become null."""
    kind, pts = F.col("type_name"), F.col("points")
    p, q = F.element_at(pts, 1), F.get(pts, 1)
    at = _pairs((10, _number(p["x"])), (20, _number(p["y"])), (30, F.lit("0.0")))
    to = _pairs((11, _number(q["x"])), (21, _number(q["y"])), (31, F.lit("0.0")))
    text = dxf_sanitize(F.coalesce("text", F.lit("")))
    axis, size = F.col("axis"), lambda c: F.coalesce(F.size(c), F.lit(0))
    corners = F.concat_ws("\n", *[_pairs((10 + k, _number(F.get(pts, k)["x"])), (20 + k, _number(F.get(pts, k)["y"]))) for k in range(4)])
    vertex = lambda v, i: _pairs((0, F.lit("VERTEX")), (10, _number(v["x"])), (20, _number(v["y"])), (42, _number(F.coalesce(F.get(F.col("bulges"), i), F.lit(0.0)))))
    closed = F.coalesce("closed", F.lit(False)).cast("int").cast("string")
    spline = F.concat_ws(
        "\n", _pairs((70, F.lit("8")), (71, F.coalesce("degree", F.lit(3)).cast("string"))), F.nullif(_numbers(F.col("knots"), 40), F.lit("")), F.nullif(_numbers(F.col("weights"), 41), F.lit("")),
        F.nullif(_points(F.col("control")), F.lit("")), F.nullif(_points(pts, 11), F.lit("")),
    )
    body = (
        F.when(kind == "LINE", F.concat_ws("\n", at, to))
        .when(kind == "CIRCLE", F.concat_ws("\n", at, _pair(40, _number(F.col("radius")))))
        .when(kind == "ARC", F.concat_ws("\n", at, _pairs((40, _number(F.col("radius"))), (50, _number(F.degrees("a0"))), (51, _number(F.degrees("a1"))))))
        .when(kind == "LWPOLYLINE", F.concat_ws("\n", _pairs((90, F.size(pts).cast("string")), (70, closed)), _bulged(pts, F.col("bulges"))))
        .when(kind.isin("TEXT", "ATTRIB", "MTEXT"), F.concat_ws("\n", at, _pairs((40, _number(F.col("height"))), (1, text), (50, _number(F.degrees("rotation"))))))
        .when(kind == "INSERT", F.concat_ws("\n", _pair(2, F.col("block_name")), at, _pairs((41, _number(F.col("sx"))), (42, _number(F.col("sy"))), (50, _number(F.degrees("rotation"))))))
        .when(kind == "POINT", at)
        .when(kind.isin("RAY", "XLINE") & (size(pts) >= 2), F.concat_ws("\n", at, to))
        .when(kind.isin("SOLID", "TRACE", "3DFACE") & (size(pts) >= 4), corners)
        .when((kind == "ELLIPSE") & axis.isNotNull(), F.concat_ws("\n", at, _pairs((11, _number(axis["x"])), (21, _number(axis["y"])), (40, _number(F.coalesce("ratio", F.lit(1.0)))), (41, _number(F.col("a0"))), (42, _number(F.col("a1"))))))
        .when(kind == "SPLINE", spline)
        .when(kind.isin("POLYLINE_2D", "POLYLINE_3D"), F.concat_ws("\n", _pairs((66, F.lit("1")), (70, closed)), F.array_join(F.transform(pts, vertex), "\n"), _pair(0, F.lit("SEQEND"))))
        .when(kind == "LEADER", F.concat_ws("\n", _pair(76, F.size(pts).cast("string")), _points(pts)))
        .when(kind.isin("HATCH", "MPOLYGON") & (size("paths") > 0), _loops(F.col("paths")))
        .when((kind == "DIMENSION") & (size(pts) >= 4), F.concat_ws("\n", F.when(F.col("block_name").isNotNull(), _pair(2, F.col("block_name"))), *[_pairs((c, _number(F.get(pts, k)["x"])), (c + 10, _number(F.get(pts, k)["y"]))) for c, k in ((10, 0), (13, 1), (14, 2), (11, 3))]))
    )
    # Old-style polylines and multi-polygons bear other names in the file.
    kind_text = F.when(kind.isin("POLYLINE_2D", "POLYLINE_3D"), "POLYLINE").when(kind == "MPOLYGON", "HATCH").otherwise(kind)
    head = _pairs((0, kind_text), (5, F.hex("handle")), (8, layer_name), (62, F.coalesce("color_index", F.lit(256)).cast("string")))
    return F.when(body.isNotNull(), F.concat_ws("\n", head, body))


def write(entities: DataFrame, layers: DataFrame) -> DataFrame:
    """(doc_id, dxf) from entity rows with layer_name, block_name and in_block, and layers (doc_id, name, aci).

    Layers that entities use without a table row are declared with the default colour. A drawing's text is gathered in
    one row, as the file is one value; drawings are the unit of parallel work.
    """
    entities = complete(entities)
    if "bulges" not in entities.columns:
        entities = entities.withColumn("bulges", F.lit(None).cast("array<double>"))
    used = entities.select("doc_id", F.col("layer_name").alias("name"))
    declared = layers.select("doc_id", "name", "aci").unionByName(used.join(layers.select("doc_id", "name"), ["doc_id", "name"], "left_anti").distinct().withColumn("aci", F.lit(7)))
    table = declared.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("name", "aci"))).alias("l"))
    row = _pairs_of_layer
    table = table.select("doc_id", F.array_join(F.transform("l", row), "\n").alias("layer_text"))
    records = entities.withColumn("t", entity_text(F.col("layer_name"))).where("t IS NOT NULL")
    per_block = records.groupBy("doc_id", "in_block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "t"))), lambda x: x["t"]), "\n").alias("body"))
    block = _pairs((0, F.lit("BLOCK")), (2, F.col("in_block")), (10, F.lit("0.0")), (20, F.lit("0.0")))
    blocks = per_block.where("in_block IS NOT NULL").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.concat_ws("\n", block, F.col("body"), _pair(0, F.lit("ENDBLK"))))).alias("blocks"))
    model = per_block.where("in_block IS NULL").select("doc_id", "body")
    corners = entities.where("in_block IS NULL").select("doc_id", F.explode("points").alias("p")).select("doc_id", "p.x", "p.y")
    j = table.join(blocks, "doc_id", "left").join(model, "doc_id", "left").join(aabb(corners), "doc_id", "left")
    section = lambda name, body: F.concat_ws("\n", _pairs((0, F.lit("SECTION")), (2, F.lit(name))), body, _pair(0, F.lit("ENDSEC")))
    extent = lambda name, side: _pairs((9, F.lit(name)), (10, _number(F.col(f"{side}_x"))), (20, _number(F.col(f"{side}_y"))), (30, F.lit("0.0")))
    header = F.concat_ws("\n", _pairs((9, F.lit("$ACADVER")), (1, F.lit("AC1015"))), F.when(F.col("min_x").isNotNull(), F.concat_ws("\n", extent("$EXTMIN", "min"), extent("$EXTMAX", "max"))))
    tables = F.concat_ws("\n", _pairs((0, F.lit("TABLE")), (2, F.lit("LAYER"))), F.col("layer_text"), _pair(0, F.lit("ENDTAB")))
    out = F.concat_ws("\n", section("HEADER", header), section("TABLES", tables), section("BLOCKS", F.nullif(F.array_join(F.coalesce("blocks", F.array().cast("array<string>")), "\n"), F.lit(""))), section("ENTITIES", F.col("body")), _pair(0, F.lit("EOF")), F.lit(""))
    return j.select("doc_id", out.alias("dxf"))


def _pairs_of_layer(x: Column) -> Column:
    return _pairs((0, F.lit("LAYER")), (2, x["name"]), (62, F.coalesce(x["aci"], F.lit(7)).cast("string")))
