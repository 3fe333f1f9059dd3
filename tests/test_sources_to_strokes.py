"""Entities of every source kind through tessellation and block expansion."""

import json
import math

import pytest
from pyspark.sql import functions as F

from draftlake.operators import bounds, tessellate
from draftlake.sinks import dxf as dxf_sink
from draftlake.sources import dxf, json_drawings


def h(n):
    return [5, 1, n, n]


def drawing(spark, *objects):
    text = json.dumps({"HEADER": {"$ACADVER": "AC1015"}, "OBJECTS": [{"handle": h(i + 1), "entmode": 2} | o for i, o in enumerate(objects)]})
    return json_drawings.parse(spark.createDataFrame([("d", text)], "doc_id string, value string"))


def strokes(entities):
    return {r["handle"]: r["strokes"] for r in tessellate.expanded(entities).select("handle", "strokes").collect()}


def test_json_curves(spark):
    got = strokes(json_drawings.entities(drawing(
        spark,
        {"entity": "ELLIPSE", "center": [1, 2, 0], "sm_axis": [4, 0, 0], "axis_ratio": 0.5, "start_angle": 0, "end_angle": 2 * math.pi},
        {"entity": "SPLINE", "degree": 2, "knots": [0, 0, 0, 1, 1, 1], "control_points": [[0, 0, 0], [1, 2, 0], [2, 0, 0]]},
        {"entity": "SPLINE", "fit_pts": [[0, 0, 0], [1, 1, 0], [2, 0, 0]]},
        {"entity": "HATCH", "paths": [{"polyline_paths": [{"point": [0, 0]}, {"point": [1, 0]}, {"point": [1, 1]}]}, {"polyline_paths": [{"point": [0, 0], "bulge": 1}, {"point": [2, 0], "bulge": 1}]}]},
        {"entity": "XLINE", "point": [0, 0, 0], "vector": [1, 0, 0]},
        {"entity": "MLINE", "verts": [{"vertex": [0, 0, 0]}, {"vertex": [1, 0, 0]}, {"vertex": [1, 1, 0]}]},
        {"entity": "LEADER", "points": [[0, 0, 0], [3, 4, 0]]},
        {"entity": "SOLID", "corner1": [0, 0], "corner2": [1, 0], "corner3": [1, 1], "corner4": [0, 1]},
        {"entity": "POLYLINE_2D", "flag": 1},
        *({"entity": "VERTEX_2D", "ownerhandle": h(9), "entmode": 0, "point": p} for p in ([0, 0], [5, 0], [5, 5])),
    )))
    assert [len(got[k]) for k in range(1, 10)] == [96, 16, 32, 3 + 122, 2, 2, 1, 4, 3]
    e = got[1][24]
    assert abs(e["x1"] - 1) < 1e-9 and abs(e["y1"] - 4) < 1e-9 and (got[2][8]["x1"], got[2][8]["y1"]) == (1.0, 1.0) and got[9][2]["x2"] == 0.0


def test_dimension_shows_its_block(spark):
    got = tessellate.expanded(json_drawings.entities(drawing(
        spark,
        {"entity": "DIMENSION_LINEAR", "block": h(50), "def_pt": [0, 0, 0], "xline1_pt": [1, 0, 0], "xline2_pt": [2, 0, 0], "text_midpt": [3, 0]},
        {"entity": "LINE", "entmode": 0, "ownerhandle": h(50), "start": [7, 7, 0], "end": [8, 8, 0]},
        {"entity": "DIMENSION_LINEAR", "block": h(51), "def_pt": [0, 0, 0], "xline1_pt": [1, 0, 0], "xline2_pt": [2, 0, 0], "text_midpt": [3, 0]},
    ))).collect()
    assert sorted((r["handle"], len(r["strokes"])) for r in got) == [(2, 1), (3, 3)]


@pytest.mark.parametrize("bare", ["nan", "-nan", "NaN", "Infinity", "-inf"])
def test_json_bare_numbers(spark, bare):
    text = '{"OBJECTS": [{"entity": "TEXT", "handle": 1, "entmode": 2, "ins_pt": [%s, 1.0], "text_value": "see nan , \\"nan, inf] here"}]}' % bare
    r = json_drawings.entities(json_drawings.parse(spark.createDataFrame([("d", text)], "doc_id string, value string"))).first()
    assert r["text"] == 'see nan , "nan, inf] here' and r["points"][0]["x"] is None and r["points"][0]["y"] == 1.0


def test_json_error_rows(spark):
    raw = spark.createDataFrame([("a", "{not json"), ("b", "{}"), ("c", '{"OBJECTS": []}')], "doc_id string, value string")
    assert {r["doc_id"]: r["error"] for r in json_drawings.drawings(json_drawings.parse(raw)).collect()} == {"a": "not JSON", "b": "no OBJECTS", "c": None}


def test_radiating_far_ends(spark):
    rows = [("d", 0.0, 0.0, float(k), 1.0) for k in range(13)] + [("d", 1e20, 0.0, float("nan"), 1.0), ("d", 5.0, 5.0, 6.0, 6.0)]
    left = bounds.without_radiating(spark.createDataFrame(rows, "doc_id string, x1 double, y1 double, x2 double, y2 double"))
    assert sorted(r["x1"] for r in left.collect()) == [5.0, 1e20]


def pairs(*items):
    return "\n".join(f"{c}\n{v}" for c, v in items)


DXF = pairs(
    (0, "SECTION"), (2, "BLOCKS"), (0, "BLOCK"), (2, "B"), (0, "LINE"), (8, "L"), (10, 0), (20, 0), (11, 1), (21, 0), (0, "ENDBLK"), (0, "ENDSEC"),
    (0, "SECTION"), (2, "ENTITIES"), (0, "INSERT"), (5, "A"), (2, "B"), (10, 100), (20, 0), (41, 2), (42, 2),
    (0, "POLYLINE"), (5, "C"), (70, 1), (10, 0), (20, 0), (0, "VERTEX"), (10, 0), (20, 0), (0, "VERTEX"), (10, 3), (20, 0), (0, "VERTEX"), (10, 3), (20, 3), (0, "SEQEND"),
    (0, "ELLIPSE"), (5, "D"), (10, 0), (20, 0), (11, 2), (21, 0), (40, 0.5), (41, 0), (42, 6.283185307179586),
    (0, "SPLINE"), (5, "E"), (71, 2), (40, 0), (40, 0), (40, 0), (40, 1), (40, 1), (40, 1), (10, 0), (20, 0), (10, 1), (20, 2), (10, 2), (20, 0),
    (0, "HATCH"), (5, "F"), (10, 0), (20, 0), (91, 1), (92, 2), (72, 0), (73, 1), (93, 3), (10, 0), (20, 0), (10, 1), (20, 0), (10, 1), (20, 1), (97, 0), (75, 0), (10, 9), (20, 9),
    (0, "SOLID"), (5, "10"), (10, 0), (20, 0), (11, 1), (21, 0), (12, 0), (22, 1), (13, 1), (23, 1), (0, "ENDSEC"), (0, "EOF"),
)


def test_dxf_to_strokes(spark):
    r = dxf.records(dxf.pairs(spark.createDataFrame([("d", DXF)], "doc_id string, value string")))
    prims = tessellate.expanded(dxf.resolved(r)).select("handle", "type_name", "strokes", F.size("strokes").alias("n")).collect()
    assert sorted((x["type_name"], x["n"]) for x in prims) == [("ELLIPSE", 96), ("HATCH", 3), ("LINE", 1), ("POLYLINE_2D", 3), ("SOLID", 4), ("SPLINE", 16)]
    line = next(x["strokes"][0] for x in prims if x["type_name"] == "LINE")
    assert (line["x1"], line["x2"]) == (100.0, 102.0)


def test_json_to_dxf_and_back(spark):
    """Strokes of a drawing written as DXF and read again."""
    e = json_drawings.entities(drawing(
        spark,
        {"entity": "ELLIPSE", "center": [1, 2, 0], "sm_axis": [4, 0, 0], "axis_ratio": 0.5, "start_angle": 0, "end_angle": 2},
        {"entity": "SPLINE", "degree": 2, "knots": [0, 0, 0, 1, 1, 1], "control_points": [[0, 0, 0], [1, 2, 0], [2, 0, 0]]},
        {"entity": "SPLINE", "fit_pts": [[0, 0, 0], [1, 1, 0], [2, 0, 0]]},
        {"entity": "HATCH", "paths": [{"polyline_paths": [{"point": [0, 0]}, {"point": [1, 0]}, {"point": [1, 1]}]}, {"polyline_paths": [{"point": [0, 0], "bulge": 1}, {"point": [2, 0], "bulge": 1}]}]},
        {"entity": "XLINE", "point": [0, 0, 0], "vector": [1, 0, 0]},
        {"entity": "LWPOLYLINE", "points": [[0, 0], [2, 0], [2, 2]], "bulges": [0.5, 0, 0], "flag": 512},
        {"entity": "LEADER", "points": [[0, 0, 0], [3, 4, 0], [5, 4, 0]]},
        {"entity": "SOLID", "corner1": [0, 0], "corner2": [1, 0], "corner3": [1, 1], "corner4": [0, 1]},
        {"entity": "POLYLINE_2D", "flag": 1},
        *({"entity": "VERTEX_2D", "ownerhandle": h(9), "entmode": 0, "point": p, "bulge": 0.25} for p in ([0, 0], [5, 0], [5, 5])),
        {"entity": "DIMENSION_LINEAR", "def_pt": [0, 0, 0], "xline1_pt": [1, 0, 0], "xline2_pt": [2, 0, 0], "text_midpt": [3, 1]},
    ))
    rows = e.withColumns({"layer_name": F.lit("L"), "block_name": F.lit(None).cast("string"), "in_block": F.lit(None).cast("string")})
    text = dxf_sink.write(rows, spark.createDataFrame([], "doc_id string, name string, aci int"))
    back = dxf.resolved(dxf.records(dxf.pairs(text.select("doc_id", F.col("dxf").alias("value")))))
    rounded = lambda ss: {k: [tuple(round(v, 6) for v in s) for s in v] for k, v in ss.items()}
    got, want = rounded(strokes(back)), rounded(strokes(e))
    assert got == want and len(want) == 10
    assert "$EXTMIN" in text.first()["dxf"]


def test_dxf_bulges_belong_to_their_points(spark):
    text = pairs((0, "SECTION"), (2, "ENTITIES"), (0, "LWPOLYLINE"), (90, 3), (10, 0), (20, 0), (10, 1), (20, 0), (42, 0.5), (10, 2), (20, 0), (0, "ENDSEC"))
    e = dxf.entities(dxf.records(dxf.pairs(spark.createDataFrame([("d", text)], "doc_id string, value string")))).first()
    assert e["bulges"] == [0.0, 0.5, 0.0] and len(e["points"]) == 3
