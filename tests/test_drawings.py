import json
import math

import pytest
from pyspark.sql import functions as F

from draftlake.functions.geometry import insert_affine
from draftlake.operators import expand, sheets, tessellate
from draftlake.sinks import dump, dxf as dxf_sink, svg
from draftlake.sources import dxf, json_drawings


def inserts(spark, rows):
    df = spark.createDataFrame([("d", *r) for r in rows], "doc_id string, owner long, handle long, seq int, block long, x double, y double, sx double, sy double, rot double")
    return df.withColumn("t", insert_affine(F.col("x"), F.col("y"), F.col("sx"), F.col("sy"), F.col("rot"))).drop("x", "y", "sx", "sy", "rot")


def lines(spark, rows):
    df = spark.createDataFrame([("d", *r) for r in rows], "doc_id string, owner long, handle long, seq int, x1 double, y1 double, x2 double, y2 double")
    return df.withColumn("strokes", F.array(F.struct("x1", "y1", "x2", "y2"))).drop("x1", "y1", "x2", "y2")


LINE = (0.0, 0.0, 5.0, 0.0)


@pytest.mark.parametrize(
    "refs, content, expected",
    [
        ([(10, 1, 0, 10), (0, 2, 0, 10)], [(10, 3)], 1),  # a block that refers to itself
        ([(10, 1, 0, 11), (11, 2, 0, 10), (0, 3, 0, 10)], [(10, 4), (11, 5)], 2),  # two that refer to each other
        ([(10, 1, 0, 11), (10, 2, 1, 11), (10, 3, 2, 11), (0, 4, 0, 10)], [(10, 5), (11, 6)], 4),  # fan-out
    ],
)
def test_cycles_and_fan_out(spark, refs, content, expected):
    i = inserts(spark, [(*r, 0.0, 0.0, 1.0, 1.0, 0.0) for r in refs])
    assert expand.primitives(lines(spark, [(o, h, 0, *LINE) for o, h in content]), i).count() == expected


def test_many_instances(spark):
    i = inserts(spark, [(0, 10_000 + k, k, 7, 100.0 * k, 0.0, 1.0, 1.0, 0.0) for k in range(600)])
    assert expand.primitives(lines(spark, [(7, k, k, *LINE) for k in range(40)]), i).count() == 24_000


def test_mirrored(spark):
    i = inserts(spark, [(0, 1, 0, 7, 100.0, 0.0, -1.0, 1.0, 0.0)])
    s = expand.primitives(lines(spark, [(7, 2, 0, 0.0, 0.0, 10.0, 0.0)]), i).first()["strokes"][0]
    assert (s["x1"], s["x2"]) == (100.0, 90.0)


JSON = {
    "HEADER": {"$ACADVER": "AC1015"},
    "OBJECTS": [
        {"object": "LAYER", "handle": [0, 1, 201, 201], "name": "WATER", "color": {"index": 5}},
        {"object": "BLOCK_HEADER", "handle": [0, 1, 100, 100], "name": "FRAME"},
        {"object": "DICTIONARY", "handle": [0, 1, 50, 50], "items": {"LIGHTINGUNITS": [2, 1, 51, 51]}},
        {"entity": "LWPOLYLINE", "handle": [0, 1, 1, 1], "entmode": 0, "ownerhandle": [4, 1, 100, 100], "layer": [5, 1, 201, 201], "points": [[0, 0], [42000, 0], [42000, 29700], [0, 29700]], "flag": 512},
        {"entity": "TEXT", "handle": [0, 1, 2, 2], "entmode": 0, "ownerhandle": [4, 1, 100, 100], "layer": [5, 1, 201, 201], "ins_pt": [40000, 1500], "height": 500, "text_value": "测试图"},
        {"entity": "INSERT", "handle": [0, 1, 3, 3], "entmode": 2, "block_header": [5, 1, 100, 100], "ins_pt": [0, 0, 0], "scale": [1, 1, 1]},
        {"entity": "MTEXT", "handle": [0, 1, 4, 4], "entmode": 2, "layer": [5, 1, 201, 201], "ins_pt": [1000, 1000, 0], "text": "{\\fArial;多行\\P文本}", "text_height": 200},
        {"entity": "TEXT", "handle": [0, 1, 5, 5], "entmode": 2, "ins_pt": [100000, 100000], "height": 300, "rotation": math.pi / 4, "text_value": "outside %%c5"},
        {"entity": "ATTDEF", "handle": [0, 1, 6, 6], "entmode": 2, "text_value": "gone"},
        {"entity": "LINE", "handle": [0, 1, 7, 7], "entmode": 1, "start": [0, 0, 0], "end": [1, 1, 0]},
    ],
}


@pytest.fixture(scope="module")
def drawing(spark):
    return json_drawings.parse(spark.createDataFrame([("d", json.dumps(JSON).replace("29700], [0, 29700]", "29700], [0, 29700]")), ("bad", "{"), ("none", '{"HEADER": {"x": nan}}')], "doc_id string, value string")).cache()


def test_json_tables(drawing):
    info = {r["doc_id"]: r for r in json_drawings.drawings(drawing).collect()}
    assert info["d"]["version"] == "R2000" and not info["d"]["no_objects"] and info["none"]["no_objects"]
    e = {r["handle"]: r for r in json_drawings.entities(drawing).collect()}
    assert set(e) == {1, 2, 3, 4, 5, 7} and e[1]["space"] == "block" and e[1]["owner"] == 100 and e[7]["space"] == "paper"
    assert json_drawings.layers(drawing).first()["name"] == "WATER"
    assert json_drawings.dictionaries(drawing).first()["item_handle"] == 51


def test_sheet_texts(spark, drawing):
    prims = tessellate.expanded(json_drawings.entities(drawing))
    box = spark.createDataFrame([("d", 1, "FRAME", 0.0, 0.0, 42000.0, 29700.0)], "doc_id string, sheet_index int, name string, min_x double, min_y double, max_x double, max_y double")
    got = {r["text"]: r for r in tessellate.sheet_texts(prims, json_drawings.layers(drawing), box).collect()}
    assert got["测试图"]["sheet"] == 1 and (got["测试图"]["x"], got["测试图"]["y"], got["测试图"]["height"]) == (40000.0, 1500.0, 500.0)
    assert got["多行\n文本"]["sheet"] == 1 and got["多行\n文本"]["layer"] == "WATER"
    assert got["outside φ5"]["sheet"] == 0 and abs(got["outside φ5"]["rotation"] - 45) < 1e-9
    names = {r["sheet_index"]: r["title"] for r in sheets.titles(box, tessellate.sheet_texts(prims, json_drawings.layers(drawing), box)).collect()}
    assert names == {1: "测试图"}


def test_svg(spark, drawing):
    box = spark.createDataFrame([("d", 1, 0.0, 0.0, 42000.0, 29700.0)], "doc_id string, sheet_index int, min_x double, min_y double, max_x double, max_y double")
    out = svg.render(tessellate.expanded(json_drawings.entities(drawing)).withColumn("rgb", F.lit(255)), box).first()["svg"]
    assert out.startswith("<svg") and "测试图" in out and out.count("<path") == 1 and "#0000FF" in out


DXF = """  0
SECTION
  2
HEADER
  9
$ACADVER
  1
AC1015
  9
$DWGCODEPAGE
  3
ANSI_936
  0
ENDSEC
  0
SECTION
  2
TABLES
  0
TABLE
  2
LAYER
  0
LAYER
  2
WALL
 62
3
  0
ENDTAB
  0
ENDSEC
  0
SECTION
  2
BLOCKS
  0
BLOCK
  2
DOOR
  0
LINE
  5
A1
  8
WALL
 10
0.0
 20
0.0
 11
10.0
 21
0.0
  0
ENDBLK
  0
BLOCK
  2
*Paper_Space
  0
LINE
 10
0
 20
0
 11
1
 21
1
  0
ENDBLK
  0
ENDSEC
  0
SECTION
  2
ENTITIES
  0
INSERT
  5
B1
  8
WALL
  2
DOOR
 10
100.0
 20
5.0
 50
90.0
  0
CIRCLE
  5
B2
  8
0
 10
1.0
 20
2.0
 40
3.0
  0
MTEXT
  5
B3
  8
NOTE
 10
7.0
 20
8.0
 40
2.5
  3
long 
  1
text^Jend
  0
TEXT
 67
1
 10
0
 20
0
  1
paper
  0
ENDSEC
  0
EOF
"""


@pytest.fixture(scope="module")
def records(spark):
    return dxf.records(dxf.pairs(spark.createDataFrame([("d", DXF)], "doc_id string, value string"))).cache()


def test_dxf_tables(spark, records):
    info = dxf.drawings(dxf.pairs(spark.createDataFrame([("d", DXF)], "doc_id string, value string"))).first()
    assert (info["version"], info["codepage"]) == ("R2000", 31)
    assert [(r["name"], r["aci"]) for r in dxf.layers(records).collect()] == [("WALL", 3)]
    e = {r["handle"]: r for r in dxf.entities(records).collect()}
    assert set(e) == {0xA1, 0xB1, 0xB2, 0xB3} and e[0xA1]["in_block"] == "DOOR" and e[0xB1]["block_name"] == "DOOR"
    assert e[0xB3]["text"] == "long text\nend" and e[0xB2]["radius"] == 3.0 and abs(e[0xB1]["rotation"] - math.pi / 2) < 1e-12


def test_dxf_round_trip(spark, records):
    """What the writer writes reads back as the same rows."""
    e = dxf.entities(records)
    text = dxf_sink.write(e, dxf.layers(records))
    back = dxf.entities(dxf.records(dxf.pairs(text.select("doc_id", F.col("dxf").alias("value")))))
    keys = ["doc_id", "handle", "type_name", "in_block", "layer_name", "points", "radius", "text", "block_name", "rotation", "height"]
    assert dump.differences(dump.long_form(dump.entities(e.select(keys))), dump.long_form(dump.entities(back.select(keys)))).count() == 0


def test_stream(spark, tmp_path):
    from draftlake.streaming.ingest import ingest

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.dxf").write_text(DXF)
    ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def framed_drawing(spark, dots=8, size=(42000, 29700), at=((0, 0), (60000, 0))):
    w, h = size
    objects = [
        {"object": "BLOCK_HEADER", "handle": [0, 1, 100, 100], "name": "FRAME"},
        {"entity": "LWPOLYLINE", "handle": [0, 1, 1, 1], "entmode": 0, "ownerhandle": [4, 1, 100, 100], "points": [[0, 0], [w, 0], [w, h], [0, h]]},
        {"entity": "TEXT", "handle": [0, 1, 2, 2], "entmode": 0, "ownerhandle": [4, 1, 100, 100], "ins_pt": [w * 0.9, h * 0.05], "height": 100, "text_value": "AB-12"},
    ]
    for k, (x, y) in enumerate(at):
        objects.append({"entity": "INSERT", "handle": [0, 1, 10 + k, 10 + k], "entmode": 2, "block_header": [5, 1, 100, 100], "ins_pt": [x, y, 0], "scale": [1, 1, 1]})
        objects += [{"entity": "LINE", "handle": [0, 1, 1000 * (k + 1) + i, 1000 * (k + 1) + i], "entmode": 2, "start": [x + 100 + i, y + 100, 0], "end": [x + 200 + i, y + 9000, 0]} for i in range(dots // 2)]
    return json_drawings.parse(spark.createDataFrame([("d", json.dumps({"HEADER": {}, "OBJECTS": objects}))], "doc_id string, value string"))


@pytest.mark.parametrize("options, n, name", [({"size": (42000, 15000)}, 2, "AB-12"), ({"dots": 2}, 1, "整图")])
def test_detects_frames(spark, options, n, name):
    from draftlake.operators import frames

    d = framed_drawing(spark, **options)
    got = frames.detect(json_drawings.entities(d), json_drawings.layers(d)).collect()
    assert (len(got), {r["name"] for r in got}) == (n, {name})


def test_texts_local(drawing):
    from draftlake.operators.texts import texts_local

    got = {(r["text"], r["x"]) for r in texts_local(json_drawings.entities(drawing)).collect()}
    assert got == {("测试图", 40000.0), ("多行\n文本", 1000.0), ("outside %%c5", 100000.0)}
