"""Records of binary drawings: every layout by round trip, damage as error rows, whole drawings against other sources."""

import json
import random
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from draftlake.operators import tessellate
from draftlake.schema import ENTITIES
from draftlake.sinks import dwg as dwg_sink
from draftlake.sources import dwg, json_drawings, paged
from draftlake.sources import dwg_records as records

value = st.sampled_from([0.0, 1.0, -2.5, 1e9, 0.1, 123456.789])


@settings(max_examples=200, deadline=None)
@given(st.sampled_from(sorted(records.LAYOUTS)), st.lists(st.tuples(value, value), min_size=6, max_size=9), st.integers(1, 1 << 40), st.integers(0, 2), st.sampled_from(dwg.DECODED), st.data())
def test_every_layout(name, points, handle, mode, version, data):
    """What is written reads back, for every type; defaults read back as well."""
    f = {"type_name": name, "handle": handle}
    if name not in records.OBJECTS:
        f |= {"layer": 16, "color_index": data.draw(st.sampled_from([0, 7, 256])), "mode": mode}
        f |= {"owner": 99} if mode == 0 else {}
    f |= {"text": "a\\Pé"} if name in ("TEXT", "MTEXT", "ATTRIB") else {}
    counts = {"LINE": 2, "RAY": 2, "XLINE": 2, "SOLID": 4, "TRACE": 4, "3DFACE": 4, "LWPOLYLINE": 9, "LEADER": 9, "MLINE": 9, "SPLINE": 9, "BLOCK_HEADER": 1, "VERTEX_PFACE_FACE": 0, "BLOCK": 0, "ENDBLK": 0, "SEQEND": 0}
    n = 1 if name in ("DIM_RADIUS", "DIM_DIAMETER") else 3 if name.startswith("DIM_") else 0 if name.startswith("POLYLINE") or name in ("HATCH", "LAYER", "DICTIONARY") else counts.get(name, 1)
    for i, (x, y) in enumerate(points[:n]):
        f |= {f"x{i}": x, f"y{i}": y}
    if name == "HATCH":
        f["paths"] = [(points, [0.0] * len(points)), (points[:3], [0.5, 0.0, -1.0])]
    if name == "DICTIONARY":
        f |= {"keys": ["a", "", "é"], "items": [1, 2, 3]}
    if name == "INSERT":
        f |= dict(zip(("sx", "sy", "sz"), data.draw(st.sampled_from([(1.0, 1.0, 1.0), (2.0, 2.0, 2.0), (1.0, -1.0, 1.0), (2.0, 3.0, 4.0)])))) | {"block": 7}
    if name == "SPLINE" and data.draw(st.booleans()):
        f = {k: v for k, v in f.items() if k[0] not in "xy"} | {"control": [(*p, 0.0) for p in points], "knots": [0.0, 1.0], "weights": [1.5] * len(points)}
    content = dwg.write([(handle, records.TYPE_CODES[name], records.write(f, version=version))], version)
    ((got_handle, offset, _, code),) = dwg.frames(content)
    got = records.read(dwg.stores(content)[1], offset, version=version)
    assert got_handle == handle and records.NAMES[code] == name
    assert {k: got.get(k) for k in f} == f


def test_bits_of_a_line():
    """A line put together by hand: no z, ends that share no bytes with the starts, by layer."""
    bits = "01" + f"{19:08b}"  # type code as a short in one byte
    body = "0000" + "0001" + f"{0x2A:08b}" + "10" + "0" + "10" + "10" + "1" + "11" + "01" + "00" + "00" + "10" + f"{29:08b}"
    f64 = lambda v: "".join(f"{b:08b}" for b in struct.pack("<d", v))
    body += "1" + f64(1.0) + "11" + f64(-7.25) + f64(2.0) + "00" + "1" + "1"
    refs = "0011" + "0000" + "0101" + "0001" + f"{16:08b}"
    size = len(bits) + 32 + len(body)
    whole = bits + "".join(f"{b:08b}" for b in size.to_bytes(4, "little")) + body + refs
    data = int(whole.ljust(-(-len(whole) // 8) * 8, "0"), 2).to_bytes(-(-len(whole) // 8), "big")
    got = records.read(len(data).to_bytes(2, "little") + data, 0)
    assert {k: got[k] for k in ("handle", "mode", "layer", "owner", "color_index", "x0", "y0", "x1", "y1")} == {"handle": 42, "mode": 2, "layer": 16, "owner": 0, "color_index": 256, "x0": 1.0, "y0": 2.0, "x1": -7.25, "y1": 2.0}


@pytest.mark.parametrize("version", dwg.DECODED)
def test_damage_gives_error_rows(version):
    """Any flipped byte or cut leaves the other records readable and never raises."""
    good = dwg.write([(k, records.TYPE_CODES["LINE"], records.write({"type_name": "LINE", "handle": k, "x0": float(k), "y0": 0.0, "x1": 1.0, "y1": 1.0, "layer": 1}, version=version)) for k in range(1, 21)] + [(50, 500, b"\0\0")], version)
    assert [r["kind"] for r in dwg.rows(good)] == ["entity"] * 20 + ["error"]
    draw = random.Random(5)
    for _ in range(300):
        bad = bytearray(good)
        for _ in range(draw.randrange(1, 6)):
            bad[draw.randrange(0x1E, len(bad))] = draw.randrange(256)
        assert all(r["kind"] in ("entity", "object", "error") for r in dwg.rows(bytes(bad[: draw.randrange(0x22, len(bad))] if draw.random() < 0.3 else bad)))
    if version in paged.PAGED:
        return
    one = bytearray(good)
    at = next(o for h, o, _, _ in dwg.frames(good) if h == 7)
    one[at + 1] = 0xFF
    assert sum(r["kind"] == "entity" for r in dwg.rows(bytes(one))) == 19


def h(n):
    return [5, 1, n, n]


@pytest.fixture()
def drawing(spark):
    objects = [
        {"entity": "LINE", "start": [0, 0, 0], "end": [5, 1, 0]}, {"entity": "CIRCLE", "center": [1, 2, 0], "radius": 3.0},
        {"entity": "ARC", "center": [1, 2, 0], "radius": 3.0, "start_angle": 0.5, "end_angle": 2.0}, {"entity": "POINT", "point": [4, 4, 0]},
        {"entity": "ELLIPSE", "center": [1, 2, 0], "sm_axis": [4, 0, 0], "axis_ratio": 0.5, "start_angle": 0, "end_angle": 2},
        {"entity": "SPLINE", "degree": 2, "knots": [0, 0, 0, 1, 1, 1], "control_points": [[0, 0, 0], [1, 2, 0], [2, 0, 0]]},
        {"entity": "SPLINE", "fit_pts": [[0, 0, 0], [1, 1, 0], [2, 0, 0]]}, {"entity": "XLINE", "point": [0, 0, 0], "vector": [1, 0, 0]},
        {"entity": "HATCH", "paths": [{"polyline_paths": [{"point": [0, 0], "bulge": 1}, {"point": [2, 0], "bulge": 1}]}]},
        {"entity": "LWPOLYLINE", "points": [[0, 0], [2, 0], [2, 2]], "bulges": [0.5, 0, 0], "flag": 512},
        {"entity": "LEADER", "points": [[0, 0, 0], [3, 4, 0], [5, 4, 0]]}, {"entity": "MLINE", "verts": [{"vertex": [0, 0, 0]}, {"vertex": [1, 0, 0]}, {"vertex": [1, 1, 0]}]},
        {"entity": "SOLID", "corner1": [0, 0], "corner2": [1, 0], "corner3": [1, 1], "corner4": [0, 1]}, {"entity": "POLYLINE_2D", "flag": 1},
        *({"entity": "VERTEX_2D", "ownerhandle": h(14), "entmode": 0, "point": p, "bulge": 0.25} for p in ([0, 0], [5, 0], [5, 5])),
        {"entity": "DIMENSION_LINEAR", "def_pt": [0, 0, 0], "xline1_pt": [1, 0, 0], "xline2_pt": [2, 0, 0], "text_midpt": [3, 1]},
        {"entity": "INSERT", "ins_pt": [100, 50, 0], "scale": [2, -3, 1], "rotation": 0.5, "block_header": h(90)},
        {"entity": "LINE", "entmode": 0, "ownerhandle": h(90), "start": [7, 7, 0], "end": [8, 8, 0]},
        {"entity": "TEXT", "entmode": 0, "ownerhandle": h(90), "ins_pt": [1, 1, 0], "text_value": "图号 A-1", "height": 2.5, "rotation": 0.25},
        {"entity": "MTEXT", "ins_pt": [1, 1, 0], "text": "two\\Plines", "text_height": 3.5}, {"entity": "LINE", "entmode": 1, "start": [0, 0, 0], "end": [1, 1, 0]},
        {"entity": "ATTRIB", "ins_pt": [9, 9, 0], "text_value": "v", "tag": "T", "height": 1.0, "ownerhandle": h(19), "entmode": 0},
        {"object": "LAYER", "name": "墙", "color": {"index": 3}}, {"object": "BLOCK_HEADER", "handle": h(90), "name": "B"},
    ]
    text = json.dumps({"OBJECTS": [{"handle": h(i + 1), "layer": h(25), "entmode": 2} | o for i, o in enumerate(objects)]})
    return json_drawings.parse(spark.createDataFrame([("d", text)], "doc_id string, value string"))


@pytest.mark.parametrize("version", dwg.DECODED)
def test_json_to_dwg_and_back(drawing, version):
    """Every row of a drawing, its layers and blocks, and its strokes and labels, written as a binary drawing and read again."""
    e = json_drawings.entities(drawing)
    files = dwg_sink.write(e, json_drawings.layers(drawing), json_drawings.blocks(drawing), page=39, version=version).cache()
    assert files.first()["left_out"] == 0
    back = dwg.entities(files)
    columns = ("handle", "type_name", "space", "owner", "layer", "color_index", "points", "radius", "text", "tag", "height", "rotation", "block", "sx", "sy", "paths")
    want, got = ({r["handle"]: r for r in x.select(*columns).collect()} for x in (e, back))
    assert got == want and len(want) == 21
    rounded = lambda x: {(r["handle"], r["text"]): [tuple(round(v, 6) for v in s) for s in r["strokes"]] for r in tessellate.expanded(x).select("handle", "text", "strokes").collect()}
    assert rounded(back) == rounded(e)
    assert dwg.layers(files).first()[1:4] == (25, "墙", 3) and dwg.blocks(files).first()[1:3] == (90, "B")
    assert dwg.decode_errors(files).count() == 0


def test_paged_sections():
    """Sections of no, one and several pages, through masks, maps and compression; gaps and missing pages."""
    draw = random.Random(3)
    parts = {"AcDb:Empty": b"", "AcDb:One": b"x" * 100, "AcDb:Many": bytes(draw.choices(b"abc\0", k=70_000)) + draw.randbytes(40_000)}
    good = paged.write(parts, "AC1024", 30)
    assert paged.sections(good) == parts
    for cut in (0x90, 0x120, len(good) // 2, len(good) - 5):
        with pytest.raises(ValueError):
            paged.sections(good[:cut])


def test_true_colours(spark, drawing):
    e = json_drawings.entities(drawing).withColumn("true_color", F.lit(0x123456).cast("bigint"))
    layers = spark.createDataFrame([], "doc_id string, layer_handle bigint, name string, aci int")
    files = dwg_sink.write(e, layers, json_drawings.blocks(drawing), version="AC1018")
    assert {r["true_color"] for r in dwg.entities(files).collect()} == {0x123456}


def test_many_objects():
    """An object map of several chunks."""
    rows = [(3 * k, records.TYPE_CODES["ENDBLK"], records.write({"type_name": "ENDBLK", "handle": 3 * k})) for k in range(1, 3_000)]
    content = dwg.write(rows)
    assert len(list(dwg.map_chunks(dwg.stores(content)[0], 0, 1 << 30))) > 2
    assert [r["handle"] for r in dwg.rows(content)] == [h for h, _, _ in rows]


@pytest.mark.parametrize("version", dwg.DECODED)
def test_classes(spark, version):
    """Names of a file's own types; records of these types are error rows that carry the name."""
    own = {500: "ACDBDICTIONARYWDFLT", 501: "", 777: "IMAGE", 40_000: "LAYOUT"}
    content = dwg.write([(5, 777, b"abc"), (9, 778, b"abc")], version, own=own)
    files = spark.createDataFrame([("d", content), ("cut", content[:-9]), ("new", b"AC1032")], "doc_id string, content binary")
    assert {(r["type_code"], r["name"]) for r in dwg.classes(files).where("doc_id = 'd'").collect()} == {(k, v) for k, v in own.items() if v}
    assert [(r["handle"], r["type_name"], r["reason"]) for r in dwg.rows(content)] == [(5, "IMAGE", "no decoder for type 777"), (9, None, "no decoder for type 778")]
    assert dwg.class_names(dwg.write([(1, 5, b"")], version)) == {}


def test_other_files(spark):
    files = spark.createDataFrame([("new", b"AC1032" + bytes(200)), ("none", b""), ("null", None), ("no map", b"AC1015" + bytes(200))], "doc_id string, content binary")
    assert {(r["doc_id"], r["reason"], r["n"]) for r in dwg.skipped(files).collect()} == {("new", "no decoder for this release", 1), ("none", "no decoder for this release", 1)}
    assert dwg.entities(files).count() == dwg.layers(files).count() == 0


def test_rows_that_cannot_be_written(spark, drawing):
    e = json_drawings.entities(drawing).where("handle IN (1, 2)")
    odd = e.withColumn("type_name", F.when(F.col("handle") == 1, "3DSOLID").otherwise(F.col("type_name")))
    r = dwg_sink.write(odd, json_drawings.layers(drawing), json_drawings.blocks(drawing)).first()
    files = spark.createDataFrame([r], "doc_id string, content binary, left_out long")
    assert r["left_out"] == 1 and [x["handle"] for x in dwg.entities(files).collect()] == [2]


def _long(spark, n):
    """A drawing of old-style polylines, inserts with attributes and circles, its handles over several pieces."""
    e = spark.range(1, n + 1).selectExpr(
        "'d' AS doc_id", "id * 9 AS handle", "element_at(array('POLYLINE_2D', 'INSERT', 'ATTRIB', 'CIRCLE'), CAST(id % 4 + 1 AS INT)) AS type_name", "'model' AS space",
        "CASE WHEN id % 4 = 2 THEN (id - 1) * 9 ELSE 0L END AS owner", "1L AS layer", "transform(sequence(1, CASE WHEN id % 4 = 0 THEN 3 ELSE 1 END), k -> struct(CAST(id AS DOUBLE) AS x, CAST(k AS DOUBLE) AS y)) AS points",
        "2.5D AS radius", "CASE WHEN id % 4 = 2 THEN 'v' END AS text", "CASE WHEN id % 4 = 1 THEN 5L END AS block", "1D AS sx", "1D AS sy",
    )
    kinds = {f.name: f.dataType for f in StructType.fromDDL(ENTITIES)}
    e = e.withColumns({c: F.lit(None).cast(kinds.get(c, "int")) for c in dwg_sink.ROW if c not in e.columns and c not in tessellate.OPTIONAL})
    layers = spark.createDataFrame([("d", 10**9, "L", 3)], "doc_id string, layer_handle bigint, name string, aci int")
    return e, layers, spark.createDataFrame([], "doc_id string, block_handle bigint, name string")


@pytest.mark.parametrize("version", dwg.DECODED)
def test_writer_in_pieces(spark, version):
    """No task of the writer holds more than a piece; what the pieces hold reads back whole, with handles of its own each."""
    e, layers, blocks = _long(spark, 8_000)
    pieces = dwg_sink.pieces(e, layers, blocks, version=version).where("later = 0").select(F.size("handles").alias("n")).collect() if version == "AC1015" else [(2,)] * 2
    assert len(pieces) > 1 and max(r[0] for r in pieces) < 8_000
    content, left = dwg_sink.write(e, layers, blocks, version=version).first()[1:]
    rows = list(dwg.rows(content))
    assert left == 0 and len({r["handle"] for r in rows}) == len(rows) == 8_001 + 2_000 * 4 + 2_000
    assert all(r["kind"] != "error" for r in rows) and [r["handle"] for r in rows] == sorted(r["handle"] for r in rows)
    assert {r["handle"]: r["points"][0]["x"] for r in rows if r["type_name"] == "CIRCLE"} == {9 * k: float(k) for k in range(3, 8_001, 4)}
    assert {r["owner"] for r in rows if r["type_name"] == "SEQEND"} == {9 * k for k in range(1, 8_001) if k % 4 < 2}


def test_runs_of_a_file(spark):
    """A file's records are decoded in runs of bounded size, dealt over the tasks."""
    rows = [(3 * k, records.TYPE_CODES["ENDBLK"], records.write({"type_name": "ENDBLK", "handle": 3 * k})) for k in range(1, 12_001)]
    content = dwg.write([*rows, (40_000, 500, b"abc")])
    assert [len(r["seqs"]) for r in dwg.runs(content)] == [dwg.RUN_RECORDS] * 2 + [2_001]
    files = spark.createDataFrame([("d", content)], "doc_id string, content binary")
    got = dwg.decoded(files).select("handle", "seq", "kind", F.spark_partition_id().alias("p")).collect()
    assert sorted((r["seq"], r["handle"]) for r in got) == [*enumerate(h for h, _, _ in rows), (12_000, 40_000)]
    assert len({r["p"] for r in got}) > 1 and [r["seq"] for r in got if r["kind"] == "error"] == [12_000]
