"""Codecs, code pages, flattening and dispatch."""

import json
import random

import pytest
from pyspark.sql import functions as F

from draftlake import sources
from draftlake.functions.text import decode_codepage
from draftlake.sinks import dump
from draftlake.sources import dxf, json_drawings, lz77


def test_lz77_round_trip():
    r = random.Random(4)
    cases = [b"abcd", b"a" * 5000, bytes(range(256)) * 3, b"\0" * 70_000, r.randbytes(4000)]
    cases += [b"".join(r.choice([b"line ", b"circle", b"\0\0\0\0", r.randbytes(r.randint(1, 30))]) for _ in range(r.randint(1, 900))) + b"tail" for _ in range(60)]
    block = r.randbytes(300)
    cases.append(block + r.randbytes(20_000) + block + r.randbytes(14_000) + block[:100] + block)
    for data in cases:
        packed = lz77.compress(data)
        assert lz77.decompress(packed, len(data)) == data
    assert len(lz77.compress(b"a" * 5000)) < 40 and lz77.decompress(lz77.compress(b"abcdefgh"), 12) == b"abcdefgh\0\0\0\0"


def test_lz77_known_streams():
    """Streams written out by hand from the format's description."""
    assert lz77.decompress(bytes([0x01]) + b"abcd" + bytes([0x5C, 0x00, 0x11, 0, 0]), 8) == b"abcdabcd"  # four bytes from four back
    assert lz77.decompress(bytes([0x01]) + b"abcd" + bytes([0x5D, 0x00]) + b"X" + bytes([0x11, 0, 0]), 9) == b"abcdabcdX"
    assert lz77.decompress(bytes([0x01]) + b"abcd" + bytes([0x22, 0x0C, 0x00, 0x11, 0, 0]), 8) == b"abcdabcd"


@pytest.mark.parametrize("bad", [b"", b"\x01abc", b"\x01abcd\x05", b"\x01abcd\x5f\xff", b"\x01abcd\x5c\x40\x11"])
def test_lz77_bad_streams(bad):
    with pytest.raises(lz77.BadStream):
        lz77.decompress(bad, 10)


def test_code_pages(spark, tmp_path):
    rows = [("测试".encode("gbk"), 31, "测试"), ("é".encode("latin-1"), 30, "é"), ("测".encode(), 0, "测"), (b"", 31, ""), (None, 31, None)]
    got = spark.createDataFrame([(bytearray(b) if b is not None else None, p) for b, p, _ in rows], "b binary, p int").select(decode_codepage("b", "p").alias("t")).collect()
    assert [r["t"] for r in got] == [t for *_, t in rows]
    head = "0\nSECTION\n2\nHEADER\n9\n$ACADVER\n1\n%s\n9\n$DWGCODEPAGE\n3\nANSI_936\n0\nENDSEC\n0\nSECTION\n2\nENTITIES\n0\nTEXT\n1\n测试图\n0\nENDSEC\n0\nEOF"
    (tmp_path / "old.dxf").write_bytes((head % "AC1015").encode("gbk"))
    (tmp_path / "new.dxf").write_bytes((head % "AC1027").encode())
    e = dxf.entities(dxf.records(dxf.pairs(dxf.read_bytes(spark, str(tmp_path)))))
    assert {(r["doc_id"], r["text"]) for r in e.collect()} == {("old.dxf", "测试图"), ("new.dxf", "测试图")}
    assert sources.read(spark, str(tmp_path / "old.dxf")).where("raw = '测试图'").count() == 1
    assert [sources.kind_of(n) for n in ("a.DXF", "a.dxfb", "a.json", "a.dwg", "a")] == ["dxf", "dxf_binary", "json", "dwg", "dwg"]


def test_flatten(spark):
    v = {"a": 1, "b": {"c": [1.5, {"d": "x"}], "e": None, "f": []}, "paths": [{"pts": [[1, 2], [3, 4]]}]}
    rows = spark.createDataFrame([(1, json.dumps(v)), (2, "[7]"), (3, "null")], "id int, t string").select("id", F.parse_json("t").alias("v"))
    flat = dump.flatten(rows, "id")
    got = {(r["id"], r["path"]): r["value"] for r in flat.collect()}
    assert got == {(1, "a"): "1", (1, "b.c[0]"): "1.5", (1, "b.c[1].d"): "x", (1, "paths[0].pts[0][0]"): "1", (1, "paths[0].pts[0][1]"): "2", (1, "paths[0].pts[1][0]"): "3", (1, "paths[0].pts[1][1]"): "4", (2, "[0]"): "7"}
    keys = spark.createDataFrame([("paths[i].pts[j][k]",), ("a",), ("missing",)], "pattern string")
    assert sorted(r["value"] for r in dump.expected_keys(flat, keys).collect()) == ["1", "1", "2", "3", "4"]


def test_decode_errors(spark):
    raw = spark.createDataFrame([("a", "{"), ("b", '{"OBJECTS": [{"handle": 1}, {"entity": "LINE"}, {"entity": "LINE", "handle": 2}]}')], "doc_id string, value string")
    got = sorted((r["doc_id"], r["reason"], r["n"]) for r in json_drawings.skipped(json_drawings.parse(raw)).collect())
    assert got == [("a", "not JSON", 1), ("b", "no handle", 1), ("b", "no type", 1)]
