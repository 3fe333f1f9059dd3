import struct

from hypothesis import given, settings
from hypothesis import strategies as st

from draftlake.sources import dwg
from draftlake.sources.bits import BitReader, BitWriter, crc16, key_stream, object_map, page_checksum, resolve_handle, unmask

u16, u32, u64 = (st.integers(0, (1 << n) - 1) for n in (16, 32, 56))
doubles = st.floats(allow_nan=False)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 7), u16, u32, u64, doubles, doubles, st.integers(-(1 << 40), 1 << 40), st.text(st.characters(max_codepoint=255, min_codepoint=1), max_size=9))
def test_codecs(shift, a, b, c, x, y, signed, text):
    """Whatever is written reads back, at any bit offset."""
    w = BitWriter()
    w.bits(0, shift)
    for name, *args in (("u16", a), ("u32", b), ("u64", c), ("f64", x), ("short", a), ("long", b), ("long_long", c), ("double", x), ("double_from", x, y), ("thickness", x), ("extrusion", (x, y, 1.0)), ("handle", 5, c), ("modular_short", b), ("modular", c), ("modular", signed, True), ("text", text), ("unicode", text)):
        getattr(w, name)(*args)
    r = BitReader(w.done(), shift)
    assert (r.u16(), r.u32(), r.u64(), r.f64(), r.short(), r.long(), r.long_long(), r.double()) == (a, b, c, x, a, b, c, x)
    assert struct.pack("<d", r.double_from(y)) == struct.pack("<d", x)
    assert (r.thickness(), r.extrusion(), r.handle(), r.modular_short(), r.modular(), r.modular(True)) == (x, (x, y, 1.0), (5, c), b, c, signed)
    assert (r.text(), r.unicode()) == (text.rstrip("\0"), text)


def test_checksums_and_keys():
    assert crc16(b"123456789", 0) == 0xBB3D and page_checksum(b"a") == 97 << 16 | 97
    assert unmask(unmask(b"header bytes")) == b"header bytes" and len(key_stream(256)) == 256
    assert [resolve_handle(c, 3, 10) for c in (2, 6, 8, 10, 12)] == [3, 11, 9, 13, 7]


def test_object_map_drops_bad_pairs():
    w = BitWriter()
    for dh, do in ((5, 100), (1, -500), (2, 20)):
        w.modular(dh)
        w.modular(do, True)
    assert object_map(w.done()) == [(5, 100), (7, 120)]


def test_container(spark, tmp_path):
    rows = [(k, 19 + k % 3, bytes(range(k))) for k in range(1, 60)]
    (tmp_path / "a.dwg").write_bytes(dwg.write(rows, codepage=39))
    (tmp_path / "b.dwg").write_bytes(b"AC1032" + bytes(100))
    (tmp_path / "c.dwg").write_bytes(b"no drawing")
    files = dwg.read(spark, str(tmp_path))
    info = {r["doc_id"]: (r["version"], r["codepage"]) for r in dwg.drawings(files).collect()}
    assert info["a.dwg"] == ("R2000", 39) and info["b.dwg"][0] == "R2018" and info["c.dwg"][0] is None
    got = sorted((r["handle"], r["type_code"]) for r in dwg.objects(files).collect())
    assert got == [(k, t) for k, t, _ in rows]
