"""Binary drawings as tables of bytes: version, section directory, object map and record frames.

Files are read as rows of bytes. One task walks a file's object map and cuts its records out in runs of bounded size;
these are dealt over all tasks, decoded a run at a time, and rows leave typed. The
directory and map of the uncompressed container family are read; of the other families the version and the unmasked
header. Of R2000 and R2004 files the records are decoded to the rows that JSON exports give; a record that cannot be decoded is an
error row, never a lost file.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import batched
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.text import codec, version_name
from ..schema import P2
from . import dwg_records as records
from . import paged
from .bits import BitReader, BitWriter, crc16, object_map
from .json_drawings import with_vertices

#: Releases whose container is the uncompressed section directory, and the directory's place.
PLAIN = ("AC1012", "AC1014", "AC1015")
DIRECTORY_AT = 0x15
#: The releases whose records are decoded, and the names of the sections that hold objects and their map.
DECODED = ("AC1015", "AC1018")
OBJECTS_SECTION, MAP_SECTION, CLASSES_SECTION = "AcDb:AcDbObjects", "AcDb:Handles", "AcDb:Classes"
CLASSES_MARK = bytes.fromhex("8da1c4b8c4a9f8c5c0dcf45fe7cfb68a")
ROWS_PER_BATCH = 5_000
#: Records and bytes of a run, at most; a larger record has a run of its own.
RUN_RECORDS, RUN_BYTES = 5_000, 1 << 20
#: Records cut out of a file: ``body`` holds those to decode, ``ends`` where each ends in it; the others have a reason.
RUNS = "doc_id string, version string, page string, seqs array<int>, handles array<bigint>, names array<string>, reasons array<string>, ends array<int>, body binary"
#: Rows of every kind of record; ``kind`` is entity, object or error.
DECODED_ROWS = f"""doc_id string, seq int, kind string, type_name string, handle bigint, space string, owner bigint, layer bigint,
 color_index int, true_color bigint, points array<{P2}>, radius double, a0 double, a1 double, bulges array<double>, closed boolean,
 text string, tag string, height double, rotation double, block bigint, sx double, sy double, axis {P2}, ratio double, degree int,
 knots array<double>, control array<{P2}>, weights array<double>, turns double,
 paths array<struct<points:array<{P2}>,bulges:array<double>>>, name string, keys array<string>, items array<bigint>, reason string"""


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, content)."""
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("doc_id"), "content")


def drawings(files: DataFrame) -> DataFrame:
    code = F.decode(F.substring("content", 1, 6), "ISO-8859-1")
    page = F.conv(F.hex(F.concat(F.substring("content", 0x15, 1), F.substring("content", 0x14, 1))), 16, 10).cast("int")
    return files.select("doc_id", F.lit("dwg").alias("source"), F.when(code.rlike(r"^AC10\d\d$"), version_name(code)).alias("version"), page.alias("codepage"))


def sections(data: bytes) -> dict[int, tuple[int, int]]:
    """Number to (offset, size) of the plain container."""
    if str(data[:6], "latin-1") not in PLAIN:
        return {}
    r = BitReader(data, 8 * DIRECTORY_AT)
    return {r.u8(): (r.u32(), r.u32()) for _ in range(r.u32())}


def map_chunks(data: bytes, at: int, size: int) -> Iterator[bytes]:
    """Chunks of the object map: big-endian size that counts itself, payload, checksum; a size of two ends it."""
    end = at + size
    while at + 2 <= end:
        n = int.from_bytes(data[at : at + 2], "big")
        if n <= 2 or at + n > end:
            return
        yield data[at + 2 : at + n]
        at += n + 2


def stores(data: bytes) -> tuple[bytes, bytes]:
    """(object map, bytes that its offsets point into); empty for files without them. A damaged paged file raises."""
    if str(data[:6], "latin-1") in paged.PAGED:
        parts = paged.sections(bytes(data))
        return parts.get(MAP_SECTION, b""), parts.get(OBJECTS_SECTION, b"")
    at, size = sections(data).get(2, (0, 0))
    return bytes(data[at : at + size]), data


def class_names(data: bytes) -> dict[int, str]:
    """Type code to class name, of the types that a file defines itself; empty for a file without the section.

    An entry cut off by the section's end ends the list. A section without its mark raises.
    """
    is_paged = str(data[:6], "latin-1") in paged.PAGED
    at, size = sections(data).get(1, (0, 0))
    content = paged.sections(bytes(data)).get(CLASSES_SECTION, b"") if is_paged else bytes(data[at : at + size])
    if not content:
        return {}
    if not content.startswith(CLASSES_MARK):
        raise ValueError("no classes")
    r, out = BitReader(content, 8 * len(CLASSES_MARK)), {}
    r.end = min(r.end, r.at + 32 + 8 * r.u32())
    if is_paged:
        r.short(), r.u8(), r.u8(), r.flag()  # the largest number and three fixed fields
    try:
        while r.at + 8 < r.end:
            code, _, _, _, name = r.short(), r.short(), r.text(), r.text(), r.text()
            r.flag(), r.short()
            if is_paged:
                for _ in range(5):  # objects, version, maintenance release and two fixed fields
                    r.long()
            if name:
                out[code] = name
    except ValueError:
        pass
    return out


def classes(files: DataFrame) -> DataFrame:
    """(doc_id, type_code, name): the classes of each file, for ``operators.resolve.with_type_name``. Files of releases
    whose records are not decoded, and damaged sections, give none."""

    def run(batches):
        for b in batches:
            for doc, data in zip(b.column(0).to_pylist(), b.column(1)):
                content = data.as_py() or b""
                try:
                    names = class_names(content) if str(content[:6], "latin-1") in DECODED else {}
                except ValueError:
                    names = {}
                yield pa.RecordBatch.from_arrays([pa.array([doc] * len(names), pa.string()), pa.array(list(names), pa.int64()), pa.array(list(names.values()), pa.string())], names=["doc_id", "type_code", "name"])

    return files.select("doc_id", "content").mapInArrow(run, "doc_id string, type_code long, name string")


def places(chunks: bytes) -> Iterator[tuple[int, int]]:
    """(handle, offset) of each object of a map."""
    for chunk in map_chunks(chunks, 0, len(chunks)):
        yield from object_map(chunk)


def frame(data: bytes, offset: int) -> tuple[int, int]:
    """(size, type code) of the record at an offset; one that leaves the file raises."""
    r = BitReader(data, 8 * offset)
    size = r.modular_short()
    kind = r.short()
    if offset + size > len(data):
        raise ValueError(f"record of {size} bytes at {offset} of {len(data)}")
    return size, kind


def frames(data: bytes) -> Iterator[tuple[int, int, int, int]]:
    """(handle, offset, size, type code) of each object; a record that leaves the file is left out."""
    try:
        chunks, body = stores(data)
    except ValueError:
        return
    for handle, offset in places(chunks):
        try:
            size, kind = frame(body, offset)
        except ValueError:
            continue
        yield handle, offset, size, kind


def objects(files: DataFrame) -> DataFrame:
    """(doc_id, handle, offset, size, type_code)."""
    names = ["doc_id", "handle", "offset", "size", "type_code"]

    def run(batches):
        for b in batches:
            for doc, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                cols = list(zip(*frames(data or b""))) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array([doc] * len(cols[0]), pa.string()), *[pa.array(c, pa.int64()) for c in cols]], names=names)

    return files.select("doc_id", "content").mapInArrow(run, "doc_id string, handle long, offset long, size long, type_code long")


def _pairs(points: list[tuple] | None) -> list[dict[str, float]] | None:
    return None if points is None else [{"x": p[0], "y": p[1]} for p in points]


def row(f: dict[str, Any]) -> dict[str, Any]:
    """The row of one record's fields, with the meanings of the JSON exports' rows."""
    name = f["type_name"]
    indices = sorted(int(k[1:]) for k in f if k[0] == "x" and k[1:].isdigit())
    points = [(f[f"x{i}"], f[f"y{i}"]) for i in indices]
    if name in records.DIMENSIONS:
        points = [(f[f"x{i}"], f[f"y{i}"]) for i in indices if i < 4]
    turn = math.atan2(f["direction"][1], f["direction"][0]) if name == "MTEXT" else f.get("rotation") or 0.0
    closed = f.get("flags", 0) & (512 if name == "LWPOLYLINE" else 1)
    out = {k: f.get(k) for k in ("handle", "owner", "layer", "color_index", "radius", "a0", "a1", "bulges", "text", "tag", "height", "block", "ratio", "degree", "knots", "weights", "name", "keys", "items", "true_color")}
    axis = f.get("axis")
    out["block"] = out["block"] or None  # a null reference
    if name in records.DIMENSIONS:
        out["text"] = out["text"] or None  # the measured value is shown
    return out | {
        "kind": "object" if name in records.OBJECTS else "entity",
        "type_name": "INSERT" if name == "MINSERT" else "DIMENSION" if name in records.DIMENSIONS else name,
        "space": "paper" if f["mode"] == 1 else "block" if f["mode"] == 0 and f["owner"] else "model",
        "points": _pairs(points) if points else None, "closed": bool(closed), "rotation": turn, "sx": f.get("sx", 1.0), "sy": f.get("sy", 1.0),
        "bulges": [f["bulge"]] if "bulge" in f else f.get("bulges"),
        "axis": _pairs([axis])[0] if axis else None, "control": _pairs(f.get("control")),
        "paths": None if "paths" not in f else [{"points": _pairs(p), "bulges": b} for p, b in f["paths"]],
    }


def runs(data: bytes, kinds: frozenset[str] | None = None) -> Iterator[dict[str, Any]]:
    """The records of a file as rows of ``RUNS`` (without doc_id): those of the types asked for (default: all), and with a
    reason each one that cannot be cut out or has no decoder; for a file that cannot be read, the reason without a place."""
    version = str(data[:6], "latin-1")
    page = codec(int.from_bytes(data[0x13:0x15], "little"))

    def run() -> dict[str, Any]:
        return {"version": version, "page": page, "seqs": [], "handles": [], "names": [], "reasons": [], "ends": [], "body": bytearray()}

    def add(r: dict[str, Any], seq: int | None, handle: int | None, name: str | None, reason: str | None, record: bytes = b"") -> None:
        r["body"] += record
        for k, v in (("seqs", seq), ("handles", handle), ("names", name), ("reasons", reason), ("ends", len(r["body"]))):
            r[k].append(v)

    out = run()
    if version not in DECODED:
        add(out, None, None, None, "no decoder for this release")
        yield out
        return
    try:
        chunks, body = stores(data)
    except ValueError:
        add(out, None, None, None, "damaged container")
        yield out
        return
    try:
        own = class_names(data)
    except ValueError:
        own = {}
    for seq, (handle, offset) in enumerate(places(chunks)):
        name = None
        try:
            r = BitReader(body, 8 * offset)
            size, code = r.modular_short(), frame(body, offset)[1]
            name = records.NAMES.get(code)
            if name is None:
                add(out, seq, handle, own.get(code), f"no decoder for type {code}")
            elif kinds is None or name in kinds:
                add(out, seq, handle, name, None, body[offset : (r.at >> 3) + size])
        except ValueError:
            add(out, seq, handle, name, "damaged record")
        if len(out["seqs"]) >= RUN_RECORDS or len(out["body"]) >= RUN_BYTES:
            yield out
            out = run()
    if out["seqs"]:
        yield out


def run_rows(run: dict[str, Any]) -> Iterator[dict[str, Any]]:
    """A row for each record of a run, and an error row for each that is not decoded."""
    at = 0
    for seq, handle, name, reason, end in zip(*(run[k] for k in ("seqs", "handles", "names", "reasons", "ends"))):
        if reason is None:
            try:
                yield row(records.read(bytes(run["body"][at:end]), 0, run["page"], run["version"])) | {"seq": seq}
            except ValueError:
                reason = "damaged record"
        if reason is not None:
            yield {"kind": "error", "reason": reason, "handle": handle, "type_name": name} | ({} if seq is None else {"seq": seq})
        at = end


def rows(data: bytes, kinds: frozenset[str] | None = None) -> Iterator[dict[str, Any]]:
    """A row for each record of the types asked for (default: all), and an error row for each that is not decoded."""
    for run in runs(data, kinds):
        yield from run_rows(run)


def decoded(files: DataFrame, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """Rows of ``DECODED_ROWS`` for the records of each file (doc_id, content); null content has none."""
    schema, run_schema = (to_arrow_schema(StructType.fromDDL(d)) for d in (DECODED_ROWS, RUNS))
    wanted = None if kinds is None else frozenset(kinds)

    def cut_out(batches):
        for b in batches:
            for doc, data in zip(b.column(0).to_pylist(), b.column(1)):
                for run in runs(memoryview(data.as_buffer()), wanted) if data.is_valid else ():  # not copied
                    yield pa.RecordBatch.from_pylist([{"doc_id": doc} | run | {"body": bytes(run["body"])}], run_schema)

    def decode(batches):
        for b in batches:
            for i in range(b.num_rows):
                run = b.slice(i, 1).to_pylist()[0]
                for part in batched(({"doc_id": run["doc_id"]} | r for r in run_rows(run)), ROWS_PER_BATCH):
                    yield pa.RecordBatch.from_pylist(list(part), schema)

    dealt = files.select("doc_id", "content").mapInArrow(cut_out, RUNS).repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return dealt.mapInArrow(decode, DECODED_ROWS)


def entities(files: DataFrame) -> DataFrame:
    """Entity rows as JSON exports give them: vertices joined to their polylines, block ends and markers left out."""
    vertices = ("VERTEX_2D", "VERTEX_3D", "VERTEX_MESH", "VERTEX_PFACE")
    left_out = (*records.OBJECTS, *vertices, "BLOCK", "ENDBLK")
    e = decoded(files, tuple(k for k in records.TYPE_CODES if k not in left_out)).where("kind = 'entity'")
    v = decoded(files, vertices).where("kind = 'entity'")
    v = v.select("doc_id", "owner", "seq", F.get("points", 0).alias("p"), F.coalesce(F.get("bulges", 0), F.lit(0.0)).alias("b"))
    return with_vertices(e.drop("kind", "name", "keys", "items", "reason"), v)


def layers(files: DataFrame) -> DataFrame:
    return decoded(files, ("LAYER",)).where("type_name = 'LAYER' AND kind = 'object'").select("doc_id", F.col("handle").alias("layer_handle"), "name", F.col("color_index").alias("aci"), "true_color")


def blocks(files: DataFrame) -> DataFrame:
    return decoded(files, ("BLOCK_HEADER",)).where("type_name = 'BLOCK_HEADER' AND kind = 'object'").select("doc_id", F.col("handle").alias("block_handle"), "name")


def dictionaries(files: DataFrame) -> DataFrame:
    """(doc_id, dict_handle, pos, key, item_handle)."""
    d = decoded(files, ("DICTIONARY",)).where("type_name = 'DICTIONARY' AND kind = 'object'")
    return d.select("doc_id", F.col("handle").alias("dict_handle"), F.posexplode(F.arrays_zip("keys", "items")).alias("pos", "e")).select("doc_id", "dict_handle", "pos", F.col("e.keys").alias("key"), F.col("e.items").alias("item_handle"))


def decode_errors(files: DataFrame) -> DataFrame:
    """(doc_id, seq, handle, type_name, reason): files and records that reading skips."""
    return decoded(files).where("kind = 'error'").select("doc_id", "seq", "handle", "type_name", "reason")


def skipped(files: DataFrame) -> DataFrame:
    """(doc_id, reason, n)."""
    return decode_errors(files).groupBy("doc_id", "reason").agg(F.count("*").alias("n"))


def framed(kind: int, payload: bytes) -> bytes:
    """A record with its size and checksum."""
    w, n = BitWriter(), BitWriter()
    w.short(kind)
    w.raw(payload)
    data = w.done()
    n.modular_short(len(data))
    return n.done() + data + crc16(data).to_bytes(2, "little")


def first_offset(version: str) -> int:
    """Where the object map puts the first record: after the directory of two, or at the start of its section."""
    return 0 if version in paged.PAGED else DIRECTORY_AT + 4 + 9 * 2


def container(bodies: list[Any], maps: list[Any], version: str = "AC1015", codepage: int = 30, own: dict[int, str] | None = None) -> bytes:
    """A file of framed records and parts of their object map, each a list of bytes in order, and the names of classes;
    plain or paged by the version."""
    is_paged = version in paged.PAGED
    maps, named = [*maps, b"\0\2"], _class_bytes(own or {}, is_paged)
    if is_paged:
        return paged.write({OBJECTS_SECTION: b"".join(bodies), MAP_SECTION: b"".join(maps), CLASSES_SECTION: named}, version, codepage)
    head = bytearray(version.encode().ljust(DIRECTORY_AT, b"\0"))
    head[0x13:0x15] = codepage.to_bytes(2, "little")
    at = first_offset(version) + sum(map(len, bodies))
    listed = b"".join(bytes([n]) + at.to_bytes(4, "little") + size.to_bytes(4, "little") for n, at, size in ((1, at, len(named)), (2, at + len(named), sum(map(len, maps)))))
    return b"".join([head, (2).to_bytes(4, "little"), listed, *bodies, named, *maps])


def write(contents: list[tuple[int, int, bytes]], version: str = "AC1015", codepage: int = 30, own: dict[int, str] | None = None) -> bytes:
    """A container with records (handle, type code, payload), their object map and the names of classes, plain or paged
    by the version."""
    bodies, starts, at = [], [], first_offset(version)
    for handle, kind, payload in sorted(contents):
        bodies.append(framed(kind, payload))
        starts.append((handle, at))
        at += len(bodies[-1])
    return container(bodies, [map_part(starts)], version, codepage, own)


def _class_bytes(own: dict[int, str], is_paged: bool) -> bytes:
    if not own:
        return b""
    w = BitWriter()
    if is_paged:
        w.short(max(own))
        w.u8(0)
        w.u8(0)
        w.flag(True)
    for code, name in own.items():
        w.short(code)
        w.short(0)
        for text in ("ObjectDBX Classes", "", name):
            w.text(text)
        w.flag(False)
        w.short(0x1F3)  # fixed value: a class of objects
        for _ in range(5 if is_paged else 0):
            w.long(0)
    content = w.done()
    return CLASSES_MARK + len(content).to_bytes(4, "little") + content


def map_part(starts: list[tuple[int, int]]) -> bytes:
    """Chunks of an object map, each with sums of its own and of fewer than 2,000 bytes; the empty one ends a map."""
    out, at = bytearray(), 0
    while at < len(starts):
        m, last = BitWriter(), (0, 0)
        while at < len(starts) and m.at < 8 * 2_000:
            handle, offset = starts[at]
            m.modular(handle - last[0])
            m.modular(offset - last[1], signed=True)
            last, at = (handle, offset), at + 1
        chunk = m.done()
        sized = (len(chunk) + 2).to_bytes(2, "big") + chunk
        out += sized + crc16(sized).to_bytes(2, "big")
    return bytes(out)
