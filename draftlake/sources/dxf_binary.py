"""Binary DXF to the same pairs as ASCII DXF; one file is decoded in one task, several per Arrow batch."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: what every binary file starts with.
MAGIC = b"AutoCAD Binary DXF\r\n\x1a\x00"
#: The group codes whose values aren't zero-ended strings, by width and kind.
_KINDS = (
    ((10, 59), "<d"), ((110, 149), "<d"), ((210, 239), "<d"), ((460, 469), "<d"), ((1010, 1059), "<d"),
    ((60, 79), "<h"), ((170, 179), "<h"), ((270, 289), "<h"), ((370, 389), "<h"), ((400, 409), "<h"), ((1060, 1070), "<h"),
    ((90, 99), "<i"), ((420, 429), "<i"), ((440, 459), "<i"), ((1071, 1071), "<i"), ((160, 169), "<q"), ((290, 299), "<B"),
    ((310, 319), "bytes"), ((1004, 1004), "bytes"),
)


def kind_of(code: int) -> str:
    return next((k for (a, b), k in _KINDS if a <= code <= b), "text")


def pairs_of(data: bytes) -> Iterator[tuple[int, str]]:
    """(code, value as text). Codes take two bytes, in old files one; a file that breaks off gives the pairs before."""
    if not data.startswith(MAGIC):
        return
    at = len(MAGIC)
    wide = data[at : at + 2] == b"\0\0"
    while at < len(data):
        if wide:
            if at + 2 > len(data):
                return
            code, at = struct.unpack_from("<H", data, at)[0], at + 2
        else:
            code, at = data[at], at + 1
            if code == 255:
                if at + 2 > len(data):
                    return
                code, at = struct.unpack_from("<H", data, at)[0], at + 2
        kind = kind_of(code)
        if kind == "text":
            end = data.find(b"\0", at)
            if end < 0:
                return
            yield code, data[at:end].decode("utf-8", "replace")
            at = end + 1
        elif kind == "bytes":
            if at >= len(data) or at + 1 + data[at] > len(data):
                return
            yield code, data[at + 1 : at + 1 + data[at]].hex().upper()
            at += 1 + data[at]
        else:
            size = struct.calcsize(kind)
            if at + size > len(data):
                return
            yield code, str(struct.unpack_from(kind, data, at)[0])
            at += size


def encode(pairs: list[tuple[int, str]]) -> bytes:
    out = bytearray(MAGIC)
    for code, value in pairs:
        out += struct.pack("<H", code)
        kind = kind_of(code)
        if kind == "text":
            out += value.encode() + b"\0"
        elif kind == "bytes":
            raw = bytes.fromhex(value)
            out += bytes([len(raw)]) + raw
        else:
            out += struct.pack(kind, float(value) if kind == "<d" else int(value))
    return bytes(out)


def pairs(files: DataFrame) -> DataFrame:
    """(doc_id, idx, code, raw) from rows (doc_id, content); files without the magic give none."""

    def run(batches):
        for b in batches:
            for doc, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows = list(pairs_of(data or b""))
                yield pa.RecordBatch.from_arrays([pa.array([doc] * len(rows), pa.string()), pa.array(range(len(rows)), pa.int64()), pa.array([c for c, _ in rows], pa.int32()), pa.array([v for _, v in rows], pa.string())], names=["doc_id", "idx", "code", "raw"])

    return files.select("doc_id", "content").mapInArrow(run, "doc_id string, idx long, code int, raw string")


def read(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(path)
    return pairs(files.select(F.element_at(F.split("path", "/"), -1).alias("doc_id"), "content"))
