"""Writer of binary drawings: entity, layer and block rows to R2000 or R2004 records and their container.

Rows are encoded in pieces of neighbouring handles, so a task holds the records of one piece; only bytes meet in the task
that puts a drawing's file together, as the file is one value (of fewer than 2 GB). The container holds the object map and the records, which is
what this library's reader needs; the header variables and classes that a drawing program asks for are not written.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable
from itertools import accumulate
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.text import codec
from ..operators.expand import cut
from ..operators.tessellate import complete
from ..sources import dwg
from ..sources import dwg_records as records

ROW = (
    "type_name", "handle", "space", "owner", "layer", "color_index", "true_color", "points", "radius", "a0", "a1", "bulges", "closed", "text", "tag", "height", "rotation",
    "block", "sx", "sy", "axis", "ratio", "degree", "knots", "control", "weights", "paths",
)
#: A piece holds the records of 2^14 neighbouring handles; ``later`` marks vertices and sequence ends, which follow all others.
PIECE_BITS = 14
PIECES = "doc_id string, later int, piece bigint, handles array<bigint>, sizes array<int>, body binary, left_out bigint"
MODES = {"block": 0, "paper": 1, "model": 2}
#: Points that a type's record needs.
LEAST = {"LINE": 2, "RAY": 2, "XLINE": 2, "SOLID": 4, "TRACE": 4, "3DFACE": 4, "DIMENSION": 4, "SPLINE": 0, "HATCH": 0, "POLYLINE_2D": 0, "LWPOLYLINE": 0, "SEQEND": 0}


def _xy(points: list | None) -> list[tuple[float, float]]:
    return [(p["x"], p["y"]) for p in points or ()]


def fields(row: dict[str, Any]) -> dict[str, Any] | None:
    """The record fields of an entity row; None for a type without a layout, or with too few points or without a place."""
    name = "DIM_LINEAR" if row["type_name"] == "DIMENSION" else row["type_name"]
    points = _xy(row["points"])
    if name not in records.LAYOUTS or name in records.OBJECTS or len(points) < LEAST.get(row["type_name"], 1):
        return None
    if any(v is None for p in points for v in p):
        return None
    f = {k: row[k] for k in ROW if row[k] is not None and k not in ("points", "paths", "axis", "control", "space")}
    if name in ("POLYLINE_2D", "POLYLINE_3D"):
        points = []  # their vertices are records
    f |= {"type_name": name, "mode": MODES.get(row["space"], 2)} | {f"{a}{i}": v for i, p in enumerate(points) for a, v in zip("xy", p)}
    if row["axis"]:
        f["axis"] = (row["axis"]["x"], row["axis"]["y"], 0.0)
    if row["control"]:
        f["control"] = _xy(row["control"])
    if row["paths"] is not None:
        f["paths"] = [(_xy(p["points"]), p["bulges"]) for p in row["paths"]]
    return f


def encoded(rows: Iterable[dict[str, Any]], objects: Iterable[dict[str, Any]], attribs: dict[int, list[int]], free: int, page: int = 30, version: str = "AC1015") -> tuple[list, list, int]:
    """(records, records of vertices and sequence ends, number of rows left out); a record is (handle, framed bytes).

    Rows without a positive handle are left out. Vertices and sequence ends take handles from ``free`` on; ``attribs`` has
    the first and last attribute of an insert.
    """
    out, extra, left, text = [], [], 0, codec(page)

    def add(to: list, f: dict[str, Any]) -> None:
        kind = records.TYPE_CODES[f["type_name"]]
        to.append((f["handle"], kind, dwg.framed(kind, records.write(f, text, version))))

    for r in rows:
        f = fields(r) if (r["handle"] or 0) > 0 else None
        if f is None:
            left += 1
            continue
        parts = []
        if f["type_name"] in ("POLYLINE_2D", "POLYLINE_3D"):
            flat = f["type_name"] == "POLYLINE_2D"
            bulges = f.pop("bulges", None) or []
            for i, (x, y) in enumerate(_xy(r["points"])):
                parts.append(free)
                add(extra, {"type_name": "VERTEX_2D" if flat else "VERTEX_3D", "handle": free, "mode": 0, "owner": f["handle"], "layer": f.get("layer"), "x0": x, "y0": y, "bulge": bulges[i] if i < len(bulges) else 0.0})
                free += 1
        elif f["type_name"] == "INSERT":
            parts = attribs.get(f["handle"], [])
            f["has_attribs"] = bool(parts)
        if parts:
            f["parts"] = [parts[0], parts[-1], free]
            add(extra, {"type_name": "SEQEND", "handle": free, "mode": 0, "owner": f["handle"], "layer": f.get("layer")})
            free += 1
        add(out, f)
    for f in objects:
        if (f["handle"] or 0) <= 0:
            left += 1
        else:
            add(out, {k: v for k, v in f.items() if v is not None})
    return *([(h, data) for h, _, data in sorted(part)] for part in (out, extra)), left


def pieces(entities: DataFrame, layers: DataFrame, blocks: DataFrame, page: int = 30, version: str = "AC1015") -> DataFrame:
    """Rows of ``PIECES``: the framed records of each piece of a drawing, by handle."""
    none, shape = F.lit(None), "struct<type_name:string,handle:bigint,name:string,color_index:int>"
    kind = F.col("type_name")
    # handles that a row may need beyond its own
    more = F.when(kind.isin("POLYLINE_2D", "POLYLINE_3D"), F.coalesce(F.size("points"), F.lit(0)) + 1).when(kind == "INSERT", 1).otherwise(0).cast("bigint")
    e = complete(entities).select("doc_id", "handle", more.alias("more"), F.struct(*[F.col(c) for c in ROW]).alias("e"), none.cast(shape).alias("o"))
    y = layers.select("doc_id", F.col("layer_handle").cast("bigint").alias("handle"), F.struct(F.lit("LAYER"), F.col("layer_handle"), F.col("name"), F.col("aci").cast("int")).cast(shape).alias("o"))
    b = blocks.select("doc_id", F.col("block_handle").cast("bigint").alias("handle"), F.struct(F.lit("BLOCK_HEADER"), F.col("block_handle"), F.col("name"), none.cast("int")).cast(shape).alias("o"))
    # rows without a place, which are only counted, stay where they are
    piece = F.when(F.col("handle") > 0, F.shiftright("handle", PIECE_BITS)).otherwise(-1 - F.spark_partition_id()).cast("bigint")
    rows = e.unionByName(y, allowMissingColumns=True).unionByName(b, allowMissingColumns=True).withColumn("piece", piece)
    sums = rows.groupBy("doc_id", "piece").agg(F.sum("more").alias("more"), F.max("handle").alias("top"))
    of = Window.partitionBy("doc_id")
    before = F.coalesce(F.sum("more").over(of.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    frees = sums.select("doc_id", "piece", (F.greatest(F.coalesce(F.max("top").over(of), F.lit(0)), F.lit(0)) + 1 + before).alias("free"), "more").where("more > 0").drop("more")
    a = e.where("e.type_name = 'ATTRIB' AND handle IS NOT NULL AND e.owner > 0").groupBy("doc_id", F.col("e.owner").alias("owner")).agg(F.min("handle").alias("first"), F.max("handle").alias("last"))
    a = a.select("doc_id", F.shiftright("owner", PIECE_BITS).alias("piece"), F.struct("owner", "first", "last").alias("a"))
    both = rows.drop("handle", "more").unionByName(a, allowMissingColumns=True).unionByName(frees, allowMissingColumns=True)

    def encode(key, table):
        attribs = {x["owner"]: [x["first"], x["last"]] for x in table["a"].drop_null().to_pylist()}
        free = max(table["free"].drop_null().to_pylist(), default=0)
        each = lambda c: (r for part in table.select([c]).to_batches(max_chunksize=1_000) for r in part.column(0).drop_null().to_pylist())
        *parts, left = encoded(each("e"), each("o"), attribs, free, page, version)
        rows = [
            {"doc_id": key[0].as_py(), "later": i, "piece": key[1].as_py(), "handles": [h for h, _ in part], "sizes": [len(d) for _, d in part], "body": b"".join(d for _, d in part), "left_out": 0 if i else left}
            for i, part in enumerate(parts) if part or not i
        ]
        return pa.Table.from_pylist(rows, schema)

    schema = to_arrow_schema(StructType.fromDDL(PIECES))
    return both.groupBy("doc_id", "piece").applyInArrow(encode, PIECES)


def write(entities: DataFrame, layers: DataFrame, blocks: DataFrame, page: int = 30, version: str = "AC1015") -> DataFrame:
    """(doc_id, content, left_out): one file a drawing that has any row; true colours need R2004 (AC1018). ``page`` is the code page of its texts, in which
    characters that it lacks become question marks."""

    def mapped(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                handles, sizes, at = (one.column(c).to_pylist()[0] for c in ("handles", "sizes", "at"))
                part = dwg.map_part(list(zip(handles, accumulate(sizes[:-1], initial=at)))) if handles else b""
                yield pa.RecordBatch.from_arrays([*(one.column(c) for c in ("doc_id", "later", "piece", "body", "left_out")), pa.array([part], pa.binary())], names=["doc_id", "later", "piece", "body", "left_out", "map"])

    def assemble(key, table):
        order = table.select(["later", "piece"]).to_pylist()
        order = sorted(range(len(order)), key=lambda i: (order[i]["later"], order[i]["piece"]))
        bodies, maps = ([memoryview(table[c][i].as_buffer()) for i in order] for c in ("body", "map"))
        data = dwg.container(bodies, maps, version, page)
        content = pa.Array.from_buffers(pa.binary(), 1, [None, pa.py_buffer(array("i", [0, len(data)])), pa.py_buffer(data)])  # not copied
        return pa.table([pa.array([key[0].as_py()], pa.string()), content, pa.array([sum(table["left_out"].to_pylist())], pa.int64())], names=["doc_id", "content", "left_out"])

    parts = cut(pieces(entities, layers, blocks, page, version))
    place = Window.partitionBy("doc_id").orderBy("later", "piece").rowsBetween(Window.unboundedPreceding, -1)
    at = parts.select("doc_id", "later", "piece", F.length("body").cast("bigint").alias("size")).select("doc_id", "later", "piece", (F.coalesce(F.sum("size").over(place), F.lit(0)) + dwg.first_offset(version)).alias("at"))
    at = at.select("at", *[F.col(c).alias(f"__{c}") for c in ("doc_id", "later", "piece")])
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in ("doc_id", "later", "piece")]
    placed = parts.join(at, same).drop("__doc_id", "__later", "__piece").mapInArrow(mapped, "doc_id string, later int, piece bigint, body binary, left_out bigint, map binary")
    return placed.groupBy("doc_id").applyInArrow(assemble, "doc_id string, content binary, left_out long")
