"""Sources of drawings, chosen by file name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import dwg, dxf, dxf_binary, json_drawings

#: What a file name's ending says of its format; others are binary drawings.
ENDINGS = {".dxf": "dxf", ".dxfb": "dxf_binary", ".json": "json"}


def kind_of(name: str) -> str:
    return next((k for e, k in ENDINGS.items() if name.lower().endswith(e)), "dwg")


def read(spark: SparkSession, path: str) -> DataFrame:
    """What a file or folder of one format holds: pairs of DXF, documents of JSON."""
    kind = kind_of(path.rstrip("/"))
    if kind == "dxf":
        return dxf.pairs(dxf.read_bytes(spark, path))
    if kind == "dxf_binary":
        return dxf_binary.read(spark, path)
    if kind == "json":
        return json_drawings.read(spark, path)
    return dwg.read(spark, path)
