"""Structured JSON exports of drawings as tables.

A file is one drawing: HEADER, FILEHEADER and OBJECTS, whose members carry ``entity`` or ``object``. Everything is read
from a VARIANT, so unknown keys cost nothing and a missing key is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import version_name


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, v): one row a file, bare nan as null, doc_id its name; v is null if the file isn't JSON."""
    raw = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("doc_id"), "value")
    return parse(raw)


def parse(raw: DataFrame) -> DataFrame:
    """The same from rows (doc_id, value). Bare nan and infinity, of any case and sign, become null; strings stay."""
    pieces = F.regexp_extract_all("value", F.lit(r'(?s)("[^"\\]*+(?:\\.[^"\\]*+)*+"|[^"]++|")'), F.lit(1))
    bare = F.transform(pieces, lambda x: F.when(x.startswith('"'), x).otherwise(F.regexp_replace(x, r"(?i)(?<![\w.+-])[-+]?(?:nan|inf(?:inity)?)(?!\w)", "null")))
    clean = F.when(F.col("value").rlike(r"(?i)[\[:,\s][-+]?(?:nan|inf)"), F.array_join(bare, "")).otherwise(F.col("value"))
    return raw.select("doc_id", F.try_parse_json(clean).alias("v"))


def get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def handle(v: Column, path: str) -> Column:
    """The absolute handle: the last element of a reference, or the number itself."""
    return F.coalesce(F.element_at(get(v, path, "array<bigint>"), -1), get(v, path, "bigint"))


def drawings(docs: DataFrame) -> DataFrame:
    v = F.col("v")
    header = F.coalesce(get(v, "$.HEADER['$ACADVER']", "string"), get(v, "$.HEADER.ACADVER", "string"), get(v, "$.FILEHEADER.version", "string"))
    return docs.select(
        "doc_id", F.lit("json").alias("source"), version_name(header).alias("version"), header.isNull().alias("version_assumed"),
        F.to_json(get(v, "$.HEADER", "variant")).alias("header"), get(v, "$.OBJECTS", "variant").isNull().alias("no_objects"),
        F.when(v.isNull(), "not JSON").when(get(v, "$.OBJECTS", "variant").isNull(), "no OBJECTS").alias("error"),
    )


def objects(docs: DataFrame) -> DataFrame:
    """(doc_id, seq, kind, type_name, handle, owner, layer, o): members of OBJECTS in order."""
    o = docs.where(get(F.col("v"), "$.OBJECTS", "variant").isNotNull()).select("doc_id", F.expr("posexplode(try_variant_get(v, '$.OBJECTS', 'array<variant>'))").alias("seq", "o"))
    x = F.col("o")
    return o.select(
        "doc_id", "seq", F.when(get(x, "$.entity", "string").isNotNull(), "entity").otherwise("object").alias("kind"),
        F.coalesce(get(x, "$.entity", "string"), get(x, "$.object", "string")).alias("type_name"),
        handle(x, "$.handle").alias("handle"), F.coalesce(handle(x, "$.ownerhandle"), F.lit(0)).alias("owner"), handle(x, "$.layer").alias("layer"), "o",
    )


def _pair(a: Column) -> Column:
    return F.struct(F.get(a, 0).alias("x"), F.get(a, 1).alias("y"))


def _p2(x: Column, path: str) -> Column:
    a = get(x, path, "array<double>")
    return F.when(F.size(a) >= 2, _pair(a))


def _p2s(x: Column, path: str) -> Column:
    return F.transform(get(x, path, "array<array<double>>"), _pair)


def entities(docs: DataFrame) -> DataFrame:
    """Typed entity rows. Attribute definitions are left out; paper space (mode 1) is marked, not dropped."""
    e = objects(docs).where("kind = 'entity' AND type_name <> 'ATTDEF'")
    x = F.col("o")
    mode = F.coalesce(get(x, "$.entmode", "int"), F.lit(2))
    kind = F.col("type_name")
    measured = F.filter(F.array(*[_p2(x, f"$.{k}") for k in ("def_pt", "xline1_pt", "xline2_pt", "text_midpt")]), lambda a: a.isNotNull())
    corners = F.filter(F.array(*[_p2(x, f"$.corner{k}") for k in range(1, 5)]), lambda a: a.isNotNull())
    verts = F.transform(get(x, "$.verts", "array<struct<vertex:array<double>>>"), lambda a: _pair(a["vertex"]))
    points = F.coalesce(
        F.when(kind.startswith("DIMENSION"), measured), F.when(kind.isin("SOLID", "TRACE", "3DFACE"), corners), F.when(kind == "MLINE", verts),
        F.when(kind.isin("RAY", "XLINE"), F.array(_p2(x, "$.point"), _p2(x, "$.vector"))),
        F.when(kind == "SPLINE", _p2s(x, "$.fit_pts")),
        _p2s(x, "$.points"),
        F.when(_p2(x, "$.start").isNotNull() & _p2(x, "$.end").isNotNull(), F.array(_p2(x, "$.start"), _p2(x, "$.end"))),
        F.when(F.coalesce(_p2(x, "$.center"), _p2(x, "$.ins_pt"), _p2(x, "$.point")).isNotNull(), F.array(F.coalesce(_p2(x, "$.center"), _p2(x, "$.ins_pt"), _p2(x, "$.point")))),
    )
    scale = get(x, "$.scale", "array<double>")
    loops = get(x, "$.paths", "array<struct<polyline_paths:array<struct<point:array<double>,bulge:double>>>>")
    paths = F.transform(loops, lambda h: F.struct(F.transform(h["polyline_paths"], lambda a: _pair(a["point"])).alias("points"), F.transform(h["polyline_paths"], lambda a: F.coalesce(a["bulge"], F.lit(0.0))).alias("bulges")))
    return _with_vertices(e, e.select(
        "doc_id", "handle", "seq", F.when(kind.startswith("DIMENSION"), "DIMENSION").otherwise(kind).alias("type_name"),
        F.when(mode == 1, "paper").when((mode == 0) & (F.col("owner") != 0), "block").otherwise("model").alias("space"),
        F.when((mode == 0), F.col("owner")).otherwise(F.lit(0)).alias("owner"), "layer",
        F.coalesce(get(x, "$.color.index", "int"), get(x, "$.color", "int"), F.lit(256)).alias("color_index"),
        F.conv(get(x, "$.color.rgb", "string"), 16, 10).cast("bigint").alias("true_color"),
        points.alias("points"), get(x, "$.radius", "double").alias("radius"), get(x, "$.start_angle", "double").alias("a0"), get(x, "$.end_angle", "double").alias("a1"),
        get(x, "$.bulges", "array<double>").alias("bulges"), (F.coalesce(get(x, "$.flag", "int"), F.lit(0)).bitwiseAND(513) != 0).alias("closed"),
        F.coalesce(get(x, "$.text_value", "string"), get(x, "$.text", "string")).alias("text"), get(x, "$.tag", "string").alias("tag"),
        F.coalesce(get(x, "$.height", "double"), get(x, "$.text_height", "double")).alias("height"), F.coalesce(get(x, "$.rotation", "double"), F.lit(0.0)).alias("rotation"),
        F.coalesce(handle(x, "$.block_header"), F.when(kind.startswith("DIMENSION"), handle(x, "$.block"))).alias("block"), F.coalesce(F.get(scale, 0), F.lit(1.0)).alias("sx"), F.coalesce(F.get(scale, 1), F.lit(1.0)).alias("sy"),
        _p2(x, "$.sm_axis").alias("axis"), get(x, "$.axis_ratio", "double").alias("ratio"), get(x, "$.degree", "int").alias("degree"), get(x, "$.knots", "array<double>").alias("knots"),
        _p2s(x, "$.control_points").alias("control"), get(x, "$.weights", "array<double>").alias("weights"), get(x, "$.turns", "double").alias("turns"), paths.alias("paths"),
    ))


def _with_vertices(e: DataFrame, rows: DataFrame) -> DataFrame:
    x = F.col("o")
    v = e.where(F.col("type_name").isin("VERTEX_2D", "VERTEX_3D", "VERTEX_MESH", "VERTEX_PFACE")).select("doc_id", "owner", "seq", _p2(x, "$.point").alias("p"), F.coalesce(get(x, "$.bulge", "double"), F.lit(0.0)).alias("b"))
    return with_vertices(rows, v)


def with_vertices(rows: DataFrame, v: DataFrame) -> DataFrame:
    """Old-style polylines with the points and bulges of their vertices (doc_id, owner, seq, p, b), which name them as
    owner; vertices themselves go."""
    listed = F.array_sort(F.collect_list(F.struct("seq", "p", "b")))
    v = v.where("p IS NOT NULL").groupBy("doc_id", F.col("owner").alias("handle")).agg(listed.alias("l"))
    v = v.select("doc_id", "handle", F.transform("l", lambda a: a["p"]).alias("__p"), F.transform("l", lambda a: a["b"]).alias("__b"))
    joined = rows.where(~F.col("type_name").startswith("VERTEX_") & (F.col("type_name") != "SEQEND")).join(v, ["doc_id", "handle"], "left")
    return joined.withColumns({"points": F.coalesce("points", "__p"), "bulges": F.coalesce("bulges", "__b")}).select(*rows.columns)


def layers(docs: DataFrame) -> DataFrame:
    x = F.col("o")
    rows = objects(docs).where("kind = 'object' AND type_name = 'LAYER'")
    return rows.select("doc_id", F.col("handle").alias("layer_handle"), get(x, "$.name", "string").alias("name"), F.coalesce(get(x, "$.color.index", "int"), get(x, "$.color", "int")).alias("aci"), F.conv(get(x, "$.color.rgb", "string"), 16, 10).cast("bigint").alias("true_color"))


def blocks(docs: DataFrame) -> DataFrame:
    rows = objects(docs).where("kind = 'object' AND type_name = 'BLOCK_HEADER'")
    return rows.select("doc_id", F.col("handle").alias("block_handle"), get(F.col("o"), "$.name", "string").alias("name"))


def dictionaries(docs: DataFrame) -> DataFrame:
    """(doc_id, dict_handle, pos, key, item_handle) of dictionaries whose items are an object of references."""
    rows = objects(docs).where("kind = 'object' AND type_name = 'DICTIONARY'")
    items = rows.select("doc_id", F.col("handle").alias("dict_handle"), F.map_entries(get(F.col("o"), "$.items", "map<string,array<bigint>>")).alias("m"))
    return items.select("doc_id", "dict_handle", F.posexplode("m").alias("pos", "e")).select("doc_id", "dict_handle", "pos", F.col("e.key").alias("key"), F.element_at("e.value", -1).alias("item_handle"))


def decode_errors(docs: DataFrame) -> DataFrame:
    """(doc_id, seq, reason): what reading skips: whole files, and members without a type or a handle."""
    files = drawings(docs).where("error IS NOT NULL").select("doc_id", F.lit(None).cast("int").alias("seq"), F.col("error").alias("reason"))
    o = objects(docs)
    members = o.select("doc_id", "seq", F.when(F.col("type_name").isNull(), "no type").when(F.col("handle").isNull(), "no handle").alias("reason"))
    return files.unionByName(members.where("reason IS NOT NULL"))


def skipped(docs: DataFrame) -> DataFrame:
    """(doc_id, reason, n)."""
    return decode_errors(docs).groupBy("doc_id", "reason").agg(F.count("*").alias("n"))
