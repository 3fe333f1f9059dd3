"""ASCII DXF as tables: pairs, then records, then entities; all by split and window functions.

A file is one row of text; its pairs are numbered, a record starts at each pair of code 0, sections and blocks are
carried forward. Windows are per drawing, so a drawing is the unit of parallel work, as files are many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import codepage, decode_codepage, dxf_unquote, version_name
from ..operators.resolve import carried_host, named_handles

FIRST_HANDLE = 0x100000


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("doc_id"), "value")


def read_bytes(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, value) of files whose text is in the code page that their header names; from R2007 on it is UTF-8."""
    raw = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("doc_id"), "content")
    head = F.decode("content", "ISO-8859-1")
    version = F.regexp_extract(head, r"\$ACADVER\s+1\s+(AC\d+)", 1)
    page = codepage(F.regexp_extract(head, r"\$DWGCODEPAGE\s+3\s+(\S+)", 1))
    return raw.select("doc_id", decode_codepage("content", F.when(version >= "AC1021", F.lit(0)).otherwise(page)).alias("value"))


def pairs(raw: DataFrame) -> DataFrame:
    """(doc_id, idx, code, raw) from rows (doc_id, value); a code that isn't a number ends nothing and is left out."""
    lines = raw.select("doc_id", F.posexplode(F.split(F.regexp_replace("value", "\r", ""), "\n")).alias("n", "line"))
    halves = lines.groupBy("doc_id", F.floor(F.col("n") / 2).alias("idx")).agg(F.max(F.when(F.col("n") % 2 == 0, F.trim("line"))).alias("c"), F.max(F.when(F.col("n") % 2 == 1, F.col("line"))).alias("raw"))
    return halves.select("doc_id", "idx", F.col("c").try_cast("int").alias("code"), "raw").where("code IS NOT NULL AND raw IS NOT NULL")


def records(p: DataFrame) -> DataFrame:
    """(doc_id, rec, type_name, pairs, section, table, block): one row a record, with where it stands."""
    w = Window.partitionBy("doc_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    numbered = p.withColumn("rec", F.sum((F.col("code") == 0).cast("int")).over(w)).where("rec > 0")
    rows = numbered.groupBy("doc_id", "rec").agg(F.array_sort(F.collect_list(F.struct("idx", "code", "raw"))).alias("pairs"))
    rows = rows.withColumn("type_name", F.upper(F.trim(F.element_at("pairs", 1)["raw"])))
    o = Window.partitionBy("doc_id").orderBy("rec").rowsBetween(Window.unboundedPreceding, 0)
    name = text_of(F.col("pairs"), 2)

    def carried(opens: str, closes: str) -> Column:
        mark = F.when(F.col("type_name") == opens, F.struct(F.upper(name).alias("v") if opens != "BLOCK" else name.alias("v"))).when(F.col("type_name") == closes, F.struct(F.lit(None).cast("string").alias("v")))
        return F.last(mark, True).over(o)["v"]

    return rows.withColumns({"section": carried("SECTION", "ENDSEC"), "table": carried("TABLE", "ENDTAB"), "block": carried("BLOCK", "ENDBLK")})


def all_of(p: Column, code: int) -> Column:
    return F.transform(F.filter(p, lambda x: x["code"] == code), lambda x: x["raw"])


def text_of(p: Column, code: int) -> Column:
    return F.get(all_of(p, code), 0)


def number_of(p: Column, code: int) -> Column:
    return F.trim(text_of(p, code)).try_cast("double")


def int_of(p: Column, code: int) -> Column:
    return F.trim(text_of(p, code)).try_cast("int")


def handle_of(p: Column, code: int) -> Column:
    return F.conv(F.trim(text_of(p, code)), 16, 10).try_cast("bigint")


def numbers_of(p: Column, code: int) -> Column:
    return F.transform(all_of(p, code), lambda x: F.trim(x).try_cast("double"))


def bulges_of(p: Column) -> Column:
    """One bulge a point: the code 42 between its code 10 and the next, else 0."""
    starts = F.filter(F.transform(p, lambda x, i: F.when(x["code"] == 10, i)), lambda i: i.isNotNull())
    own = lambda i, k: F.slice(p, i + 1, F.coalesce(F.get(starts, k + 1), F.size(p)) - i)
    return F.transform(starts, lambda i, k: F.coalesce(number_of(own(i, k), 42), F.lit(0.0)))


def hatch_paths(p: Column) -> Column:
    """Boundary loops: each opens with code 92. Polyline loops keep their bulges, edge loops the starts of their lines."""
    starts = F.filter(F.transform(p, lambda x, i: F.when(x["code"] == 92, i)), lambda i: i.isNotNull())
    end = F.coalesce(F.array_min(F.filter(F.transform(p, lambda x, i: F.when(x["code"] == 75, i)), lambda i: i > F.element_at(starts, 1))), F.size(p))

    def loop(start: Column, k: Column) -> Column:
        own = F.slice(p, start + 1, F.coalesce(F.get(starts, k + 1), end) - start)
        return F.struct(points_of(own, 10).alias("points"), numbers_of(own, 42).alias("bulges"))

    return F.when(F.size(starts) > 0, F.transform(starts, loop))


def points_of(p: Column, code: int = 10) -> Column:
    xs, ys = all_of(p, code), all_of(p, code + 10)
    return F.zip_with(xs, ys, lambda x, y: F.struct(F.trim(x).try_cast("double").alias("x"), F.trim(y).try_cast("double").alias("y")))


def drawings(p: DataFrame) -> DataFrame:
    """(doc_id, version, codepage) from the header variables."""
    w = Window.partitionBy("doc_id").orderBy("idx")
    named = p.withColumn("next", F.lead("raw").over(w)).where("code = 9")
    var = lambda n: F.max(F.when(F.trim("raw") == n, F.trim("next")))
    out = named.groupBy("doc_id").agg(var("$ACADVER").alias("v"), var("$DWGCODEPAGE").alias("c"))
    return out.select("doc_id", F.lit("dxf").alias("source"), version_name(F.col("v")).alias("version"), codepage(F.coalesce("c", F.lit(""))).alias("codepage"))


def layers(r: DataFrame) -> DataFrame:
    """Layer table rows; a layer without a handle gets one by name."""
    p = F.col("pairs")
    rows = r.where("section = 'TABLES' AND table = 'LAYER' AND type_name = 'LAYER'")
    rows = rows.select("doc_id", text_of(p, 2).alias("name"), handle_of(p, 5).alias("h"), F.abs(int_of(p, 62)).alias("aci"), int_of(p, 420).cast("bigint").alias("true_color"))
    fresh = F.row_number().over(Window.partitionBy("doc_id").orderBy("name")) + (FIRST_HANDLE - 1)
    return rows.select("doc_id", F.coalesce("h", fresh).alias("layer_handle"), "name", "aci", "true_color")


def is_paper_block(name: Column) -> Column:
    return F.upper(name).startswith("*PAPER_SPACE")


def entities(r: DataFrame) -> DataFrame:
    """Entity rows of model space and blocks, by name: layer_name, block_name (what an INSERT shows), in_block.

    Content of the model-space block counts as model space, paper space is left out.
    """
    p = F.col("pairs")
    inside = r.where("(section = 'ENTITIES' OR section = 'BLOCKS') AND type_name NOT IN ('SECTION', 'ENDSEC', 'BLOCK', 'ENDBLK', 'EOF')")
    inside = inside.where(F.coalesce(int_of(p, 67), F.lit(0)) != 1).where(F.col("block").isNull() | ~is_paper_block(F.col("block")))
    model = F.col("block").isNull() | F.upper("block").startswith("*MODEL_SPACE")
    w = Window.partitionBy("doc_id").orderBy("rec")
    mtext = F.concat(F.array_join(all_of(p, 3), ""), F.coalesce(text_of(p, 1), F.lit("")))
    angle = lambda c: F.radians(number_of(p, c))
    kind, spline = F.col("type_name"), F.col("type_name") == "SPLINE"
    two = F.concat(points_of(p, 10), points_of(p, 11))
    four = F.concat(*[points_of(p, c) for c in (10, 11, 12, 13)])
    points = (
        F.when(kind.isin("LINE", "RAY", "XLINE"), two).when(kind.isin("SOLID", "TRACE", "3DFACE"), four).when(spline, points_of(p, 11))
        .when(kind == "DIMENSION", F.concat(*[points_of(p, c) for c in (10, 13, 14, 11)])).when(kind == "POLYLINE", F.lit(None)).when(kind == "HATCH", F.lit(None)).otherwise(points_of(p, 10))
    )
    return inside.select(
        "doc_id", F.coalesce(handle_of(p, 5), F.row_number().over(w) + (2 * FIRST_HANDLE)).alias("handle"), F.col("rec").alias("seq"), "type_name",
        F.when(model, "model").otherwise("block").alias("space"), F.when(~model, F.col("block")).alias("in_block"), handle_of(p, 330).alias("owner_handle"),
        F.coalesce(F.nullif(text_of(p, 8), F.lit("")), F.lit("0")).alias("layer_name"), F.coalesce(int_of(p, 62), F.lit(256)).alias("color_index"), int_of(p, 420).cast("bigint").alias("true_color"),
        points.alias("points"), number_of(p, 40).alias("radius"),
        F.when(kind == "ELLIPSE", number_of(p, 41)).otherwise(angle(50)).alias("a0"), F.when(kind == "ELLIPSE", number_of(p, 42)).otherwise(angle(51)).alias("a1"), F.when(kind == "LWPOLYLINE", bulges_of(p)).alias("bulges"), (F.coalesce(int_of(p, 70), F.lit(0)).bitwiseAND(1) != 0).alias("closed"),
        dxf_unquote(F.when(F.col("type_name") == "MTEXT", mtext).otherwise(text_of(p, 1))).alias("text"), F.when(F.col("type_name").isin("ATTRIB", "ATTDEF"), text_of(p, 2)).alias("tag"),
        F.when(F.col("type_name").isin("TEXT", "MTEXT", "ATTRIB", "ATTDEF"), number_of(p, 40)).alias("height"), F.coalesce(angle(50), F.lit(0.0)).alias("rotation"),
        F.when(F.col("type_name").isin("INSERT", "DIMENSION"), text_of(p, 2)).alias("block_name"), F.coalesce(number_of(p, 41), F.lit(1.0)).alias("sx"), F.coalesce(number_of(p, 42), F.lit(1.0)).alias("sy"),
        F.coalesce(int_of(p, 72), F.lit(0)).alias("h_align"), F.coalesce(int_of(p, 73), F.lit(0)).alias("v_align"),
        F.when(kind == "ELLIPSE", F.get(points_of(p, 11), 0)).alias("axis"), F.when(kind == "ELLIPSE", number_of(p, 40)).alias("ratio"),
        F.when(spline, int_of(p, 71)).alias("degree"), F.when(spline, numbers_of(p, 40)).alias("knots"), F.when(spline, points_of(p, 10)).alias("control"), F.when(spline, F.nullif(numbers_of(p, 41), F.array().cast("array<double>"))).alias("weights"),
        F.when(kind == "HATCH", hatch_paths(p)).alias("paths"),
    )


def blocks(r: DataFrame) -> DataFrame:
    """(doc_id, name, block_handle): block definitions by first record; one without a handle gets one by name."""
    p = F.col("pairs")
    rows = r.where("section = 'BLOCKS' AND type_name = 'BLOCK'").groupBy("doc_id", text_of(p, 2).alias("name")).agg(F.min(handle_of(p, 5)).alias("handle"))
    known = rows.where("handle IS NOT NULL")
    return named_handles(rows, known, 3 * FIRST_HANDLE).select("doc_id", "name", F.col("handle").alias("block_handle"))


def polyline_vertices(r: DataFrame) -> DataFrame:
    """(doc_id, seq, points, bulges): the vertices that follow each POLYLINE up to SEQEND; seq is the polyline's record."""
    p, kind = F.col("pairs"), F.col("type_name")
    rows = r.where(kind.isin("POLYLINE", "VERTEX", "SEQEND")).select("doc_id", F.col("rec").alias("idx"), F.col("rec").cast("bigint").alias("handle"), F.lit(None).cast("bigint").alias("owner"), "type_name", F.get(points_of(p, 10), 0).alias("p"), F.coalesce(number_of(p, 42), F.lit(0.0)).alias("b"))
    hosted = carried_host(rows, kind == "POLYLINE", kind == "VERTEX", kind == "SEQEND")
    listed = hosted.where("owner IS NOT NULL AND p IS NOT NULL").groupBy("doc_id", F.col("owner").alias("seq")).agg(F.array_sort(F.collect_list(F.struct("idx", "p", "b"))).alias("l"))
    return listed.select("doc_id", "seq", F.transform("l", lambda x: x["p"]).alias("points"), F.transform("l", lambda x: x["b"]).alias("bulges"))


def resolved(r: DataFrame) -> DataFrame:
    """Entity rows as block expansion and tessellation want them: layer, owner and block by handle, polylines with points."""
    named = blocks(r)
    layer = layers(r).groupBy("doc_id", F.col("name").alias("layer_name")).agg(F.min("layer_handle").alias("layer"))
    v = polyline_vertices(r).select("doc_id", "seq", F.col("points").alias("__p"), F.col("bulges").alias("__b"))
    e = entities(r).where("type_name NOT IN ('VERTEX', 'SEQEND', 'ATTDEF')").join(layer, ["doc_id", "layer_name"], "left").join(v, ["doc_id", "seq"], "left")
    e = e.join(named.select("doc_id", F.col("name").alias("in_block"), F.col("block_handle").alias("owner")), ["doc_id", "in_block"], "left")
    e = e.join(named.select("doc_id", F.col("name").alias("block_name"), F.col("block_handle").alias("block")), ["doc_id", "block_name"], "left")
    old = F.col("type_name") == "POLYLINE"
    return e.withColumns({
        "owner": F.coalesce("owner", F.lit(0)), "points": F.when(old, F.col("__p")).otherwise(F.col("points")), "bulges": F.when(old, F.col("__b")).otherwise(F.col("bulges")),
        "type_name": F.when(old, "POLYLINE_2D").otherwise(F.col("type_name")),
    }).drop("__p", "__b")
