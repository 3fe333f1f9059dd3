"""SVG of a drawing or of its sheets: strings aggregated in drawing order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import xml_escape


def render(prims: DataFrame, boxes: DataFrame, width: int = 2048) -> DataFrame:
    """(doc_id, sheet_index, svg) of primitives (doc_id, order, rgb, strokes, text, at, height, rotation) in each box.

    A primitive is drawn on a sheet if one of its strokes' boxes meets it or its anchor lies inside.
    """
    b = boxes.select("doc_id", "sheet_index", *[F.col(c).alias(f"__{c}") for c in ("min_x", "min_y", "max_x", "max_y")])
    meets = F.exists("strokes", lambda s: (F.least(s["x1"], s["x2"]) <= F.col("__max_x")) & (F.greatest(s["x1"], s["x2"]) >= F.col("__min_x")) & (F.least(s["y1"], s["y2"]) <= F.col("__max_y")) & (F.greatest(s["y1"], s["y2"]) >= F.col("__min_y")))
    inside = F.coalesce(F.col("at.x").between(F.col("__min_x"), F.col("__max_x")) & F.col("at.y").between(F.col("__min_y"), F.col("__max_y")), F.lit(False)) & F.col("text").isNotNull()
    j = prims.join(b, "doc_id").where(meets | inside)
    k = F.lit(width) / F.greatest(F.col("__max_x") - F.col("__min_x"), F.lit(1e-9))
    px = lambda x: F.round((x - F.col("__min_x")) * k, 2).cast("string")
    py = lambda y: F.round((F.col("__max_y") - y) * k, 2).cast("string")
    color = F.format_string("#%06X", F.coalesce("rgb", F.lit(0)))
    path = F.array_join(F.transform("strokes", lambda s: F.concat(F.lit("M"), px(s["x1"]), F.lit(" "), py(s["y1"]), F.lit("L"), px(s["x2"]), F.lit(" "), py(s["y2"]))), "")
    line = F.when(F.size("strokes") > 0, F.concat(F.lit('<path fill="none" stroke="'), color, F.lit('" d="'), path, F.lit('"/>')))
    label = F.when(
        F.col("text").isNotNull() & F.col("at").isNotNull(),
        F.concat(F.lit('<text fill="'), color, F.lit('" font-size="'), F.round(F.col("height") * k, 2), F.lit('" transform="translate('), px(F.col("at.x")), F.lit(" "), py(F.col("at.y")), F.lit(") rotate("), F.round(-F.degrees("rotation"), 3), F.lit(')">'), xml_escape(F.col("text")), F.lit("</text>")),
    )
    items = j.select("doc_id", "sheet_index", "order", F.concat_ws("", line, label).alias("item"), F.round((F.col("__max_y") - F.col("__min_y")) * k, 0).cast("int").alias("h"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("order", "item"))), lambda x: x["item"]), "\n")
    out = items.groupBy("doc_id", "sheet_index").agg(body.alias("body"), F.first("h").alias("h"))
    head = F.format_string('<svg xmlns="http://www.w3.org/2000/svg" width="%d" height="%d" viewBox="0 0 %d %d">', F.lit(width), "h", F.lit(width), "h")
    return out.select("doc_id", "sheet_index", F.concat_ws("\n", head, F.col("body"), F.lit("</svg>")).alias("svg"))


#: Groups of one colour and layer a drawing; beyond, a group is a colour.
MAX_GROUPS = 200


def groups(prims: DataFrame, most: int = MAX_GROUPS) -> DataFrame:
    """(doc_id, rgb, layer, place): colour and layer groups in order of first appearance; those beyond ``most`` fall
    together by colour, with a null layer. Primitives are counted to groups before any window."""
    first = prims.groupBy("doc_id", "rgb", "layer").agg(F.min("order").alias("first"), F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("first"))
    ranked = first.withColumn("layer", F.when(place <= most, F.struct(F.col("layer").alias("name"))))
    again = ranked.groupBy("doc_id", "rgb", "layer").agg(F.min("first").alias("first"), F.sum("n").alias("n"))
    return again.select("doc_id", "rgb", F.col("layer.name").alias("layer"), F.row_number().over(Window.partitionBy("doc_id").orderBy("first")).alias("place"), "n")
