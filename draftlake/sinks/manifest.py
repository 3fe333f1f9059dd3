"""The manifest: one JSON document a drawing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA_VERSION = 1


def manifest(texts: DataFrame, sheets: DataFrame) -> DataFrame:
    """(doc_id, manifest): schema_version, sheets with their text counts, and the number of texts on none.

    Texts are counted before anything is gathered, so what meets in a row is the drawing's list of sheets.
    """
    counts = texts.groupBy("doc_id", F.col("sheet").alias("sheet_index")).agg(F.count("*").alias("texts"))
    listed = sheets.join(counts, ["doc_id", "sheet_index"], "left").withColumn("texts", F.coalesce("texts", F.lit(0)))
    row = F.struct(F.col("sheet_index").alias("index"), "name", F.array("min_x", "min_y", "max_x", "max_y").alias("box"), "texts")
    per_doc = listed.groupBy("doc_id").agg(F.array_sort(F.collect_list(row)).alias("sheets"))
    outside = counts.where("sheet_index = 0").select("doc_id", F.col("texts").alias("texts_outside"))
    j = per_doc.join(outside, "doc_id", "left").withColumn("texts_outside", F.coalesce("texts_outside", F.lit(0)))
    return j.select("doc_id", F.to_json(F.struct(F.lit(SCHEMA_VERSION).alias("schema_version"), F.col("doc_id").alias("source"), "sheets", "texts_outside")).alias("manifest"))
