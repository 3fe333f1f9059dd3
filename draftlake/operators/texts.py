"""Texts of a drawing in the coordinates they are stored in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_mtext
from .expand import MODEL, instances
from .tessellate import TEXTS, parts


def texts_local(entities: DataFrame) -> DataFrame:
    """(doc_id, text, layer, x, y): model space's texts, and the texts of a block once for each INSERT that shows it.

    An INSERT is visited once however often its own block is shown. Format codes of MTEXT are taken out, %% codes stay.
    """
    _, inserts = parts(entities)
    shown = instances(inserts).select("doc_id", F.col("block").alias("owner")).distinct()
    visited = inserts.where(F.col("owner") == MODEL).unionByName(inserts.join(shown, ["doc_id", "owner"], "left_semi").select(inserts.columns))
    visited = visited.select("doc_id", "handle", F.col("block").alias("owner")).distinct().select("doc_id", "owner")
    t = entities.where("space <> 'paper'").where(F.col("type_name").isin(*TEXTS))
    p = F.element_at("points", 1)
    row = [F.when(F.col("type_name") == "MTEXT", strip_mtext(F.col("text"))).otherwise(F.col("text")).alias("text"), "layer", p["x"].alias("x"), p["y"].alias("y")]
    return t.where(F.col("owner") == MODEL).select("doc_id", *row).unionByName(t.join(visited, ["doc_id", "owner"]).select("doc_id", *row))
