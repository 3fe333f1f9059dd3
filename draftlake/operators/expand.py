"""Recursive expansion of block references into world-space instances."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import IDENTITY, affine, apply_point, apply_strokes, compose

MAX_DEPTH = 12
MODEL = 0


def cut(df: DataFrame) -> DataFrame:
    """The rows checkpointed to the shared folder, or, in local mode, to one of our own where none is set."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="draftlake-"))
    return df.checkpoint()


def instances(inserts: DataFrame, max_depth: int = MAX_DEPTH, roots: DataFrame | None = None) -> DataFrame:
    """(doc_id, root, block, depth, path, order, t): every instance of every block reachable from model space (owner 0,
    root null), or from each block of ``roots`` (doc_id, root) taken at identity.

    inserts: doc_id, owner, handle, seq, block, t (its own transform). A branch ends where a block is on its own path or
    at the greatest depth. One join a level, each level's rows checkpointed, until a level is empty; blocks nest a few
    levels deep, so the loop is short whatever the number of rows. ``order`` is the path of positions, which sorts
    instances as a depth-first walk would meet them.
    """
    edge = inserts.select("doc_id", F.col("owner").alias("__owner"), F.col("seq").alias("__seq"), F.col("block").alias("__block"), F.col("t").alias("__t"))
    if roots is None:
        first = inserts.where(F.col("owner") == MODEL).withColumn("root", F.lit(None).cast("bigint"))
    else:
        first = roots.select("doc_id", "root", F.col("root").alias("block"), F.lit(0).alias("seq"), affine(*IDENTITY).alias("t"))
    level = first.select("doc_id", "root", "block", F.lit(1).alias("depth"), F.array("block").alias("path"), F.array("seq").alias("order"), "t")
    out = level = cut(level)
    for depth in range(2, max_depth + 1):
        level = level.join(edge, (level["doc_id"] == edge["doc_id"]) & (F.col("block") == F.col("__owner")) & ~F.array_contains("path", F.col("__block"))).select(
            level["doc_id"], "root", F.col("__block").alias("block"), F.lit(depth).alias("depth"), F.concat("path", F.array("__block")).alias("path"),
            F.concat("order", F.array("__seq")).alias("order"), compose(F.col("t"), F.col("__t")).alias("t"),
        )
        level = cut(level)
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out


def primitives(leaves: DataFrame, inserts: DataFrame, max_depth: int = MAX_DEPTH, roots: DataFrame | None = None) -> DataFrame:
    """Leaves (doc_id, owner, handle, seq, strokes, at and others) of model space and of every instance, in world space;
    with ``roots`` those of each root block in its own space."""
    placed = instances(inserts, max_depth, roots)
    nested = leaves.join(placed.select("doc_id", "root", F.col("block").alias("owner"), "t", "depth", F.col("order").alias("__order")), ["doc_id", "owner"])
    both = nested.withColumn("order", F.concat("__order", F.array("seq"))).drop("__order")
    if roots is None:
        direct = leaves.where(F.col("owner") == MODEL).withColumns({"t": affine(*IDENTITY), "depth": F.lit(0), "order": F.array("seq"), "root": F.lit(None).cast("bigint")})
        both = direct.unionByName(both)
    moved = {"strokes": apply_strokes(F.col("t"), F.col("strokes"))} if "strokes" in leaves.columns else {}
    if "at" in leaves.columns:
        moved["at"] = apply_point(F.col("t"), F.col("at"))
    return both.withColumns(moved)
