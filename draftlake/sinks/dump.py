"""Key-level dump of entities: one JSON object an entity, or one row a key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOLERANCE = 1e-6


def entities(rows: DataFrame) -> DataFrame:
    """(doc_id, handle, type, dxf): fields that are null are left out, numbers that aren't finite are null."""
    keys = [c for c in rows.columns if c not in ("doc_id", "handle", "type_name", "o")]
    safe = [F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(F.col(c)).alias(c) if dict(rows.dtypes)[c] == "double" else F.col(c) for c in keys]
    return rows.select("doc_id", "handle", F.col("type_name").alias("type"), F.to_json(F.struct(*safe)).alias("dxf"))


def long_form(dump: DataFrame) -> DataFrame:
    """(doc_id, handle, key, value): top-level keys of the dump."""
    e = dump.select("doc_id", "handle", F.explode(F.from_json("dxf", "map<string,string>")).alias("key", "value"))
    return e


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Keys of two long dumps whose values differ; numbers count as equal within the tolerance."""
    j = left.withColumnRenamed("value", "left").join(right.withColumnRenamed("value", "right"), ["doc_id", "handle", "key"], "full")
    near = F.abs(F.col("left").try_cast("double") - F.col("right").try_cast("double")) < TOLERANCE
    return j.where(~(F.coalesce(near, F.lit(False)) | F.col("left").eqNullSafe(F.col("right"))))


def flatten(rows: DataFrame, key: str, depth: int = 6) -> DataFrame:
    """(key, path, value): leaves of a VARIANT column ``v`` under dotted paths, list places in brackets.

    One lateral step a level, at most ``depth``; what nests deeper is a leaf with its JSON text. Null leaves have none.
    """
    level = rows.where("v IS NOT NULL").select(F.col(key), F.lit("").alias("path"), "v")
    out = None
    for k in range(depth + 1):
        kind = F.schema_of_variant("v")
        nested = (kind.startswith("OBJECT") | kind.startswith("ARRAY")) if k < depth else F.lit(False)
        leaves = level.where(~nested).select(key, "path", F.coalesce(F.try_variant_get("v", "$", "string"), F.to_json("v")).alias("value"))
        out = leaves if out is None else out.unionByName(leaves)
        if k < depth:
            steps = level.where(nested).lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("v").outer()).toDF("pos", "name", "inner"))
            path = F.when(F.col("name").isNull(), F.concat("path", F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.concat_ws(".", F.nullif("path", F.lit("")), "name"))
            level = steps.select(key, path.alias("path"), F.col("inner").alias("v"))
    return out.where("value IS NOT NULL AND value <> 'null'")


def expected_keys(flat: DataFrame, keys: DataFrame) -> DataFrame:
    """The flattened leaves whose path fits a key of the list (key, pattern); [i], [j] and [k] of a pattern stand for any
    place. Paths and patterns meet by equality once their places are taken out."""
    general = F.regexp_replace("path", r"\[\d+\]", "[]")
    wanted = keys.select(F.regexp_replace("pattern", r"\[[ijk]\]", "[]").alias("__p"), "pattern").distinct()
    return flat.withColumn("__p", general).join(wanted, "__p").drop("__p")
