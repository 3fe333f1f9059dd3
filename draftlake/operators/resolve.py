"""Reference resolution: joins by handle, order and name. All inputs carry doc_id."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.color import effective

#: Rows of one handle that one task joins, about.
SHARE = 50_000


def with_layer(entities: DataFrame, layers: DataFrame, white_background: bool = True) -> DataFrame:
    """entities with layer_name ('' if unknown) and rgb."""
    dim = layers.select("doc_id", F.col("layer_handle").alias("layer"), F.col("name").alias("__name"), F.col("aci").alias("__aci"), F.col("true_color").alias("__true"))
    out = entities.join(dim, ["doc_id", "layer"], "left")
    rgb = effective(F.col("true_color"), F.coalesce("color_index", F.lit(256)), F.col("__true"), F.col("__aci"), white_background)
    return out.withColumns({"layer_name": F.coalesce("__name", F.lit("")), "rgb": rgb}).drop("__name", "__aci", "__true")


def attributes(inserts: DataFrame, attribs: DataFrame) -> DataFrame:
    """(doc_id, handle, pos, attrib fields): each insert's attributes in order; dangling handles are left out.

    A handle listed more than ``SHARE`` times, dangling or not, is dealt over shares of about that size; such handles are
    few (one in ``SHARE`` of the listed at most), so they are broadcast.
    """
    listed = inserts.select("doc_id", F.col("handle").alias("insert_handle"), F.posexplode("attribs").alias("pos", "handle"))
    often = listed.groupBy("doc_id", "handle").count().where(F.col("count") > SHARE).select("doc_id", "handle", F.ceil(F.col("count") / SHARE).alias("__shares"))
    often = F.broadcast(often)
    share = F.coalesce(F.pmod(F.xxhash64("insert_handle", "pos"), F.col("__shares")), F.lit(0))
    dealt = listed.join(often, ["doc_id", "handle"], "left").withColumn("__share", share).drop("__shares")
    copies = attribs.join(often, ["doc_id", "handle"], "left").withColumn("__share", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("__shares", F.lit(1)) - 1))).drop("__shares")
    return dealt.join(copies, ["doc_id", "handle", "__share"]).drop("__share")


def attributes_by_owner(attribs: DataFrame) -> DataFrame:
    """(doc_id, owner, attribs): handles of each owner's attributes, ascending and distinct."""
    return attribs.groupBy("doc_id", "owner").agg(F.array_sort(F.collect_set("handle")).alias("attribs"))


def polyline_points(vertices: DataFrame, *order: str) -> DataFrame:
    """(doc_id, owner, points): vertices of each owner in order."""
    row = F.struct(*order, F.struct("x", "y").alias("p"))
    points = F.transform(F.array_sort(F.collect_list(row)), lambda r: r["p"])
    return vertices.groupBy("doc_id", "owner").agg(points.alias("points"))


def carried_host(records: DataFrame, is_host, is_member, closes, order: str = "idx") -> DataFrame:
    """Members with the handle of the last host before them, unless a closing record stands between."""
    w = Window.partitionBy("doc_id").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mark = F.when(is_host, F.struct(F.col("handle").alias("host"))).when(closes, F.struct(F.lit(None).cast("bigint").alias("host")))
    return records.withColumn("host", F.last(mark, True).over(w)["host"]).where(is_member).withColumn("owner", F.coalesce("owner", "host"))


def named_handles(names: DataFrame, known: DataFrame, first: int = 0x100000) -> DataFrame:
    """(doc_id, name, handle): known names keep their handle, others get new ones in name order."""
    missing = names.select("doc_id", "name").distinct().join(known, ["doc_id", "name"], "left_anti")
    fresh = missing.withColumn("handle", F.row_number().over(Window.partitionBy("doc_id").orderBy("name")).cast("bigint") + (first - 1))
    return known.select("doc_id", "name", "handle").unionByName(fresh)


def without_handles_of(rows: DataFrame, first: DataFrame) -> DataFrame:
    """first, then the rows whose handle it doesn't have."""
    return first.unionByName(rows.join(first.select("doc_id", "handle").distinct(), ["doc_id", "handle"], "left_anti"), allowMissingColumns=True)


def best_duplicates(candidates: DataFrame) -> DataFrame:
    """Of the rows of one handle the one with the highest score, then the largest offset."""
    w = Window.partitionBy("doc_id", "handle").orderBy(F.desc("score"), F.desc("offset"))
    return candidates.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def largest_block(children: DataFrame) -> DataFrame:
    """(doc_id, block_handle, n): the block with most children, the smallest handle on ties."""
    n = children.groupBy("doc_id", F.col("owner").alias("block_handle")).agg(F.count("*").alias("n"))
    best = F.max_by("block_handle", F.struct("n", -F.col("block_handle")))
    return n.groupBy("doc_id").agg(best.alias("block_handle"), F.max("n").alias("n"))


def dictionary_values(dictionaries: DataFrame, variables: DataFrame, key: str) -> DataFrame:
    """(doc_id, value) of a named dictionary variable."""
    item = dictionaries.where(F.col("key") == key).select("doc_id", F.col("item_handle").alias("handle"))
    return item.join(variables, ["doc_id", "handle"]).select("doc_id", "value")


def with_type_name(rows: DataFrame, fixed: DataFrame, classes: DataFrame) -> DataFrame:
    """rows (doc_id, type_code) with type_name: of the fixed codes (type_code, name), else of the drawing's own classes
    (doc_id, type_code, name)."""
    own = classes.select("doc_id", "type_code", F.col("name").alias("__own"))
    out = rows.join(fixed.select("type_code", F.col("name").alias("__fixed")), "type_code", "left").join(own, ["doc_id", "type_code"], "left")
    return out.withColumn("type_name", F.coalesce("__fixed", "__own")).drop("__fixed", "__own")
