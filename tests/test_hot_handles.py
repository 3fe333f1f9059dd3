"""Attributes listed by very many inserts."""

from pyspark.sql import functions as F

from draftlake.operators import resolve


def test_hot_handles_are_dealt(spark):
    """One handle listed by all inserts, one that dangles: every row is there, and they are not all in one task."""
    n = 2 * resolve.SHARE + 10
    inserts = spark.range(n).selectExpr("'d' AS doc_id", "id AS handle", "array(1L, 9L, id + 100) AS attribs")
    attribs = spark.createDataFrame([("d", 1, "a"), ("d", 100, "b"), ("e", 9, "c")], "doc_id string, handle bigint, tag string")
    keep = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        got = resolve.attributes(inserts, attribs).withColumn("p", F.spark_partition_id())
        by = {(r["handle"], r["pos"], r["tag"]): r for r in got.groupBy("handle", "pos", "tag").agg(F.count("*").alias("n"), F.countDistinct("insert_handle").alias("d"), F.countDistinct("p").alias("tasks")).collect()}
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    assert {k: (r["n"], r["d"]) for k, r in by.items()} == {(1, 0, "a"): (n, n), (100, 2, "b"): (1, 1)}
    assert by[1, 0, "a"]["tasks"] > 1
