"""Drawing-shaped views of the driver's tables, once as DataFrames and once as SQL with equal results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import insert_affine, stroke


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def points(self) -> DataFrame:
        """Orders as text anchors: handle, place, layer, height, rotation."""
        return self("orders").selectExpr(
            "o_orderstatus AS doc_id", "o_orderkey + 1 AS handle", "o_totalprice AS x",
            "CAST(datediff(o_orderdate, DATE'1992-01-01') * 100 AS DOUBLE) AS y", "CAST(o_custkey % 10 AS BIGINT) AS layer",
            "CAST(100 + (o_orderkey % 7) * 50 AS DOUBLE) AS height", "radians(CAST((o_orderkey % 29) * 15 AS DOUBLE)) AS rotation",
            "o_orderpriority AS text", "CAST(o_orderkey % 260 AS INT) AS color_index", "CASE WHEN o_orderkey % 11 = 0 THEN o_orderkey * 37 % 16777216 END AS true_color",
        )

    def layers(self) -> DataFrame:
        return self("supplier").selectExpr(
            "explode(array('F','O','P')) AS doc_id", "s_suppkey AS layer_handle", "s_name AS name", "CAST(s_nationkey AS INT) AS aci",
            "CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey * 100 END AS true_color",
        ).where("layer_handle < 8")

    def sheets(self) -> DataFrame:
        return self("nation").selectExpr(
            "explode(array('F','O','P')) AS doc_id", "CAST(n_nationkey + 1 AS INT) AS sheet_index", "n_name AS name",
            "CAST(n_nationkey % 5 * 60000 AS DOUBLE) AS min_x", "CAST(n_nationkey DIV 5 * 50000 AS DOUBLE) AS min_y",
            "CAST(n_nationkey % 5 * 60000 + 62000 AS DOUBLE) AS max_x", "CAST(n_nationkey DIV 5 * 50000 + 45000 AS DOUBLE) AS max_y",
        )

    def vertices(self) -> DataFrame:
        return self("lineitem").selectExpr(
            "l_returnflag AS doc_id", "l_orderkey + 1 AS owner", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice AS x", "l_quantity * 1000 AS y", "l_suppkey % 10 AS layer",
        )

    def strokes(self) -> DataFrame:
        """Neighbouring vertices of one order."""
        w = "OVER (PARTITION BY doc_id, owner ORDER BY l_linenumber, l_partkey, l_suppkey, x, y)"
        return self.vertices().selectExpr("doc_id", "owner", "x AS x1", "y AS y1", f"lead(x) {w} AS x2", f"lead(y) {w} AS y2").where("x2 IS NOT NULL")

    def inserts(self) -> DataFrame:
        """Model space holds a block per region, those a block per nation; one nation's block refers back to its region's."""
        region = self("region").selectExpr("'D' AS doc_id", "0L AS owner", "CAST(100000 + r_regionkey AS BIGINT) AS handle", "CAST(r_regionkey AS INT) AS seq", "CAST(1 + r_regionkey AS BIGINT) AS block", "r_regionkey * 1000000D AS x", "0D AS y", "1D AS sx", "0D AS rot")
        nation = self("nation").selectExpr("'D' AS doc_id", "CAST(1 + n_regionkey AS BIGINT) AS owner", "CAST(200000 + n_nationkey AS BIGINT) AS handle", "CAST(n_nationkey AS INT) AS seq", "CAST(100 + n_nationkey AS BIGINT) AS block", "n_nationkey * 1000D AS x", "n_nationkey * 500D AS y", "CAST(1 + n_nationkey % 3 AS DOUBLE) AS sx", "radians(CAST(n_nationkey * 15 AS DOUBLE)) AS rot")
        back = self("nation").where("n_nationkey < 3").selectExpr("'D' AS doc_id", "CAST(100 + n_nationkey AS BIGINT) AS owner", "CAST(300000 + n_nationkey AS BIGINT) AS handle", "-1 AS seq", "CAST(1 + n_regionkey AS BIGINT) AS block", "0D AS x", "0D AS y", "1D AS sx", "0D AS rot")
        return region.unionByName(nation).unionByName(back).withColumn("t", insert_affine(F.col("x"), F.col("y"), F.col("sx"), F.col("sx"), F.col("rot"))).drop("x", "y", "sx", "rot")

    def block_lines(self) -> DataFrame:
        """A line per customer in its nation's block."""
        c = self("customer").selectExpr("'D' AS doc_id", "CAST(100 + c_nationkey AS BIGINT) AS owner", "c_custkey + 1000000 AS handle", "CAST(c_custkey AS INT) AS seq", "c_acctbal AS x", "CAST(c_custkey % 100 AS DOUBLE) AS y")
        return c.withColumn("strokes", F.array(stroke(F.col("x"), F.lit(0.0), F.col("x") + 10, F.col("y")))).drop("x", "y")


SQL = {
    "points": """SELECT o_orderstatus AS doc_id, o_orderkey + 1 AS handle, o_totalprice AS x, CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) * 100 AS DOUBLE) AS y,
  CAST(o_custkey % 10 AS BIGINT) AS layer, CAST(100 + (o_orderkey % 7) * 50 AS DOUBLE) AS height, radians(CAST((o_orderkey % 29) * 15 AS DOUBLE)) AS rotation, o_orderpriority AS text,
  CAST(o_orderkey % 260 AS INT) AS color_index, CASE WHEN o_orderkey % 11 = 0 THEN o_orderkey * 37 % 16777216 END AS true_color FROM orders""",
    "layers": "SELECT unnest(['F','O','P']) AS doc_id, s_suppkey AS layer_handle, s_name AS name, s_nationkey AS aci, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey * 100 END AS true_color FROM supplier WHERE s_suppkey < 8",
    "sheets": """SELECT unnest(['F','O','P']) AS doc_id, CAST(n_nationkey + 1 AS INT) AS sheet_index, n_name AS name, n_nationkey % 5 * 60000.0 AS min_x, n_nationkey // 5 * 50000.0 AS min_y,
  n_nationkey % 5 * 60000.0 + 62000 AS max_x, n_nationkey // 5 * 50000.0 + 45000 AS max_y FROM nation""",
    "vertices": "SELECT l_returnflag AS doc_id, l_orderkey + 1 AS owner, l_linenumber, l_partkey, l_suppkey, l_extendedprice AS x, l_quantity * 1000 AS y, l_suppkey % 10 AS layer FROM lineitem",
    "strokes": """SELECT * FROM (SELECT doc_id, owner, x AS x1, y AS y1, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM vertices
  WINDOW w AS (PARTITION BY doc_id, owner ORDER BY l_linenumber, l_partkey, l_suppkey, x, y)) WHERE x2 IS NOT NULL""",
    "e": "SELECT * FROM (SELECT doc_id, x1 AS x, y1 AS y FROM strokes UNION ALL SELECT doc_id, x2, y2 FROM strokes) WHERE abs(x) < 1e7 AND abs(y) < 1e7",
}


def with_views(sql: str, *names: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in names) + " " + sql
