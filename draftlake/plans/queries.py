"""The query catalogue: each operator over the driver's tables, with the DuckDB SQL that must agree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import color, geometry, text
from ..operators import bounds, expand, resolve, sheets, tessellate
from ..schema import ENTITIES
from ..sinks import dump, svg
from ..sinks import dwg as dwg_sink
from ..sources import dwg, dxf
from .adapters import Tables, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, *views: str):
    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = with_views(sql, *views) if views else sql
        return f

    return add


def rounded(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, places) for n in names})


@query(
    """SELECT p.doc_id, p.handle, trim(p.text) AS text, p.x, p.y, p.height, round(fmod(degrees(p.rotation) + 1e-9, 360), 6) AS rotation, coalesce(l.name, '') AS layer_name, coalesce(s.i, 0) AS sheet
    FROM points p LEFT JOIN layers l ON l.doc_id = p.doc_id AND l.layer_handle = p.layer
    LEFT JOIN (SELECT p.handle, min(sheet_index) AS i FROM points p JOIN sheets s ON s.doc_id = p.doc_id AND x BETWEEN min_x AND max_x AND y BETWEEN min_y AND max_y GROUP BY 1) s ON s.handle = p.handle
    WHERE trim(p.text) <> '' AND abs(x) < 1e7 AND abs(y) < 1e7""",
    "points", "layers", "sheets",
)
def text_sheet_assign(t: Tables) -> DataFrame:
    """Flagship: every text in world coordinates with its layer name and the sheet it lies on."""
    labelled = resolve.with_layer(t.points(), t.layers()).drop("rgb")
    out = sheets.assign(labelled.where(geometry.plausible(F.col("x"), F.col("y"))), t.sheets())
    return out.select("doc_id", "handle", F.trim("text").alias("text"), "x", "y", "height", F.round(F.pmod(F.degrees("rotation") + 1e-9, F.lit(360.0)), 6).alias("rotation"), "layer_name", "sheet").where("text <> ''")


@query("SELECT p.doc_id, p.layer, coalesce(l.name, '') AS layer_name, count(*) AS n FROM points p LEFT JOIN layers l ON l.doc_id = p.doc_id AND l.layer_handle = p.layer GROUP BY ALL", "points", "layers")
def layer_entity_counts(t: Tables) -> DataFrame:
    return resolve.with_layer(t.points(), t.layers()).groupBy("doc_id", "layer", "layer_name").agg(F.count("*").alias("n"))


_ACI = "(SELECT * FROM (VALUES " + ", ".join(f"({i}, {c[0] << 16 | c[1] << 8 | c[2]})" for i in range(1, 256) if (c := color.rgb(i))) + ") v(i, c))"


@query(
    f"""SELECT p.doc_id, p.handle, CAST(coalesce(p.true_color & 16777215, CASE WHEN p.color_index NOT IN (0, 256, 257) THEN a.c END,
      CASE WHEN (l.true_color & 16777215) > 255 THEN l.true_color & 16777215 ELSE b.c END, d.c, 0) AS BIGINT) AS rgb
    FROM points p LEFT JOIN layers l ON l.doc_id = p.doc_id AND l.layer_handle = p.layer LEFT JOIN {_ACI} a ON a.i = p.color_index
    LEFT JOIN {_ACI} b ON b.i = l.true_color LEFT JOIN {_ACI} d ON d.i = l.aci""",
    "points", "layers",
)
def entity_layer_resolve(t: Tables) -> DataFrame:
    return resolve.with_layer(t.points(), t.layers()).select("doc_id", "handle", "rgb")


@query("SELECT event_type AS type_name, count(*) AS n FROM events GROUP BY 1")
def type_histogram(t: Tables) -> DataFrame:
    return t("events").groupBy(F.col("event_type").alias("type_name")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, block_handle, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, block_handle) AS r FROM (SELECT doc_id, owner AS block_handle, count(*) AS n FROM vertices GROUP BY 1, 2)) WHERE r = 1", "vertices")
def largest_block(t: Tables) -> DataFrame:
    return resolve.largest_block(t.vertices())


@query("SELECT doc_id, owner, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey, l_suppkey) AS children FROM vertices GROUP BY 1, 2", "vertices")
def block_children_ordered(t: Tables) -> DataFrame:
    kids = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey")))
    return t.vertices().groupBy("doc_id", "owner").agg(F.array_join(F.transform(kids, lambda k: k["l_partkey"].cast("string")), ",").alias("children"))


@query("SELECT i.k AS insert_handle, i.pos, a.l_partkey AS handle, a.n FROM (SELECT o_orderkey AS k, unnest(range(3)) AS pos, unnest([o_orderkey % 500, o_custkey % 500, 100000000]) AS h FROM orders) i JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) a ON a.l_partkey = i.h")
def attrib_lookup(t: Tables) -> DataFrame:
    ins = t("orders").selectExpr("'D' AS doc_id", "o_orderkey AS handle", "array(o_orderkey % 500, o_custkey % 500, 100000000L) AS attribs")
    att = t("lineitem").groupBy(F.lit("D").alias("doc_id"), F.col("l_partkey").alias("handle")).agg(F.count("*").alias("n"))
    return resolve.attributes(ins, att).select("insert_handle", F.col("pos").cast("bigint").alias("pos"), "handle", "n")


@query("SELECT doc_id, owner, count(*) AS n_points, round(sum(x), 4) AS sum_x FROM vertices GROUP BY 1, 2", "vertices")
def polyline_vertices(t: Tables) -> DataFrame:
    p = resolve.polyline_points(t.vertices(), "l_linenumber", "l_partkey", "l_suppkey")
    return p.select("doc_id", "owner", F.size("points").cast("bigint").alias("n_points"), F.round(F.aggregate("points", F.lit(0.0), lambda a, q: a + q["x"]), 4).alias("sum_x"))


@query("SELECT * FROM strokes", "vertices", "strokes")
def polyline_strokes(t: Tables) -> DataFrame:
    p = resolve.polyline_points(t.vertices(), "l_linenumber", "l_partkey", "l_suppkey", "x", "y")
    return p.select("doc_id", "owner", F.explode(geometry.path_strokes(F.col("points"))).alias("s")).select("doc_id", "owner", "s.*")


@query("SELECT p_partkey AS handle, coalesce(b.n, 0) AS n_children, CASE WHEN b.n IS NULL THEN 'points' ELSE 'block' END AS shown_by FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_quantity > 45 GROUP BY 1) b ON b.l_partkey = p_partkey")
def dimension_fallback(t: Tables) -> DataFrame:
    kids = t("lineitem").where("l_quantity > 45").groupBy(F.col("l_partkey").alias("handle")).agg(F.count("*").alias("n"))
    j = t("part").select(F.col("p_partkey").alias("handle")).join(kids, "handle", "left")
    return j.select("handle", F.coalesce("n", F.lit(0)).alias("n_children"), F.when(F.col("n").isNull(), "points").otherwise("block").alias("shown_by"))


@query("""SELECT event_id AS handle, coalesce(CASE WHEN event_id % 17 = 0 THEN event_id ELSE h END, -1) AS owner FROM (SELECT *, last_value(CASE WHEN event_type = 'view' THEN event_id WHEN event_type = 'purchase' THEN -1 END IGNORE NULLS) OVER (PARTITION BY user_id % 8 ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS h0,
  nullif(h0, -1) AS h FROM events) WHERE event_type = 'click'""")
def host_carry_forward(t: Tables) -> DataFrame:
    r = t("events").selectExpr("user_id % 8 AS doc_id", "event_id AS idx", "event_id AS handle", "event_type", "CASE WHEN event_id % 17 = 0 THEN event_id END AS owner")
    return resolve.carried_host(r, F.col("event_type") == "view", F.col("event_type") == "click", F.col("event_type") == "purchase").select("handle", F.coalesce("owner", F.lit(-1)).alias("owner"))


@query("SELECT s.doc_id, s.sheet_index, count(p.handle) AS n FROM sheets s LEFT JOIN points p ON s.doc_id = p.doc_id AND x BETWEEN min_x AND max_x AND y BETWEEN min_y AND max_y GROUP BY 1, 2", "points", "sheets")
def dots_per_frame(t: Tables) -> DataFrame:
    return sheets.dots_per_sheet(t.points(), t.sheets())


@query("SELECT doc_id, handle, x, y FROM points p WHERE NOT EXISTS (SELECT 1 FROM sheets s WHERE s.doc_id = p.doc_id AND x BETWEEN min_x AND max_x AND y BETWEEN min_y AND max_y)", "points", "sheets")
def residual_dots(t: Tables) -> DataFrame:
    return sheets.residual(t.points(), t.sheets()).select("doc_id", "handle", "x", "y")


@query("SELECT doc_id, avg(CASE WHEN (x, y) IN (SELECT (x, y) FROM points WHERE text LIKE '1%' OR text LIKE '2%') THEN 1.0 ELSE 0.0 END) AS fraction FROM points GROUP BY 1", "points")
def text_dot_fraction(t: Tables) -> DataFrame:
    p = t.points()
    marks = p.where("text LIKE '1%' OR text LIKE '2%'").select("x", "y").distinct().withColumn("hit", F.lit(1.0))
    return p.join(marks, ["x", "y"], "left").groupBy("doc_id").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("fraction"))


@query("SELECT handle FROM points WHERE abs(x * 50) < 1e7 AND abs(y) < 1e7", "points")
def plausible_points(t: Tables) -> DataFrame:
    return t.points().where(geometry.plausible(F.col("x") * 50, F.col("y"))).select("handle")


@query("SELECT event_id FROM events WHERE value IS NOT NULL AND event_id % 7 NOT IN (0, 1)")
def finite_guard(t: Tables) -> DataFrame:
    v = F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).when(F.col("event_id") % 7 == 1, F.lit(float("inf"))).otherwise(F.col("value"))
    return t("events").where(geometry.finite(v)).select("event_id")


@query("SELECT doc_id, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y FROM points GROUP BY 1", "points")
def aabb(t: Tables) -> DataFrame:
    return bounds.aabb(t.points())


@query("SELECT doc_id, round(median(x), 6) AS median_x, round(median(y), 6) AS median_y FROM points GROUP BY 1", "points")
def median_xy(t: Tables) -> DataFrame:
    return rounded(bounds.median(t.points()), "median_x", "median_y")


@query("SELECT doc_id, " + ", ".join(f"(list_sort(list({c})))[CAST(floor((count(*) - 1) * {q}) AS BIGINT) + 1] AS {n}_{c}" for c in "xy" for n, q in (("low", 0.005), ("high", 0.995))) + " FROM points GROUP BY 1", "points")
def quantile_bounds(t: Tables) -> DataFrame:
    return bounds.quantiles(t.points())


@query("""SELECT doc_id, round(mx - 3 * px, 4) AS min_x, round(my - 3 * py, 4) AS min_y, round(mx + 3 * px, 4) AS max_x, round(my + 3 * py, 4) AS max_y FROM (
  SELECT doc_id, any_value(mx) AS mx, any_value(my) AS my, (list_sort(list(abs(x - mx))))[CAST(floor((count(*) - 1) * 0.9) AS BIGINT) + 1] AS px, (list_sort(list(abs(y - my))))[CAST(floor((count(*) - 1) * 0.9) AS BIGINT) + 1] AS py
  FROM points JOIN (SELECT doc_id, median(x) AS mx, median(y) AS my FROM points GROUP BY 1) USING (doc_id) GROUP BY 1)""", "points")
def robust_bounds(t: Tables) -> DataFrame:
    return rounded(bounds.robust(t.points()), "min_x", "min_y", "max_x", "max_y", places=4)


@query(
    """SELECT s.* FROM strokes s WHERE NOT EXISTS (SELECT 1 FROM (SELECT doc_id, x, y FROM (SELECT doc_id, trunc(x1 / 1000) AS x, trunc(y1 / 1000) AS y FROM strokes UNION ALL SELECT doc_id, trunc(x2 / 1000), trunc(y2 / 1000) FROM strokes) GROUP BY ALL HAVING count(*) > 12) e
    WHERE e.doc_id = s.doc_id AND ((e.x = trunc(x1 / 1000) AND e.y = trunc(y1 / 1000)) OR (e.x = trunc(x2 / 1000) AND e.y = trunc(y2 / 1000))))""",
    "vertices", "strokes",
)
def radiating_filter(t: Tables) -> DataFrame:
    return bounds.without_radiating(t.strokes(), 1000.0)


@query("""SELECT s.* FROM strokes s JOIN (SELECT doc_id, min(x) AS a, min(y) AS b, max(x) AS c, max(y) AS d FROM vertices GROUP BY 1) v USING (doc_id)
  WHERE sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) <= 0.2 * sqrt((c - a) * (c - a) + (d - b) * (d - b))""", "vertices", "strokes")
def oversize_filter(t: Tables) -> DataFrame:
    return bounds.without_oversize(t.strokes(), bounds.aabb(t.vertices()), 0.2)


@query("""SELECT s.* FROM strokes s JOIN (SELECT doc_id, (lx + hx) / 2 AS cx, (ly + hy) / 2 AS cy, sqrt((hx - lx) * (hx - lx) + (hy - ly) * (hy - ly)) / 2 AS half FROM (
  SELECT doc_id, CASE WHEN n < 4 THEN ax ELSE mx - rx END AS lx, CASE WHEN n < 4 THEN bx ELSE mx + rx END AS hx, CASE WHEN n < 4 THEN ay ELSE my - ry END AS ly, CASE WHEN n < 4 THEN by_ ELSE my + ry END AS hy FROM (
  SELECT *, CASE WHEN 3 * px < 1e-6 THEN 10 ELSE 3 * px END AS rx, CASE WHEN 3 * py < 1e-6 THEN 10 ELSE 3 * py END AS ry FROM (
  SELECT doc_id, count(*) AS n, any_value(mx) AS mx, any_value(my) AS my, min(x) AS ax, max(x) AS bx, min(y) AS ay, max(y) AS by_, (list_sort(list(abs(x - mx))))[CAST(floor((count(*) - 1) * 0.9) AS BIGINT) + 1] AS px,
    (list_sort(list(abs(y - my))))[CAST(floor((count(*) - 1) * 0.9) AS BIGINT) + 1] AS py
  FROM e JOIN (SELECT doc_id, median(x) AS mx, median(y) AS my FROM e GROUP BY 1) USING (doc_id) GROUP BY 1)))) b USING (doc_id)
  WHERE NOT ((sqrt((x1 - cx) ** 2 + (y1 - cy) ** 2) < 0.04 * half AND sqrt((x2 - cx) ** 2 + (y2 - cy) ** 2) > 1.5 * half) OR (sqrt((x2 - cx) ** 2 + (y2 - cy) ** 2) < 0.04 * half AND sqrt((x1 - cx) ** 2 + (y1 - cy) ** 2) > 1.5 * half))""",
  "vertices", "strokes", "e")
def origin_anchored_filter(t: Tables) -> DataFrame:
    return bounds.without_centre_rays(t.strokes())


@query("SELECT doc_id, CAST(floor(x / 10000) AS BIGINT) AS i, CAST(floor(y / 10000) AS BIGINT) AS j, count(*) AS n FROM points GROUP BY ALL HAVING count(*) >= 5", "points")
def grid_density(t: Tables) -> DataFrame:
    return bounds.grid_density(t.points(), 10000.0, 5)


@query("""SELECT doc_id, cluster, round(avg(v), 6) AS mean, count(*) AS n FROM (SELECT *, CAST(sum(CASE WHEN v - p > 25 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY v ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cluster FROM
  (SELECT doc_id, x AS v, lag(x) OVER (PARTITION BY doc_id ORDER BY x) AS p FROM points)) GROUP BY 1, 2""", "points")
def grid_cluster_1d(t: Tables) -> DataFrame:
    return rounded(bounds.clusters_1d(t.points().select("doc_id", F.col("x").alias("v")), 25.0), "mean")


@query("""SELECT doc_id, round(range_low, 6) AS range_low, round(range_high, 6) AS range_high, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, cluster) AS r FROM (
  SELECT doc_id, cluster, any_value(lo) + min(band) * (any_value(hi) - any_value(lo)) / 64 AS range_low, any_value(lo) + (max(band) + 1) * (any_value(hi) - any_value(lo)) / 64 AS range_high, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT *, sum(CASE WHEN band - p > 10 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY band) AS cluster FROM (SELECT *, lag(band) OVER (PARTITION BY doc_id ORDER BY band) AS p FROM (
  SELECT doc_id, lo, hi, least(floor((x - lo) / (hi - lo) * 64), 63) AS band, count(*) AS n FROM points JOIN (SELECT doc_id, min(x) AS lo, max(x) AS hi FROM points GROUP BY 1) USING (doc_id) GROUP BY ALL))) GROUP BY 1, 2)) WHERE r = 1""", "points")
def principal_range(t: Tables) -> DataFrame:
    return rounded(bounds.principal_range(t.points().select("doc_id", F.col("x").alias("v"))), "range_low", "range_high")


@query("SELECT handle, score, off FROM (SELECT l_orderkey AS handle, l_partkey % 10 AS score, l_partkey * 1000 + l_suppkey * 10 + l_linenumber AS off, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey % 10 DESC, off DESC) AS r FROM lineitem) WHERE r = 1")
def duplicate_handle_best(t: Tables) -> DataFrame:
    c = t("lineitem").selectExpr("'D' AS doc_id", "l_orderkey AS handle", "l_partkey % 10 AS score", "l_partkey * 1000 + l_suppkey * 10 + l_linenumber AS offset")
    return resolve.best_duplicates(c).select("handle", "score", F.col("offset").alias("off"))


@query(r"SELECT o_orderkey, regexp_full_match(chr(CAST(65 + o_custkey % 26 AS INT)) || 'B-' || CAST(o_orderkey % 2000 AS VARCHAR), '[A-Z]{1,6}(?:\([A-Z]{1,4}\))?-\d{1,3}') AS is_number FROM orders")
def sheet_number_match(t: Tables) -> DataFrame:
    name = F.concat(F.char(65 + F.col("o_custkey") % 26), F.lit("B-"), (F.col("o_orderkey") % 2000).cast("string"))
    return t("orders").select("o_orderkey", text.is_sheet_number(name).alias("is_number"))


@query(r"SELECT doc_id, length(regexp_replace(s, '[^\p{Han}]', '', 'g')) >= 4 AND 2 * length(regexp_replace(s, '[^\p{Han}]', '', 'g')) > length(regexp_replace(s, '\s', '', 'g')) AS is_name FROM (SELECT doc_id, text || repeat('测试图纸平面', 100) AS s FROM documents)")
def cjk_dominant(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", text.is_cjk_name(F.concat("text", F.lit("测试图纸平面" * 100))).alias("is_name"))


@query(r"SELECT doc_id, regexp_matches(text, '[\p{L}\p{Nd}]') AS readable FROM documents UNION ALL SELECT doc_id, regexp_matches(regexp_replace(text, '[a-z0-9]', '', 'g'), '[\p{L}\p{Nd}]') FROM documents")
def readable_text(t: Tables) -> DataFrame:
    d = t("documents")
    return d.select("doc_id", text.is_readable(F.col("text")).alias("readable")).unionAll(d.select("doc_id", text.is_readable(F.regexp_replace("text", "[a-z0-9]", ""))))


_MARKED = "concat('{\\\\fArial;A}%%c', text, '\\\\P%%d%%%', doc_id, '\\\\~%%')"


@query(r"""SELECT doc_id, array_to_string(list_transform(regexp_extract_all('{\fArial;A}%%c' || text || '\P%%d%%%' || doc_id || '\~%%', '(?s)(\\[ACcFfHLlOoQSTW][^;]*;?|\\.|[{}]|[^\\{}]+|\\)'),
  lambda x: CASE WHEN x IN ('{', '}', '\') THEN '' WHEN left(x, 1) <> '\' THEN x WHEN x[2] = 'P' THEN chr(10) WHEN x[2] IN ('~', 'X') THEN ' ' WHEN x[2] = '\' THEN '\' ELSE '' END), '') AS plain FROM documents""")
def strip_mtext(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", text.strip_mtext(F.expr(_MARKED)).alias("plain"))


@query(r"""SELECT doc_id, array_to_string(list_transform(w, lambda x, i: CASE WHEN x = '%%' AND i = len(w) THEN '%' WHEN lower(x) = '%%c' THEN 'φ' WHEN lower(x) = '%%d' THEN '°' WHEN lower(x) = '%%p' THEN '±' WHEN x = '%%%' THEN '%' WHEN lower(x) IN ('%%u', '%%o') THEN '' ELSE x END), '') AS plain
  FROM (SELECT doc_id, regexp_extract_all('%%c' || text || '%%d%%%' || doc_id || '%%', '(?s)(%%[cCdDpPuUoO%]|%%|%|[^%]+)') AS w FROM documents)""")
def expand_percent(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", text.expand_percent(F.concat(F.lit("%%c"), F.col("text"), F.lit("%%d%%%"), F.col("doc_id"), F.lit("%%"))).alias("plain"))


@query(r"""SELECT doc_id, CASE WHEN n = '' THEN 'sheet' ELSE n END AS name FROM (SELECT doc_id, regexp_replace(left(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[\s\x0B/\\:*?"<>|]+', '-', 'g'), '[\x00-\x1F\x7F]', '', 'g'), '-{2,}', '-', 'g'), '^[-.]+|[-.]+$', '', 'g'), 80), '[-.]+$', '') AS n FROM documents)""")
def sanitize_name(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", text.sanitize_name(F.col("text")).alias("name"))


@query("SELECT doc_id, replace(replace(replace(replace(replace(replace(text, chr(13), '^M'), chr(10), '^J'), '^J', chr(10)), '^M', chr(13)), '^I', chr(9)), '^ ', '^') AS back FROM documents")
def dxf_unquote(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", text.dxf_unquote(text.dxf_sanitize(F.col("text"))).alias("back"))


@query("SELECT code, CASE WHEN code BETWEEN 10 AND 59 THEN 'double' WHEN code < 10 THEN 'string' WHEN code BETWEEN 60 AND 79 THEN 'int16' WHEN code BETWEEN 90 AND 99 THEN 'int32' ELSE 'string' END AS kind FROM (SELECT DISTINCT CAST(event_id % 100 AS INT) AS code FROM events)")
def code_value_type(t: Tables) -> DataFrame:
    return t("events").select((F.col("event_id") % 100).cast("int").alias("code")).distinct().withColumn("kind", text.group_value_type(F.col("code")))


@query("SELECT s_suppkey, i, round(abs(s_acctbal) * cos(2 * pi() * i / 72), 5) + 0.0 AS x1, round(abs(s_acctbal) * sin(2 * pi() * i / 72), 5) + 0.0 AS y1 FROM (SELECT *, unnest(range(72)) AS i FROM supplier)")
def tess_circle(t: Tables) -> DataFrame:
    s = t("supplier").select("s_suppkey", F.posexplode(geometry.circle_strokes(F.lit(0.0), F.lit(0.0), F.abs("s_acctbal"))).alias("i", "s"))
    return s.select("s_suppkey", F.col("i").cast("bigint").alias("i"), (F.round("s.x1", 5) + 0.0).alias("x1"), (F.round("s.y1", 5) + 0.0).alias("y1"))


@query("SELECT s_suppkey, CAST(least(floor((s_nationkey * 0.2 + 0.1) / (pi() / 60)) + 1, 720) AS BIGINT) AS n, round(cos(s_nationkey * 0.2 + 1.1), 6) AS end_x FROM supplier")
def tess_arc(t: Tables) -> DataFrame:
    arc = geometry.arc_strokes(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0), F.col("s_nationkey") * F.lit(0.2) + F.lit(1.1))
    return t("supplier").select("s_suppkey", arc.alias("s")).select("s_suppkey", F.size("s").cast("bigint").alias("n"), F.round(F.element_at("s", -1)["x2"], 6).alias("end_x"))


@query("SELECT i AS aci, CAST(c // 65536 AS INT) AS r, CAST(c // 256 % 256 AS INT) AS g, CAST(c % 256 AS INT) AS b FROM " + _ACI)
def aci_rgb(t: Tables) -> DataFrame:
    return color.palette(t.spark)


@query(f"SELECT p_partkey, i AS nearest_aci FROM (SELECT p_partkey, i, row_number() OVER (PARTITION BY p_partkey ORDER BY (p_partkey % 256 - c // 65536) * (p_partkey % 256 - c // 65536) + (p_size * 5 - c // 256 % 256) * (p_size * 5 - c // 256 % 256) + (p_partkey % 7 * 30 - c % 256) * (p_partkey % 7 * 30 - c % 256), i) AS n FROM part, {_ACI}) WHERE n = 1")
def nearest_aci(t: Tables) -> DataFrame:
    c = t("part").selectExpr("p_partkey", "p_partkey % 256 AS r", "p_size * 5 AS g", "p_partkey % 7 * 30 AS b")
    return color.nearest_index(c).select("p_partkey", "nearest_aci")


@query("""SELECT c_custkey + 1000000 AS handle, 3 AS depth0, round(n_regionkey * 1000000 + k * x1 * cos(w) + n_nationkey * 1000, 4) AS x1, round(k * x1 * sin(w) + n_nationkey * 500, 4) AS y1
  FROM (SELECT *, 1 + n_nationkey % 3 AS k, radians(n_nationkey * 15.0) AS w, c_acctbal AS x1 FROM customer JOIN nation ON n_nationkey = c_nationkey)""")
def insert_expand(t: Tables) -> DataFrame:
    p = expand.primitives(t.block_lines(), t.inserts())
    s = p.select("handle", (F.col("depth") + 1).alias("depth0"), F.explode("strokes").alias("s"))
    return rounded(s.select("handle", "depth0", "s.x1", "s.y1"), "x1", "y1", places=4)


@query("SELECT a.doc_id, a.sheet_index AS a, b.sheet_index AS b, (least(a.max_x, b.max_x) - greatest(a.min_x, b.min_x)) * (least(a.max_y, b.max_y) - greatest(a.min_y, b.min_y)) AS area FROM sheets a JOIN sheets b ON a.doc_id = b.doc_id AND a.sheet_index < b.sheet_index AND least(a.max_x, b.max_x) > greatest(a.min_x, b.min_x) AND least(a.max_y, b.max_y) > greatest(a.min_y, b.min_y)", "sheets")
def overlap_pairs(t: Tables) -> DataFrame:
    return sheets.overlaps(t.sheets()).select("doc_id", "a", "b", "area")


@query("SELECT a.doc_id, a.sheet_index AS a, b.sheet_index AS b, sqrt(greatest(a.min_x - b.max_x, b.min_x - a.max_x, 0) ** 2 + greatest(a.min_y - b.max_y, b.min_y - a.max_y, 0) ** 2) AS gap FROM sheets a JOIN sheets b ON a.doc_id = b.doc_id AND a.sheet_index < b.sheet_index", "sheets")
def box_gap(t: Tables) -> DataFrame:
    return sheets.gaps(t.sheets()).select("doc_id", "a", "b", "gap")


@query("SELECT doc_id, avg(CASE WHEN height * 0.03 >= 8 THEN 1.0 ELSE 0.0 END) AS pass_rate FROM points GROUP BY 1", "points")
def text_pass_rate(t: Tables) -> DataFrame:
    return sheets.pass_rate(t.points(), 0.03)


@query("SELECT doc_id, CAST(least(greatest(floor(60000 * 8 / (list_sort(list(height)))[count(*) // 4 + 1] + 0.5), 4096), 16384) AS INT) AS width FROM points GROUP BY 1", "points")
def sheet_width(t: Tables) -> DataFrame:
    return sheets.width(t.points(), 60000.0)


@query("SELECT handle, kind FROM (SELECT c_custkey AS handle, 'first' AS kind FROM customer WHERE c_acctbal > 0 UNION ALL SELECT o_custkey, 'rest' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0))")
def union_dedupe(t: Tables) -> DataFrame:
    a = t("customer").where("c_acctbal > 0").selectExpr("'D' AS doc_id", "c_custkey AS handle", "'first' AS kind")
    b = t("orders").selectExpr("'D' AS doc_id", "o_custkey AS handle", "'rest' AS kind")
    return resolve.without_handles_of(b, a).select("handle", "kind")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def props_json(t: Tables) -> DataFrame:
    return t("events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


@query("SELECT event_id % 100 AS doc_id, max(CAST(json_extract(props, '$.k') AS BIGINT)) AS value FROM events WHERE event_type = 'click' GROUP BY 1")
def dictionary_lookup(t: Tables) -> DataFrame:
    e = t("events").selectExpr("event_id % 100 AS doc_id", "event_type AS key", "event_id AS item_handle", "event_id AS handle", "try_variant_get(try_parse_json(props), '$.k', 'bigint') AS value")
    return resolve.dictionary_values(e.select("doc_id", "key", "item_handle"), e.select("doc_id", "handle", "value"), "click").groupBy("doc_id").agg(F.max("value").alias("value"))


@query("SELECT doc_id, name, CAST(handle AS BIGINT) AS handle FROM (SELECT 'D' AS doc_id, name, CASE WHEN k IS NOT NULL THEN k ELSE 1048575 + row_number() OVER (PARTITION BY k IS NULL ORDER BY name) END AS handle FROM (SELECT DISTINCT p_brand AS name, k FROM part LEFT JOIN (SELECT p_brand AS b, min(p_partkey) AS k FROM part WHERE p_size < 3 AND p_partkey % 2 = 0 GROUP BY 1) ON b = p_brand))")
def name_handles(t: Tables) -> DataFrame:
    names = t("part").select(F.lit("D").alias("doc_id"), F.col("p_brand").alias("name"))
    known = t("part").where("p_size < 3 AND p_partkey % 2 = 0").groupBy(F.lit("D").alias("doc_id"), F.col("p_brand").alias("name")).agg(F.min("p_partkey").alias("handle"))
    return resolve.named_handles(names, known)


def _dxf(t: Tables) -> DataFrame:
    """DXF text a region: a block of lines of its suppliers, placed once a nation."""
    pair = lambda *items: "concat_ws('\\n', " + ", ".join(f"'{c}', {v}" for c, v in items) + ")"
    line = pair((0, "'LINE'"), (8, "'L'"), (10, "CAST(s_acctbal AS STRING)"), (20, "'0'"), (11, "CAST(s_acctbal + 10 AS STRING)"), (21, "'5'"))
    ins = pair((0, "'INSERT'"), (5, "hex(n_nationkey + 1)"), (2, "'B'"), (10, "CAST(n_nationkey * 1000 AS STRING)"), (20, "'0'"), (41, "'2'"), (42, "'2'"))
    lines = t("supplier").join(t("nation"), F.expr("s_nationkey = n_nationkey")).groupBy("n_regionkey").agg(F.expr(f"array_join(array_sort(collect_list({line})), '\\n')").alias("lines"))
    places = t("nation").groupBy("n_regionkey").agg(F.expr(f"array_join(array_sort(collect_list({ins})), '\\n')").alias("places"))
    head, mid, end = ("'0\\nSECTION\\n2\\nBLOCKS\\n0\\nBLOCK\\n2\\nB'", "'0\\nENDBLK\\n0\\nENDSEC\\n0\\nSECTION\\n2\\nENTITIES'", "'0\\nENDSEC\\n0\\nEOF'")
    return lines.join(places, "n_regionkey").selectExpr("CAST(n_regionkey AS STRING) AS doc_id", f"concat_ws('\\n', {head}, lines, {mid}, places, {end}) AS value")


@query("""SELECT CAST(n_regionkey AS VARCHAR) AS doc_id, type_name, count(*) AS n_records, CAST(sum(k) AS BIGINT) AS n_pairs FROM (SELECT n_regionkey, 'LINE' AS type_name, 6 AS k FROM supplier JOIN nation ON n_nationkey = s_nationkey
  UNION ALL SELECT n_regionkey, 'INSERT', 7 FROM nation WHERE n_regionkey IN (SELECT n_regionkey FROM supplier JOIN nation ON n_nationkey = s_nationkey)) GROUP BY ALL""")
def record_segments(t: Tables) -> DataFrame:
    r = dxf.records(dxf.pairs(_dxf(t))).where("type_name IN ('LINE', 'INSERT')")
    return r.groupBy("doc_id", "type_name").agg(F.count("*").alias("n_records"), F.sum(F.size("pairs").cast("bigint")).alias("n_pairs"))


@query("""SELECT CAST(a.n_regionkey AS VARCHAR) AS doc_id, b.n_nationkey + 1 AS place, round(2 * s_acctbal + 1000 * b.n_nationkey, 4) AS x1, round(2 * (s_acctbal + 10) + 1000 * b.n_nationkey, 4) AS x2, 10.0 AS y2
  FROM supplier JOIN nation a ON a.n_nationkey = s_nationkey JOIN nation b ON b.n_regionkey = a.n_regionkey""")
def dxf_insert_expand(t: Tables) -> DataFrame:
    """From DXF text to world coordinates: pairs, records, blocks by name, inserts, strokes."""
    e = expand.cut(dxf.resolved(expand.cut(dxf.records(dxf.pairs(_dxf(t))))))
    leaves, ins = tessellate.parts(e)
    seq = ins.select("doc_id", "seq", F.col("handle").alias("place"))
    p = expand.primitives(leaves, ins).select("doc_id", F.col("order")[0].alias("seq"), F.col("strokes")[0].alias("s")).join(seq, ["doc_id", "seq"])
    return rounded(p.select("doc_id", "place", "s.x1", "s.x2", "s.y2"), "x1", "x2", places=4)


@query("""SELECT s_suppkey, i, round(3 * cos(2 * pi() * i / 96) - 4 * 0.5 * sin(2 * pi() * i / 96) + s_nationkey, 5) + 0.0 AS x1, round(4 * cos(2 * pi() * i / 96) + 3 * 0.5 * sin(2 * pi() * i / 96), 5) + 0.0 AS y1 FROM (SELECT *, unnest(range(96)) AS i FROM supplier)""")
def tess_ellipse(t: Tables) -> DataFrame:
    one = lambda v: F.lit(float(v))
    s = t("supplier").select("s_suppkey", F.posexplode(geometry.ellipse_strokes(F.col("s_nationkey"), one(0), one(3), one(4), one(0.5), one(0), one(0))).alias("i", "s"))
    return s.select("s_suppkey", F.col("i").cast("bigint").alias("i"), (F.round("s.x1", 5) + 0.0).alias("x1"), (F.round("s.y1", 5) + 0.0).alias("y1"))


@query("""SELECT s_suppkey, CAST(CASE WHEN b = 0 THEN 1 ELSE least(floor(abs(4 * atan(b)) / (pi() / 60)) + 1, 720) END AS BIGINT) AS n, CASE WHEN b = 0 THEN 2 * s_nationkey + 2.0 ELSE round((s_nationkey + 1) * (1 + b * b) / (2 * abs(b)) * 4 * abs(atan(b)), 1) END AS arc_length
  FROM (SELECT *, s_suppkey % 5 / 4.0 AS b FROM supplier)""")
def tess_bulge(t: Tables) -> DataFrame:
    """One arc segment over a chord of 2 (nationkey + 1): steps, and the length of its arc from its radius and sweep."""
    c = F.col("s_nationkey") + 1.0
    pts = F.array(geometry.point(-c, F.lit(0)), geometry.point(c, F.lit(0)))
    s = t("supplier").select("s_suppkey", (2 * c).alias("chord"), (F.col("s_suppkey") % 5 / 4.0).alias("b"), geometry.bulge_strokes(pts, F.array(F.col("s_suppkey") % 5 / 4.0, F.lit(0.0)), F.lit(False)).alias("s"))
    n, length = F.size("s"), F.aggregate("s", F.lit(0.0), lambda a, x: a + F.hypot(x["x2"] - x["x1"], x["y2"] - x["y1"]))
    step = 4 * F.atan("b") / n  # a polygon's length over its arc's is sin(step / 2) / (step / 2)
    return s.select("s_suppkey", n.cast("bigint").alias("n"), F.when(F.col("b") == 0, length).otherwise(F.round(length * (step / 2) / F.sin(step / 2), 1)).alias("arc_length"))


@query("SELECT doc_id, owner, CAST(CASE WHEN count(*) > 1 THEN count(*) ELSE 0 END AS BIGINT) AS n, round(CASE WHEN count(*) > 1 THEN sum(x) ELSE 0 END, 4) AS sum_x1 FROM vertices GROUP BY 1, 2", "vertices")
def hatch_paths(t: Tables) -> DataFrame:
    """A hatch an order, its vertices one closed loop."""
    p = resolve.polyline_points(t.vertices(), "l_linenumber", "l_partkey", "l_suppkey")
    loop = F.array(F.struct(F.col("points"), F.array().cast("array<double>").alias("bulges")))
    e = p.select("doc_id", "owner", F.lit("HATCH").alias("type_name"), F.lit(None).cast("array<struct<x:double,y:double>>").alias("points"), loop.alias("paths"), *[F.lit(None).cast("double").alias(c) for c in ("radius", "a0", "a1")], F.lit(None).cast("array<double>").alias("bulges"), F.lit(False).alias("closed"))
    s = tessellate.complete(e).select("doc_id", "owner", tessellate.local_strokes().alias("s"))
    return s.select("doc_id", "owner", F.size("s").cast("bigint").alias("n"), F.round(F.aggregate("s", F.lit(0.0), lambda a, x: a + x["x1"]), 4).alias("sum_x1"))


@query("SELECT event_id, CASE WHEN event_id % 20 < 10 THEN 'fixed' || event_id % 20 WHEN event_id % 20 < 15 THEN 'class' || event_id % 20 END AS type_name FROM events")
def type_names(t: Tables) -> DataFrame:
    rows = t("events").selectExpr("'D' AS doc_id", "event_id", "event_id % 20 AS type_code")
    codes = t.spark.range(20).selectExpr("'D' AS doc_id", "id AS type_code")
    own = codes.where("type_code < 15").selectExpr("doc_id", "type_code", "concat('class', type_code) AS name")
    return resolve.with_type_name(rows, codes.where("type_code < 10").selectExpr("type_code", "concat('fixed', type_code) AS name"), own).select("event_id", "type_name")


@query(r"""SELECT p_partkey, CAST(4 * len(regexp_extract_all(n, '[A-Z0-9]')) + 2 * len(regexp_extract_all(n, '[_$*]')) + len(regexp_extract_all(n, '[a-z]')) - 12 * len(regexp_extract_all(n, '[\x00-\x1F]')) - 4 * len(regexp_extract_all(n, '[^A-Za-z0-9_$*\x00-\x1F]')) AS INT) AS score
  FROM (SELECT p_partkey, p_type || CASE WHEN p_partkey % 3 = 0 THEN '_$*' || chr(9) ELSE '' END AS n FROM part)""")
def class_name_scores(t: Tables) -> DataFrame:
    name = F.concat("p_type", F.when(F.col("p_partkey") % 3 == 0, "_$*\t").otherwise(""))
    return t("part").select("p_partkey", text.class_name_score(name).alias("score"))


@query("""SELECT o_orderkey, o_custkey % 4 = 0 AND o_orderkey % 2 = 0 AND NOT (abs(a) <= pi() / 12 OR abs(a - pi()) <= pi() / 12) AS hookline FROM (SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN pi() / 2 ELSE atan2(CAST(o_orderkey % 7 - 3 AS DOUBLE), CAST(o_custkey % 5 - 2 AS DOUBLE)) END AS a FROM orders)""")
def hookline(t: Tables) -> DataFrame:
    zero = geometry.point(F.lit(0), F.lit(0))
    leg = geometry.point(F.col("o_custkey") % 5 - 2, F.col("o_orderkey") % 7 - 3)
    pts = F.when(F.col("o_orderkey") % 3 == 0, F.array(leg, zero)).otherwise(F.array(zero, leg, zero))
    return t("orders").select("o_orderkey", geometry.hookline_on(F.col("o_custkey") % 4, F.col("o_orderkey") % 2, pts).alias("hookline"))


@query("""SELECT doc_id, rgb, layer, row_number() OVER (PARTITION BY doc_id ORDER BY min(f)) AS place, CAST(sum(n) AS BIGINT) AS n FROM (SELECT doc_id, rgb, CASE WHEN row_number() OVER (PARTITION BY doc_id ORDER BY f) <= 200 THEN layer END AS layer, f, n
  FROM (SELECT doc_id, color_index AS rgb, layer, min(handle) AS f, count(*) AS n FROM points GROUP BY ALL)) GROUP BY doc_id, rgb, layer""", "points")
def svg_groups(t: Tables) -> DataFrame:
    p = t.points().select("doc_id", F.col("color_index").alias("rgb"), "layer", F.array("handle").alias("order"))
    return svg.groups(p).withColumn("place", F.col("place").cast("bigint"))


@query("SELECT event_id, '$.' || key AS path, props ->> ('$.' || key) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events) WHERE (props ->> ('$.' || key)) IS NOT NULL")
def props_flatten(t: Tables) -> DataFrame:
    rows = t("events").select("event_id", F.try_parse_json("props").alias("v"))
    flat = dump.flatten(rows, "event_id")
    return flat.select("event_id", F.concat(F.lit("$."), "path").alias("path"), "value")


@query("""SELECT doc_id, sheet_index, CAST(4096 * 2 ** k AS INT) AS width, pass_rate, CAST(k AS INT) AS rerenders FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, sheet_index ORDER BY CASE WHEN pass_rate >= 0.6 THEN 0 ELSE 1 END, CASE WHEN pass_rate >= 0.6 THEN k ELSE -k END) AS r FROM (
  SELECT s.doc_id, s.sheet_index, k, avg(CASE WHEN height * (4096 * 2 ** k) / (max_x - min_x) >= 8 THEN 1.0 ELSE 0.0 END) AS pass_rate FROM sheets s, range(4) r(k), points p
  WHERE p.doc_id = s.doc_id AND x BETWEEN min_x AND max_x AND y BETWEEN min_y AND max_y AND (4096 * 2 ** k) * floor(4096 * 2 ** k * (max_y - min_y) / (max_x - min_x)) <= 4e8 GROUP BY ALL)) WHERE r = 1""", "points", "sheets")
def rerender_plan(t: Tables) -> DataFrame:
    widths = t.sheets().select("doc_id", "sheet_index", F.lit(4096).alias("width"))
    return sheets.planned_widths(t.points(), t.sheets(), widths)


def _dwg(t: Tables) -> DataFrame:
    """Binary drawings of a region: a circle and a text a customer, an insert a supplier."""
    point = "array(struct(CAST({} AS DOUBLE) AS x, CAST({} AS DOUBLE) AS y))"
    of_nation = t("nation").selectExpr("n_nationkey", "CAST(n_regionkey AS STRING) AS doc_id")
    c = t("customer").join(of_nation, F.expr("c_nationkey = n_nationkey"))
    one = "CAST(0 AS BIGINT) AS owner", "'model' AS space"
    circle = c.selectExpr("doc_id", "3 * c_custkey + 3 AS handle", "'CIRCLE' AS type_name", *one, "c_custkey % 9 + 1 AS layer", point.format("c_acctbal", "c_custkey") + " AS points", "CAST(c_nationkey + 0.5 AS DOUBLE) AS radius")
    label = c.selectExpr("doc_id", "3 * c_custkey + 4 AS handle", "'TEXT' AS type_name", *one, "c_custkey % 9 + 1 AS layer", point.format("c_custkey", "c_acctbal") + " AS points", "c_name AS text", "CAST(c_nationkey + 1 AS DOUBLE) AS height")
    place = t("supplier").join(of_nation, F.expr("s_nationkey = n_nationkey")).selectExpr(
        "doc_id", "3 * s_suppkey + 5 AS handle", "'INSERT' AS type_name", *one, "CAST(1 AS BIGINT) AS layer", point.format("s_acctbal", "0") + " AS points", "s_suppkey + 1 AS block", "CAST(s_nationkey - 3 AS DOUBLE) AS sx", "2.0D AS sy"
    )
    rows = circle.unionByName(label, allowMissingColumns=True).unionByName(place, allowMissingColumns=True)
    kinds = {f.name: f.dataType for f in StructType.fromDDL(ENTITIES)}
    rows = rows.withColumns({n: F.lit(None).cast(kinds.get(n, "int")) for n in dwg_sink.ROW if n not in rows.columns and n not in tessellate.OPTIONAL})
    layers = t("region").selectExpr("CAST(r_regionkey AS STRING) AS doc_id", "CAST(1000000000 + r_regionkey AS BIGINT) AS layer_handle", "r_name AS name", "r_regionkey + 1 AS aci")
    blocks = t("nation").selectExpr("CAST(n_regionkey AS STRING) AS doc_id", "CAST(1000000100 + n_nationkey AS BIGINT) AS block_handle", "n_name AS name")
    return dwg_sink.write(rows, layers, blocks)


@query("""SELECT CAST(n_regionkey AS VARCHAR) AS doc_id, handle, type_name, layer, x, y, radius, text, height, block, sx FROM (
  SELECT c_nationkey AS k, 3 * c_custkey + 3 AS handle, 'CIRCLE' AS type_name, c_custkey % 9 + 1 AS layer, c_acctbal AS x, CAST(c_custkey AS DOUBLE) AS y, CAST(c_nationkey + 0.5 AS DOUBLE) AS radius, NULL AS text, CAST(NULL AS DOUBLE) AS height, CAST(NULL AS BIGINT) AS block, 1.0::DOUBLE AS sx FROM customer
  UNION ALL SELECT c_nationkey, 3 * c_custkey + 4, 'TEXT', c_custkey % 9 + 1, CAST(c_custkey AS DOUBLE), c_acctbal, NULL, c_name, CAST(c_nationkey + 1 AS DOUBLE), NULL, 1.0 FROM customer
  UNION ALL SELECT s_nationkey, 3 * s_suppkey + 5, 'INSERT', 1, s_acctbal, 0.0, NULL, NULL, NULL, s_suppkey + 1, CAST(s_nationkey - 3 AS DOUBLE) FROM supplier) JOIN nation ON n_nationkey = k""")
def dwg_entities(t: Tables) -> DataFrame:
    """Rows written as binary drawings, read again by container, object map, records and payloads."""
    p = F.element_at("points", 1)
    return dwg.entities(_dwg(t)).select("doc_id", "handle", "type_name", "layer", p["x"].alias("x"), p["y"].alias("y"), "radius", "text", "height", "block", "sx")


@query("""SELECT CAST(r_regionkey AS VARCHAR) AS doc_id, 1000000000 + r_regionkey AS handle, 'LAYER' AS kind, r_name AS name, CAST(r_regionkey + 1 AS INT) AS aci FROM region
  UNION ALL SELECT CAST(n_regionkey AS VARCHAR), 1000000100 + n_nationkey, 'BLOCK_HEADER', n_name, NULL FROM nation""")
def dwg_objects(t: Tables) -> DataFrame:
    """Layers and blocks of binary drawings."""
    files = _dwg(t)
    y = dwg.layers(files).select("doc_id", F.col("layer_handle").alias("handle"), F.lit("LAYER").alias("kind"), "name", "aci")
    return y.unionByName(dwg.blocks(files).select("doc_id", F.col("block_handle").alias("handle"), F.lit("BLOCK_HEADER").alias("kind"), "name", F.lit(None).cast("int").alias("aci")))


_WIDER = "CASE WHEN sheet_index % 3 = 0 THEN max_x + 40000 ELSE max_x END"


def _last(name: str, sql: str, *views: str, recursive: bool = True) -> None:
    """Oracle SQL of which the last part is a list of further common tables and the final query."""
    ORACLE_SQL[name] = with_views("", *views).rstrip().replace("WITH", "WITH RECURSIVE" if recursive else "WITH", 1) + ", " + sql


@query()
def overlap_dedupe(t: Tables) -> DataFrame:
    return sheets.without_overlaps(t.sheets().withColumn("max_x", F.expr(_WIDER)))


_last(
    "overlap_dedupe",
    f"""w AS (SELECT * REPLACE ({_WIDER} AS max_x) FROM sheets), b AS (SELECT *, (max_x - min_x) * (max_y - min_y) AS area, row_number() OVER (PARTITION BY doc_id ORDER BY (max_x - min_x) * (max_y - min_y) DESC, sheet_index) AS r FROM w),
g AS (SELECT doc_id, CAST(0 AS BIGINT) AS r, CAST([] AS STRUCT(i INT, a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE, s DOUBLE)[]) AS kept FROM b WHERE r = 1 UNION ALL
SELECT g.doc_id, b.r, CASE WHEN len(list_filter(g.kept, lambda k: greatest(least(max_x, k.c) - greatest(min_x, k.a), 0) * greatest(least(max_y, k.d) - greatest(min_y, k.b), 0) > 0.3 * least(area, k.s))) = 0
  THEN list_append(g.kept, {{'i': sheet_index, 'a': min_x, 'b': min_y, 'c': max_x, 'd': max_y, 's': area}}) ELSE g.kept END FROM g JOIN b ON b.doc_id = g.doc_id AND b.r = g.r + 1)
SELECT w.* FROM w JOIN (SELECT doc_id, unnest(list_transform(kept, lambda k: k.i)) AS sheet_index FROM (SELECT doc_id, arg_max(kept, r) AS kept FROM g GROUP BY 1)) USING (doc_id, sheet_index)""",
    "sheets",
)


@query()
def components(t: Tables) -> DataFrame:
    return sheets.grid_components(bounds.grid_density(t.points(), 10000.0, 3))


_last(
    "components",
    """c AS (SELECT doc_id, CAST(floor(x / 10000) AS BIGINT) AS i, CAST(floor(y / 10000) AS BIGINT) AS j, count(*) AS n FROM points GROUP BY ALL HAVING count(*) >= 3),
r AS (SELECT doc_id, i, j, i AS a, j AS b FROM c UNION SELECT r.doc_id, r.i, r.j, c.i, c.j FROM r JOIN c ON c.doc_id = r.doc_id AND abs(c.i - r.a) <= 1 AND abs(c.j - r.b) <= 1),
m AS (SELECT doc_id, i, j, min(b * 1000000 + a) AS k FROM r GROUP BY ALL)
SELECT c.doc_id, c.i, c.j, c.n, CAST(dense_rank() OVER (PARTITION BY c.doc_id ORDER BY k) - 1 AS INT) AS component FROM c JOIN m ON m.doc_id = c.doc_id AND m.i = c.i AND m.j = c.j""",
    "points",
)


@query()
def sheet_detect(t: Tables) -> DataFrame:
    """Points drawn together to patches of 4,000 units, 40,000 apart; held against a plain version in the tests."""
    patch = {c: F.floor(F.col(c) / 40_000) * 40_000 + F.pmod(c, F.lit(40_000)) / 10 for c in "xy"}
    p = t.points().withColumns(patch)
    return sheets.residual_sheets(p.withColumn("is_text", F.lit(True)), t.sheets().where("sheet_index = 1"), p)


@query()
def manifest(t: Tables) -> DataFrame:
    from ..sinks.manifest import manifest as build

    return build(text_sheet_assign(t), t.sheets())


_last(
    "manifest",
    """t AS (SELECT p.doc_id, p.handle, coalesce(min(s.sheet_index), 0) AS sheet_index FROM points p LEFT JOIN sheets s ON s.doc_id = p.doc_id AND x BETWEEN min_x AND max_x AND y BETWEEN min_y AND max_y
  WHERE trim(p.text) <> '' AND abs(x) < 1e7 AND abs(y) < 1e7 GROUP BY ALL), k AS (SELECT doc_id, sheet_index, count(*) AS n FROM t GROUP BY ALL),
l AS (SELECT s.doc_id, list({'index': s.sheet_index, 'name': name, 'box': [CAST(min_x AS DOUBLE), min_y, max_x, max_y], 'texts': coalesce(n, 0)} ORDER BY s.sheet_index) AS sheets FROM sheets s LEFT JOIN k ON k.doc_id = s.doc_id AND k.sheet_index = s.sheet_index GROUP BY 1)
SELECT l.doc_id, CAST(to_json({'schema_version': 1, 'source': l.doc_id, 'sheets': sheets, 'texts_outside': coalesce(n, 0)}) AS VARCHAR) AS manifest FROM l LEFT JOIN k ON k.doc_id = l.doc_id AND k.sheet_index = 0""",
    "points", "sheets",
)
