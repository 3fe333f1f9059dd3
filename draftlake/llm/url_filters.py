"""URL filters: dated list entries become validity intervals, captures are joined to the entries active at fetch time.

An entry is (list, key, action add/remove, at): a key is a host name, which covers its subdomains, or a host with a
path prefix. The events of one list and key, in time order, alternate; each add is valid until the next remove. A
capture asks for its host, its parent domains and its path prefixes; all are joined to the intervals on the key and the
time in one equi-join, whose large side Spark may split when a host is hot, and whose small side it broadcasts only
under its own size threshold. Per capture the longest key decides; on one key, an allow list wins over a block list.

DataFrame functions only. Defined results: a null or unparsable URL, or a null time, is active on no list and kept;
repeated captures each get their own row; events of one key at one time count as the last action in the order remove,
add (so the key is listed); empty tables give empty results or unmatched captures; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: Depth of the parents and prefixes in ORACLE_SQL only; the hosts and lists of the tables are no deeper.
MAX_LABELS, MAX_SEGMENTS = 8, 4
ALLOW, BLOCK = "allow", "block"


def host(url: Column) -> Column:
    """Lower-cased host without user, port or a leading www., null if there is none."""
    h = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1))
    return F.nullif(F.regexp_replace(h, r"^www\.", ""), F.lit(""))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)


def keys(url: Column, n_labels: Column, n_segments: Column) -> Column:
    """The host, its parents of two labels or more, and the host with each path prefix, as deep as any key listed."""
    h = host(url)
    labels = F.split(h, r"\.")
    parents = F.transform(F.sequence(F.lit(2), F.greatest(F.least(F.size(labels), n_labels), F.lit(2))), lambda n: F.array_join(F.slice(labels, -n, n), "."))
    segments = F.filter(F.split(path(url), "/"), lambda s: s != "")
    prefixes = F.transform(F.sequence(F.lit(1), F.greatest(F.least(F.size(segments), n_segments), F.lit(1))), lambda n: F.concat(h, F.lit("/"), F.array_join(F.slice(segments, 1, n), "/")))
    none = F.array().cast("array<string>")
    out = F.concat(
        F.array(h),
        F.when(F.size(labels) >= 2, parents).otherwise(none),
        F.when(F.size(segments) >= 1, prefixes).otherwise(none),
    )
    return F.when(h.isNull(), none).otherwise(F.array_distinct(out))


def intervals(entries: DataFrame) -> DataFrame:
    """(list, key, valid_from, valid_to): half-open, open-ended without a later remove."""
    last = entries.where("list IS NOT NULL AND key IS NOT NULL AND at IS NOT NULL").groupBy("list", "key", "at").agg(F.min("action").alias("action"))
    w = Window.partitionBy("list", "key").orderBy("at")
    turns = last.withColumn("before", F.lag("action").over(w)).where(F.col("before").isNull() | (F.col("before") != F.col("action")))
    spans = turns.withColumn("valid_to", F.lead("at").over(w))
    return spans.where("action = 'add'").select("list", "key", F.col("at").alias("valid_from"), "valid_to")


def filter_urls(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures (capture_id, url, fetched) with the deciding list and key, how many entries were active, and kept."""
    rows = captures.select("capture_id", "url", "fetched", F.monotonically_increasing_id().alias("__row"))
    spans = intervals(entries)
    # One row, also without entries: no parent or prefix that is left out can be a key.
    deepest = spans.agg(
        F.coalesce(F.max(F.size(F.split(F.substring_index("key", "/", 1), r"\."))), F.lit(0)).alias("__labels"),
        F.coalesce(F.max(F.size(F.split("key", "/")) - 1), F.lit(0)).alias("__segments"),
    )
    asked = rows.crossJoin(F.broadcast(deepest)).select("__row", "capture_id", "url", "fetched", F.explode_outer(keys(F.col("url"), F.col("__labels"), F.col("__segments"))).alias("key"))
    active = asked.join(
        spans.withColumnRenamed("key", "__key"),
        (F.col("key") == F.col("__key")) & (F.col("fetched") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("fetched") < F.col("valid_to"))),
        "left",
    )
    best = F.max(F.when(F.col("list").isNotNull(), F.struct(F.length("key").alias("n"), (F.col("list") == ALLOW).alias("allow"), F.col("list"), F.col("key"), F.col("valid_from"))))
    out = active.groupBy("__row").agg(
        F.first("capture_id").alias("capture_id"), F.first("url").alias("url"), F.first("fetched").alias("fetched"), F.count("list").alias("n_active"), best.alias("best")
    )
    return out.select(
        "capture_id", host(F.col("url")).alias("host"), "fetched", "n_active",
        F.col("best.list").alias("list"), F.col("best.key").alias("key"), F.col("best.valid_from").alias("listed_at"),
        F.coalesce(F.col("best.list") != BLOCK, F.lit(True)).alias("kept"),
    )


# The tables have neither fetch times nor lists. Captures get a time from their id over 2024; entries are derived from
# the hosts of all pages and a fixed list, their dates and turns from a digest of the key, so that SQL can do the same.
#: Lists, keys, and days of 2024 on which a key is added, removed and added again.
LISTED = (("block", "spam-farm.example.org", 10, 150, 200), ("allow", "spam-farm.example.org/en", 60, 90, 300), ("block", "example.net", 100, 160, 400))


def _digest(c: str, k: int) -> str:
    """Four hex digits of the key's digest as a number, in SQL that Spark and DuckDB share but for the conversion."""
    return f"conv(substr(md5({c}), {4 * k + 1}, 4), 16, 10)"


def captures_of(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").alias("capture_id"), "url", (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.pmod(F.col("page_id") * 7, F.lit(366)).cast("int"), F.pmod("page_id", F.lit(24)).cast("int"))).alias("fetched"))


def _dated(df: DataFrame) -> DataFrame:
    turn = F.explode(F.array(*[F.struct(F.lit(a).alias("action"), F.col(d).cast("int").alias("day")) for a, d in (("add", "d0"), ("remove", "d1"), ("add", "d2"))]))
    return df.select("list", "key", turn.alias("t")).select("list", "key", "t.action", (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval("t.day")).alias("at"))


def entries_of(pages: DataFrame) -> DataFrame:
    """A fifth of the hosts on the block list, a fifth on the allow list, each with add, remove and add again."""
    hosts = pages.select(host(F.col("url")).alias("key")).where("key IS NOT NULL").distinct()
    digits = [F.expr(_digest("key", k)).cast("int") for k in range(4)]
    drawn = hosts.select(
        F.when(digits[0] % 5 == 0, BLOCK).when(digits[0] % 5 == 1, ALLOW).alias("list"), "key",
        (digits[1] % 120).alias("d0"), (120 + digits[2] % 120).alias("d1"), (240 + digits[3] % 120).alias("d2"),
    ).where("list IS NOT NULL")
    fixed = pages.sparkSession.createDataFrame(list(LISTED), "list string, key string, d0 int, d1 int, d2 int")
    return _dated(drawn.unionByName(fixed))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(captures_of(pages), entries_of(pages))


def _dk(k: int) -> str:
    return f"CAST('0x' || substr(md5(key), {4 * k + 1}, 4) AS INTEGER)"


ORACLE_SQL = f"""
WITH p AS (SELECT row_number() OVER () AS r, page_id AS capture_id, url, TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST((page_id * 7) % 366 AS INTEGER)) + to_hours(page_id % 24) AS fetched,
  nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '^www\\.', ''), '') AS host,
  list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), '/'), lambda s: s <> '') AS seg FROM pages),
q AS (SELECT *, string_split(host, '.') AS lab FROM p),
k AS (SELECT DISTINCT r, key FROM (
  SELECT r, host AS key FROM q WHERE host IS NOT NULL
  UNION ALL SELECT r, array_to_string(lab[len(lab) - n + 1:], '.') FROM (SELECT r, lab, unnest(range(2, least(len(lab), {MAX_LABELS}) + 1)) AS n FROM q WHERE host IS NOT NULL)
  UNION ALL SELECT r, host || '/' || array_to_string(seg[:n], '/') FROM (SELECT r, host, seg, unnest(range(1, least(len(seg), {MAX_SEGMENTS}) + 1)) AS n FROM q WHERE host IS NOT NULL))),
h AS (SELECT DISTINCT host AS key FROM p WHERE host IS NOT NULL),
drawn AS (SELECT CASE {_dk(0)} % 5 WHEN 0 THEN 'block' WHEN 1 THEN 'allow' END AS list, key, {_dk(1)} % 120 AS d0, 120 + {_dk(2)} % 120 AS d1, 240 + {_dk(3)} % 120 AS d2 FROM h
  UNION ALL SELECT * FROM (VALUES {", ".join(str(x) for x in LISTED)}) v(list, key, d0, d1, d2)),
ev AS (SELECT list, key, unnest(['add', 'remove', 'add']) AS action, TIMESTAMP '2024-01-01 00:00:00' + to_days(unnest([d0, d1, d2])) AS ts FROM drawn WHERE list IS NOT NULL),
one AS (SELECT list, key, ts, min(action) AS action FROM ev GROUP BY ALL),
turn AS (SELECT * FROM (SELECT *, lag(action) OVER (PARTITION BY list, key ORDER BY ts) AS before FROM one) WHERE before IS NULL OR before <> action),
iv AS (SELECT * FROM (SELECT list, key, action, ts AS f, lead(ts) OVER (PARTITION BY list, key ORDER BY ts) AS t FROM turn) WHERE action = 'add'),
act AS (SELECT k.r, iv.list, iv.key, iv.f, row_number() OVER (PARTITION BY k.r ORDER BY length(iv.key) DESC, iv.list, iv.key DESC) AS pick, count(*) OVER (PARTITION BY k.r) AS n
  FROM k JOIN iv ON k.key = iv.key JOIN p ON p.r = k.r WHERE p.fetched >= iv.f AND (iv.t IS NULL OR p.fetched < iv.t))
SELECT capture_id, host, fetched, coalesce(n, 0) AS n_active, list, key, f AS listed_at, coalesce(list, '') <> 'block' AS kept FROM p LEFT JOIN (SELECT * FROM act WHERE pick = 1) a USING (r)
"""
