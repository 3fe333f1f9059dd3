"""Bounds and stroke filters. Points and strokes carry doc_id; all are grouped by it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import plausible
from .expand import cut

#: Buckets of a range of values at a time, and shares in which a group meets its few rows.
BUCKETS, SHARES = 4_096, 64


def aabb(points: DataFrame) -> DataFrame:
    ok = points.where(plausible(F.col("x"), F.col("y")))
    return ok.groupBy("doc_id").agg(*[f(c).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in ("x", "y")])


def beside(rows: DataFrame, few: DataFrame, by: list[str]) -> DataFrame:
    """rows joined with the few rows of each group, whose copies meet an even share of the group each, so that a large
    group is never in one task whatever join is chosen."""
    plain = [c for c, t in rows.dtypes if t in ("double", "bigint", "int", "string", "boolean")]
    dealt = rows.withColumn("__share", F.pmod(F.xxhash64(*plain), F.lit(SHARES)).cast("int"))
    return dealt.join(few.withColumn("__share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1)))), [*by, "__share"]).drop("__share")


def _values(points: DataFrame) -> DataFrame:
    """(k, v, w): per drawing and axis (k) the distinct values and how often each occurs, of plausible points."""
    both = F.explode(F.array(*[F.struct(F.struct("doc_id", F.lit(c).alias("axis")).alias("k"), F.col(c).cast("double").alias("v")) for c in "xy"])).alias("e")
    return points.where(plausible(F.col("x"), F.col("y"))).select(both).groupBy("e.k", "e.v").agg(F.count("*").alias("w"))


def _elements(values: DataFrame, places: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """(k, name, v): of each group k the values at the named places, functions of its size, of the sorted values (k, v, w).

    Values are counted in equal buckets of their range, then those of a wanted bucket in buckets of its own range, at last
    by value; so neither is a group sorted nor gathered. What is in an order is the buckets.
    """
    total = values.groupBy("k").agg(F.sum("w").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    named = F.array(*[F.struct(F.lit(k).alias("name"), f(F.col("n")).cast("bigint").alias("r")) for k, f in places.items()])
    want = total.select("k", "lo", "hi", F.explode(named).alias("w")).select("k", "lo", "hi", "w.*")
    upto = F.sum("c").over(Window.partitionBy("k", "name").orderBy("b"))
    bucket = F.when(F.col("hi") > F.col("lo"), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BUCKETS)).otherwise(0)
    for b in (bucket, bucket, F.col("v")):
        inside = beside(values, want, ["k"]).where("v BETWEEN lo AND hi")
        counts = inside.groupBy("k", "name", "r", b.alias("b")).agg(F.sum("w").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        want = counts.withColumn("upto", upto).where("r < upto AND r >= upto - c").select("k", "name", F.expr("r - (upto - c)").alias("r"), "lo", "hi")
    return want.select("k", "name", F.col("lo").alias("v"))


def _middle(values: DataFrame) -> DataFrame:
    """(k, m): the median, of two middle values their mean."""
    two = _elements(values, {"low": lambda n: F.floor((n - 1) / 2), "high": lambda n: F.ceil((n - 1) / 2)})
    return two.groupBy("k").agg((0.5 * F.min("v") + 0.5 * F.max("v")).alias("m"))


def _wide(rows: DataFrame, *columns: tuple[str, Column]) -> DataFrame:
    """One row a drawing from rows (k, …): per axis the columns, named with the axis."""
    return rows.groupBy(F.col("k.doc_id").alias("doc_id")).agg(*[F.max(F.when(F.col("k.axis") == c, v)).alias(f"{name}_{c}") for c in "xy" for name, v in columns])


def median(points: DataFrame) -> DataFrame:
    return _wide(_middle(_values(points)), ("median", F.col("m")))


def quantiles(points: DataFrame, low: float = 0.005, high: float = 0.995) -> DataFrame:
    """Per axis the elements at int((n-1)*q) of the sorted values."""
    at = {k: (lambda n, q=q: F.floor((n - 1) * q)) for k, q in (("low", low), ("high", high))}
    return _wide(_elements(_values(points), at), *[(k, F.when(F.col("name") == k, F.col("v"))) for k in at])


def robust(points: DataFrame) -> DataFrame:
    """Median plus and minus three times the 90th percentile of the distances from it, per axis; the plain box under four points."""
    values = _values(points)
    mid = cut(_middle(values))
    far = beside(values, mid, ["k"]).select("k", F.abs(F.col("v") - F.col("m")).alias("v"), "w")
    p90 = _elements(far, {"p": lambda n: F.floor((n - 1) * 0.9)}).select("k", F.col("v").alias("p"))
    each = values.groupBy("k").agg(F.sum("w").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).join(mid, "k").join(p90, "k")
    reach, few = F.when(3 * F.col("p") < 1e-6, 10.0).otherwise(3 * F.col("p")), F.col("n") < 4
    sides = {"min": F.when(few, F.col("lo")).otherwise(F.col("m") - reach), "max": F.when(few, F.col("hi")).otherwise(F.col("m") + reach)}
    return _wide(each, *sides.items()).select("doc_id", *[f"{k}_{c}" for k in sides for c in "xy"])


def without_radiating(strokes: DataFrame, cell: float = 1e-6, most: int = 12) -> DataFrame:
    """Strokes neither of whose ends coincides with more than ``most`` stroke ends of the drawing.

    Ends coincide in one cell, found by truncation; ends that aren't plausible coincide with nothing.
    """
    key = lambda x, y: F.when(plausible(F.col(x), F.col(y)), F.struct((F.col(x) / cell).cast("bigint").alias("i"), (F.col(y) / cell).cast("bigint").alias("j")))
    keyed = strokes.withColumns({"__p": key("x1", "y1"), "__q": key("x2", "y2")})
    ends = keyed.select("doc_id", F.explode(F.array("__p", "__q")).alias("__e")).where("__e IS NOT NULL").groupBy("doc_id", "__e").count().where(F.col("count") > most)
    for c in ("__p", "__q"):
        keyed = keyed.join(ends.select("doc_id", F.col("__e").alias(c)), ["doc_id", c], "left_anti")
    return keyed.drop("__p", "__q")


def without_centre_rays(strokes: DataFrame, near: float = 0.04, far: float = 1.5) -> DataFrame:
    """Without strokes that run from close to the centre of the drawing's box to far outside half its diagonal."""
    ends = strokes.select("doc_id", F.explode(F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))).alias("p")).select("doc_id", "p.x", "p.y")
    box = robust(ends)
    j = beside(strokes, box, ["doc_id"])
    cx, cy = (F.col("min_x") + F.col("max_x")) / 2, (F.col("min_y") + F.col("max_y")) / 2
    half = F.hypot(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y")) / 2
    d1, d2 = (F.hypot(F.col(f"x{k}") - cx, F.col(f"y{k}") - cy) for k in (1, 2))
    ray = ((d1 < near * half) & (d2 > far * half)) | ((d2 < near * half) & (d1 > far * half))
    return j.where(~ray).select(strokes.columns)


def without_oversize(strokes: DataFrame, boxes: DataFrame, most: float = 1.5) -> DataFrame:
    """Without strokes longer than 1.5 diagonals of the drawing's box."""
    j = beside(strokes, boxes, ["doc_id"])
    diagonal = F.hypot(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y"))
    return j.where(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) <= most * diagonal).select(strokes.columns)


def principal_range(values: DataFrame, bands: int = 64, gap: int = 9) -> DataFrame:
    """Of the clusters of filled bands between a drawing's smallest and largest value the one with most values, the
    lower on ties; more than ``gap`` empty bands part clusters."""
    w = Window.partitionBy("doc_id")
    lo, hi = F.min("v").over(w), F.max("v").over(w)
    band = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bands), F.lit(bands - 1))
    b = values.withColumns({"lo": lo, "hi": hi}).where("hi > lo").withColumn("band", band).groupBy("doc_id", "lo", "hi", "band").agg(F.count("*").alias("n"))
    o = Window.partitionBy("doc_id").orderBy("band")
    new = (F.col("band") - F.lag("band").over(o) > gap + 1).cast("int")
    c = b.withColumn("new", F.coalesce(new, F.lit(0))).withColumn("cluster", F.sum("new").over(o))
    s = c.groupBy("doc_id", "cluster").agg(F.sum("n").alias("n"), (F.first("lo") + F.min("band") * (F.first("hi") - F.first("lo")) / bands).alias("range_low"), (F.first("lo") + (F.max("band") + 1) * (F.first("hi") - F.first("lo")) / bands).alias("range_high"))
    best = F.max_by(F.struct("range_low", "range_high", "n"), F.struct("n", -F.col("cluster")))
    return s.groupBy("doc_id").agg(best.alias("r")).select("doc_id", "r.*")


def grid_density(points: DataFrame, cell: float, least: int) -> DataFrame:
    """Cells of a fixed size with at least so many points."""
    keyed = points.select("doc_id", F.floor(F.col("x") / cell).alias("i"), F.floor(F.col("y") / cell).alias("j"))
    return keyed.groupBy("doc_id", "i", "j").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def clusters_1d(values: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """Runs of sorted values with neighbours no further apart than the tolerance: mean and size."""
    w = Window.partitionBy("doc_id").orderBy("v")
    new = F.coalesce((F.col("v") - F.lag("v").over(w) > tolerance).cast("int"), F.lit(0))
    numbered = values.withColumn("__new", new).withColumn("cluster", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("doc_id", "cluster").agg(F.avg("v").alias("mean"), F.count("*").alias("n"))
