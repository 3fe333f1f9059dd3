"""Elements of sorted values without sorting a drawing: against plain Python, and by what the plan holds."""

import math
import random
from statistics import median

from draftlake.operators import bounds


def _points(spark):
    draw = random.Random(3)
    sets = {
        "even": [draw.uniform(-1e6, 1e6) for _ in range(3_000)], "ties": [float(draw.randrange(3)) for _ in range(2_001)], "one": [4.5], "two": [1.0, 2.0], "three": [-0.0, 0.0, 5.0],
        "skew": [9e6, *(1 + draw.random() * 1e-9 for _ in range(1_000)), -9e6], "same": [7.25] * 500, "powers": [10.0**-k for k in range(-6, 300)], "wild": [1e9, float("nan"), *map(float, range(10))],
    }
    return sets, spark.createDataFrame([(k, v, -v) for k, vs in sets.items() for v in vs], "doc_id string, x double, y double").repartition(4)


def test_elements_and_bounds(spark):
    sets, points = _points(spark)
    ok = {k: sorted(v for v in vs if abs(v) < 1e7) for k, vs in sets.items()}
    mid = {r["doc_id"]: r for r in bounds.median(points).collect()}
    low = {r["doc_id"]: r for r in bounds.quantiles(points).collect()}
    box = {r["doc_id"]: r for r in bounds.robust(points).collect()}
    assert set(mid) == set(low) == set(box) == set(sets)
    for k, vs in ok.items():
        n = len(vs)
        assert mid[k]["median_x"] == 0.5 * vs[(n - 1) // 2] + 0.5 * vs[n // 2] and math.isclose(mid[k]["median_y"], -median(vs), abs_tol=1e-300)
        down = sorted(-v for v in vs)
        assert [low[k][c] for c in ("low_x", "high_x", "low_y", "high_y")] == [s[math.floor((n - 1) * q)] for s in (vs, down) for q in (0.005, 0.995)]
        m = mid[k]["median_x"]
        p = 3 * sorted(abs(v - m) for v in vs)[math.floor((n - 1) * 0.9)]
        p = 10.0 if p < 1e-6 else p
        assert (box[k]["min_x"], box[k]["max_x"]) == ((vs[0], vs[-1]) if n < 4 else (m - p, m + p))


def test_no_drawing_is_sorted_or_gathered(spark):
    """What a plan orders are counts of buckets; no percentile keeps a drawing's values in one task."""
    _, points = _points(spark)
    for df in (bounds.median(points), bounds.quantiles(points), bounds.robust(points)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "percentile(" not in plan and "row_number()" not in plan


def test_titles_without_sorting_a_sheet(spark):
    """The title is the tall text closest to the middle line, the smallest handle on ties; a sheet's texts are not sorted."""
    from draftlake.operators import sheets

    boxes = spark.createDataFrame([("d", 1, 0.0, 0.0, 10.0, 10.0)], "doc_id string, sheet_index int, min_x double, min_y double, max_x double, max_y double")
    texts = [("d", 3, 4.0, 1.0, "third", 2.0), ("d", 2, 6.0, 1.0, " second ", 1.9), ("d", 1, 5.0, 1.0, "small", 1.0), ("d", 4, 9.0, 1.0, "far", 2.0)]
    got = sheets.residual_titles(boxes, spark.createDataFrame(texts, "doc_id string, handle bigint, x double, y double, text string, height double"))
    assert [tuple(r) for r in got.collect()] == [("d", 1, "second")]
    assert "row_number()" not in got._jdf.queryExecution().optimizedPlan().toString()
