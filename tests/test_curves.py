import math

import numpy as np

from draftlake.functions.curves import fitted_points, helix_strokes, spline_points
from draftlake.sources import dxf, dxf_binary


def test_spline_of_one_span_is_a_bezier_curve():
    c = np.array([[0, 0], [1, 2], [3, 2], [4, 0]], float)
    p = spline_points(3, np.array([0, 0, 0, 0, 1, 1, 1, 1], float), c)
    t = np.linspace(0, 1, 17)[:, None]
    assert np.allclose(p, (1 - t) ** 3 * c[0] + 3 * t * (1 - t) ** 2 * c[1] + 3 * t**2 * (1 - t) * c[2] + t**3 * c[3])


def test_rational_quarter_circle_and_fallback():
    c = np.array([[1, 0], [1, 1], [0, 1]], float)
    p = spline_points(2, np.array([0, 0, 0, 1, 1, 1], float), c, np.array([1, math.sqrt(0.5), 1]))
    assert np.allclose(np.hypot(p[:, 0], p[:, 1]), 1)
    assert spline_points(2, np.array([0, 1], float), c) is c


def test_fit_points_are_met():
    f = np.array([[0, 0], [1, 3], [2, -1], [5, 5]], float)
    assert np.allclose(fitted_points(f)[::16], f)


def test_helix(spark):
    from pyspark.sql import functions as F

    s = spark.range(1).select(helix_strokes(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0), F.lit(2.0)).alias("s")).first()["s"]
    assert len(s) == 64 and abs(s[-1]["x2"] - 1) < 1e-9


def test_binary_dxf(spark):
    rows = [(0, "SECTION"), (2, "ENTITIES"), (0, "CIRCLE"), (5, "B2"), (8, "0"), (10, "1.5"), (20, "-2.0"), (40, "3.25"), (62, "5"), (310, "0AFF"), (0, "ENDSEC"), (0, "EOF")]
    files = spark.createDataFrame([("a", bytearray(dxf_binary.encode(rows))), ("b", bytearray(b"none")), ("c", bytearray(dxf_binary.encode(rows)[:-3]))], "doc_id string, content binary")
    p = dxf_binary.pairs(files)
    assert [(r["code"], r["raw"]) for r in p.where("doc_id = 'a'").orderBy("idx").collect()] == rows
    assert p.where("doc_id = 'b'").count() == 0 and p.where("doc_id = 'c'").count() == len(rows) - 1
    e = dxf.entities(dxf.records(p.where("doc_id = 'a'"))).first()
    assert (e["type_name"], e["radius"], e["points"][0]["x"], e["color_index"]) == ("CIRCLE", 3.25, 1.5, 5)


def test_spline_column(spark):
    from pyspark.sql import functions as F

    from draftlake.functions.curves import spline_strokes

    pts = "array(named_struct('x', 0D, 'y', 0D), named_struct('x', 1D, 'y', 2D), named_struct('x', 3D, 'y', 0D))"
    df = spark.sql(f"SELECT 2 AS degree, array(0D, 0D, 0D, 1D, 1D, 1D) AS knots, {pts} AS control, CAST(NULL AS ARRAY<DOUBLE>) AS weights, {pts} AS fit")
    assert len(df.select(spline_strokes(*[F.col(c) for c in df.columns]).alias("s")).first()["s"]) == 16
