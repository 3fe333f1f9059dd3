"""Splines, helices and clip frames as strokes."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import STROKE
from .geometry import no_strokes, path_strokes, stroke

STEPS_PER_SPAN, STEPS_PER_TURN, MIN_STEPS, MAX_STEPS = 16, 32, 8, 20_000


def spline_points(degree: int, knots: np.ndarray, control: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """Points of a (rational) B-spline, 16 a knot span with length; the control polygon if the knots don't fit."""
    n = len(control)
    if degree < 1 or n <= degree or len(knots) != n + degree + 1 or not np.isfinite(knots).all() or (np.diff(knots) < 0).any():
        return control
    w = np.ones(n) if weights is None or len(weights) != n else weights
    homogeneous = np.column_stack((control * w[:, None], w))
    edges = np.unique(knots[degree : n + 1])
    u = np.concatenate([np.linspace(a, b, STEPS_PER_SPAN, endpoint=False) for a, b in zip(edges, edges[1:])] + [edges[-1:]])
    span = np.clip(np.searchsorted(knots, u, "right") - 1, degree, n - 1)
    d = homogeneous[span[:, None] - degree + np.arange(degree + 1)]
    for r in range(1, degree + 1):
        for j in range(degree, r - 1, -1):
            left, right = knots[span - degree + j], knots[span + 1 + j - r]
            a = np.divide(u - left, right - left, out=np.zeros(len(u)), where=right > left)[:, None]
            d[:, j] = (1 - a) * d[:, j - 1] + a * d[:, j]
    p = d[:, degree]
    return p[:, :2] / np.where(np.abs(p[:, 2:]) < 1e-12, 1.0, p[:, 2:])


def fitted_points(fit: np.ndarray) -> np.ndarray:
    """A Catmull-Rom curve through fit points, 16 steps between neighbours."""
    if len(fit) < 3:
        return fit
    p = np.vstack((fit[:1], fit, fit[-1:]))
    t = np.linspace(0, 1, STEPS_PER_SPAN, endpoint=False)[:, None]
    parts = [0.5 * (2 * b + (c - a) * t + (2 * a - 5 * b + 4 * c - d) * t**2 + (3 * b - a - 3 * c + d) * t**3) for a, b, c, d in zip(p, p[1:], p[2:], p[3:])]
    return np.vstack((*parts, fit[-1:]))


def _strokes(points: np.ndarray) -> list[dict]:
    return [{"x1": a[0], "y1": a[1], "x2": b[0], "y2": b[1]} for a, b in zip(points.tolist(), points[1:].tolist())]


def _array(points) -> np.ndarray:
    return np.array([] if points is None else [(p["x"], p["y"]) for p in points], float).reshape(-1, 2)


def spline_strokes(degree: Column, knots: Column, control: Column, weights: Column, fit: Column) -> Column:
    """Arrow-batched: de Boor's recurrence needs the knot span of each parameter, which array functions can't index well."""
    return F.pandas_udf(_spline_batch, f"array<{STROKE}>")(degree, knots, control, weights, fit)


def _spline_batch(degree: pd.Series, knots: pd.Series, control: pd.Series, weights: pd.Series, fit: pd.Series) -> pd.Series:
    out = []
    for d, k, c, w, f in zip(degree, knots, control, weights, fit):
        points = _array(c)
        if not len(points):
            out.append(_strokes(fitted_points(_array(f))))
        else:
            out.append(_strokes(spline_points(int(d), np.array([] if k is None else k, float), points, None if w is None else np.array(w, float))))
    return pd.Series(out)


def helix_strokes(cx: Column, cy: Column, radius: Column, end_radius: Column, turns: Column) -> Column:
    """The plan view: 32 steps a turn, the radius changing evenly."""
    n = F.least(F.greatest(F.ceil(F.abs(turns) * STEPS_PER_TURN).cast("int"), F.lit(MIN_STEPS)), F.lit(MAX_STEPS))

    def at(i: Column) -> tuple[Column, Column]:
        angle, r = turns * (2 * math.pi) * i / n, radius + (end_radius - radius) * i / n
        return cx + r * F.cos(angle), cy + r * F.sin(angle)

    return F.when(turns.isNull(), no_strokes()).otherwise(F.transform(F.sequence(F.lit(0), n - 1), lambda i: stroke(*at(i), *at(i + 1))))


def clip_frame(points: Column) -> Column:
    """The closed polygon of an underlay's clip points."""
    return path_strokes(points, F.lit(True))
