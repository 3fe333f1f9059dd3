"""Residual sheets against a plain version of the same rules, and single rules on small fixtures."""

import math
import random

import pytest

from draftlake.operators import sheets

SCHEMA = "doc_id string, handle long, x double, y double, is_text boolean"
BOXES = "doc_id string, sheet_index int, name string, min_x double, min_y double, max_x double, max_y double"


def area_of(x0, y0, w, h, nx, ny, text):
    return [(x0 + w * i / (nx - 1), y0 + h * j / (ny - 1), text((i, j))) for i in range(nx) for j in range(ny)]


def found(spark, points, frames=(), texts=None):
    df = spark.createDataFrame([("d", k, float(x), float(y), bool(t)) for k, (x, y, t) in enumerate(points)], SCHEMA)
    named = spark.createDataFrame([("d", k, *t) for k, t in enumerate(texts)], "doc_id string, handle long, x double, y double, text string, height double") if texts else None
    boxes = spark.createDataFrame([("d", k + 1, "", *map(float, f)) for k, f in enumerate(frames)], BOXES)
    return sorted((r["sheet_index"], r["name"], *(round(r[c], 6) for c in ("min_x", "min_y", "max_x", "max_y"))) for r in sheets.residual_sheets(df, boxes, named).collect())


def box_of(points):
    return min(p[0] for p in points), min(p[1] for p in points), max(p[0] for p in points), max(p[1] for p in points)


def clusters(points, most, cell):
    x0, y0, x1, y1 = box_of(points)
    count = [most if not cell else min(int(s / cell) + 1, most) for s in (x1 - x0, y1 - y0)]
    size = [cell or (s / most if s > 0 else 1.0) for s in (x1 - x0, y1 - y0)]
    at = lambda p: (min(int((p[0] - x0) / size[0]), count[0] - 1), min(int((p[1] - y0) / size[1]), count[1] - 1))
    cells = {}
    for p in points:
        cells.setdefault(at(p), []).append(p)
    ok = {c for c, ps in cells.items() if len(ps) >= 5}
    out, seen = [], set()
    for start in sorted(ok, key=lambda c: (c[1], c[0])):
        if start not in seen:
            seen.add(start)
            group = [start]
            for x, y in group:
                for a in range(-2, 3):
                    for b in range(-2, 3):
                        c, middle = (x + a, y + b), (x + int(a / 2), y + int(b / 2))
                        far = max(abs(a), abs(b)) > 1
                        if c in ok and c not in seen and not (far and (min(abs(a), abs(b)) > 1 or middle in ok)):
                            seen.add(c)
                            group.append(c)
            pts = [p for c in group for p in cells[c]]
            if len(pts) >= 50:
                out.append(pts)
    return sorted(out, key=len, reverse=True)


def plain(points, frames):
    left = [p for p in points if not any(f[0] <= p[0] <= f[2] and f[1] <= p[1] <= f[3] for f in frames)]
    n = len(left)
    if n >= 4:
        edge = [(sorted(p[k] for p in left)[int((n - 1) * 0.005)], sorted(p[k] for p in left)[int((n - 1) * 0.995)]) for k in (0, 1)]
        left = [p for p in left if all(edge[k][0] <= p[k] <= edge[k][1] for k in (0, 1))]
    finals = []
    for part in clusters(left, 64, None):
        subs = clusters(part, 512, 10_000.0)
        if len(subs) < 2:
            finals.append(part)
            continue
        root = list(range(len(subs)))
        for i, p in enumerate(subs):
            for j in range(i):
                a, b = box_of(p), box_of(subs[j])
                gap = math.hypot(max(a[0] - b[2], b[0] - a[2], 0), max(a[1] - b[3], b[1] - a[3], 0))
                if gap < 0.3 * min(min(q[2] - q[0], q[3] - q[1]) for q in (a, b)):
                    low, high = sorted((root[i], root[j]))
                    root = [low if r == high else r for r in root]
        symbol = []
        for k in sorted(set(root)):
            unit = [p for s, r in zip(subs, root) if r == k for p in s]
            if sum(p[2] for p in unit) >= 0.3 * len(unit):
                finals.append(unit)
            else:
                symbol += unit
        if len(symbol) >= 50:
            finals.append(symbol)
    finals = [(len(p), box_of(p)) for p in finals]
    finals = [(k, b) for k, b in finals if (b[2] - b[0]) * (b[3] - b[1]) > 0 and k / ((b[2] - b[0]) * (b[3] - b[1])) * 1e10 >= 100]
    finals = sorted(finals, key=lambda f: -f[0])[:16]
    over = lambda a, b: max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
    kept = [b for _, b in finals if not any(over(b, f) > 0.3 * (b[2] - b[0]) * (b[3] - b[1]) for f in frames)]
    grown = [(b[0] - (b[2] - b[0]) * 0.05, b[1] - (b[3] - b[1]) * 0.05, b[2] + (b[2] - b[0]) * 0.05, b[3] + (b[3] - b[1]) * 0.05) for b in kept]
    return sorted((k, f"补充区域 {k}", *(round(v, 6) for v in b)) for k, b in enumerate(grown, 1))


@pytest.mark.parametrize("seed", range(4))
def test_equals_plain_version(spark, seed):
    r = random.Random(seed)
    points = []
    for _ in range(7):
        x, y, w, h = r.uniform(0, 500_000), r.uniform(0, 400_000), r.uniform(15_000, 90_000), r.uniform(15_000, 90_000)
        share = r.choice([0.1, 0.6])
        points += [(x + r.random() * w, y + r.random() * h, r.random() < share) for _ in range(r.randint(60, 900))]
    points += [(r.uniform(-1e6, 1e6), r.uniform(-1e6, 1e6), False) for _ in range(12)]
    frames = [(0, 0, 120_000, 90_000)]
    want = plain(points, frames)
    assert found(spark, points, frames) == want and want


def test_few_texts_and_gaps(spark):
    """An area with few texts is a sheet; a page with an empty row of cells stays one."""
    legend = area_of(0, 0, 60_000, 40_000, 110, 110, lambda c: c[0] == 0)
    page = [p for p in area_of(300_000, 0, 60_000, 80_000, 110, 110, lambda c: True) if not 35_000 < p[1] < 36_400]
    got = found(spark, legend + page)
    assert len(got) == 2 and got == plain(legend + page, [])


def test_title(spark):
    pages = area_of(0, 0, 60_000, 40_000, 110, 110, lambda c: True) + area_of(300_000, 0, 60_000, 40_000, 100, 100, lambda c: True)
    texts = [(30_000.0, 39_000.0, "设计说明", 800.0), (1_000.0, 100.0, "1", 810.0), (30_000.0, 20_000.0, "small", 200.0), (30_000.0, 1.0, "--", 900.0)]
    assert [r[1] for r in found(spark, pages, texts=texts)] == ["设计说明", "补充区域 2"]
