"""PNG of sheets: strokes drawn by numpy in the workers, encoded with zlib. Labels are drawn as their baseline's bar, as
no font is at hand."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_PIXELS = 4e8


def encode(image: np.ndarray) -> bytes:
    """An 8-bit RGB image (height, width, 3)."""
    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    h, w = image.shape[:2]
    rows = np.concatenate((np.zeros((h, 1), np.uint8), image.reshape(h, 3 * w)), 1)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def draw(strokes: np.ndarray, colors: np.ndarray, box: tuple[float, float, float, float], width: int) -> np.ndarray:
    """White ground; strokes (n, 4) in world units, colours 0xRRGGBB."""
    x0, y0, x1, y1 = box
    k = width / max(x1 - x0, 1e-9)
    height = max(1, round((y1 - y0) * k))
    if width * height > MAX_PIXELS:
        raise ValueError(f"{width} x {height} pixels")
    image = np.full((height, width, 3), 255, np.uint8)
    p = (strokes.reshape(-1, 2, 2) - (x0, y0)) * k
    # Cut to the image: the stretch of each stroke between where it enters and leaves.
    d = p[:, 1] - p[:, 0]
    with np.errstate(divide="ignore", invalid="ignore"):
        t = np.stack(((-1 - p[:, 0]) / d, ((width + 1, height + 1) - p[:, 0]) / d))
    enter, leave = np.fmax(np.fmin(t[0], t[1]).max(1), 0), np.fmin(np.fmax(t[0], t[1]).min(1), 1)
    ok = (enter <= leave) & np.isfinite(strokes).all(1)
    p, d, colors, enter, leave = p[ok], d[ok], colors[ok], enter[ok], leave[ok]
    p = np.stack((p[:, 0] + d * enter[:, None], p[:, 0] + d * leave[:, None]), 1)
    steps = np.abs(p[:, 1] - p[:, 0]).max(1).astype(int) + 1
    for (a, b), n, c in zip(p, steps, colors):
        q = np.rint(a + (b - a) * np.linspace(0, 1, n + 1)[:, None]).astype(int)
        q = q[(q[:, 0] >= 0) & (q[:, 0] < width) & (q[:, 1] >= 0) & (q[:, 1] < height)]
        image[height - 1 - q[:, 1], q[:, 0]] = (c >> 16 & 255, c >> 8 & 255, c & 255)
    return image


def render(prims: DataFrame, boxes: DataFrame, width: int = 2048) -> DataFrame:
    """(doc_id, sheet_index, png) of primitives (doc_id, rgb, strokes, text, at, height, rotation) in each box."""
    w = F.char_length("text") * F.col("height") * 0.8
    bar = F.array(F.struct(F.col("at.x").alias("x1"), F.col("at.y").alias("y1"), (F.col("at.x") + w * F.cos("rotation")).alias("x2"), (F.col("at.y") + w * F.sin("rotation")).alias("y2")))
    lines = F.when(F.col("text").isNotNull() & F.col("at").isNotNull(), bar).otherwise(F.col("strokes"))
    s = prims.select("doc_id", F.coalesce("rgb", F.lit(0)).cast("long").alias("rgb"), F.explode(lines).alias("s")).select("doc_id", "rgb", "s.*")
    meets = (F.least("x1", "x2") <= F.col("max_x")) & (F.greatest("x1", "x2") >= F.col("min_x")) & (F.least("y1", "y2") <= F.col("max_y")) & (F.greatest("y1", "y2") >= F.col("min_y"))
    j = s.join(boxes.select("doc_id", "sheet_index", "min_x", "min_y", "max_x", "max_y"), "doc_id").where(meets)

    def run(d: pd.DataFrame) -> pd.DataFrame:
        r = d.iloc[0]
        image = draw(d[["x1", "y1", "x2", "y2"]].to_numpy(float), d.rgb.to_numpy(), (r.min_x, r.min_y, r.max_x, r.max_y), width)
        return pd.DataFrame({"doc_id": [r.doc_id], "sheet_index": [r.sheet_index], "png": [encode(image)]})

    return j.groupBy("doc_id", "sheet_index").applyInPandas(run, "doc_id string, sheet_index int, png binary")
