"""Colour indexes and effective colours."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BY_BLOCK, BY_LAYER, UNDEFINED = 0, 256, 257
#: Indexes 1 to 9 (7 turns black on white).
STANDARD = ((255, 0, 0), (255, 255, 0), (0, 255, 0), (0, 255, 255), (0, 0, 255), (255, 0, 255), (255, 255, 255), (128, 128, 128), (192, 192, 192))


def _hsv(h: float, s: float, v: float) -> tuple[int, int, int]:
    """Eight-bit RGB, rounded half up."""
    def channel(n: int) -> int:
        k = (n + h * 6) % 6
        return math.floor((v - v * s * max(0.0, min(k, 4 - k, 1.0))) * 255 + 0.5)

    return channel(5), channel(3), channel(1)


def rgb(index: int, white_background: bool = True) -> tuple[int, int, int] | None:
    """10 to 249: 24 hues by 10 bands that darken by 0.08 and from the sixth on lose saturation; 250 to 255: greys."""
    if index == 7:
        return (0, 0, 0) if white_background else (255, 255, 255)
    if 1 <= index <= 9:
        return STANDARD[index - 1]
    if 10 <= index <= 249:
        band, hue = divmod(index - 10, 24)
        return _hsv(hue / 24, 0.7 if band >= 5 else 1.0, max(0.28, 1.0 - band * 0.08))
    if 250 <= index <= 255:
        return (int(255 * (index - 250) / 5),) * 3
    return None


def palette(spark: SparkSession, white_background: bool = True) -> DataFrame:
    """aci, r, g, b of the 255 indexes that carry a colour."""
    return spark.createDataFrame([(i, *rgb(i, white_background)) for i in range(1, 256)], "aci int, r int, g int, b int")


def rgb_of(index: Column, white_background: bool = True) -> Column:
    """0xRRGGBB of an index column, null if it carries no colour."""
    packed = [F.lit(None).cast("int") if (c := rgb(i, white_background)) is None else F.lit(c[0] << 16 | c[1] << 8 | c[2]) for i in range(256)]
    return F.when(index.between(0, 255), F.get(F.array(*packed), index))


def effective(true_color: Column, index: Column, layer_true: Column, layer_index: Column, white_background: bool = True) -> Column:
    """0xRRGGBB: own true colour, own index, the layer's true colour (values up to 0xFF are indexes), its index, else
    black on white or white on black."""
    layer_low = layer_true.bitwiseAND(0xFFFFFF)
    from_layer = F.when(layer_low > 0xFF, layer_low).when(layer_true.isNotNull(), rgb_of(layer_low.cast("int"), white_background).cast("bigint"))
    own = F.when(~index.isin(BY_BLOCK, BY_LAYER, UNDEFINED), rgb_of(index, white_background))
    return F.coalesce(true_color.bitwiseAND(0xFFFFFF), own.cast("bigint"), from_layer, rgb_of(F.abs(layer_index), white_background).cast("bigint"), F.lit(0 if white_background else 0xFFFFFF).cast("bigint"))


def nearest_index(colors: DataFrame) -> DataFrame:
    """colors (r, g, b and others) with the index of the closest palette colour, the smaller on ties.

    The palette has 255 rows whatever the data. A squared distance less that of the colour itself is linear in r, g and
    b, so 256 times that plus the index is one number an index, and the least of these is one compiled expression.
    """
    packed = [f"{(x * x + y * y + z * z) * 256 + i}L - {512 * x}L * r - {512 * y}L * g - {512 * z}L * b" for i in range(1, 256) for x, y, z in [rgb(i)]]
    return colors.withColumn("nearest_aci", F.expr(f"CAST(pmod(least({', '.join(packed)}), 256) AS INT)"))
