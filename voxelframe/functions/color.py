"""Colour conversions as column expressions; channels are 0 to 255."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# sRGB primaries to XYZ, the D65 white, the L*a*b* knee, luma weights.
RGB_TO_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
WHITE = (0.95047, 1.0, 1.08883)
KNEE = 216 / 24389
LUMA = (0.2126, 0.7152, 0.0722)


def linear(channel: Column) -> Column:
    """Linear light of an sRGB channel."""
    v = channel / F.lit(255.0)
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


def xyz(r: Column, g: Column, b: Column) -> list[Column]:
    light = [linear(c) for c in (r, g, b)]
    return [sum((F.lit(w) * c for w, c in zip(row[1:], light[1:], strict=True)), F.lit(row[0]) * light[0]) for row in RGB_TO_XYZ]


def lab_curve(t: Column) -> Column:
    """Cube root with a linear toe below the knee."""
    return F.when(t < KNEE, t / (3 * (6 / 29) ** 2) + 4 / 29).otherwise(F.pow(t, F.lit(1 / 3)))


def lab(r: Column, g: Column, b: Column) -> list[Column]:
    x, y, z = (lab_curve(c / w) for c, w in zip(xyz(r, g, b), WHITE, strict=True))
    return [116 * y - 16, 500 * (x - y), 200 * (y - z)]


def saturation(r: Column, g: Column, b: Column) -> Column:
    """HSV saturation; 0 for black."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    return F.when(top == 0, 0.0).otherwise(F.try_divide((top - low).cast("double"), top.cast("double")))


def luma(r: Column, g: Column, b: Column) -> Column:
    return sum((F.lit(w) * c for w, c in zip(LUMA[1:], (g, b), strict=True)), F.lit(LUMA[0]) * r) / 255


def scaled(pixels: Column, most: float = 255.0) -> Column:
    """An array of 0..most as 0..1."""
    return F.transform(pixels, lambda x: x / F.lit(most))
