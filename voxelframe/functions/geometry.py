"""Coordinates, masks, boxes and polygons as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def pol_to_cart(angle_deg: Column, eccentricity: Column) -> tuple[Column, Column]:
    return eccentricity * F.cos(F.radians(angle_deg)), eccentricity * F.sin(F.radians(angle_deg))


def cart_to_pol(x: Column, y: Column) -> tuple[Column, Column]:
    """(angle in [0, 360), eccentricity)."""
    angle = F.degrees(F.atan2(y, x))
    return F.when(angle < 0, angle + 360).otherwise(angle), F.sqrt(x * x + y * y)


def pdf_height(z: float, points: int = 1000) -> float:
    """Height of the unit-peak normal curve at the point of an even grid over [-5, 5] nearest to z.

    The peak is that of the grid, which has no point at zero.
    """
    grid = [-5 + 10 * k / (points - 1) for k in range(points)]
    top = max(math.exp(-g * g / 2) for g in grid)
    near = min(grid, key=lambda g: (abs(g - z), g))
    return math.exp(-near * near / 2) / top


def mask_cutoff(z: float = 2) -> float:
    return round(pdf_height(z), 2)


def gaussian(x: Column, y: Column, cx: Column, cy: Column, sd: Column, sd2: Column | None = None, orient_deg: float = 0.0) -> Column:
    """Unnormalised oriented Gaussian on image coordinates; rows count downwards, so the centre's y is negated."""
    ratio = F.lit(1.0) if sd2 is None else sd / sd2
    c, s = math.cos(math.radians(orient_deg)), math.sin(math.radians(orient_deg))
    dx, dy = x - cx, y + cy
    a, b = dx * c + dy * s, dy * c - dx * s
    return F.exp(-(a * a + ratio * ratio * b * b) / (2 * sd * sd))


def von_mises(x_deg: Column, mu_deg: float, k: float, axis_deg: float = 360.0) -> Column:
    """Von Mises curve with peak 1 at mu; normalise and scale it with scaled_curve."""
    turn = 2 * math.pi / axis_deg
    return F.exp(F.lit(k) * (F.cos((x_deg - mu_deg) * turn) - 1))


def scaled_curve(curve: Column, low: Column, high: Column, a: float, b: float, normalise: bool = True) -> Column:
    return a * (F.try_divide(curve - low, high - low) if normalise else curve) + b


def crop_box_pixels(box: list[Column], height: Column, width: Column) -> list[Column]:
    """Fractions cut from top, bottom, left and right to pixel bounds."""
    t, b, l, r = box  # noqa: E741
    return [F.floor(t * height), F.floor(height - b * height), F.floor(l * width), F.floor(width - r * width)]


def square_crop(height: Column, width: Column) -> list[Column]:
    """Fractions that cut the longer side evenly to a square."""
    tall = F.abs((width / height - 1) / 2)
    wide = F.abs((height / width - 1) / 2)
    zero = F.lit(0.0)
    return [*[F.when(height > width, tall).otherwise(zero)] * 2, *[F.when(height > width, zero).otherwise(wide)] * 2]


def polygon_of_box(x: Column, y: Column, w: Column, h: Column) -> Column:
    """Corners of a box as x, y, x, y, ..., clockwise from the top left."""
    return F.array(x, y, x + w, y, x + w, y + h, x, y + h)


def polygon_cropped(polygon: Column, crop: Column, size: Column) -> Column:
    """Shift by crop(hmin, hmax, wmin, wmax) and rescale to size(height, width)."""
    high = F.get(crop, F.lit(1)) - F.get(crop, F.lit(0))
    wide = F.get(crop, F.lit(3)) - F.get(crop, F.lit(2))
    return F.transform(
        polygon,
        lambda v, i: F.when(i % 2 == 0, (v - F.get(crop, F.lit(2))) / wide * F.get(size, F.lit(1))).otherwise((v - F.get(crop, F.lit(0))) / high * F.get(size, F.lit(0))),
    )


def polygon_scaled(polygon: Column, old: tuple[float, float], new: tuple[float, float]) -> Column:
    """Rescale from (height, width) old to new."""
    return F.transform(polygon, lambda v, i: F.when(i % 2 == 0, v * F.lit(new[1] / old[1])).otherwise(v * F.lit(new[0] / old[0])))


def polygon_outward(polygon: Column) -> Column:
    """Round a box polygon outwards: values up to the middle of their axis down, others up."""
    xs = F.filter(polygon, lambda v, i: i % 2 == 0)
    ys = F.filter(polygon, lambda v, i: i % 2 == 1)
    middle = lambda a: (F.array_min(a) + F.array_max(a)) / 2
    out = lambda v, m: F.when(v <= m, F.floor(v)).otherwise(F.ceil(v)).cast("double")
    return F.transform(polygon, lambda v, i: F.when(i % 2 == 0, out(v, middle(xs))).otherwise(out(v, middle(ys))))


def inside_polygon(x: Column, y: Column, polygon: Column) -> Column:
    """Even-odd rule; polygon as x, y, x, y, ..."""
    n = F.floor(F.size(polygon) / 2).cast("int")

    def crossing(k):
        at = lambda m: F.get(polygon, F.pmod(m, F.size(polygon)).cast("int"))
        x1, y1, x2, y2 = at(2 * k), at(2 * k + 1), at(2 * k + 2), at(2 * k + 3)
        return F.when(((y1 > y) != (y2 > y)) & (x < F.try_divide((x2 - x1) * (y - y1), y2 - y1) + x1), 1).otherwise(0)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda acc, k: acc + crossing(k)) % 2 == 1


def prf_box(x: Column, y: Column, sigma: Column, n_pix: int, n_sd: float = 2, min_pix: int | None = None, square: bool = False) -> Column:
    """struct(xmin, xmax, ymin, ymax): the pixel box of a receptive field, clipped to the image.

    x runs along rows here, y along columns. With square, a box that is long
    enough is trimmed on its longer side, one that is not is moved outwards.
    """
    small = min_pix or 1
    reach = F.greatest(F.ceil(sigma * n_sd * n_pix), F.lit(small // 2).cast("long"))
    nudged = lambda c: F.when(F.ceil(c) == F.floor(c), c + 0.0001).otherwise(c)
    rows, cols = nudged(F.lit(n_pix / 2) - y * n_pix), nudged(x * n_pix + n_pix / 2)
    clip = lambda c: F.greatest(F.least(c, F.lit(n_pix).cast("long")), F.lit(0).cast("long"))
    lows, highs = [], []
    for centre in (rows, cols):
        low, high = clip(F.floor(centre - reach)), clip(F.ceil(centre + reach))
        short = high - low < small
        lows.append(F.when(short & (low != 0), n_pix - small).otherwise(low))
        highs.append(F.when(short & (low == 0), small).otherwise(high))
    if square:
        a, b = highs[0] - lows[0], highs[1] - lows[1]
        gap, shorter = F.abs(a - b), F.least(a, b)
        trim = shorter >= small
        half_down, half_up = F.floor(gap / 2), F.ceil(gap / 2)
        out = []
        for k, mine, other in ((0, a, b), (1, b, a)):
            long_side, short_side = mine > other, mine < other
            low = F.when(trim & long_side, lows[k] + half_down).when(~trim & short_side & (lows[k] != 0), lows[k] - gap).otherwise(lows[k])
            high = F.when(trim & long_side, highs[k] - half_up).when(~trim & short_side & (lows[k] == 0), highs[k] + gap).otherwise(highs[k])
            out.append((low, high))
        (lows[0], highs[0]), (lows[1], highs[1]) = out
    return F.struct(lows[0].cast("int").alias("xmin"), highs[0].cast("int").alias("xmax"), lows[1].cast("int").alias("ymin"), highs[1].cast("int").alias("ymax"))


def double_phase(re: Column, im: Column) -> Column:
    """struct(re, im) of the value with its phase doubled and its modulus kept."""
    theta, radius = F.atan2(im, re), F.sqrt(re * re + im * im)
    return F.struct((radius * F.cos(2 * theta)).alias("re"), (radius * F.sin(2 * theta)).alias("im"))
