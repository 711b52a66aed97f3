"""Receptive-field grids as table-valued functions: (prf_ix, x, y, sigma).

A grid has at most a few thousand rows whatever the data's size, so it may be
broadcast. Positions are float32 values, as grid rows are compared by value.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def even(spark: SparkSession, n: int, low: float, high: float, name: str) -> DataFrame:
    """n even steps from low to high: (name_pos, name)."""
    step = (high - low) / (n - 1) if n > 1 else 0.0
    return spark.range(n).select(F.col("id").alias(f"{name}_pos"), (F.lit(low) + F.col("id") * step).alias(name))


def log_spaced(spark: SparkSession, n: int, low: float, high: float, name: str, less: float = 0.0) -> DataFrame:
    """n steps from low to high, even in the logarithm, and then less: (name_pos, name)."""
    grid = even(spark, n, math.log(low), math.log(high), "v")
    return grid.select(F.col("v_pos").alias(f"{name}_pos"), (F.exp("v") - less).alias(name))


def _single(c: Column) -> Column:
    return c.cast("float")


def _in_view(df: DataFrame) -> DataFrame:
    """Rows of which one standard deviation reaches the image [-0.5, 0.5]."""
    return df.where("x - sigma <= 0.5 and x + sigma >= -0.5 and y + sigma >= -0.5 and y - sigma <= 0.5")


def _numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """prf_ix by order; one window over a grid of bounded size."""
    return df.select((F.row_number().over(Window.orderBy(*order)) - 1).cast("int").alias("prf_ix"), *(F.col(c).cast("double").alias(c) for c in ("x", "y", "sigma")))


def _polar(eccentricities: DataFrame, angles: int) -> DataFrame:
    turn = 2 * math.pi / angles
    spun = eccentricities.crossJoin(eccentricities.sparkSession.range(angles).withColumnRenamed("id", "angle_pos"))
    angle = _single(F.col("angle_pos") * turn)
    ecc = _single(F.col("ecc"))
    return spun.withColumn("x", _single(ecc * _single(F.cos(angle)))).withColumn("y", _single(ecc * _single(F.sin(angle))))


def log_polar_grid(spark: SparkSession, sigmas=(0.02, 1.0, 10), eccentricities=(0.0, 7 / 8.4, 10), angles: int = 16, centre: float = 0.0) -> DataFrame:
    """Sizes and eccentricities even in the logarithm, every angle; repeats keep their first place, fields out of view go.

    centre: the innermost eccentricity. At 0 its angles are one field; at a
    tiny value they stay apart.
    """
    ecc = log_spaced(spark, eccentricities[2], eccentricities[0] + 0.1, eccentricities[1] + 0.1, "ecc", 0.1)
    ecc = ecc.withColumn("ecc", F.when(F.abs("ecc") < 1e-9, centre).otherwise(F.col("ecc")))
    sized = _polar(ecc, angles).crossJoin(log_spaced(spark, sigmas[2], sigmas[0], sigmas[1], "sigma"))
    place = (F.col("sigma_pos") * eccentricities[2] + F.col("ecc_pos")) * angles + F.col("angle_pos")
    flat = sized.select((F.col("x") + F.lit(0.0)).alias("x"), (F.col("y") + F.lit(0.0)).alias("y"), _single(F.col("sigma")).alias("sigma"), place.alias("pos"))
    return _numbered(_in_view(flat.groupBy("x", "y", "sigma").agg(F.min("pos").alias("pos"))), ["pos"])


def scaled_log_polar_grid(spark: SparkSession, eccentricities=(0.0, 7 / 8.4, 10), angles: int = 16) -> DataFrame:
    """Three sizes for each eccentricity: half, once and one and a half times 0.7 e + 0.05; repeats stay."""
    ecc = log_spaced(spark, eccentricities[2], eccentricities[0] + 0.1, eccentricities[1] + 0.1, "ecc", 0.1)
    size = F.col("ecc") * 0.7 + 0.05
    sized = _polar(ecc, angles).select("*", F.posexplode(F.array(size * 0.5, size, size * 1.5)).alias("sigma_pos", "sigma"))
    place = (F.col("ecc_pos") * 3 + F.col("sigma_pos")) * angles + F.col("angle_pos")
    return _numbered(_in_view(sized.select("x", "y", _single(F.col("sigma")).alias("sigma"), place.alias("pos"))), ["pos"])


def rect_grid(spark: SparkSession, sigmas=(0.02, 0.10, 10), spacing: float = 0.04) -> DataFrame:
    """A square lattice past the image's edge by half the largest size, for each size."""
    n, reach = math.ceil(1 / spacing), max(sigmas[:2]) / 2
    xs, ys = even(spark, n, -0.5 - reach, 0.5 + reach, "x"), even(spark, n, -0.5 - reach, 0.5 + reach, "y")
    sized = xs.crossJoin(ys).crossJoin(log_spaced(spark, sigmas[2], sigmas[0], sigmas[1], "sigma"))
    place = (F.col("sigma_pos") * n + F.col("y_pos")) * n + F.col("x_pos")
    return _numbered(_in_view(sized.select("x", "y", "sigma", place.alias("pos"))), ["pos"])


def _lattices(spark: SparkSession, sizes: list[tuple[float, int]], aperture: float) -> DataFrame:
    """For each (sigma, n): an n by n lattice over the aperture."""
    rows = spark.createDataFrame([(k, float(s), n) for k, (s, n) in enumerate(sizes)], "k int, sigma double, n int")
    line = lambda c: F.when(F.col("n") > 1, F.lit(-aperture / 2) + F.col(c) * aperture / (F.col("n") - 1)).otherwise(F.lit(-aperture / 2))
    flat = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return flat.select("k", "j", "i", line("i").alias("x"), line("j").alias("y"), "sigma")


def pyramid_grid(spark: SparkSession, sigmas: list[float], spacing: float = 1.4, aperture: float = 1.1) -> DataFrame:
    """Lattices whose spacing grows with the size."""
    return _numbered(_lattices(spark, [(s, math.ceil(aperture / (s * spacing))) for s in sigmas], aperture), ["k", "j", "i"])


#: Lattice sides of the second pyramid.
PYRAMID_SIDES = (21, 15, 11, 9, 7, 7, 7, 7, 7)


def fixed_pyramid_grid(spark: SparkSession, sigmas: list[float], aperture: float = 1.1) -> DataFrame:
    """Lattices of fixed sides, then one field of size 10 that covers everything."""
    flat = _lattices(spark, list(zip(sigmas, PYRAMID_SIDES, strict=False)), aperture)
    wide = spark.sql(f"SELECT {len(sigmas)} AS k, 0 AS j, 0 AS i, 0.0D AS x, 0.0D AS y, 10.0D AS sigma")
    return _numbered(flat.union(wide), ["k", "j", "i"])


def log_points(n: int, start: float, stop: float) -> list[float]:
    """n points even in the logarithm."""
    if n <= 1:
        return [start]
    a, b = math.log(start + 1e-12), math.log(stop + 1e-12)
    return [math.exp(a + (b - a) * k / (n - 1)) for k in range(n)]


def even_points(n: int, centre: float, width: float, right_bound: bool = False) -> list[float]:
    """n points over width: from centre on with right_bound, else the middles of n parts about it."""
    if n <= 1:
        return [centre]
    if right_bound:
        return [centre + width * k / (n - 1) for k in range(n)]
    d = width / n
    return [centre + (d - width) / 2 + d * k for k in range(n)]


def prf_grid(spark: SparkSession, which: int = 5) -> DataFrame:
    """The grid of a number from 0 to 7; grid 0 is one row of nulls (no spatial selectivity)."""
    if which == 0:
        return spark.sql("SELECT 0 AS prf_ix, CAST(NULL AS DOUBLE) AS x, CAST(NULL AS DOUBLE) AS y, CAST(NULL AS DOUBLE) AS sigma")
    makers = {
        1: lambda: pyramid_grid(spark, log_points(8, 0.04, 0.4)),
        2: lambda: fixed_pyramid_grid(spark, log_points(9, 0.04, 0.8)),
        3: lambda: fixed_pyramid_grid(spark, log_points(9, 0.04, 0.8)),
        4: lambda: log_polar_grid(spark, (0.04, 1.0, 12), (0.0, 1.4, 12)),
        5: lambda: log_polar_grid(spark, centre=2.0**-56),
        6: lambda: scaled_log_polar_grid(spark),
        7: lambda: rect_grid(spark, (0.04, 0.04, 1)),
    }
    if which not in makers:
        raise ValueError(f"no grid {which}")
    return makers[which]()


def decoding_fields(grid: DataFrame, screen_deg: float = 8.4, rings: int = 8, skip_sizes: int = 5) -> DataFrame:
    """Rows of the lowest eccentricities and without the smallest sizes, by rank of the rounded values."""
    ecc = F.round(F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")) * screen_deg, 4)
    size = F.round(F.col("sigma") * screen_deg, 4)
    ranked = grid.withColumn("__e", F.dense_rank().over(Window.orderBy(ecc))).withColumn("__s", F.dense_rank().over(Window.orderBy(size)))
    return ranked.where((F.col("__e") <= rings) & (F.col("__s") > skip_sizes)).drop("__e", "__s")


def combinations(spark: SparkSession, values: list[float], levels: int) -> DataFrame:
    """All choices of a value for each of levels columns, in order: (pos, v0, v1, ...)."""
    n = len(values)
    v = F.array(*[F.lit(float(x)) for x in values])
    return spark.range(n**levels).select(F.col("id").alias("pos"), *(F.get(v, F.pmod(F.floor(F.col("id") / n ** (levels - 1 - k)), F.lit(n)).cast("int")).alias(f"v{k}") for k in range(levels)))


#: Number of penalties and the largest, by kind of features.
PENALTY_GRIDS = {"zscored": (9, 1e5), "raw": (10, 1e1), "deep": (20, 1e10)}


def ridge_penalties(kind: str = "zscored", ridge: bool = True, semantic: bool = False) -> list[float]:
    """Penalties to search, even in log(v + 0.01) from 0; two zeros without ridge; semantic has 1e-8 for 0."""
    if not ridge:
        return [0.0, 0.0]
    n, top = PENALTY_GRIDS[kind]
    a, b = math.log(0.01), math.log(top + 0.01)
    out = [0.0, *(math.exp(a + (b - a) * k / (n - 1)) - 0.01 for k in range(1, n))]
    return [1e-8 if semantic and v == 0 else v for v in out]


def gaussian_weights(grid: DataFrame, n_pix: int, aperture: float = 1.0) -> DataFrame:
    """(prf_ix, row, col, w): each field's weights over an n_pix by n_pix image, summing to 1.

    The pixels are generated beside each field, so the work is spread by field.
    """
    from ..functions.geometry import gaussian

    step = aperture / (n_pix - 1)
    line = lambda c: F.lit(-aperture / 2) + F.col(c) * step
    px = grid.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(n_pix - 1)))).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(n_pix - 1))))
    px = px.withColumn("g", gaussian(line("col"), line("row"), F.col("x"), F.col("y"), F.col("sigma")))
    total = F.sum("g").over(Window.partitionBy("prf_ix"))
    return px.select("prf_ix", "row", "col", F.try_divide(F.col("g"), F.nullif(total, F.lit(0.0))).alias("w"))


def field_masks(grid: DataFrame, n_pix: int, z: float = 2) -> DataFrame:
    """(prf_ix, row, col) of the pixels within about z standard deviations.

    The height is relative to the curve's largest value on the pixel lattice,
    which is continued past the image for a centre outside it.
    """
    from ..functions.geometry import gaussian, mask_cutoff

    step, cut = 1.0 / (n_pix - 1), mask_cutoff(z)
    line = lambda c: F.lit(-0.5) + c * step
    pad = math.ceil(0.5 / step)
    inside = (F.abs("x") < 0.5) & (F.abs("y") < 0.5)
    bound = lambda c: F.greatest(F.least(F.round((c + 0.5) / step), F.when(inside, n_pix - 1).otherwise(n_pix - 1 + pad)), F.when(inside, 0).otherwise(-pad))
    peak = gaussian(line(bound(F.col("x"))), line(bound(-F.col("y"))), F.col("x"), F.col("y"), F.col("sigma"))
    px = grid.withColumn("peak", peak).withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(n_pix - 1)))).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(n_pix - 1))))
    height = gaussian(line(F.col("col")), line(F.col("row")), F.col("x"), F.col("y"), F.col("sigma"))
    return px.where(F.try_divide(height, F.col("peak")) > cut).select("prf_ix", "row", "col")
