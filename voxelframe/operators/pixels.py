"""Statistics of images under receptive-field weights.

Stored images are arrays: a batch of them meets the weights of all fields as
one product of matrices, and statistics of any kind are products of derived
maps (powers, products of two maps) with the same weights; no pixel is joined
or shuffled. Images that come as rows (image_ix, row, col, v) are joined with
weights (prf_ix, row, col, w) instead; partial sums are formed before the
shuffle, so what moves is images x fields.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def pooled(images: DataFrame, weights: DataFrame) -> DataFrame:
    """(image_ix, prf_ix, f): weighted sums of v."""
    return images.join(weights, ["row", "col"]).groupBy("image_ix", "prf_ix").agg(F.sum(F.col("w") * F.col("v")).alias("f"))


#: Values of a grid's weights that may be sent to every task.
MOST_WEIGHTS = 20_000_000


def field_weights(places: list[tuple[float, float, float]], side: int, scaled: bool = False) -> np.ndarray:
    """(side x side, fields): the weights of fields (x, y, sigma), summing to 1; scaled: from 0 to 1 instead, over the number of pixels."""
    line = np.linspace(-0.5, 0.5, side)
    weights = np.empty((side * side, len(places)))
    for k, (x, y, sigma) in enumerate(places):
        g = np.exp(-((line[None, :] - x) ** 2 + (line[:, None] + y) ** 2) / (2 * sigma**2))
        total, spread = g.sum(), g.max() - g.min()
        if scaled:
            weights[:, k] = ((g - g.min()) / spread / g.size if spread else g * np.nan).ravel()
        else:
            weights[:, k] = (g / total if total else g * np.nan).ravel()
    return weights


def under_fields(images: DataFrame, grid: DataFrame, side: int, by: list[str], maps: list[str], names: list[str], work: Callable[..., list[np.ndarray]], scaled: bool = False, batch: int = 256) -> DataFrame:
    """(by, names): for each image an array over the fields of grid, in order of prf_ix.

    work(weights, *maps) gets the weights of all fields and a batch of each map
    (images, pixels), and returns an array (images, fields, ...) for each name.
    A grid is a generated table of checked size; its weights are made once a
    task. Rows with a null map are left out.
    """
    fields = grid.select("prf_ix", "x", "y", "sigma").orderBy("prf_ix").limit(MOST_WEIGHTS // (side * side) + 1).collect()
    if len(fields) * side * side > MOST_WEIGHTS:
        raise ValueError("pool under fewer fields or smaller images at once")
    places = [(r.x, r.y, r.sigma) for r in fields]

    def run(batches):
        weights = field_weights(places, side, scaled)
        for b in batches:
            for k in range(0, b.num_rows, batch):
                part = b.slice(k, batch)
                n = part.num_rows
                out = work(weights, *(part.column(len(by) + j).flatten().to_numpy(zero_copy_only=False).reshape(n, -1) for j in range(len(maps))))
                ends = pa.array(np.arange(n + 1, dtype=np.int32) * (out[0].size // n))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in range(len(by))), *(pa.ListArray.from_arrays(ends, pa.array(o.ravel())) for o in out)], [*by, *names])

    types = dict(images.dtypes)
    rows = images.select(*by, *[F.col(m).cast("array<double>").alias(m) for m in maps]).where(" and ".join(f"{m} is not null" for m in maps))
    return rows.mapInArrow(run, ", ".join([*(f"{b} {types[b]}" for b in by), *(f"{n} array<double>" for n in names)]))


def pooled_images(images: DataFrame, grid: DataFrame, side: int, by: list[str], maps: list[str] | None = None, scaled: bool = False) -> DataFrame:
    """(by, f): weighted sums of images(by, px; side by side pixels by row) under every field of grid, in order of prf_ix.

    With other maps than px, one array of sums for each, under its name. For
    maps of a network, by holds image and channel.
    """
    maps = maps or ["px"]
    return under_fields(images, grid, side, by, maps, ["f"] if maps == ["px"] else maps, lambda w, *x: [v @ w for v in x], scaled)


def image_moments(images: DataFrame, grid: DataFrame, side: int, by: list[str]) -> DataFrame:
    """(by, mean, variance, skew, kurtosis): arrays over the fields, as weighted_moments has them."""

    def work(w, x):
        m, total = x.mean(axis=1, keepdims=True), w.sum(axis=0)
        p = [(x - m) ** k @ w for k in range(1, 5)]
        var = p[1] - p[0] ** 2 * (2 - total) + 1e-6
        c3 = p[2] - 3 * p[0] * p[1] + 3 * p[0] ** 3 - p[0] ** 3 * total
        c4 = p[3] - 4 * p[0] * p[2] + 6 * p[0] ** 2 * p[1] - 4 * p[0] ** 4 + p[0] ** 4 * total
        with np.errstate(all="ignore"):
            return [p[0] + m * total, var, np.nan_to_num(c3 / var**1.5, nan=0.0, posinf=0.0, neginf=0.0), np.nan_to_num(c4 / var**2, nan=0.0, posinf=0.0, neginf=0.0)]

    return under_fields(images, grid, side, by, ["px"], ["mean", "var", "skew", "kurtosis"], work)


def image_cross(images: DataFrame, grid: DataFrame, side: int, by: list[str], a: str = "px", b: str = "other") -> DataFrame:
    """(by, cross): weighted covariance of two maps without a shift, an array over the fields."""
    return under_fields(images, grid, side, by, [a, b], ["cross"], lambda w, v, u: [(v * u) @ w - (v @ w) * (u @ w)])


def cross_correlations(images: DataFrame, grid: DataFrame, side: int, by: list[str], reach: int, a: str = "px", b: str = "other") -> DataFrame:
    """(by, cross): weighted covariance of two maps at every shift of up to reach rows and columns.

    Each map less its weighted mean is multiplied by the root of the weights and
    padded with zeros; one product of transforms gives all shifts. cross has, for
    each field, the shifts by row and column: at (dy, dx) the sum over places
    (r, c) of the first map there and the second at (r + dy, c + dx).
    """
    n = 1 << (side + reach - 1).bit_length()
    shifts = np.arange(-reach, reach + 1)

    def work(w, v, u):
        out = np.empty((len(v), w.shape[1], len(shifts) ** 2))
        roots = np.sqrt(w)
        for k in range(w.shape[1]):
            x, y = (((m - (m @ w[:, k])[:, None]) * roots[:, k]).reshape(-1, side, side) for m in (v, u))
            c = np.fft.irfft2(np.conj(np.fft.rfft2(x, (n, n))) * np.fft.rfft2(y, (n, n)), (n, n))
            out[:, k] = c[:, shifts[:, None] % n, shifts[None, :] % n].reshape(len(v), -1)
        return [out]

    return under_fields(images, grid, side, by, [a, b], ["cross"], work, batch=32)


def by_field(arrays: DataFrame, by: list[str], names: list[str], prf_ix: str = "prf_ix") -> DataFrame:
    """(by, prf_ix, names): a row for each place of arrays of one length."""
    rows = arrays.select(*by, F.posexplode(F.arrays_zip(*names)).alias(prf_ix, "__v"))
    return rows.select(*by, F.col(prf_ix).cast("long").alias(prf_ix), *[F.col(f"__v.{n}").alias(n) for n in names])


def scaled_pool(images: DataFrame, weights: DataFrame) -> DataFrame:
    """As pooled, with weights scaled to 0..1 within each field, and the mean over pixels."""
    w = Window.partitionBy("prf_ix")
    scaled = weights.withColumn("w", F.try_divide(F.col("w") - F.min("w").over(w), F.nullif(F.max("w").over(w) - F.min("w").over(w), F.lit(0.0))))
    return images.join(scaled, ["row", "col"]).groupBy("image_ix", "prf_ix").agg(F.avg(F.col("w") * F.col("v")).alias("f"))


def weighted_moments(images: DataFrame, weights: DataFrame) -> DataFrame:
    """Mean, variance (+1e-6), skewness and (not excess) kurtosis; 0 where undefined.

    Powers are summed about the image's own mean, which keeps precision.
    """
    centre = Window.partitionBy("image_ix")
    rows = images.withColumn("m", F.avg("v").over(centre)).withColumn("d", F.col("v") - F.col("m"))
    s = rows.join(weights, ["row", "col"]).groupBy("image_ix", "prf_ix").agg(F.first("m").alias("m"), *[F.sum(F.col("w") * F.pow("d", F.lit(k))).alias(f"p{k}") for k in range(5)])
    mu, total = F.col("p1"), F.col("p0")
    var = F.col("p2") - mu * mu * (2 - total)
    c3 = F.col("p3") - 3 * mu * F.col("p2") + 3 * mu * mu * mu - mu * mu * mu * total
    c4 = F.col("p4") - 4 * mu * F.col("p3") + 6 * mu * mu * F.col("p2") - 4 * F.pow(mu, F.lit(4)) + F.pow(mu, F.lit(4)) * total
    s = s.withColumn("mean", mu + F.col("m") * total).withColumn("var", var + 1e-6).withColumn("c3", c3).withColumn("c4", c4)
    ratio = lambda a, b: F.coalesce(F.nanvl(F.try_divide(a, b), F.lit(0.0)), F.lit(0.0))
    return s.select("image_ix", "prf_ix", "mean", "var", ratio(F.col("c3"), F.pow("var", F.lit(1.5))).alias("skew"), ratio(F.col("c4"), F.col("var") * F.col("var")).alias("kurtosis"))


def weighted_cross(images: DataFrame, weights: DataFrame) -> DataFrame:
    """Weighted covariance of two maps v and u at zero shift."""
    wv, wu, wvu = F.col("w") * F.col("v"), F.col("w") * F.col("u"), F.col("w") * F.col("v") * F.col("u")
    return images.join(weights, ["row", "col"]).groupBy("image_ix", "prf_ix").agg((F.sum(wvu) - F.sum(wv) * F.sum(wu)).alias("cross"))


def coverage(members: DataFrame, by: list[str], weights: DataFrame) -> DataFrame:
    """Mean and largest peak-scaled weight of each pixel over the members' fields.

    Members are counted by field first, so the join has one row a field.
    """
    top = F.max("w").over(Window.partitionBy("prf_ix"))
    scaled = weights.withColumn("h", F.col("w") / top).select("prf_ix", "row", "col", "h")
    counts = members.groupBy(*by, "prf_ix").agg(F.count("*").alias("n"))
    return counts.join(scaled, "prf_ix").groupBy(*by, "row", "col").agg((F.sum(F.col("h") * F.col("n")) / F.sum("n")).alias("mean"), F.max("h").alias("max"))
