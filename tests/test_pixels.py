"""Statistics under fields by products of matrices, against sums pixel by pixel and the joins of pixel rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelframe.operators import aggregates as A
from voxelframe.operators import grids as GR
from voxelframe.operators import pixels as PX

SIDE = 9


def data(spark, n=7, seed=1):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, 256, (n, SIDE, SIDE)).astype(float), rng.normal(size=(n, SIDE, SIDE))
    b[0] = 3.0  # a map without variance
    images = spark.createDataFrame([(k, "x", a[k].ravel().tolist(), b[k].ravel().tolist()) for k in range(n)] + [(n, "x", None, [0.0] * SIDE**2)], "image_ix long, f string, px array<double>, other array<double>")
    grid = spark.createDataFrame([(k, float(x), float(y), 0.05 + 0.1 * k) for k, (x, y) in enumerate(rng.uniform(-0.5, 0.5, (4, 2)))], "prf_ix int, x double, y double, sigma double")
    return a, b, images, grid


def rows_of(images):
    long = images.where("px is not null").select("image_ix", F.posexplode(F.arrays_zip("px", "other")).alias("p", "v"))
    return long.select("image_ix", F.floor(F.col("p") / SIDE).cast("int").alias("row"), (F.col("p") % SIDE).cast("int").alias("col"), F.col("v.px").alias("v"), F.col("v.other").alias("u"))


def table(df, names):
    return {(r.image_ix, r.prf_ix): [r[n] for n in names] for r in df.collect()}


def test_arrays_and_rows_agree(spark):
    _, _, images, grid = data(spark)
    weights, rows = GR.gaussian_weights(grid, SIDE), rows_of(images)
    names = ["mean", "var", "skew", "kurtosis"]
    for got, want, columns in (
        (PX.image_moments(images, grid, SIDE, ["image_ix"]), PX.weighted_moments(rows.select("image_ix", "row", "col", "v"), weights), names),
        (PX.image_cross(images, grid, SIDE, ["image_ix"]), PX.weighted_cross(rows, weights), ["cross"]),
        (PX.pooled_images(images, grid, SIDE, ["image_ix"]), PX.pooled(rows, weights), ["f"]),
        (PX.pooled_images(images, grid, SIDE, ["image_ix"], scaled=True), PX.scaled_pool(rows, weights), ["f"]),
    ):
        a, b = table(PX.by_field(got, ["image_ix"], columns), columns), table(want, columns)
        assert a.keys() == b.keys() and len(a) == 28
        assert all(np.allclose(a[k], b[k], rtol=1e-6, atol=1e-7) for k in a)
    flat = images.select("image_ix", F.transform("other", lambda v: F.lit(2.0)).alias("px"))
    found = PX.by_field(PX.image_moments(flat, grid, SIDE, ["image_ix"]), ["image_ix"], names).first()
    assert found.skew == pytest.approx(0, abs=1e-6) and found["var"] == pytest.approx(1e-6)


@pytest.mark.parametrize("reach", [0, 1, 4])
def test_every_shift_by_plain_sums(spark, reach):
    a, b, images, grid = data(spark)
    places = [(r.x, r.y, r.sigma) for r in grid.orderBy("prf_ix").collect()]
    w = PX.field_weights(places, SIDE)
    got = {r.image_ix: np.array(r.cross).reshape(4, 2 * reach + 1, 2 * reach + 1) for r in PX.cross_correlations(images, grid, SIDE, ["image_ix"], reach).collect()}
    assert sorted(got) == list(range(7))
    for n in range(7):
        for k in range(4):
            g = w[:, k].reshape(SIDE, SIDE)
            x, y = ((m[n] - (m[n] * g).sum()) * np.sqrt(g) for m in (a, b))
            for dy in range(-reach, reach + 1):
                for dx in range(-reach, reach + 1):
                    want = sum(x[r, c] * y[r + dy, c + dx] for r in range(SIDE) for c in range(SIDE) if 0 <= r + dy < SIDE and 0 <= c + dx < SIDE)
                    assert got[n][k, dy + reach, dx + reach] == pytest.approx(want, abs=1e-8)


def test_no_pixel_is_joined(spark):
    _, _, images, grid = data(spark)
    for df in (PX.image_moments(images, grid, SIDE, ["image_ix"]), PX.cross_correlations(images, grid, SIDE, ["image_ix"], 1)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "Aggregate" not in plan and "Generate" not in plan


def test_numbering_in_stretches(spark, monkeypatch):
    rng = np.random.default_rng(2)
    values = sorted({float(v) for v in rng.normal(size=500)} | {1e300, -1e300})
    df = spark.createDataFrame([(v,) for v in rng.permutation(values).tolist()], "x double").repartition(5)
    for rows in (1_000_000, 40, 7):
        monkeypatch.setattr(A, "NUMBERED", rows)
        assert [r.n for r in A.numbered(df, "x", "n").orderBy("x").collect()] == list(range(len(values)))
    assert A.numbered(df.limit(0), "x", "n").count() == 0
    out = A.binned(df.union(df.limit(10)), "x", "x", 0, "unique").orderBy("bin").collect()
    assert [r.bin for r in out] == list(range(len(values))) and sum(r.n for r in out) == len(values) + 10
