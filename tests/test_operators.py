"""Operators without SQL, against plain numpy and loops."""

import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelframe.functions import geometry as G
from voxelframe.functions import stats as S
from voxelframe.operators import aggregates as A
from voxelframe.operators import grids as GR
from voxelframe.operators import joins as J
from voxelframe.operators import kernels as K
from voxelframe.operators import models as M
from voxelframe.operators import sampling as P
from voxelframe.sources import tables as T


def test_grid_sizes(spark):
    assert [GR.prf_grid(spark, k).count() for k in range(1, 8)] == [875, 1114, 1114, 1684, 1456, 476, 625]
    assert GR.prf_grid(spark, 0).first().x is None
    with pytest.raises(ValueError):
        GR.prf_grid(spark, 9)
    assert GR.even_points(4, 0, 1) == pytest.approx([-0.375, -0.125, 0.125, 0.375])
    assert GR.even_points(3, 0, 1, True) == pytest.approx([0, 0.5, 1])
    assert G.mask_cutoff(2) == 0.14
    assert [round(v, 3) for v in GR.ridge_penalties()[:4]] == [0.0, 0.065, 0.552, 4.207]
    assert GR.ridge_penalties(semantic=True)[0] == 1e-8 and GR.ridge_penalties(ridge=False) == [0.0, 0.0]


def box(x, y, sigma, n, small, square):
    reach = max(int(np.ceil(sigma * 2 * n)), small // 2)
    c = np.array([n / 2 - y * n, x * n + n / 2])
    c = np.where(np.ceil(c) == np.floor(c), c + 0.0001, c)
    low, high = (np.clip(f(c + s * reach).astype(int), 0, n) for f, s in ((np.floor, -1), (np.ceil, 1)))
    for k in range(2):
        if high[k] - low[k] < small:
            low[k], high[k] = (low[k], small) if low[k] == 0 else (n - small, high[k])
    side = high - low
    if square and side[0] != side[1]:
        long, short, gap = side.argmax(), side.argmin(), abs(side[0] - side[1])
        if side.min() >= small:
            low[long], high[long] = low[long] + gap // 2, high[long] - -(-gap // 2)
        elif low[short] == 0:
            high[short] += gap
        else:
            low[short] -= gap
    return [int(v) for v in (low[0], high[0], low[1], high[1])]


def test_boxes(spark):
    g = GR.prf_grid(spark, 5).where("prf_ix % 7 = 0")
    for small, square in ((None, False), (8, True)):
        got = g.select("x", "y", "sigma", G.prf_box(F.col("x"), F.col("y"), F.col("sigma"), 240, min_pix=small, square=square).alias("b")).collect()
        assert all(list(r.b) == box(r.x, r.y, r.sigma, 240, small or 1, square) for r in got)


def test_outward(spark):
    assert spark.range(1).select(G.polygon_outward(F.array(*[F.lit(v) for v in (1.2, 2.3, 5.4, 2.3, 5.4, 9.9, 1.2, 9.9)]))).first()[0] == [1, 2, 6, 2, 6, 10, 1, 10]


def test_inverse_normal_and_dprime(spark):
    ps = [0.001, 0.02, 0.3, 0.5, 0.9, 0.999]
    got = spark.createDataFrame([(p,) for p in ps], "p double").select(S.inverse_normal(F.col("p"))).collect()
    assert [r[0] for r in got] == pytest.approx([statistics.NormalDist().inv_cdf(p) for p in ps], abs=1e-7)
    rng = np.random.default_rng(0)
    a = rng.integers(0, 3, 300)
    p = np.where(rng.random(300) < 0.7, a, rng.integers(0, 3, 300))
    df = spark.createDataFrame([(1, int(x), int(y)) for x, y in zip(a, p, strict=True)] + [(2, 0, 0), (2, 0, 1), (3, 0, 0)], "g int, a int, p int")
    got = {r.g: r.dprime for r in S.dprime(df, ["g"], "a", "p").collect()}
    assert got[1] == pytest.approx(M.dprime_of(p, a), abs=1e-6) and got[2] is None and got[3] is None


def test_zero_variance_gives_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert df.agg(S.corr(F.col("x"), F.col("y")), S.r2(F.col("x"), F.col("y"))).first()[:] == (None, None)
    assert df.limit(0).agg(S.corr(F.col("x"), F.col("y"))).first()[0] is None


def test_ridge_matches_direct_solution(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 5))
    y = x @ rng.normal(size=(5, 3)) + 0.1 * rng.normal(size=(60, 3))
    split = ["trn" if k % 3 else "holdout" for k in range(60)]
    feats = spark.createDataFrame([(p, k, split[k], (x[k] * (1 if p else -0.1) + p).tolist()) for p in (0, 1) for k in range(60)], "prf_ix int, image_ix long, split string, f array<double>")
    resp = spark.createDataFrame([(k, v, float(y[k, v])) for k in range(60) for v in range(3)], "image_ix long, voxel_ix long, y double")
    fits = M.fit_ridge(feats, resp, [0.0, 1e5, 1e6], M.partial_versions({"a": [0, 1], "b": [2], "c": [3, 4]}), block=2)
    rows = {(r.prf_ix, r.voxel_ix, r.version): r for r in fits.collect()}
    assert len(rows) == 2 * 3 * 7
    trn = np.array(split) == "trn"
    z = (x + 1 - (x + 1).mean(0)) / ((x + 1).std(0) + 1e-6)
    d = np.c_[z, np.ones(60)]
    for v in range(3):
        w = np.linalg.lstsq(d[trn], y[trn, v], rcond=None)[0]
        r = rows[1, v, "full"]
        assert r.lambda_ix == 0 and np.allclose(r.w, w[:-1], atol=1e-6) and abs(r.bias - w[-1]) < 1e-6
        assert r.loss == pytest.approx(float(((d[~trn] @ w - y[~trn, v]) ** 2).sum()), rel=1e-6)
    best = M.best_field(fits)
    assert {r.version for r in best.collect()} == {"full", "just_a", "just_b", "just_c", "leave_out_a", "leave_out_b", "leave_out_c"}
    good = {r.voxel_ix: r for r in M.validate(M.predict(feats, best), resp).where("version = 'full'").collect()}
    assert all(r.r2 > 0.95 and r.n == 60 for r in good.values())


def test_partial_correlation_and_p(spark):
    rng = np.random.default_rng(2)
    c = rng.normal(size=(200, 2))
    x, y = c @ [1, 2] + rng.normal(size=200), c @ [2, -1] + rng.normal(size=200)
    df = spark.createDataFrame([(1, *map(float, (a, b, *k))) for a, b, k in zip(x, y, c, strict=True)], "g int, x double, y double, c1 double, c2 double")
    r = M.partial_correlations(df, ["g"], "x", "y", ["c1", "c2"]).first()
    d = np.c_[c, np.ones(200)]
    rx, ry = (v - d @ np.linalg.lstsq(d, v, rcond=None)[0] for v in (x, y))
    assert r.r == pytest.approx(np.corrcoef(rx, ry)[0, 1], abs=1e-9) and 0 <= r.p <= 1
    assert M.two_sided_p(0.0, 10) == pytest.approx(1) and M.two_sided_p(0.576, 10) == pytest.approx(0.05, abs=0.0005)


def test_gram_in_groups(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(50, 4))
    df = spark.createDataFrame([(k % 2, row.tolist()) for k, row in enumerate(x)], "g int, v array<double>").repartition(3)
    got = {(r.g, r.i, r.j): r["cov"] for r in A.covariance(df, "v", 4, ["g"]).collect()}
    for g in (0, 1):
        want = np.cov(x[np.arange(50) % 2 == g].T)
        assert all(got[g, i, j] == pytest.approx(want[i, j]) for i in range(4) for j in range(i, 4))


def test_pca_keeps_variance(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 3)) @ rng.normal(size=(3, 6))
    df = spark.createDataFrame([(0, k, row.tolist()) for k, row in enumerate(x)], "g int, k int, v array<double>")
    s = np.array([r.scores for r in M.pca(df, ["g"], "k", "v", min_pct=99.9999).orderBy("k").collect()])
    assert s.shape[1] == 3 and np.allclose(np.var(s, axis=0).sum(), np.var(x, axis=0).sum())


def test_lda_separates(spark):
    rng = np.random.default_rng(5)
    rows = [(0, k, (rng.normal(size=4) + 3 * (k % 2)).tolist(), k % 2) for k in range(100)] + [(1, k, [0.0] * 4, 1) for k in range(5)]
    got = {r.g: r for r in M.decode(spark.createDataFrame(rows, "g int, k long, v array<double>, y int"), ["g"], "k", "v", "y").collect()}
    assert got[0].accuracy > 0.95 and got[0].dprime > 2 and got[1].accuracy is None


def test_sampling_invariants(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 3).alias("a"), F.when(F.col("id") % 7 == 0, None).otherwise(F.col("id") % 2).alias("b"))
    b = P.balanced(df, [], ["a", "b"], "id", 4).groupBy("iter", "a", "b").agg(F.count("*").alias("n"), F.countDistinct("id").alias("d")).collect()
    assert len(b) == 24 and len({r.n for r in b}) == 1 and all(r.n == r.d for r in b)
    s = P.split(df, [], "id", F.col("id") < 100).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in s} == {"val": 100, "holdout": 90, "trn": 810}
    p = P.permutation(df, ["a"], "id", 2).groupBy("a", "iter").agg(F.count("*").alias("n"), F.countDistinct("source").alias("d")).collect()
    assert all(r.n == r.d for r in p)


def test_overlaps_agree(spark):
    rng = np.random.default_rng(6)
    boxes = [[(k, int(a), int(a + w), int(b), int(b + h)) for k, (a, b, w, h) in enumerate(zip(*rng.integers(0, 40, (2, 30)), *rng.integers(1, 15, (2, 30)), strict=True))] for _ in range(2)]
    left, right = (spark.createDataFrame(b, "id int, x0 int, x1 int, y0 int, y1 int") for b in boxes)
    got = {(r.left_id, r.right_id): r.pixels for r in J.box_overlap(left, right, 8).collect()}
    want = {}
    for i, a0, a1, b0, b1 in boxes[0]:
        for j, c0, c1, d0, d1 in boxes[1]:
            n = max(0, min(a1, c1) - max(a0, c0)) * max(0, min(b1, d1) - max(b0, d0))
            if n > 10:
                want[i, j] = n
    assert got == want


def test_kernels():
    x = K.noise_images(3, 32, 0)
    assert np.allclose(K.shrink(K.expand(x, 2), 2).mean(), x.mean(), atol=0.5)
    assert np.allclose(K.expand(x, 2).mean(axis=(-2, -1)), x.mean(axis=(-2, -1)))
    a = K.auto_correlation(x, np.ones((32, 32)), 7)
    assert np.allclose(a[:, 3, 3], x.var(axis=(-2, -1))) and np.allclose(a, a[:, ::-1, ::-1])
    assert K.unique_correlations(a).shape == (3, 25)
    assert np.allclose(K.resize(x, 32, 32), x) and K.resize_crop(x, 16).shape == (3, 16, 16)
    assert np.allclose(K.block_means(np.ones((2, 30, 31)), 4), 1)
    assert abs(K.gabor_pair(4, 30, (0, 0), 0.1, 33).real.sum()) < 1e-9 and abs(K.bent_kernel(0.4, 0.1, 30, 15).sum()) < 1e-9
    grating = 127 + 100 * K.sine_wave(6, 0, 0, 64)[None]
    e = K.gabor_energy(grating, 4, 3, compress=False).mean(axis=(-2, -1)).reshape(3, 4)
    assert e.sum(axis=0).argmax() == 0
    p = K.steerable_pyramid(x, 2)
    assert p["bands"][0].shape == (3, 4, 32, 32) and p["bands"][1].shape == (3, 4, 16, 16) and p["low"].shape == (3, 8, 8)
    t = K.texture_statistics(x, (0.0, 0.0, 50.0), 2, 4)
    assert np.allclose(t["pixel_stats"][:, 0], x.mean(axis=(-2, -1)), rtol=1e-3) and all(np.isfinite(v).all() for v in t.values())
    assert K.inside([2, 2, 8, 2, 8, 6, 2, 6], 10, 10).sum() == 24


def test_sources(spark, tmp_path):
    (tmp_path / "info.csv").write_text('coco_id,crop_box,coco_split,filename_raw\n5,"(0.1, 0, 0.2, 0)",train,a.jpg\n')
    assert T.image_info(spark, str(tmp_path / "info.csv")).first().crop_box == [0.1, 0, 0.2, 0]
    (tmp_path / "a.json").write_text('{"annotations":[{"image_id":1,"category_id":2,"bbox":[1,2,3,4],"iscrowd":0}],"categories":[{"id":2,"name":"cat","supercategory":"animal"}]}')
    a, c = T.annotations(spark, str(tmp_path / "a.json"))
    assert a.first().bbox == [1, 2, 3, 4] and T.category_info(c).first().supercategory == "animal"
    (tmp_path / "x.ctab").write_text("0 Unknown 0 0 0 0\n1 V1 10 20 30 0\nbad line\n")
    assert [(r.id, r.name) for r in T.label_colours(spark, str(tmp_path / "x.ctab")).collect()] == [(0, "Unknown"), (1, "V1")]
    np.save(tmp_path / "m.npy", np.arange(6).reshape(2, 3))
    r = T.array_files(spark, str(tmp_path / "m.npy")).first()
    assert r.shape == [2, 3] and r["values"] == [0, 1, 2, 3, 4, 5]
    head = bytearray(352)
    head[0:4] = np.int32(348).tobytes()
    head[40:56] = np.array([3, 2, 3, 1, 1, 1, 1, 1], np.int16).tobytes()
    head[70:72] = np.int16(16).tobytes()
    head[108:120] = np.array([352, 2, 1], np.float32).tobytes()
    (tmp_path / "v.nii").write_bytes(bytes(head) + np.arange(6, dtype=np.float32).tobytes())
    got = {(r.i, r.j): r.value for r in T.volumes(spark, str(tmp_path / "v.nii")).collect()}
    assert got[1, 0] == 3 and got[0, 1] == 5 and len(got) == 6
    runs = spark.createDataFrame([("s", n) for n in ("Jan-31-2021_1205_30", "Feb-01-2021_0905", "DEBUG_Feb-02-2021_0905", "junk")], "k string, name string")
    assert T.recent_runs(runs, ["k"], "name").first().name == "Feb-01-2021_0905"
    df = spark.range(3)
    assert T.recast(df, {"id": "bigint"}) is df and dict(T.recast(df, {"id": "int"}).dtypes)["id"] == "int"
    T.write_partitioned(df.withColumn("p", F.col("id") % 2), str(tmp_path / "out"), ["p"])
    assert spark.read.parquet(str(tmp_path / "out")).where("p = 0").count() == 2


def test_ranks_by_draw_are_exact(spark):
    """Ranks over buckets equal a plain sort, also within null and lopsided groups."""
    from voxelframe.operators import sampling as P

    rows = [(k, None if k % 7 == 0 else "big" if k % 7 < 6 else "small") for k in range(4000)]
    df = spark.createDataFrame(rows, "k long, g string").repartition(5)
    got = {r.k: (r.rank, r.n) for r in P.ranked_by_draw(df, ["g"], P.draw(F.col("k"), 3), "k", "rank", "n").collect()}
    drawn = {r.k: r.d for r in df.select("k", P.draw(F.col("k"), 3).alias("d")).collect()}
    for g in ("big", "small", None):
        mine = sorted((k for k, x in rows if x == g), key=lambda k: (drawn[k], k))
        assert [got[k] for k in mine] == [(i + 1, len(mine)) for i in range(len(mine))]
    few = P.first_by_draw(df.withColumn("n", F.lit(25)), ["g"], P.draw(F.col("k"), 3), "k", "n").collect()
    assert len(few) == 75 and {r.k for r in few} == {k for k, (rank, _) in got.items() if rank <= 25}


def test_quantiles_are_exact(spark):
    from voxelframe.operators.aggregates import quantiles

    rng = np.random.default_rng(5)
    for values in (rng.normal(size=9000), np.concatenate([np.zeros(6000), rng.normal(size=3000) * 1e-9, [1e12]]), np.array([2.5]), np.repeat([1.0, 2.0], 5000)):
        shares = [0, 0.1, 1 / 3, 0.5, 0.9, 0.999, 1]
        got = quantiles(spark.createDataFrame([(float(v),) for v in values], "x double").repartition(3), shares, buckets=16, few=40)
        np.testing.assert_allclose(got, np.quantile(values, shares), rtol=1e-12, atol=1e-18)
    assert quantiles(spark.createDataFrame([], "x double"), [0.5]) == [0.0]


def test_adjusted_p_is_exact(spark):
    from voxelframe.functions import stats as S

    rng = np.random.default_rng(6)
    p = [float(x) for x in np.concatenate([rng.random(300), rng.random(100) ** 8, [0.0, 1.0, 0.5, 0.5]])] + [None]
    df = spark.createDataFrame(list(enumerate(p)), "i long, p double").withColumn("g", F.lit(None).cast("string")).repartition(3)
    got = {r.i: r.p_adj for r in S.adjusted(df, "p", ["g"]).collect()}
    order = sorted((i for i in got if p[i] is not None), key=lambda i: p[i])
    n, least = len(order), 1.0
    for k in range(n, 0, -1):
        least = min(least, p[order[k - 1]] * n / k)
        assert abs(got[order[k - 1]] - least) < 1e-12
    assert got[len(p) - 1] is None and len(got) == len(p)
    assert abs(spark.range(1).select(S._harmonic(F.lit(5000))).first()[0] - sum(1 / k for k in range(1, 5001))) < 1e-12


def _refit_data(spark, n=90, p=4, channels=3):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(2, n, p)) * 2 + 1
    y = x[0] @ rng.normal(size=(p, channels)) + 0.3 * rng.normal(size=(n, channels))
    split = np.array([("trn", "trn", "trn", "holdout", "val")[k % 5] for k in range(n)])
    feats = spark.createDataFrame([(f, k, split[k], x[f, k].tolist()) for f in (0, 1) for k in range(n)], "prf_ix int, image_ix long, split string, f array<double>")
    resp = spark.createDataFrame([(k, v, float(y[k, v])) for k in range(n) for v in range(channels)], "image_ix long, voxel_ix long, y double")
    return x, y, split, feats, resp


@pytest.mark.parametrize("bootstrap", [False, True])
def test_refits_match_plain_fits(spark, monkeypatch, bootstrap):
    """Every iteration equals a fit on the moved or drawn rows themselves, with grouped penalties and column masks, over many small parts."""
    monkeypatch.setattr(M, "IMAGES", 7)
    monkeypatch.setattr(M, "PARTIALS", 3)
    x, y, split, feats, resp = _refit_data(spark)
    fields = spark.createDataFrame([(0, 0), (1, 1), (2, 0)], "voxel_ix long, prf_ix int")
    penalties = M.group_penalties([0.0, 5.0], [0, 0, 1, 1])
    masks = {"full": [0, 1, 2, 3], "some": [1, 3]}
    fits, scores = M.refit(feats, resp, penalties, fields, 3, masks, bootstrap=bootstrap)
    images = feats.select("split", "image_ix").distinct()
    plan = (P.bootstrap if bootstrap else P.permutation)(images, ["split"], "image_ix", 3).collect()
    got = {(r.voxel_ix, r.version, r.iter): r for r in fits.collect()}
    score = {(r.voxel_ix, r.version, r.iter): r for r in scores.collect()}
    assert len(got) == len(score) == 3 * 2 * 3
    seen = split != "val"
    for (v, version, i), r in got.items():
        field = {0: 0, 1: 1, 2: 0}[v]
        z = (x[field] - x[field][seen].mean(0)) / (x[field][seen].std(0) + 1e-6)
        d = np.c_[z[:, masks[version]], np.ones(len(z))]
        rows = {s: [(q.source if bootstrap else q.image_ix, q.source) for q in plan if q.iter == i and q.split == s] for s in ("trn", "holdout", "val")}
        of = lambda s: (d[[a for a, _ in rows[s]]], y[[b for _, b in rows[s]], v])  # noqa: B023, E731
        (a, b), (a_out, b_out), (a_val, b_val) = map(of, ("trn", "holdout", "val"))
        ws = [np.linalg.solve(a.T @ a + np.diag(lam[[*masks[version], 4]]), a.T @ b) for lam in penalties]
        losses = [((a_out @ w - b_out) ** 2).sum() for w in ws]
        k = int(np.argmin(losses))
        assert r.prf_ix == field and r.loss == pytest.approx(losses[k], rel=1e-8) and losses[r.lambda_ix] == pytest.approx(losses[k], rel=1e-9)
        assert np.allclose([*(r.w[c] for c in masks[version]), r.bias], ws[r.lambda_ix], atol=1e-8)
        yhat = a_val @ ws[r.lambda_ix]
        assert score[v, version, i].r2 == pytest.approx(1 - ((yhat - b_val) ** 2).sum() / ((b_val - b_val.mean()) ** 2).sum(), abs=1e-8)


def test_channels_with_missing_images(spark):
    """A channel is fitted on its own images, and one without train images has no fit."""
    x, y, split, feats, resp = _refit_data(spark)
    some = resp.where("not (voxel_ix = 1 and image_ix < 30) and not (voxel_ix = 2 and image_ix % 5 < 3)")
    got = {(r.prf_ix, r.voxel_ix): r for r in M.fit_ridge(feats, some, [3.0]).collect()}
    assert set(got) == {(f, v) for f in (0, 1) for v in (0, 1)}
    seen, z = split != "val", {}
    for f in (0, 1):
        z[f] = np.c_[(x[f] - x[f][seen].mean(0)) / (x[f][seen].std(0) + 1e-6), np.ones(90)]
    for (f, v), r in got.items():
        on = (split == "trn") & ((v == 0) | (np.arange(90) >= 30))
        w = np.linalg.solve(z[f][on].T @ z[f][on] + np.diag([3.0] * 4 + [0]), z[f][on].T @ y[on, v])
        assert np.allclose([*r.w, r.bias], w, atol=1e-8)


def test_simulated_noise_is_repeatable(spark):
    df = spark.range(4000).select(F.col("id").alias("image_ix"), F.lit(1).alias("voxel_ix"), F.lit(2.0).alias("v"))
    a, b = ([r.y for r in M.simulated(df.repartition(k), 0.5, 3).orderBy("image_ix").collect()] for k in (1, 7))
    assert a == b and abs(np.mean(a) - 2) < 0.03 and abs(np.std(a) - 0.5) < 0.03


def test_p_of_t_and_f(spark):
    """Against the incomplete beta function in plain Python, and known points."""
    cases = [(0.0, 5.0), (2.571, 5.0), (-1.96, 1e5), (0.3, 1.5), (12.0, 40.0), (1.0, 3000.0)]
    got = [r[0] for r in spark.createDataFrame(cases, "t double, d double").select(S.t_p(F.col("t"), F.col("d"))).collect()]
    for (t, d), p in zip(cases, got, strict=True):
        assert p == pytest.approx(M._beta_share(d / 2, 0.5, d / (d + t * t)), rel=1e-9, abs=1e-300)
    assert got[0] == pytest.approx(1) and got[1] == pytest.approx(0.05, abs=1e-4) and got[2] == pytest.approx(0.05, abs=1e-4)
    cases = [(3.49, 3.0, 12.0), (1.0, 1.0, 1.0), (0.2, 7.0, 400.0), (50.0, 2.0, 9.0), (0.0, 2.0, 9.0)]
    got = [r[0] for r in spark.createDataFrame(cases, "f double, a double, b double").select(S.f_p(F.col("f"), F.col("a"), F.col("b"))).collect()]
    for (f, a, b), p in zip(cases, got, strict=True):
        assert p == pytest.approx(M._beta_share(b / 2, a / 2, b / (b + a * f)), rel=1e-9)
    assert got[0] == pytest.approx(0.05, abs=1e-3) and got[1] == pytest.approx(0.5) and got[4] == 1.0
    assert spark.range(1).select(S.t_p(F.lit(1.0), F.lit(0.0))).first()[0] is None


def test_stored_components_match_svd(spark, tmp_path):
    """Stored weights applied to new rows equal a plain decomposition, over several parts of a group and with a null key."""
    rng = np.random.default_rng(14)
    x = {g: rng.normal(size=(120, 3)) @ rng.normal(size=(3, 5)) + rng.normal(size=5) for g in ("a", None)}
    rows = [(g, k, v.tolist()) for g in x for k, v in enumerate(x[g])]
    df = spark.createDataFrame(rows, "g string, k long, v array<double>").repartition(5)
    M.fit_pca(df.where("k < 80"), ["g"], "v", 99.9).write.parquet(str(tmp_path / "w"))
    kept = spark.read.parquet(str(tmp_path / "w"))
    got = {(r.g, r.k): r.scores for r in M.apply_pca(df, ["g"], "k", "v", kept).collect()}
    assert len(got) == 240
    for g in x:
        m = x[g][:80].mean(0)
        _, s, vt = np.linalg.svd(x[g][:80] - m, full_matrices=False)
        vt = vt * np.sign(vt[np.arange(len(vt)), np.abs(vt).argmax(1)])[:, None]
        scores = (x[g] - m) @ vt[:3].T
        assert all(np.allclose(got[g, k], scores[k], atol=1e-8) for k in range(120))
    assert M.apply_pca(df.withColumn("g", F.lit("none")), ["g"], "k", "v", kept).count() == 0


def test_feature_and_result_stores(spark, tmp_path):
    import datetime

    from voxelframe.sources import stores as ST
    from voxelframe.operators import trials as TR

    df = spark.range(40).select((F.col("id") % 4).cast("int").alias("prf_ix"), (F.col("id") % 10).alias("image_ix"), F.array(F.col("id") * 1.0, F.lit(None).cast("double")).alias("f"))
    ST.write_features(df, str(tmp_path / "f"))
    back = ST.read_features(spark, str(tmp_path / "f"))
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    one = TR.selected_features(back, spark.range(3).withColumnRenamed("id", "image_ix"), [2])
    assert "PartitionFilters: [isnotnull(prf_ix" in one._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")) or one.inputFiles()
    assert {(r.prf_ix, r.image_ix) for r in one.collect()} == {(r.prf_ix, r.image_ix) for r in df.collect() if r.prf_ix == 2 and r.image_ix < 3}
    assert {(r.k, r.defined) for r in TR.defined_columns(back).collect()} == {(0, True), (1, False)}
    when = datetime.datetime(2021, 1, 31, 12, 5, 30)
    for k in range(3):
        spark.range(k + 1).write.parquet(ST.result_path(str(tmp_path), "s1", ST.model_name(["a", "b"]), when + datetime.timedelta(days=k)) + "/fits")
    spark.range(99).write.parquet(ST.result_path(str(tmp_path), "s1", "a_plus_b", when + datetime.timedelta(days=9), debug=True) + "/fits")
    assert [ST.load_result(spark, str(tmp_path), "s1", "a_plus_b", "fits", n).count() for n in (0, 2)] == [3, 1]
    with pytest.raises(ValueError):
        ST.load_result(spark, str(tmp_path), "s1", "a_plus_b", "fits", 3)


def test_image_files(spark, tmp_path):
    """PNG files with every line filter, with a palette and grey, and PPM files give their pixels back."""
    import struct
    import zlib

    from voxelframe.sources import stores as ST

    rng = np.random.default_rng(15)

    def png(a, colour, palette=None, modes=None):
        h, w, c = a.shape
        rows, before = b"", np.zeros((w, c), int)
        for y in range(h):
            mode, line, out = (modes or [0])[y % len(modes or [0])], a[y].astype(int), []
            for x in range(w):
                left, corner = (line[x - 1], before[x - 1]) if x else (np.zeros(c, int), np.zeros(c, int))
                p = left + before[x] - corner
                near = [np.abs(p - v) for v in (left, before[x], corner)]
                paeth = np.where((near[0] <= near[1]) & (near[0] <= near[2]), left, np.where(near[1] <= near[2], before[x], corner))
                out.append((line[x] - [0, left, before[x], (left + before[x]) // 2, paeth][mode]) % 256)
            rows += bytes([mode]) + np.array(out, np.uint8).tobytes()
            before = line
        chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)) + (chunk(b"PLTE", palette.tobytes()) if palette is not None else b"") + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")

    rgb, grey, ix = rng.integers(0, 256, (11, 6, 3)), rng.integers(0, 256, (4, 5, 1)), rng.integers(0, 7, (3, 3, 1))
    palette = rng.integers(0, 256, (7, 3)).astype(np.uint8)
    (tmp_path / "a.png").write_bytes(png(rgb, 2, modes=[0, 1, 2, 3, 4]))
    (tmp_path / "b.png").write_bytes(png(grey, 0, modes=[4, 3]))
    (tmp_path / "c.png").write_bytes(png(ix, 3, palette))
    (tmp_path / "d.ppm").write_bytes(b"P6\n# note\n6 11\n255\n" + rgb.astype(np.uint8).tobytes())
    got = {r.path[-5:]: np.array(r.px).reshape(r.height, r.w, r.channels) for r in ST.image_files(spark, str(tmp_path)).collect()}
    assert (got["a.png"] == rgb).all() and (got["b.png"] == grey).all() and (got["c.png"] == palette[ix[..., 0]]).all() and (got["d.ppm"] == rgb).all()


def test_trials_and_residual_checks(spark):
    from voxelframe.operators import trials as TR

    rows = spark.createDataFrame([(1, 0.5), (2, 0.1)], "trial_ix long, r double")
    assert TR.checked_residuals(rows, rows).count() == 2
    with pytest.raises(ValueError, match="1 missing trials from 3"):
        TR.checked_residuals(rows, spark.createDataFrame([(1,), (2,), (3,)], "trial_ix long"))
    assert TR.checked_residuals(rows.limit(0), rows.limit(0)).count() == 0
    chosen = [r.prf_ix for r in TR.spread_grid(GR.prf_grid(spark, 5)).collect()]
    assert len(chosen) == len(set(chosen)) > 50
    out = TR.concatenated({"a": rows, "b": rows.limit(0), "c": rows}, "trial_ix").collect()
    assert [(r.subject, r.trial_ix) for r in out] == [("a", 1), ("a", 2), ("c", 4), ("c", 5)]


def test_texture_groups_match_the_dictionary():
    """Widths and names group by group, and values of several groups by plain loops over pixels."""
    from voxelframe.operators.catalogue import TEXTURE_GROUPS

    rng = np.random.default_rng(16)
    x, field = rng.normal(size=(2, 64, 64)).cumsum(axis=1), (0.1, -0.15, 0.12)
    t = K.texture_statistics(x, field)
    assert [(name, v.shape) for name, v in t.items()] == [(name, (2, n)) for name, n, _ in TEXTURE_GROUPS]
    assert all(np.isfinite(v).all() for v in t.values())

    def weights(n):
        g = np.array([[np.exp(-((c / (n - 1) - 0.5 - 0.1) ** 2 + (r / (n - 1) - 0.5 - 0.15) ** 2) / (2 * 0.12**2)) for c in range(n)] for r in range(n)])
        return g / g.sum()

    p = K.steerable_pyramid(x)
    w = weights(64)
    mean = (x * w).sum(axis=(1, 2))
    assert np.allclose(t["pixel_stats"][:, 0], mean) and np.allclose(t["pixel_stats"][:, 1], ((x - mean[:, None, None]) ** 2 * w).sum(axis=(1, 2)) + 1e-6)
    assert np.allclose(t["pixel_stats"][:, 4:], np.stack([x.min(axis=(1, 2)), x.max(axis=(1, 2))], axis=1))
    bands = p["bands"][::-1]  # coarse to fine
    for scale, band in enumerate(bands):
        w = weights(band.shape[-1])
        assert np.allclose(t["mean_magnitudes"].reshape(2, 4, 4)[:, scale], (np.abs(band) * w).sum(axis=(2, 3)))
        assert np.allclose(t["mean_realparts"].reshape(2, 4, 4)[:, scale], (band.real * w).sum(axis=(2, 3)))
        for name, part in (("magnitude", np.abs(band)), ("real", band.real)):
            pairs = [(a, b) for a in range(4) for b in range(a + 1, 4)]
            for k, (a, b) in enumerate(pairs):
                u, v = (part[:, c] - (part[:, c] * w).sum(axis=(1, 2))[:, None, None] for c in (a, b))
                assert np.allclose(t[f"{name}_within_scale_crosscorrs"].reshape(2, 4, 6)[:, scale, k], (u * v * w).sum(axis=(1, 2)) / w.size)
    # the finest autocorrelation of the high residual, at each shift, by its definition
    rows, cols = K.field_patch(field, 64, 7)
    w = weights(64)[rows, cols]
    patch = p["high"][:, rows, cols]
    d = (patch - (patch * w).sum(axis=(1, 2))[:, None, None] / w.sum()) * np.sqrt(w)
    side = d.shape[-1]
    want = np.array([[[sum(d[n, r, c] * d[n, (r + a) % side, (c + b) % side] for r in range(side) for c in range(side)) for b in range(-3, 4)] for a in range(-3, 4)] for n in range(2)])
    assert np.allclose(t["highpass_resid_autocorrs"], K.unique_correlations(want))
    coarse = K.expand(p["low"], 2)
    w = weights(coarse.shape[-1])
    a, b = coarse, np.roll(coarse, 1, axis=2)
    a, b = (v - (v * w).sum(axis=(1, 2))[:, None, None] for v in (a, b))
    assert np.allclose(t["real_spatshift_within_scale_crosscorrs"][:, 0], (a * b * w).sum(axis=(1, 2)) / w.size)
    assert np.allclose(K.expand(p["recon"][-1], 2).shape, p["recon"][-2].shape) and np.abs(p["recon"][0] - x).mean() < np.abs(x - x.mean()).mean()


def test_stored_fits_predict_other_images(spark, tmp_path):
    """A whole job: fit, keep, load the latest run, predict images that were not fitted."""
    import datetime

    from voxelframe.sources import stores as ST

    x, y, split, feats, resp = _refit_data(spark)
    ST.fit_and_store(feats, resp, [0.0, 1.0], str(tmp_path), "s1", ["a"], datetime.datetime(2021, 1, 31, 12, 5))
    fits = ST.load_result(spark, str(tmp_path), "s1", "a", "fits")
    assert {r.prf_ix for r in fits.collect()} == {0}
    scores = ST.load_result(spark, str(tmp_path), "s1", "a", "scores").collect()
    assert len(scores) == 3 and all(r.n == 18 and r.r2 > 0.8 for r in scores)
    other = spark.createDataFrame([(0, 1000 + k, [float(k), 1.0, 2.0, 3.0]) for k in range(4)], "prf_ix int, image_ix long, f array<double>")
    got = {(r.voxel_ix, r.image_ix): r.yhat for r in M.predict(other, fits).collect()}
    w = {r.voxel_ix: r for r in fits.collect()}
    for (v, image), yhat in got.items():
        f = np.array([image - 1000.0, 1.0, 2.0, 3.0])
        assert yhat == pytest.approx(float(((f - w[v]["mean"]) / w[v].sd) @ w[v].w + w[v].bias))


def test_max_pool_and_maps():
    x = np.arange(2 * 9 * 8, dtype=float).reshape(2, 9, 8)
    want = np.array([[[x[n, 4 * i : 4 * i + 4, 4 * j : 4 * j + 4].max() for j in range(2)] for i in range(2)] for n in range(2)])
    assert (K.max_pool(x, 4) == want).all()


def test_combined_versions_by_rule():
    from voxelframe.operators.catalogue import combined_versions

    got = combined_versions({"m": {"a": 1, "b": 1, "c": 1}, "n": {"x": 2}, "o": {"p": 1, "q": 1}})
    assert got["just_n"] == [3, 4] and got["leave_out_m"] == [3, 4, 5, 6] and got["m_leave_out_b_no_other_modules"] == [0, 2]
    assert got["o_just_p_plus_other_modules"] == [0, 1, 2, 3, 4, 5] and "m_just_a_plus_other_modules" not in got and not any(k.startswith("n_") for k in got)
    assert set(combined_versions({"m": {"a": 1}, "n": {"b": 1}}, solo=False)) == {"full_combined", "leave_out_m", "leave_out_n"}
    assert set(combined_versions({"m": {"a": 2}})) == {"full_combined", "just_m"}


def test_array_slices(spark, tmp_path):
    np.save(tmp_path / "m.npy", np.arange(10.0).reshape(2, 5))
    rows = T.array_files(spark, str(tmp_path / "m.npy"), 4).orderBy("start").collect()
    assert [r.start for r in rows] == [0, 4, 8] and sum((r["values"] for r in rows), []) == list(range(10)) and all(r.shape == [2, 5] for r in rows)


def test_feature_sets_open_side_by_side(spark, tmp_path):
    from voxelframe.sources import features as FS
    from voxelframe.sources import stores as ST

    a = spark.range(12).select((F.col("id") % 3).cast("int").alias("prf_ix"), F.floor(F.col("id") / 3).alias("image_ix"), F.array(F.col("id") * 1.0, F.lit(2.0)).alias("f"))
    b = spark.range(4).select(F.lit(0).alias("prf_ix"), F.col("id").alias("image_ix"), F.array(F.col("id") * 10.0).alias("f"))
    ST.write_features(a, str(tmp_path / "a"))
    ST.write_features(b, str(tmp_path / "b"))
    sets = FS.FeatureSets(FS.FeatureSet("net", str(tmp_path / "a"), {"low": 1, "high": 1}), FS.FeatureSet("labels", str(tmp_path / "b"), {"all": 1}, by_field=False))
    features, masks = sets.open(spark, ["net", "labels"], spark.range(2).withColumnRenamed("id", "image_ix"), [1, 2])
    assert {(r.prf_ix, r.image_ix, tuple(r.f)) for r in features.collect()} == {(p, i, (3.0 * i + p, 2.0, 10.0 * i)) for p in (1, 2) for i in (0, 1)}
    assert masks["just_labels"] == [2] and masks["net_just_low_plus_other_modules"] == [0, 2]
    with pytest.raises(ValueError):
        FS.FeatureSets(FS.FeatureSet("x", "p"), FS.FeatureSet("x", "q"))


def test_separate_boxes(spark):
    rng = np.random.default_rng(17)
    rows = []
    for k in range(120):
        x, y = rng.integers(0, 40, 2)
        rows.append((int(k % 4), k, float(x), float(x + rng.integers(3, 20)), float(y), float(y + rng.integers(3, 20)), float(rng.choice([0.5, 0.9, 0.95, 0.99]))))
    got = {r.id for r in J.separate_boxes(spark.createDataFrame(rows, "image_ix int, id int, x0 double, x1 double, y0 double, y1 double, score double")).collect()}
    want = set()
    for image in range(4):
        kept = []
        for r in sorted((r for r in rows if r[0] == image and r[6] >= 0.9), key=lambda r: (-r[6], r[1])):
            share = lambda a, b: (s := max(min(a[3], b[3]) - max(a[2], b[2]), 0) * max(min(a[5], b[5]) - max(a[4], b[4]), 0)) / ((a[3] - a[2]) * (a[5] - a[4]) + (b[3] - b[2]) * (b[5] - b[4]) - s)
            if all(share(r, q) <= 0.4 for q in kept):
                kept.append(r)
        want |= {r[1] for r in kept}
    assert got == want and 4 < len(got) < 90


def test_components_by_group_of_columns(spark):
    """Each group of columns has its own decomposition, and labels name every texture column."""
    from voxelframe.operators.catalogue import TEXTURE_GROUPS, texture_labels

    rng = np.random.default_rng(18)
    x = rng.normal(size=(50, 7)) @ rng.normal(size=(7, 7))
    groups = {"a": [0, 2, 4], "b": [1, 3, 5, 6]}
    df = spark.createDataFrame([(0, k, v.tolist()) for k, v in enumerate(x)], "prf_ix int, k long, f array<double>")
    rows = M.column_groups(df, ["prf_ix", "k"], "f", groups)
    scores = M.apply_pca(rows, ["prf_ix", "group"], "k", "v", M.fit_pca(rows, ["prf_ix", "group"], "v", 100.0)).collect()
    assert len(scores) == 100
    for name, cols in groups.items():
        s = np.array([r.scores for r in sorted((r for r in scores if r.group == name), key=lambda r: r.k)])
        part = x[:, cols] - x[:, cols].mean(0)
        assert np.allclose(np.sort((s**2).sum(0)), np.sort(np.linalg.svd(part, compute_uv=False) ** 2))
    labels = texture_labels()
    assert [(name, sum(r[0] == name for r in labels)) for name, *_ in TEXTURE_GROUPS] == [(name, n) for name, n, _ in TEXTURE_GROUPS]


def test_feature_residuals_match_least_squares(spark):
    rng = np.random.default_rng(19)
    x = {g: rng.normal(size=(60, 3)) for g in ("a", None)}
    y = {g: x[g] @ rng.normal(size=(3, 2)) + rng.normal(size=(60, 2)) + 5 for g in x}
    df = spark.createDataFrame([(g, k, y[g][k].tolist(), x[g][k].tolist()) for g in x for k in range(60)], "g string, k int, t array<double>, s array<double>").repartition(4)
    got = {(r.g, r.k): r.residual for r in M.feature_residuals(df, ["g"], "k", "t", "s", F.col("k") < 40).collect()}
    assert len(got) == 120
    for g in x:
        d = np.c_[x[g], np.ones(60)]
        want = y[g] - d @ np.linalg.lstsq(d[:40], y[g][:40], rcond=None)[0]
        assert all(np.allclose(got[g, k], want[k], atol=1e-9) for k in range(60))


@pytest.mark.parametrize("shape", [(3, 32, 32), (2, 31, 33), (2, 9, 14), (1, 3, 3), (1, 1, 2), (2, 2, 12, 10)])
@pytest.mark.parametrize(("orientations", "blocks", "pad"), [((8, 8, 8, 8), 4, 32), ((4, 3), 3, 5), ((2,), 5, 0)])
def test_descriptor_by_products_and_transforms(shape, orientations, blocks, pad):
    x = np.random.default_rng(0).uniform(0, 255, shape)
    x[0, ..., 0, 0] = 0
    h, w = shape[-2:]
    y = np.pad(K.prefilter(x), [(0, 0)] * (x.ndim - 2) + [(pad, pad)] * 2, "symmetric")
    fy, fx = np.meshgrid(np.fft.fftfreq(h + 2 * pad), np.fft.fftfreq(w + 2 * pad), indexing="ij")
    want = []
    for scale, n in enumerate(orientations):
        for k in range(n):
            turned = (np.angle(fx + 1j * fy) + np.pi * k / n + np.pi) % (2 * np.pi) - np.pi
            g = np.exp(-3.5 * (np.hypot(fx, fy) * 1.85**scale / 0.3 - 1) ** 2 - n**2 / 32 * np.pi * turned**2)
            a = np.abs(np.fft.ifft2(np.fft.fft2(y) * g))[..., pad : pad + h, pad : pad + w]
            want.append(K.block_means(a, blocks).reshape(*shape[:-2], -1))
    want = np.concatenate(want, axis=-1)
    for most in (1 << 26, 0):
        got = K.gist(x, orientations, blocks, pad, most)
        assert got.shape == want.shape
        assert np.abs(got - want).max() < 1e-12


def test_descriptor_of_a_broken_image_is_its_own():
    x = np.random.default_rng(1).uniform(0, 255, (3, 32, 32))
    want = K.gist(x)
    x[1, 4, 5] = np.nan
    got = K.gist(x)
    assert np.isnan(got[1]).all()
    assert np.allclose(got[[0, 2]], want[[0, 2]], rtol=0, atol=1e-12)


def test_descriptor_matrices_are_bounded():
    for shape, kept in (((1, 8, 8), 1), ((1, 32, 32), 1), ((1, 64, 64), 0), ((1, 200, 200), 0), ((1, 2, 500), 0), ((1, 500, 2), 0)):
        K.gist_matrices.cache_clear()
        K.gist(np.ones(shape))
        assert K.gist_matrices.cache_info().currsize == kept
    K.gist(np.random.default_rng(2).uniform(0, 255, (1, 32, 32)))
    assert sum(m.nbytes for pair in K.gist_matrices(32, 32, (8,) * 4, 32) for m in pair) <= 1 << 26
