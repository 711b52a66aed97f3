"""Models from sums: bounded groups, shared products, discriminants and templates against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelframe.operators import discriminant as DI
from voxelframe.operators import models as M
from voxelframe.operators import sampling as P
from voxelframe.operators import templates as TE
from voxelframe.operators.kernels import bent_kernel, convolve


def discriminate(x, y, fold):
    """Cross-validated predictions, each fold fitted from the rows of the others."""
    out = y.copy()
    for f in np.unique(fold):
        trn, tst = fold != f, fold == f
        classes = np.unique(y[trn])
        means = np.stack([x[trn & (y == c)].mean(axis=0) for c in classes])
        centred = np.concatenate([x[trn & (y == c)] - m for c, m in zip(classes, means, strict=True)])
        inverse = np.linalg.pinv(centred.T @ centred / max(len(centred) - len(classes), 1), rcond=1e-4)
        score = x[tst] @ inverse @ means.T - 0.5 * np.einsum("ij,jk,ik->i", means, inverse, means) + np.log([(y[trn] == c).mean() for c in classes])
        out[tst] = classes[score.argmax(axis=1)]
    return out


@pytest.mark.parametrize("few", [4_000_000, 0])
def test_decoding_from_sums(spark, monkeypatch, few):
    monkeypatch.setattr(DI, "MOST_NUMBERS", few)
    rng = np.random.default_rng(4)
    rows = []
    for g, classes in (("a", 3), ("b", 2), (None, 2), ("one", 1)):
        for k in range(150):
            y = int(rng.integers(0, classes))
            rows.append((g, len(rows), [float(v) for v in rng.normal(size=4) + y * np.array([1, 0, 0.5, -1])] + [100.0], y))
    rows += [("a", len(rows), None, 1), ("a", len(rows) + 1, [0.0] * 5, None)]
    df = spark.createDataFrame(rows, "g string, k long, v array<double>, y int")
    found = DI.cross_validated(df, ["g"], "k", "v", "y", 5).collect()
    scores = {r.g: r for r in DI.decode(df, ["g"], "k", "v", "y", 5).collect()}
    for g in ("a", "b", None):
        mine = sorted((r for r in found if r.g == g), key=lambda r: r.k)
        at = {r[1]: r for r in rows}
        x, y, fold = np.array([at[r.k][2] for r in mine]), np.array([r.y for r in mine]), np.array([r.fold for r in mine])
        want = discriminate(x, y, fold)
        assert [r.predicted for r in mine] == want.tolist() and len(mine) == 150
        assert scores[g].accuracy == pytest.approx((want == y).mean()) and scores[g].dprime == pytest.approx(M.dprime_of(want, y))
    assert scores["one"].n == 150 and scores["one"].accuracy is None and scores["one"].dprime is None
    assert DI.decode(df.limit(0), ["g"], "k", "v", "y").count() == 0


def test_a_fold_less_is_the_rest():
    rng = np.random.default_rng(5)
    x, n = rng.normal(size=(50, 3)) + 1e3, 20
    of = lambda a: (float(len(a)), a.mean(axis=0), (a - a.mean(axis=0)).T @ (a - a.mean(axis=0)))
    whole = DI.merged(of(x[:n]), of(x[n:]))
    for got, want in ((whole, of(x)), (DI.without(whole, of(x[:n])), of(x[n:]))):
        assert all(np.allclose(a, b) for a, b in zip(got, want, strict=True))


def test_decoding_holds_no_group_in_a_task(spark):
    df = spark.range(1000).select(F.lit(1).alias("g"), F.col("id").alias("k"), F.array(F.rand(1), F.rand(2)).alias("v"), (F.col("id") % 2).cast("int").alias("y"))
    models = DI.fold_models(P.folds(df, ["g"], "k").withColumn("fold", F.col("fold").cast("int")), ["g"], "v")
    plan = models._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapGroupsInPandas") == 3  # two merges of sums, and the fit from them
    assert "MapInPandas" in plan


def made(spark, images=120, width=5, channels=6, fields=2, seed=6):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(fields, images, width))
    split = np.array(["trn"] * (images * 6 // 10) + ["holdout"] * (images * 2 // 10) + ["val"] * (images - images * 6 // 10 - images * 2 // 10))
    y = np.stack([x[c % fields] @ rng.normal(size=width) + rng.normal(size=images) for c in range(channels)], axis=1)
    features = spark.createDataFrame([(f, i, str(split[i]), x[f, i].tolist()) for f in range(fields) for i in range(images)], "prf_ix int, image_ix long, split string, f array<double>")
    responses = spark.createDataFrame([(i, c, float(y[i, c])) for i in range(images) for c in range(channels)], "image_ix long, voxel_ix long, y double")
    return x, split, y, features, responses


def plain_fit(x, seen, held, y, y_held, penalties, weights=(None, None)):
    """Weights, penalty and loss of one field and channel."""
    a, b = (np.concatenate([z, np.ones((len(z), 1))], axis=1) for z in (seen, held))
    best = None
    for j, l in enumerate(penalties):
        w = np.linalg.solve(a.T @ a + np.diag([l] * (a.shape[1] - 1) + [0]), a.T @ y)
        loss = float(((b @ w - y_held) ** 2).sum())
        if best is None or loss < best[2]:
            best = (w, j, loss)
    return best


@pytest.mark.parametrize("dealt", [False, True])
def test_permuted_refits_share_their_products(spark, monkeypatch, dealt):
    if dealt:  # tasks of a few images, channels and iterations
        for name, n in (("IMAGES", 16), ("RESPONSES", 8), ("MOVED_TOGETHER", 2), ("PARTIALS", 3), ("FITS", 3), ("FIELDS", 1)):
            monkeypatch.setattr(M, name, n)
    x, split, y, features, responses = made(spark)
    penalties = [0.1, 10.0]
    plan = P.permutation(features.select("split", "image_ix").distinct(), ["split"], "image_ix", 5)
    source = {(r["iter"], r.image_ix): r.source for r in plan.collect()}
    fits = M.fit_ridge(features, responses, penalties, plan=plan, block=3).collect()
    assert len(fits) == 5 * 2 * 6
    use, trn, held = split != "val", split == "trn", split == "holdout"
    for r in fits:
        z = x[r.prf_ix]
        z = (z - z[use].mean(axis=0)) / (z[use].std(axis=0) + M.EPSILON)
        moved = np.array([y[source[r["iter"], i], r.voxel_ix] for i in range(len(split))])
        w, j, loss = plain_fit(None, z[trn], z[held], moved[trn], moved[held], penalties)
        assert r.lambda_ix == j and np.allclose(r.w, w[:-1]) and r.bias == pytest.approx(w[-1]) and r.loss == pytest.approx(loss, rel=1e-6)
    # a channel without some responses does not share them
    some = responses.where("not (voxel_ix = 2 and image_ix % 7 = 0)")
    for r in M.fit_ridge(features, some, penalties, plan=plan, block=3).where("voxel_ix = 2").collect():
        z = x[r.prf_ix]
        z = (z - z[use].mean(axis=0)) / (z[use].std(axis=0) + M.EPSILON)
        ok = np.array([source[r["iter"], i] % 7 != 0 for i in range(len(split))])
        moved = np.array([y[source[r["iter"], i], 2] for i in range(len(split))])
        w, j, loss = plain_fit(None, z[trn & ok], z[held & ok], moved[trn & ok], moved[held & ok], penalties)
        assert r.lambda_ix == j and np.allclose(r.w, w[:-1]) and r.loss == pytest.approx(loss, rel=1e-6)


def test_predictions_in_small_products(spark, monkeypatch):
    for name, n in (("IMAGES", 16), ("FITS", 3)):
        monkeypatch.setattr(M, name, n)
    x, split, y, features, responses = made(spark)
    fits = M.fit_ridge(features, responses, [1.0]).persist()
    got = {(r.voxel_ix, r.prf_key, r.image_ix): r.yhat for r in M.predict(features, fits.withColumn("version", F.concat("version", F.col("prf_ix").cast("string")))).selectExpr("*", "version as prf_key").collect()}
    assert len(got) == 120 * 6 * 2
    for r in fits.collect():
        z = (x[r.prf_ix] - np.array(r["mean"])) / np.array(r.sd)
        want = z @ np.array(r.w) + r.bias
        assert np.allclose([got[r.voxel_ix, f"full{r.prf_ix}", i] for i in range(120)], want)
    assert M.predict(features.limit(0), fits).count() == 0 and M.predict(features, fits.limit(0)).count() == 0


def test_groups_of_a_refit_are_bounded(spark, monkeypatch):
    """No task gets more than IMAGES images of about RESPONSES channels and iterations."""
    for name, n in (("IMAGES", 20), ("RESPONSES", 12)):
        monkeypatch.setattr(M, name, n)
    _, _, _, features, responses = made(spark, images=200, channels=8)
    plan = P.permutation(features.select("split", "image_ix").distinct(), ["split"], "image_ix", 6)
    fits = M.fit_ridge(features, responses, [1.0], plan=plan, block=2)
    plan_text = fits._jdf.queryExecution().optimizedPlan().toString()
    cogroup = next(line for line in plan_text.splitlines() if "FlatMapCoGroupsInPandas" in line)
    assert "part" in cogroup and "chunk" in cogroup and "deal" in cogroup
    assert fits.count() == 6 * 2 * 8


def test_a_thousand_iterations(spark):
    _, _, _, features, responses = made(spark, images=60, width=3, channels=2, fields=1)
    plan = P.permutation(features.select("split", "image_ix").distinct(), ["split"], "image_ix", 1000)
    fits = M.fit_ridge(features, responses, [1.0, 10.0], plan=plan)
    r = fits.groupBy("voxel_ix").agg(F.count("*").alias("n"), F.countDistinct("iter").alias("i")).collect()
    assert sorted((x.voxel_ix, x.n, x.i) for x in r) == [(0, 1000, 1000), (1, 1000, 1000)]


def test_template_bank_against_plain_search(spark):
    bank = TE.Bank((0.3, 0.5), (0.0, 0.1, 0.3), (0.0, 30.0, 60.0, 90.0, 120.0, 150.0), 9)
    assert len(bank.linear) == 12 and len(bank.curved) == 24 and all(b for _, b, _ in bank.curved)
    rng = np.random.default_rng(8)
    images = [rng.normal(size=(h, w)) for h, w in ((14, 14), (14, 14), (10, 16), (6, 6))]
    images += [convolve(np.eye(1, 196, 105).reshape(14, 14), bent_kernel(f, b, a, 9)).real for f, b, a in (bank.linear[4], bank.curved[7], bank.curved[20])]
    df = spark.createDataFrame([(k, a.shape[1], a.ravel().tolist()) for k, a in enumerate(images)] + [(99, 4, [])], "image_ix long, w int, px array<double>")
    got = {r.image_ix: r for r in TE.template_table(df, bank, spark.createDataFrame([(5,)], "image_ix long")).collect()}
    assert sorted(got) == list(range(len(images)))

    def response(a, which):
        k = bent_kernel(*which, 9)
        if min(a.shape) >= 9:
            return np.round(np.abs(convolve(a, k / np.linalg.norm(k))).max(), TE.PLACES)
        out = np.zeros(a.shape, complex)  # a kernel larger than the image wraps around it
        for r in range(a.shape[0]):
            for c in range(a.shape[1]):
                out[r, c] = sum(k[i, j] * a[(r - i + 4) % a.shape[0], (c - j + 4) % a.shape[1]] for i in range(9) for j in range(9))
        return np.round(np.abs(out / np.linalg.norm(k)).max(), TE.PLACES)

    for n, a in enumerate(images):
        lin, cur = ([response(a, w) for w in which] for which in (bank.linear, bank.curved))
        assert (got[n].best_linear, got[n].best_curved) == (int(np.argmax(lin)), int(np.argmax(cur)))
        curved = max(cur) > max(lin) and n != 5
        assert got[n].is_curved == curved
        assert (got[n].frequency, got[n].bend, got[n].angle) == (bank.curved[np.argmax(cur)] if curved else bank.linear[np.argmax(lin)])
        assert got[n].response == pytest.approx(max(cur) if curved else max(lin), abs=1e-8)
    assert got[4].best_linear == 4 and not got[5].is_curved


def test_a_job_that_was_killed_goes_on(spark, tmp_path, monkeypatch):
    from voxelframe.sources import jobs as J

    _, _, _, features, responses = made(spark, images=40, width=2, channels=2, fields=1)
    features, responses = features.coalesce(1).persist(), responses.coalesce(1).persist()
    options = {"permutations": 3, "bootstraps": 1, "together": 2, "keep_residuals": True}
    whole = J.fit_job(features, responses, [1.0, 10.0], str(tmp_path / "whole"), **options)
    assert len(whole.finished()) == 1 + 1 + 1 + 2 + 1
    made_parts = []
    kept = J.Run.part

    def dying(self, stage, block, make):
        def counted():
            made_parts.append((stage, block))
            if len(made_parts) == 4:
                raise RuntimeError("killed")
            return make()

        return kept(self, stage, block, counted)

    monkeypatch.setattr(J.Run, "part", dying)
    with pytest.raises(RuntimeError, match="killed"):
        J.fit_job(features, responses, [1.0, 10.0], str(tmp_path / "again"), **options)
    first = made_parts[:3]
    again = J.fit_job(features, responses, [1.0, 10.0], str(tmp_path / "again"), **options)
    assert again.finished() == whole.finished()
    assert not set(made_parts[4:]) & set(first) and len(made_parts) == 4 + 6 - 3  # only what was absent
    for stage in J.STAGES:
        a, b = (sorted((tuple(round(v, 6) if isinstance(v, float) else str(v)[:60] for v in r) for r in run.table(stage).drop("w", "mean", "sd").collect()), key=str) for run in (whole, again))
        assert a == b and a
    assert not [p for p in (tmp_path / "again").iterdir() if p.name.startswith("_draft")]
    with pytest.raises(ValueError, match="other settings"):
        J.fit_job(features, responses, [2.0], str(tmp_path / "again"), **options)
    # slices draw what one run of all iterations draws
    fields = whole.table("fits").select("voxel_ix", "prf_ix")
    _, scores = M.refit(features, responses, [1.0, 10.0], fields, 3)
    want = {(r.voxel_ix, r["iter"]): r.cc for r in scores.collect()}
    got = {(r.voxel_ix, r["iter"]): r.cc for r in whole.table("permutation").collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    p = {r.voxel_ix: r.p for r in J.permutation_p(whole).collect()}
    cc = {r.voxel_ix: r.cc for r in whole.table("validation").collect()}
    assert p == {v: pytest.approx((sum(got[v, i] >= cc[v] for i in range(3)) + 1) / 4) for v in range(2)}


def test_types_name_sets():
    from voxelframe.sources.features import FeatureSet, FeatureSets

    sets = FeatureSets(*[FeatureSet(n, n) for n in ("net-1", "net-2", "edges")])
    assert sets.named("edges, net*") == ["edges", "net-1", "net-2"] and sets.named("net-2,net*,net-2") == ["net-2", "net-1"] and sets.named("") == []
    with pytest.raises(ValueError, match="no feature set is named gone"):
        sets.named("edges,gone")
