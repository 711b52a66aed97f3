"""Linear encoding models.

Design matrices are one row of features an image and field (array<double>).
Ridge fits come from sums: features and responses of the same images meet once,
in groups of images and fields, which give partial sums of products; only these
(features x features, features x channels) are added up by field and block of
channels. No response is copied for each field. Losses of held-out images come
from their own sums. Permutations and bootstraps refit from the same sums over
moved or weighted rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import same_keys

EPSILON = 1e-6
#: Images and fields whose products are formed in one task, and partial sums added up in one step.
IMAGES, FIELDS, PARTIALS = 512, 64, 64
#: Channels times iterations in one such task, fits applied in one, and iterations that are solved together.
RESPONSES, FITS, MOVED_TOGETHER, DRAWN_TOGETHER = 8192, 1024, 16, 4
#: Pairs of a deal and a chunk that may be sent to every task.
MOST_DEALS = 1_000_000
#: Mark of products that all iterations share.
SHARED = -1
#: Means and deviations that may be sent to every task: fields x features.
MOST_MOMENTS = 4_000_000


def feature_moments(features: DataFrame) -> DataFrame:
    """(prf_ix, n, mean, sd) of each field's features: population deviation plus EPSILON; means and squares about them are merged, so precision is kept."""

    def partial(batches):
        for pdf in batches:
            for field, rows in pdf.groupby("prf_ix"):
                x = np.array(rows.f.tolist(), float)
                m = x.mean(axis=0)
                yield pd.DataFrame({"prf_ix": [field], "n": [len(x)], "mean": [m], "sd": [((x - m) ** 2).sum(axis=0)]})

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        n = pdf.n.to_numpy(float)
        m, q = np.stack(pdf["mean"]), np.stack(pdf["sd"])
        mean = (n[:, None] * m).sum(axis=0) / n.sum()
        var = (q.sum(axis=0) + (n[:, None] * (m - mean) ** 2).sum(axis=0)) / n.sum()
        return pd.DataFrame({"prf_ix": pdf.prf_ix[:1], "n": [int(n.sum())], "mean": [mean], "sd": [np.sqrt(var) + EPSILON]})

    schema = "prf_ix int, n long, mean array<double>, sd array<double>"
    return features.select("prf_ix", "f").mapInPandas(partial, schema).groupBy("prf_ix").applyInPandas(merge, schema)


def ridge_weights(gram: np.ndarray, products: np.ndarray, penalty: np.ndarray) -> np.ndarray:
    """(X'X + diag(penalty))^-1 X'Y; a singular system gets 1e-8 on its diagonal."""
    a = gram + np.diag(penalty)
    try:
        return np.linalg.solve(a, products)
    except np.linalg.LinAlgError:
        return np.linalg.solve(a + 1e-8 * np.eye(len(a)), products)


def _penalty_vectors(penalties, width: int) -> np.ndarray:
    """Penalties of each column and the bias: a scalar stands for all columns and no penalty of the bias."""
    if np.ndim(penalties) == 2:
        return np.asarray(penalties, float)
    return np.concatenate([np.repeat(np.asarray(penalties, float)[:, None], width, axis=1), np.zeros((len(penalties), 1))], axis=1)


FIT = "prf_ix int, voxel_ix long, version string, lambda_ix int, loss double, bias double, w array<double>, mean array<double>, sd array<double>"
_SUMS = "prf_ix int, iter int, shared int, block long, part int, holdout boolean, gram array<double>, products array<double>, squares array<double>"
_SUM_COLUMNS = [c.split()[0] for c in _SUMS.split(", ")]


def fit_ridge(features: DataFrame, responses: DataFrame, penalties, masks: dict[str, list[int]] | None = None, block: int = 256, plan: DataFrame | None = None, with_features: bool = False, fields: DataFrame | None = None) -> DataFrame:
    """All (field, channel, version[, iter]) fits of features(prf_ix, image_ix, split, f) to responses(image_ix, voxel_ix, y).

    Least holdout loss over penalties (numbers, or rows of one for each column
    and the bias, see group_penalties), the first on ties. Features are
    standardised over train and holdout together; a bias is added. Images
    without a response of a channel are left out for that channel; channels
    without train or holdout images have no row.

    plan(iter, image_ix, source) refits for each iteration: responses move from
    source to image_ix (a permutation), or with_features whole rows are drawn
    from source (a bootstrap). fields(voxel_ix, prf_ix) restricts each channel
    to its field.

    A task holds IMAGES images of FIELDS fields with the responses of about
    RESPONSES channels and iterations. A permutation of channels that answer to
    all images leaves the features' products alone: they are formed once, and
    all iterations of a slice are solved as one system.
    """
    chosen = {k: list(v) for k, v in (masks or {}).items()}
    feats = features.where("split in ('trn', 'holdout')").select("prf_ix", "image_ix", (F.col("split") == "holdout").alias("holdout"), "f")
    found = feature_moments(feats).collect()
    if sum(len(r["mean"]) for r in found) > MOST_MOMENTS:
        raise ValueError("fit fewer fields or features at once")
    moments = {r.prf_ix: (np.array(r["mean"]), np.array(r["sd"])) for r in found}
    parts = max(1, max((r.n for r in found), default=0) // IMAGES)
    iterations = [0] if plan is None else sorted(r[0] for r in plan.select("iter").distinct().collect())
    together = 1 if plan is None else DRAWN_TOGETHER if with_features else MOVED_TOGETHER

    real = responses.where("y is not null")
    images = plan.select(F.col("source").alias("image_ix")).distinct() if plan is not None else None
    if images is not None:
        real = real.join(images, "image_ix", "left_semi")
    # channels of a block have the same images
    channels = real.groupBy("voxel_ix").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("image_ix")).alias("h"))
    channels = channels.withColumn("prf", F.lit(None).cast("int")) if fields is None else channels.join(fields.select("voxel_ix", F.col("prf_ix").alias("prf")), "voxel_ix")
    every = images.count() if plan is not None and not with_features else -1
    channels = channels.select("voxel_ix", "prf", (F.col("n") == every).alias("complete"), F.xxhash64("n", "h", F.floor(F.col("voxel_ix") / block), F.coalesce("prf", F.lit(-1))).alias("block"))
    y = real.join(channels, "voxel_ix").groupBy("block", "prf", "complete", "image_ix").agg(F.transform(F.sort_array(F.collect_list(F.struct("voxel_ix", "y"))), lambda s: s["y"]).alias("ys"))
    kept = ["block", "prf", "complete"]
    if plan is None:
        y = y.select(*kept, F.lit(0).alias("iter"), "image_ix", F.lit(1.0).alias("times"), "ys")
    elif with_features:
        times = plan.groupBy("iter", F.col("source").alias("image_ix")).agg(F.count("*").cast("double").alias("times"))
        y = y.join(times, "image_ix").select(*kept, "iter", "image_ix", "times", "ys")
    else:
        moved = plan.select("iter", F.col("image_ix").alias("to"), F.col("source").alias("image_ix"))
        y = y.join(moved, "image_ix").select(*kept, "iter", F.col("to").alias("image_ix"), F.lit(1.0).alias("times"), "ys")
    part, chunk = F.pmod(F.xxhash64("image_ix"), F.lit(parts)).cast("int").alias("part"), F.floor(F.col("prf_ix") / FIELDS).alias("chunk")
    chunks = sorted({k // FIELDS for k in moments})
    deals = max(1, -(-channels.count() * len(iterations) // RESPONSES))
    deal = F.pmod(F.xxhash64("block", "iter"), F.lit(deals)).cast("int").alias("deal")
    of_block = (F.array(*[F.lit(c) for c in chunks]) if fields is None else F.array(F.floor(F.col("prf") / FIELDS))).cast("array<long>")
    y = y.select("*", part, deal, F.explode(of_block).alias("chunk"))
    # features go where a block of theirs is dealt
    wanted = channels.select("block", "prf").distinct().select("block", "prf", F.explode(F.array(*[F.lit(i) for i in iterations])).alias("iter")).select(deal, F.explode(of_block).alias("chunk")).distinct()
    first = iterations[0] if iterations else 0

    def partial(fx: pd.DataFrame, fy: pd.DataFrame) -> pd.DataFrame:
        of_field, rows = {}, []
        for field, x in fx.groupby("prf_ix"):
            x = x.sort_values("image_ix")
            m, sd = moments[field]
            z = (np.array(x.f.tolist(), float).reshape(len(x), -1) - m) / sd
            of_field[field] = x.image_ix.to_numpy(), np.concatenate([z, np.ones((len(z), 1))], axis=1), x.holdout.to_numpy(bool)
        for (number, name), mine in fy.groupby(["iter", "block"]):
            data, times, at = np.array(mine.ys.tolist(), float), mine.times.to_numpy(float), mine.image_ix.to_numpy()
            only, complete = mine.prf.iloc[0], bool(mine.complete.iloc[0])
            for field in of_field if pd.isna(only) else [int(only)] if int(only) in of_field else []:
                ids, z, holdout = of_field[field]
                k = np.minimum(np.searchsorted(ids, at), len(ids) - 1)
                ok = ids[k] == at
                for held in (False, True):
                    on = ok & (holdout[k] == held)
                    if on.any():
                        zw, yy = z[k[on]] * times[on][:, None], data[on]
                        gram = (zw.T @ z[k[on]]).ravel() if not complete or number == first else []
                        rows.append((field, number, SHARED if complete else number, name, mine.part.iloc[0], held, gram, (zw.T @ yy).ravel(), (times[on][:, None] * yy**2).sum(axis=0)))
        return pd.DataFrame(rows, columns=_SUM_COLUMNS)

    def reduce_(pdf: pd.DataFrame) -> pd.DataFrame:
        head = [pdf[c].iloc[0] for c in _SUM_COLUMNS[:5]]
        return pd.DataFrame([(*head, held, *(_added(rows, c) for c in _SUM_COLUMNS[6:])) for held, rows in pdf.groupby("holdout")], columns=_SUM_COLUMNS)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, field, names = [], int(pdf.prf_ix.iloc[0]), list(pdf.voxels.iloc[0])
        m, sd = moments[field]
        vectors, width = _penalty_vectors(penalties, len(m)), len(m) + 1
        for _, same in pdf.groupby("shared"):
            grams = {held: _added(g, "gram").reshape(width, width) for held, g in same[same.gram.map(len) > 0].groupby("holdout")}
            sums = {key: (_added(r, "products").reshape(width, -1), _added(r, "squares")) for key, r in same[same.products.map(len) > 0].groupby(["iter", "holdout"])}
            numbers = [i for i in sorted({i for i, _ in sums}) if (i, False) in sums and (i, True) in sums]
            if len(grams) < 2 or not numbers:
                continue
            xy, xy_out = (np.stack([sums[i, held][0] for i in numbers], axis=1).reshape(width, -1) for held in (False, True))
            yy_out = np.concatenate([sums[i, True][1] for i in numbers])
            for version, used in (chosen or {"full": range(len(m))}).items():
                at = [*used, len(m)]
                square = np.ix_(at, at)
                w = np.stack([ridge_weights(grams[False][square], xy[at], v[at]) for v in vectors])  # penalties x columns x (iterations and channels)
                loss = yy_out - 2 * (w * xy_out[at]).sum(axis=1) + (w * (grams[True][square] @ w)).sum(axis=1)
                best = loss.argmin(axis=0)
                for c, (number, voxel) in enumerate((i, v) for i in numbers for v in names):
                    full = np.zeros(len(m))
                    full[at[:-1]] = w[best[c], :-1, c]
                    rows.append((field, voxel, version, int(number), int(best[c]), max(float(loss[best[c], c]), 0.0), float(w[best[c], -1, c]), full, m, sd))
        return pd.DataFrame(rows, columns=["prf_ix", "voxel_ix", "version", "iter", "lambda_ix", "loss", "bias", "w", "mean", "sd"])

    dealt = feats.select("*", part, chunk).join(F.broadcast(wanted) if deals * len(chunks) <= MOST_DEALS else wanted, "chunk")
    sums = dealt.groupBy("part", "chunk", "deal").cogroup(y.groupBy("part", "chunk", "deal")).applyInPandas(partial, _SUMS)
    while parts > PARTIALS:
        sums = sums.withColumn("part", F.floor(F.col("part") / PARTIALS).cast("int")).groupBy("prf_ix", "iter", "block", "part").applyInPandas(reduce_, _SUMS)
        parts = -(-parts // PARTIALS)
    slices = sorted({i // together for i in iterations})
    empty = F.array().cast("array<double>")
    own = F.floor(F.col("iter") / together).cast("int")
    products = sums.select(*[c if c != "gram" else empty.alias("gram") for c in _SUM_COLUMNS], own.alias("slice"))
    in_slices = F.when(F.col("shared") == SHARED, F.array(*[F.lit(i) for i in slices])).otherwise(F.array(own))
    grams = sums.where(F.size("gram") > 0).select(*[c if c not in ("products", "squares") else empty.alias(c) for c in _SUM_COLUMNS], F.explode(in_slices).alias("slice"))
    voxels = channels.groupBy("block").agg(F.sort_array(F.collect_list("voxel_ix")).alias("voxels"))
    out = products.union(grams).join(voxels, "block").groupBy("prf_ix", "block", "slice").applyInPandas(solve, FIT.replace("version string,", "version string, iter int,"))
    return out if plan is not None else out.drop("iter")


def _added(rows: pd.DataFrame, column: str) -> np.ndarray:
    return np.sum([np.asarray(v, float) for v in rows[column]], axis=0)


def best_field(fits: DataFrame) -> DataFrame:
    """Each channel's field of least full-model loss (the first on ties), and all versions of that field."""
    full = fits.where("version = 'full'").groupBy("voxel_ix").agg(F.min(F.struct("loss", "prf_ix", "lambda_ix")).alias("s")).select("voxel_ix", F.col("s.prf_ix").alias("prf_ix"))
    return fits.join(full, ["voxel_ix", "prf_ix"])


def predict(features: DataFrame, fits: DataFrame) -> DataFrame:
    """(voxel_ix, version[, iter], image_ix, yhat): the fits applied to features(prf_ix, image_ix, f).

    About IMAGES images meet about FITS fits of their field in a task, as one
    product of matrices.
    """
    images, models = (df.groupBy("prf_ix").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0] for df in (features, fits))
    parts, deals = max(1, -(-images // IMAGES)), max(1, -(-models // FITS))
    named = ["voxel_ix", "version", *_iter(fits)]
    part = F.pmod(F.xxhash64("image_ix"), F.lit(parts)).cast("int")
    deal = F.pmod(F.xxhash64(*named), F.lit(deals)).cast("int")
    x = features.select("prf_ix", "image_ix", "f", part.alias("part"), F.explode(F.sequence(F.lit(0), F.lit(deals - 1))).alias("deal"))
    w = fits.select("prf_ix", *named, "bias", "w", "mean", "sd", deal.alias("deal"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))

    def apply(fx: pd.DataFrame, fw: pd.DataFrame) -> pd.DataFrame:
        if not len(fx) or not len(fw):
            return pd.DataFrame([], columns=[*named, "image_ix", "yhat"])
        weights = np.array(fw.w.tolist(), float) / np.array(fw.sd.tolist(), float)
        base = fw.bias.to_numpy(float) - (weights * np.array(fw["mean"].tolist(), float)).sum(axis=1)
        yhat = weights @ np.array(fx.f.tolist(), float).T + base[:, None]
        return pd.DataFrame({**{c: np.repeat(fw[c].to_numpy(), len(fx)) for c in named}, "image_ix": np.tile(fx.image_ix.to_numpy(), len(fw)), "yhat": yhat.ravel()})

    types = dict(fits.dtypes)
    schema = ", ".join([*(f"{c} {types[c]}" for c in named), f"image_ix {dict(features.dtypes)['image_ix']}", "yhat double"])
    keys = ["prf_ix", "part", "deal"]
    return x.groupBy(*keys).cogroup(w.groupBy(*keys)).applyInPandas(apply, schema)


def _iter(df: DataFrame) -> list[str]:
    return ["iter"] if "iter" in df.columns else []


def validate(predicted: DataFrame, responses: DataFrame) -> DataFrame:
    """(voxel_ix, version[, iter], n, cc, r2) of predictions against responses."""
    from ..functions.stats import corr, r2

    both = predicted.join(responses, ["voxel_ix", "image_ix"])
    return both.groupBy("voxel_ix", "version", *_iter(predicted)).agg(F.count("*").alias("n"), corr(F.col("y"), F.col("yhat")).alias("cc"), r2(F.col("y"), F.col("yhat")).alias("r2"))


def resampled(predicted: DataFrame, responses: DataFrame, plan: DataFrame, both_sides: bool = False) -> DataFrame:
    """cc and r2 for each iteration of plan(iter, image_ix, source).

    A permutation moves the responses only; a bootstrap (both_sides) draws
    predictions and responses together. Predictions of refits meet the plan of
    their own iteration.
    """
    from ..functions.stats import corr, r2

    moved = responses.select("voxel_ix", F.col("image_ix").alias("source"), "y").join(plan, "source")
    on = F.col("source") if both_sides else F.col("image_ix")
    both = predicted.join(moved.select("voxel_ix", "iter", on.alias("image_ix"), "y"), ["voxel_ix", "image_ix", *_iter(predicted)])
    return both.groupBy("voxel_ix", "version", "iter").agg(corr(F.col("y"), F.col("yhat")).alias("cc"), r2(F.col("y"), F.col("yhat")).alias("r2"))


def refit(features: DataFrame, responses: DataFrame, penalties, fields: DataFrame, iterations: int, masks: dict[str, list[int]] | None = None, bootstrap: bool = False, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(fits, scores) of iterations of a permutation or bootstrap of all splits, each channel at its field of fields(voxel_ix, prf_ix).

    Rows are permuted or drawn within a split. scores has cc and r2 of each
    iteration's fit on its own permuted or drawn val images.
    """
    from . import sampling as P

    images = features.select("split", "image_ix").distinct()
    plan = (P.bootstrap if bootstrap else P.permutation)(images, ["split"], "image_ix", iterations, seed)
    fits = fit_ridge(features, responses, penalties, masks, plan=plan, with_features=bootstrap, fields=fields)
    predicted = predict(features.where("split = 'val'"), fits)
    return fits, resampled(predicted, responses, plan.where("split = 'val'").drop("split"), both_sides=bootstrap)


def residuals(predicted: DataFrame, responses: DataFrame) -> DataFrame:
    """y - yhat as float, for each channel, version and image."""
    return predicted.join(responses, ["voxel_ix", "image_ix"]).select("voxel_ix", "version", "image_ix", (F.col("y") - F.col("yhat")).cast("float").alias("residual"))


def partial_versions(groups: dict[str, list[int]]) -> dict[str, list[int]]:
    """Column masks for variance partition: full, just_* and (with over two groups) leave_out_*."""
    everything = sorted(c for cols in groups.values() for c in cols)
    out = {"full": everything}
    if len(groups) > 1:
        out |= {f"just_{name}": sorted(cols) for name, cols in groups.items()}
    if len(groups) > 2:
        out |= {f"leave_out_{name}": [c for c in everything if c not in set(cols)] for name, cols in groups.items()}
    return out


def group_penalties(values: list[float], groups: list[int]) -> np.ndarray:
    """Penalty vectors: every choice of a value for each feature group, spread to its columns, and 0 for the bias."""
    n = max(groups) + 1 if groups else 0
    combos = np.array(np.meshgrid(*[values] * n, indexing="ij")).reshape(n, -1).T if n else np.zeros((1, 0))
    spread = np.concatenate([combos[:, groups], np.zeros((len(combos), 1))], axis=1)
    return np.unique(spread, axis=0)


def partial_correlations(df: DataFrame, by: list[str], x: str, y: str, covariates: list[str]) -> DataFrame:
    """(by, n, r, p) of x and y after both are freed of the covariates and an intercept.

    The Gram matrix of the columns is summed in SQL; only its few sums reach
    the solver, so a group may be of any size. p is two-sided, from t.
    """
    cols = [x, y, *covariates]
    ok = df.where(" and ".join(f"{c} is not null" for c in cols))
    sums = [F.sum(F.col(a) * F.col(b)).alias(f"s_{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if i <= j]
    sums += [F.sum(c).alias(f"m_{i}") for i, c in enumerate(cols)]
    rows = ok.groupBy(*by).agg(F.count("*").alias("n"), *sums)
    k = len(cols)

    def solve(batches):
        for pdf in batches:
            r, p = [], []
            for row in pdf.to_dict("records"):
                n = row["n"]
                mean = np.array([row[f"m_{i}"] / n for i in range(k)])
                g = np.array([[row[f"s_{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) / n - np.outer(mean, mean)
                c = g[2:, 2:]
                rest = g[:2, :2] - g[:2, 2:] @ np.linalg.pinv(c) @ g[2:, :2] if k > 2 else g[:2, :2]
                scale = np.sqrt(max(rest[0, 0], 0) * max(rest[1, 1], 0))
                tiny = rest[0, 0] <= 1e-12 * max(g[0, 0], 1e-300) or rest[1, 1] <= 1e-12 * max(g[1, 1], 1e-300)
                value = None if tiny or scale == 0 else float(np.clip(rest[0, 1] / scale, -1, 1))
                r.append(value)
                p.append(None if value is None else two_sided_p(value, n - 2))
            yield pd.DataFrame({**{b: pdf[b] for b in by}, "n": pdf.n, "r": pd.array(r, dtype="Float64"), "p": pd.array(p, dtype="Float64")})

    types = dict(df.dtypes)
    return rows.mapInPandas(solve, ", ".join([*(f"{b} {types[b]}" for b in by), "n long, r double, p double"]))


def two_sided_p(r: float, dof: int) -> float | None:
    """p of a correlation with dof degrees of freedom (incomplete beta by continued fraction)."""
    if dof <= 0:
        return None
    if abs(r) >= 1:
        return 0.0
    return _beta_share(dof / 2, 0.5, 1 - r * r)


def _beta_share(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function (Lentz's method)."""
    from math import exp, lgamma, log

    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x))
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_share(b, a, 1 - x)
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + num * d or 1e-300), 1 + num / c or 1e-300
            h *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * h / a


def _keys(values) -> pd.Series:
    """Group keys as plain objects with None for null, whatever pandas has made of them."""
    values = pd.Series(list(values), dtype=object)
    return values.where(values.notna(), None)


def scatter(df: DataFrame, by: list[str], vector: str) -> DataFrame:
    """(by, n, mean, squares) of vectors: squares is the flat matrix of products about the mean. Partial sums are merged, so no task holds a group."""
    types = dict(df.dtypes)
    schema = ", ".join([*(f"{b} {types[b]}" for b in by), "n long, mean array<double>, squares array<double>"])

    def partial(batches):
        for pdf in batches:
            for key, rows in pdf.groupby(by, dropna=False) if by else [((), pdf)]:
                x = np.array(rows[vector].tolist(), float)
                m = x.mean(axis=0)
                yield pd.DataFrame({**{b: _keys([k]) for b, k in zip(by, key, strict=True)}, "n": [len(x)], "mean": [m], "squares": [((x - m).T @ (x - m)).ravel()]})

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        n, m = pdf.n.to_numpy(float), np.stack(pdf["mean"])
        mean = (n[:, None] * m).sum(axis=0) / n.sum()
        squares = np.sum(list(pdf.squares), axis=0) + ((m - mean).T @ (n[:, None] * (m - mean))).ravel()
        return pd.DataFrame({**{b: _keys(pdf[b][:1]) for b in by}, "n": [int(n.sum())], "mean": [mean], "squares": [squares]})

    parts = df.select(*by, vector).where(F.col(vector).isNotNull()).mapInPandas(partial, schema)
    salted = schema + ", salt int"  # many partial sums of a group are merged in two steps
    first = parts.withColumn("salt", (F.rand(1) * 32).cast("int")).groupBy(*by, "salt").applyInPandas(lambda pdf: merge(pdf).assign(salt=pdf.salt.iloc[0]), salted)
    return first.drop("salt").groupBy(*by).applyInPandas(merge, schema)


def fit_pca(df: DataFrame, by: list[str], vector: str, min_pct: float = 95.0, max_pc: int = 100) -> DataFrame:
    """(by, n, mean, weights, pct, n_comp): components by group, as a table to be stored.

    weights holds max_pc components one after the other, pct their percent of
    the retained variance, n_comp the number that reaches over min_pct. The
    sign makes each component's largest weight positive.
    """
    types = dict(df.dtypes)

    def one(batches):
        for pdf in batches:
            out = []
            for n, mean, squares in zip(pdf.n, pdf["mean"], pdf.squares, strict=True):
                weights, pct = principal(np.asarray(squares).reshape(len(mean), -1), int(n), max_pc)
                out.append((weights.ravel(), pct, count_components(pct, min_pct)))
            head = {b: _keys(pdf[b]) for b in by}
            yield pd.DataFrame({**head, "n": pdf.n.to_numpy(), "mean": list(pdf["mean"])}).assign(weights=[o[0] for o in out], pct=[o[1] for o in out], n_comp=[o[2] for o in out])

    schema = ", ".join([*(f"{b} {types[b]}" for b in by), "n long, mean array<double>, weights array<double>, pct array<double>, n_comp int"])
    return scatter(df, by, vector).mapInPandas(one, schema)


def column_groups(df: DataFrame, keys: list[str], vector: str, groups: dict[str, list[int]]) -> DataFrame:
    """(keys, group, v): each row once for each group of columns, for decompositions by group."""
    parts = [F.struct(F.lit(name).alias("group"), F.array(*[F.get(vector, F.lit(c)) for c in cols]).alias("v")) for name, cols in groups.items()]
    return df.select(*keys, F.explode(F.array(*parts)).alias("__g")).select(*keys, "__g.*")


def count_components(pct: np.ndarray, min_pct: float) -> int:
    """Components until their percents add up to over min_pct."""
    return min(int(np.searchsorted(np.cumsum(pct), min_pct, "right")) + 1, len(pct))


#: Parts that a group's rows are dealt to when stored components are applied.
APPLY_PARTS = 8


def apply_pca(df: DataFrame, by: list[str], key: str, vector: str, components: DataFrame) -> DataFrame:
    """(by, key, scores): rows under the stored components of their group; groups without components have no row.

    Each part of a group meets its components once, ahead of its rows, so the
    weights are not copied to every row.
    """
    types = dict(df.dtypes)
    salt = F.pmod(F.xxhash64(key), F.lit(APPLY_PARTS)).cast("int").alias("salt")
    none = lambda kind: F.lit(None).cast(kind)
    head = components.select(*by, F.explode(F.sequence(F.lit(0), F.lit(APPLY_PARTS - 1))).alias("salt"), F.lit(0).alias("row"), none(types[key]).alias("key"), F.col("mean").alias("v"), "weights", "n_comp")
    rows = df.select(*by, salt, F.lit(1).alias("row"), F.col(key).alias("key"), F.transform(vector, lambda x: x.cast("double")).alias("v"), none("array<double>").alias("weights"), none("int").alias("n_comp"))
    dealt = head.union(rows).repartition(*by, "salt").sortWithinPartitions(*by, "salt", "row")
    group = [*by, "salt"]

    def run(batches):
        held = None
        for pdf in batches:
            new, names = (pdf.row == 0).to_numpy(), list(zip(*(_keys(pdf[c]) for c in group), strict=True))
            starts = np.array([k == 0 or names[k] != names[k - 1] for k in range(len(pdf))], bool)
            for part in np.split(np.arange(len(pdf)), np.flatnonzero(new | starts)[np.flatnonzero(new | starts) > 0]):
                if not len(part):
                    continue
                first, at = pdf.iloc[part[0]], part
                if new[part[0]]:
                    mean = np.asarray(first.v, float)
                    held = names[at[0]], mean, np.asarray(first.weights, float).reshape(-1, len(mean))[: int(first.n_comp)]
                    part = part[1:]
                if len(part) and held is not None and held[0] == names[part[0]]:
                    x = np.array(pdf.v.iloc[part].tolist(), float)
                    head = {c: _keys([v] * len(part)) for c, v in zip(by, held[0][:-1], strict=True)}
                    yield pd.DataFrame({**head, key: list(pdf.key.iloc[part]), "scores": list((x - held[1]) @ held[2].T)})

    return dealt.mapInPandas(run, ", ".join(f"{c} {types[c]}" for c in [*by, key]) + ", scores array<double>")


def pca(df: DataFrame, by: list[str], key: str, vector: str, train: Column | None = None, min_pct: float = 95.0, max_pc: int = 100, zscore: bool = False) -> DataFrame:
    """Scores by group: (by, key, scores), components until over min_pct of the retained ones' variance.

    Fitted on train rows (all without train); groups without any have no row.
    With zscore, train rows and the others are standardised apart.
    """
    rows = df.select(*by, key, F.transform(vector, lambda x: x.cast("double")).alias("__v"), (F.lit(True) if train is None else F.coalesce(train, F.lit(False))).alias("__seen"))
    if zscore:
        width = F.size("mean")
        stats = scatter(rows, [*by, "__seen"], "__v")
        sd = F.transform(F.sequence(F.lit(0), width - 1), lambda k: F.sqrt(F.get("squares", k * width + k) / F.col("n")))
        stats = stats.select(*by, "__seen", "mean", sd.alias("sd"))
        z = F.zip_with(F.zip_with("__v", "mean", lambda v, m: v - m), "sd", lambda v, s: v / F.when(s > 0, s).otherwise(1.0))
        rows = rows.join(stats, [*by, "__seen"]).select(*by, key, z.alias("__v"), "__seen")
    return apply_pca(rows, by, key, "__v", fit_pca(rows.where("__seen"), by, "__v", min_pct, max_pc))


def principal(squares: np.ndarray, n: int, max_pc: int) -> tuple[np.ndarray, np.ndarray]:
    """(weights by component, percent of the retained variance) from the products about the mean of n rows."""
    values, vectors = np.linalg.eigh(squares)
    kept = min(max_pc, n, len(values))
    values, vt = np.maximum(values[::-1][:kept], 0), vectors[:, ::-1].T[:kept]
    vt = vt * np.where(vt[np.arange(kept), np.abs(vt).argmax(axis=1)] < 0, -1, 1)[:, None]
    return vt, 100 * values / max(values.sum(), 1e-300)


def decode(df: DataFrame, by: list[str], key: str, vector: str, label: str, k: int = 10) -> DataFrame:
    """(by, n, accuracy, dprime) of k-fold discriminant analysis, see discriminant.decode."""
    from .discriminant import decode

    return decode(df, by, key, vector, label, k)


def dprime_of(predicted: np.ndarray, actual: np.ndarray, times: np.ndarray | None = None) -> float | None:
    """Mean over classes of z(hits) - z(false alarms), with rates kept off 0 and 1; pairs may come with their counts."""
    from statistics import NormalDist

    times = np.ones(len(actual)) if times is None else np.asarray(times, float)
    classes, n, z = np.unique(actual), times.sum(), NormalDist().inv_cdf
    if not np.isin(predicted, classes).all() or len(classes) < 2:
        return None
    clip = lambda p: min(max(p, 1 / (2 * n)), 1 - 1 / (2 * n)) if p in (0.0, 1.0) else p
    rate = lambda c, of: clip(float(times[of & (predicted == c)].sum() / times[of].sum()))
    return float(np.mean([z(rate(c, actual == c)) - z(rate(c, actual != c)) for c in classes]))


def feature_residuals(df: DataFrame, by: list[str], key: str, targets: str, sources: str, train: Column) -> DataFrame:
    """(by, key, residual): targets less their least-squares prediction from sources and a bias, fitted on train rows.

    The fit comes from merged sums of products; groups without train rows have no row.
    """
    types = dict(df.dtypes)
    double = lambda c: F.transform(c, lambda v: v.cast("double"))
    rows = df.select(*by, key, double(targets).alias("__t"), double(sources).alias("__s"), F.coalesce(train, F.lit(False)).alias("__seen"))
    seen = rows.where("__seen")
    sums = scatter(seen.select(*by, F.concat("__s", "__t").alias("__v")), by, "__v")
    widths = seen.groupBy(*by).agg(F.max(F.size("__s")).alias("p"))

    def solve(batches):
        for pdf in batches:
            w = []
            for p, mean, squares in zip(pdf.p, pdf["mean"], pdf.squares, strict=True):
                m = np.asarray(squares).reshape(len(mean), -1)
                w.append((np.linalg.pinv(m[:p, :p]) @ m[:p, p:]).T.ravel())  # sources of each target side by side
            yield pd.DataFrame({**{b: _keys(pdf[b]) for b in by}, "p": pdf.p.to_numpy(), "mean": list(pdf["mean"]), "w": w})

    fits = same_keys(sums, widths, by).select(*by, "p", "mean", "squares").mapInPandas(solve, ", ".join([*(f"{b} {types[b]}" for b in by), "p int, mean array<double>, w array<double>"]))
    both = same_keys(rows, fits, by)
    shifted = F.zip_with("__s", F.slice("mean", F.lit(1), F.col("p")), lambda v, m: v - m)
    predicted = lambda j: F.aggregate(F.zip_with(shifted, F.slice("w", j * F.col("p") + 1, F.col("p")), lambda v, w: v * w), F.lit(0.0), lambda acc, v: acc + v)
    return both.select(*by, key, F.transform("__t", lambda v, j: v - F.get("mean", F.col("p") + j) - predicted(j)).alias("residual"))


def simulated(features: DataFrame, noise: float, seed: int = 0) -> DataFrame:
    """(image_ix, voxel_ix, y): each chosen feature(image_ix, voxel_ix, v) plus Gaussian noise that keys and seed decide."""
    from ..functions.stats import inverse_normal
    from .sampling import MODULUS, draw

    share = (draw(F.col("image_ix") * 10_007 + F.col("voxel_ix"), seed) + 0.5) / MODULUS
    return features.select("image_ix", "voxel_ix", (F.col("v") + noise * inverse_normal(share)).alias("y"))
