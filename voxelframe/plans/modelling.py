"""Encoding models, decoding and decompositions over the driver's tables.

Iterative and matrix operators have no SQL; they are tested against numpy.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stats import r6
from ..operators import discriminant as DI
from ..operators import grids as GR
from ..operators import models as M
from ..operators import sampling as P
from ..operators import trials as TR
from ..sources import jobs as J
from ..sources import stores as ST
from ..sources.features import FeatureSets
from ..sources.shared import scratch
from .registry import query
from .statistics import t_tail


def _design(t, fields: int = 4, width: int = 16):
    """features(prf_ix, image_ix, split, f) from embeddings: field p holds entries 16p to 16p + 15."""
    e = t.embeddings.select(F.col("vec_id").alias("image_ix"), F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    e = P.split(e, [], "image_ix", F.col("image_ix") % 5 == 0)
    return e.withColumn("prf_ix", F.explode(F.sequence(F.lit(0), F.lit(fields - 1)))).select("prf_ix", "image_ix", "split", F.slice("e", F.col("prf_ix") * width + 1, F.lit(width)).alias("f"))


def _responses(t, channels: int = 12):
    """responses(image_ix, voxel_ix, y): channel c answers to a few entries."""
    e = t.embeddings.select(F.col("vec_id").alias("image_ix"), F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    v = e.withColumn("voxel_ix", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(channels - 1).cast("long"))))
    at = lambda k: F.get("e", F.pmod(F.col("voxel_ix") * 7 + k, F.lit(64)).cast("int"))
    noise = F.pmod(F.col("image_ix") * 7919 + F.col("voxel_ix") * 104729, F.lit(1009)) / 1009.0 - 0.5
    return v.select("image_ix", "voxel_ix", (2 * at(0) - at(1) + 0.5 * at(2) + 0.3 * noise).alias("y"))


_GROUPS = {"low": list(range(0, 6)), "mid": list(range(6, 11)), "high": list(range(11, 16))}


@query()
def ridge_fit(t):
    """All fields, channels and column masks."""
    fits = M.fit_ridge(_design(t), _responses(t), GR.ridge_penalties(), M.partial_versions(_GROUPS))
    return fits.select("prf_ix", "voxel_ix", "version", "lambda_ix", F.round("loss", 4).alias("loss"))


@query()
def best_field_validation(t):
    """Best field of each channel, validated on shared images, per version."""
    design = _design(t)
    best = M.best_field(M.fit_ridge(design, _responses(t), GR.ridge_penalties(), M.partial_versions(_GROUPS)))
    p = M.predict(design.where("split = 'val'"), best)
    return M.validate(p, _responses(t)).select("voxel_ix", "version", "n", F.round("cc", 4).alias("cc"), F.round("r2", 4).alias("r2"))


@query()
def shuffled_validation(t):
    """The same predictions against responses permuted among the shared images."""
    design, responses = _design(t), _responses(t)
    best = M.best_field(M.fit_ridge(design, responses, GR.ridge_penalties()))
    val = design.where("split = 'val'")
    plan = P.permutation(val.select("image_ix").distinct(), [], "image_ix", 5)
    return M.resampled(M.predict(val, best), responses, plan).select("voxel_ix", "version", "iter", F.round("cc", 4).alias("cc"))


@query()
def bootstrap_validation(t):
    """Predictions and responses resampled together."""
    design, responses = _design(t), _responses(t)
    best = M.best_field(M.fit_ridge(design, responses, GR.ridge_penalties()))
    val = design.where("split = 'val'")
    plan = P.bootstrap(val.select("image_ix").distinct(), [], "image_ix", 5)
    return M.resampled(M.predict(val, best), responses, plan, both_sides=True).select("voxel_ix", "version", "iter", F.round("r2", 4).alias("r2"))


def _draw(key, seed):
    return f"((({key}) + 1) * 48271 + (({seed}) + 1) * 69621 + (({key}) % 7919) * (({seed}) % 7907 + 1) * 31) % 1000003"


#: One feature for each of four fields, standardised over train and holdout; y of three channels.
_ONE = f"""
WITH v AS (SELECT vec_id i, vec_id % 5 = 0 AS sh FROM embeddings), k AS (SELECT *, row_number() OVER (PARTITION BY sh ORDER BY {_draw('i', 0)}, i) k, count(*) OVER (PARTITION BY sh) n FROM v),
s AS (SELECT i, CASE WHEN sh THEN 'val' WHEN k <= ceil(n * 0.1 - 1e-9) THEN 'holdout' ELSE 'trn' END AS split FROM k),
x AS (SELECT vec_id i, f.f, embedding[f.f * 16 + 1]::DOUBLE x FROM embeddings, range(4) f(f)),
m AS (SELECT f, avg(x) m, stddev_pop(x) + 1e-6 d FROM x JOIN s USING (i) WHERE split <> 'val' GROUP BY f),
z AS (SELECT i, f, split, (x - m) / d z FROM x JOIN m USING (f) JOIN s USING (i)),
y AS (SELECT vec_id i, c.c, 2 * embedding[c * 7 % 64 + 1]::DOUBLE - embedding[(c * 7 + 1) % 64 + 1]::DOUBLE + 0.5 * embedding[(c * 7 + 2) % 64 + 1]::DOUBLE + 0.3 * ((vec_id * 7919 + c * 104729) % 1009 / 1009.0 - 0.5) y FROM embeddings, range(3) c(c)),"""
_LAMBDAS = (0.0, 10.0, 1000.0)
#: From rows r(iter, f, c, split, z, y, t: times).
_SOLVED = f"""
g AS (SELECT iter, f, c, split, sum(t) n, sum(t * z) sz, sum(t * z * z) szz, sum(t * y) sy, sum(t * z * y) szy, sum(t * y * y) syy FROM r WHERE split <> 'val' GROUP BY ALL),
w AS (SELECT iter, f, c, j, ((n * szy - sz * sy) / (n * (szz + l) - sz * sz)) w, (((szz + l) * sy - sz * szy) / (n * (szz + l) - sz * sz)) b FROM g, (VALUES {", ".join(f"({j}, {v}::DOUBLE)" for j, v in enumerate(_LAMBDAS))}) p(j, l) WHERE split = 'trn'),
l AS (SELECT w.*, syy - 2 * (w * szy + b * sy) + w * w * szz + 2 * w * b * sz + b * b * n AS loss FROM w JOIN g USING (iter, f, c) WHERE split = 'holdout'),
best AS (SELECT iter, f, c, arg_min(struct_pack(j, w, b, loss), struct_pack(loss, j)) s FROM l GROUP BY ALL)
"""


def _one_feature(t):
    return _design(t).withColumn("f", F.slice("f", 1, 1)), _responses(t, 3)


def _fitted(fits, *more):
    return fits.select("prf_ix", "voxel_ix", *more, "lambda_ix", F.round(F.col("w")[0], 5).alias("w"), F.round("bias", 5).alias("bias"), F.round("loss", 3).alias("loss"))


@query(f"{_ONE} r AS (SELECT 0 AS iter, f, c, split, z, y, 1 AS t FROM z JOIN y USING (i)), {_SOLVED} SELECT f::INTEGER AS prf_ix, c AS voxel_ix, s.j::INTEGER AS lambda_ix, round(s.w, 5) + 0 AS w, round(s.b, 5) + 0 AS bias, round(s.loss, 3) + 0 AS loss FROM best")
def single_feature_fit(t):
    """Ridge with one feature and a bias, whose solution SQL can state."""
    return _fitted(M.fit_ridge(*_one_feature(t), list(_LAMBDAS)))


_TWO = _ONE[: _ONE.index("x AS (")] + f"""
x AS (SELECT vec_id i, f.f, embedding[f.f * 16 + 1]::DOUBLE a, embedding[f.f * 16 + 2]::DOUBLE b FROM embeddings, range(4) f(f)),
m AS (SELECT f, avg(a) ma, stddev_pop(a) + 1e-6 da, avg(b) mb, stddev_pop(b) + 1e-6 db FROM x JOIN s USING (i) WHERE split <> 'val' GROUP BY f),
z AS (SELECT i, f, split, (a - ma) / da a, (b - mb) / db b FROM x JOIN m USING (f) JOIN s USING (i)),
{_ONE[_ONE.index("y AS ("):]}
r AS (SELECT f, c, split, a, b, y FROM z JOIN y USING (i)),
g AS (SELECT f, c, avg(a) ma, avg(b) mb, avg(y) my, count(*) * var_pop(a) aa, count(*) * var_pop(b) bb, count(*) * covar_pop(a, b) ab, count(*) * covar_pop(a, y) ay, count(*) * covar_pop(b, y) by_ FROM r WHERE split = 'trn' GROUP BY ALL),
w AS (SELECT f, c, j, version, my, ma, mb,
  CASE version WHEN 'full' THEN ((bb + l) * ay - ab * by_) / ((aa + l) * (bb + l) - ab * ab) WHEN 'just_a' THEN ay / (aa + l) ELSE 0 END AS wa,
  CASE version WHEN 'full' THEN ((aa + l) * by_ - ab * ay) / ((aa + l) * (bb + l) - ab * ab) WHEN 'just_b' THEN by_ / (bb + l) ELSE 0 END AS wb
  FROM g, (VALUES {", ".join(f"({j}, {v}::DOUBLE)" for j, v in enumerate(_LAMBDAS))}) p(j, l), (VALUES ('full'), ('just_a'), ('just_b')) v(version)),
l AS (SELECT w.f, w.c, j, version, wa, wb, my - wa * ma - wb * mb AS bias, sum(pow(y - (my - wa * ma - wb * mb) - wa * a - wb * b, 2)) AS loss FROM w JOIN r ON r.f = w.f AND r.c = w.c AND r.split = 'holdout' GROUP BY ALL),
best AS (SELECT f, c, version, arg_min(struct_pack(j, wa, wb, bias, loss), struct_pack(loss, j)) s FROM l GROUP BY ALL)
SELECT version, f::INTEGER AS prf_ix, c AS voxel_ix, s.j::INTEGER AS lambda_ix, round(s.wa, 5) + 0 AS wa, round(s.wb, 5) + 0 AS wb, round(s.bias, 5) + 0 AS bias, round(s.loss, 3) + 0 AS loss FROM best"""


@query(_TWO)
def two_feature_fit(t):
    """Ridge with two features in all versions of a variance partition, whose solutions SQL can state."""
    features, responses = _design(t).withColumn("f", F.slice("f", 1, 2)), _responses(t, 3)
    fits = M.fit_ridge(features, responses, list(_LAMBDAS), M.partial_versions({"a": [0], "b": [1]}))
    five = lambda c: F.round(c, 5) + F.lit(0.0)
    return fits.select("version", "prf_ix", "voxel_ix", "lambda_ix", five(F.col("w")[0]).alias("wa"), five(F.col("w")[1]).alias("wb"), five("bias").alias("bias"), (F.round("loss", 3) + F.lit(0.0)).alias("loss"))


_PLAN = f"""
n AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY {_draw('i', P.PLACES)}, i) p, count(*) OVER (PARTITION BY split) n FROM s),
q AS (SELECT a.split, a.iter, a.i AS source, a.p FROM (SELECT split, i, o.iter, row_number() OVER (PARTITION BY split, o.iter ORDER BY {_draw('i', 'o.iter')}, i) p FROM s, range(3) o(iter)) a),
perm AS (SELECT n.split, q.iter, n.i, q.source FROM n JOIN q ON n.split = q.split AND n.p = q.p),
boot AS (SELECT d.split, d.iter, d.i, b.i AS source FROM (SELECT n.*, o.iter, ({_draw('(p - 1) * 31 + 7', 'o.iter')}) % n AS s FROM n, range(3) o(iter)) d JOIN n b ON b.split = d.split AND b.p - 1 = d.s),
best_field AS (SELECT c, c % 4 AS f FROM range(3) x(c)),"""
_MOVED = "SELECT iter, z.f, c, z.split, z, y.y, 1 AS t FROM perm JOIN z ON z.i = perm.i JOIN y ON y.i = perm.source JOIN best_field USING (c, f)"
_DRAWN = "SELECT iter, z.f, c, z.split, z, y.y, 1 AS t FROM boot JOIN z ON z.i = boot.source JOIN y ON y.i = boot.source JOIN best_field USING (c, f)"
_SCORED = "SELECT c AS voxel_ix, iter::INTEGER AS iter, round(covar_pop(y, s.b + s.w * z) / nullif(sqrt(var_pop(y) * var_pop(s.b + s.w * z)), 0), 5) + 0 AS cc, round(1 - sum(pow(s.b + s.w * z - y, 2)) / (var_pop(y) * count(*)), 5) + 0 AS r2 FROM r JOIN best USING (iter, f, c) WHERE split = 'val' GROUP BY ALL"


def _refitted(t, bootstrap):
    features, responses = _one_feature(t)
    fields = t.spark.range(3).select(F.col("id").alias("voxel_ix"), (F.col("id") % 4).cast("int").alias("prf_ix"))
    return M.refit(features, responses, list(_LAMBDAS), fields, 3, bootstrap=bootstrap)


for _name, _rows, _boot in (("permutation_refit", _MOVED, False), ("bootstrap_refit", _DRAWN, True)):

    def _fits(t, boot=_boot):
        return _fitted(_refitted(t, boot)[0], "iter")

    def _scores(t, boot=_boot):
        five = lambda c: F.round(c, 5) + F.lit(0.0)
        return _refitted(t, boot)[1].select("voxel_ix", "iter", five("cc").alias("cc"), five("r2").alias("r2"))

    _fits.__name__, _scores.__name__ = _name, f"{_name}_scores"
    query(f"{_ONE}{_PLAN} r AS ({_rows}), {_SOLVED} SELECT f::INTEGER AS prf_ix, c AS voxel_ix, iter::INTEGER AS iter, s.j::INTEGER AS lambda_ix, round(s.w, 5) + 0 AS w, round(s.b, 5) + 0 AS bias, round(s.loss, 3) + 0 AS loss FROM best")(_fits)
    query(f"{_ONE}{_PLAN} r AS ({_rows}), {_SOLVED} {_SCORED}")(_scores)


@query(f"""{_ONE} r AS (SELECT 0 AS iter, f, c, split, z, y, 1 AS t FROM z JOIN y USING (i)), {_SOLVED},
chosen AS (SELECT c, arg_min(f, struct_pack(l := s.loss, f := f)) AS f FROM best GROUP BY c)
SELECT c AS voxel_ix, f::INTEGER AS prf_ix, count(*) AS n, round(covar_pop(y, s.b + s.w * z) / nullif(sqrt(var_pop(y) * var_pop(s.b + s.w * z)), 0), 5) + 0 AS cc, round(1 - sum(pow(s.b + s.w * z - y, 2)) / (var_pop(y) * count(*)), 5) + 0 AS r2
FROM r JOIN best USING (iter, f, c) JOIN chosen USING (c, f) WHERE split = 'val' GROUP BY ALL""")
def stored_run(t):
    """A whole job over two blocks of channels, stored part by part and read back."""
    run = J.fit_job(*_one_feature(t), list(_LAMBDAS), scratch(t.spark, "run"), blocks=2)
    five = lambda c: F.round(c, 5) + F.lit(0.0)
    fields = run.table("fits").select("voxel_ix", "prf_ix")
    return run.table("validation").join(fields, "voxel_ix").select("voxel_ix", "prf_ix", "n", five("cc").alias("cc"), five("r2").alias("r2"))


#: The chosen field's fit of each channel, and its rows with their images.
_CHOSEN = f"""{_ONE} r AS (SELECT 0 AS iter, i, f, c, split, z, y, 1 AS t FROM z JOIN y USING (i)), {_SOLVED},
chosen AS (SELECT c, arg_min(f, struct_pack(l := s.loss, f := f)) AS f FROM best GROUP BY c),
rows_ AS (SELECT r.i, r.c, r.f, r.split, r.y, s.b + s.w * r.z AS yhat FROM r JOIN chosen USING (c, f) JOIN best USING (c, f))"""


def _chosen(t):
    """(features, responses, fits) of the one-feature model at each channel's best field."""
    features, responses = _one_feature(t)
    return features, responses, M.best_field(M.fit_ridge(features, responses, list(_LAMBDAS)))


@query(f"{_CHOSEN} SELECT c AS voxel_ix, i AS image_ix, round((y - yhat)::FLOAT::DOUBLE, 3) + 0 AS residual FROM rows_")
def single_model_residuals(t):
    """What the one-feature model leaves of every image's responses."""
    features, responses, fits = _chosen(t)
    return M.residuals(M.predict(features, fits), responses).select("voxel_ix", "image_ix", (F.round(F.col("residual").cast("double"), 3) + F.lit(0.0)).alias("residual"))


def _resampled_sql(plan):
    return f"""{_CHOSEN}, held AS (SELECT i, row_number() OVER (ORDER BY {_draw('i', P.PLACES)}, i) p, count(*) OVER () n FROM s WHERE split = 'val'), plan AS ({plan})
SELECT a.c AS voxel_ix, plan.iter::INTEGER AS iter, round(covar_pop(b.y, a.yhat) / nullif(sqrt(var_pop(b.y) * var_pop(a.yhat)), 0), 5) + 0 AS cc, round(1 - sum(pow(a.yhat - b.y, 2)) / (var_pop(b.y) * count(*)), 5) + 0 AS r2
FROM plan JOIN rows_ a ON a.i = plan.i JOIN rows_ b ON b.i = plan.source AND b.c = a.c GROUP BY ALL"""


def _resampled(t, bootstrap):
    features, responses, fits = _chosen(t)
    val = features.where("split = 'val'")
    plan = (P.bootstrap if bootstrap else P.permutation)(val.select("image_ix").distinct(), [], "image_ix", 3)
    five = lambda c: F.round(c, 5) + F.lit(0.0)
    return M.resampled(M.predict(val, fits), responses, plan, both_sides=bootstrap).select("voxel_ix", "iter", five("cc").alias("cc"), five("r2").alias("r2"))


@query(_resampled_sql(f"SELECT d.iter, b.i, b.i AS source FROM (SELECT held.*, o.iter, ({_draw('(p - 1) * 31 + 7', 'o.iter')}) % n AS q FROM held, range(3) o(iter)) d JOIN held b ON b.p - 1 = d.q"))
def single_feature_bootstrap(t):
    """Scores of the one-feature model on drawn validation images."""
    return _resampled(t, True)


@query(_resampled_sql(f"SELECT q.iter, held.i, q.i AS source FROM held JOIN (SELECT i, o.iter, row_number() OVER (PARTITION BY o.iter ORDER BY {_draw('i', 'o.iter')}, i) p FROM held, range(3) o(iter)) q USING (p)"))
def single_feature_shuffle(t):
    """Scores of the one-feature model on validation responses that were moved."""
    return _resampled(t, False)


_SET = "x AS (SELECT vec_id i, f.f, embedding[f.f * 16 + {}]::DOUBLE x FROM embeddings, range(4) f(f))"


def _set_sql(name, k):
    return f"({_ONE.replace('x AS (SELECT vec_id i, f.f, embedding[f.f * 16 + 1]::DOUBLE x FROM embeddings, range(4) f(f))', _SET.format(k))} r AS (SELECT 0 AS iter, f, c, split, z, y, 1 AS t FROM z JOIN y USING (i)), {_SOLVED} SELECT 'just_{name}' AS version, f::INTEGER AS prf_ix, c AS voxel_ix, s.j::INTEGER AS lambda_ix, round(s.loss, 3) + 0 AS loss FROM best)"


@query(f"SELECT * FROM {_set_sql('edges', 2)} UNION ALL SELECT * FROM {_set_sql('labels', 9)}")
def registered_sets(t):
    """Two stored feature sets, named in a table, opened side by side by type and fitted; each set alone is a fit that SQL can state."""
    design, responses = _design(t), _responses(t, 3)
    folder = scratch(t.spark, "sets")
    for name, k in (("edges", 2), ("labels", 9)):
        ST.write_features(design.withColumn("f", F.slice("f", k, 1)), f"{folder}/{name}")
    table = t.spark.createDataFrame([(n, f"{folder}/{n}", True, [("all", 1)]) for n in ("edges", "labels")], "name string, path string, by_field boolean, groups array<struct<name:string,width:int>>")
    sets = FeatureSets.from_table(table)
    features, masks = sets.open(t.spark, sets.named("edg*, labels"))
    features = features.join(design.select("image_ix", "split").distinct(), "image_ix")
    fits = M.fit_ridge(features, responses, list(_LAMBDAS), masks).where("version like 'just%'")
    return fits.select("version", "prf_ix", "voxel_ix", "lambda_ix", (F.round("loss", 3) + F.lit(0.0)).alias("loss"))


@query()
def model_residuals(t):
    design, responses = _design(t), _responses(t)
    best = M.best_field(M.fit_ridge(design, responses, GR.ridge_penalties()))
    return M.residuals(M.predict(design, best), responses).select("voxel_ix", "image_ix", F.round("residual", 3).alias("residual"))


@query(f"""
WITH d AS (SELECT p_brand, p_size x, p_retailprice y, p_partkey % 13 c FROM part), r AS (SELECT p_brand, count(*) n, corr(x, y) xy, corr(x, c) xc, corr(y, c) yc FROM d GROUP BY p_brand),
p AS (SELECT p_brand, n, n - 2.0 AS d, (xy - xc * yc) / sqrt((1 - xc * xc) * (1 - yc * yc)) AS r FROM r), t AS (SELECT *, r * sqrt(d / (1 - r * r)) AS t FROM p)
SELECT p_brand, n, round(r, 6) + 0 AS r, round({t_tail('t', 'd')}, 5) + 0 AS p FROM t
""")
def partial_correlations(t):
    d = t.part.select("p_brand", F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"), (F.col("p_partkey") % 13).cast("double").alias("c"))
    return M.partial_correlations(d, ["p_brand"], "x", "y", ["c"]).select("p_brand", "n", r6(F.col("r")).alias("r"), (F.round("p", 5) + F.lit(0.0)).alias("p"))


@query()
def pca_by_class(t):
    e = t.embeddings.select("label", "vec_id", "embedding")
    out = M.pca(e, ["label"], "vec_id", "embedding", F.col("vec_id") % 4 != 0, 95.0, 20)
    return out.select("label", "vec_id", F.size("scores").alias("components"), F.transform("scores", lambda x: F.round(x, 3)).alias("scores"))


@query("""
WITH v AS (SELECT label, vec_id, embedding[1]::DOUBLE a, embedding[2]::DOUBLE b FROM embeddings),
m AS (SELECT label, avg(a) ma, avg(b) mb, var_pop(a) aa, var_pop(b) bb, covar_pop(a, b) ab FROM v WHERE vec_id % 4 <> 0 GROUP BY label),
e AS (SELECT *, (aa + bb) / 2 + sqrt(pow((aa - bb) / 2, 2) + ab * ab) l1, (aa + bb) / 2 - sqrt(pow((aa - bb) / 2, 2) + ab * ab) l2 FROM m),
w AS (SELECT *, ab / sqrt(ab * ab + pow(l1 - aa, 2)) x, (l1 - aa) / sqrt(ab * ab + pow(l1 - aa, 2)) y FROM e),
s AS (SELECT *, CASE WHEN (CASE WHEN abs(x) >= abs(y) THEN x ELSE y END) < 0 THEN -1 ELSE 1 END s FROM w)
SELECT label, vec_id, round(s * (x * (a - ma) + y * (b - mb)), 5) + 0 AS score, round(100 * l1 / (l1 + l2), 5) + 0 AS pct FROM v JOIN s USING (label)
""")
def stored_components(t):
    """Components of two features fitted on some rows, kept as a table, and applied to all rows."""
    e = t.embeddings.select("label", "vec_id", F.transform(F.slice("embedding", 1, 2), lambda x: x.cast("double")).alias("v"))
    kept = M.fit_pca(e.where("vec_id % 4 <> 0"), ["label"], "v", min_pct=0.0)
    five = lambda c: F.round(c, 5) + F.lit(0.0)
    scores = M.apply_pca(e, ["label"], "vec_id", "v", kept)
    return scores.join(kept.select("label", "pct"), "label").select("label", "vec_id", five(F.col("scores")[0]).alias("score"), five(F.col("pct")[0]).alias("pct"))


@query()
def lda_decoding(t):
    """One against the rest for each class, balanced, ten folds."""
    e = t.embeddings.withColumn("axis", F.explode(F.sequence(F.lit(0), F.lit(9)))).withColumn("y", (F.col("label") == F.col("axis")).cast("int"))
    chosen = P.balanced(e, ["axis"], ["y"], "vec_id", 1)
    rows = chosen.join(t.embeddings.select("vec_id", "embedding"), "vec_id")
    return DI.decode(rows, ["axis"], "vec_id", "embedding", "y").select("axis", "n", F.round("accuracy", 4).alias("accuracy"), F.round("dprime", 4).alias("dprime"))


@query()
def pairwise_decoding(t):
    """Every pair of the ten classes; a row goes to the nine pairs that it is in."""
    e = t.embeddings.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(9)))).where("other <> label")
    e = e.withColumn("a", F.least("label", "other").cast("long")).withColumn("b", F.greatest("label", "other").cast("long")).withColumn("y", (F.col("label") == F.col("a")).cast("int"))
    return DI.decode(e, ["a", "b"], "vec_id", "embedding", "y").select("a", "b", "n", F.round("accuracy", 4).alias("accuracy"), F.round("dprime", 4).alias("dprime"))


def _discriminant(rows: str, by: str, total: str) -> str:
    """SQL of ten-fold discriminant analysis of two features, from rows r(by, i, y, u, v), with a tie going to the lower class."""
    return f"""
WITH r AS ({rows}), f AS (SELECT *, (row_number() OVER (PARTITION BY {by} ORDER BY {_draw('i', 0)}, i) - 1) % 10 AS fold FROM r),
t AS (SELECT a.{by}, a.fold, b.y, count(*) n, avg(b.u) mu, avg(b.v) mv, var_pop(b.u) * count(*) uu, var_pop(b.v) * count(*) vv, covar_pop(b.u, b.v) * count(*) uv
  FROM (SELECT DISTINCT {by}, fold FROM f) a JOIN f b ON a.{by} = b.{by} AND a.fold <> b.fold GROUP BY ALL),
c AS (SELECT {by}, fold, sum(n) n, greatest(sum(n) - count(*), 1) d, sum(uu) uu, sum(vv) vv, sum(uv) uv FROM t GROUP BY ALL),
w AS (SELECT t.{by}, t.fold, t.y, t.n / c.n AS p, mu, mv, c.vv * c.d / (c.uu * c.vv - c.uv * c.uv) a, -c.uv * c.d / (c.uu * c.vv - c.uv * c.uv) b, c.uu * c.d / (c.uu * c.vv - c.uv * c.uv) e FROM t JOIN c USING ({by}, fold)),
s AS (SELECT f.{by}, f.i, f.y, arg_max(w.y, struct_pack(s := round((a * mu + b * mv) * u + (b * mu + e * mv) * v - 0.5 * (a * mu * mu + 2 * b * mu * mv + e * mv * mv) + ln(p), 9), y := -w.y)) AS g FROM f JOIN w USING ({by}, fold) GROUP BY ALL)
SELECT {total} FROM s GROUP BY ALL"""


@query(_discriminant("SELECT a.k AS axis, vec_id AS i, (label = a.k)::INTEGER AS y, embedding[1]::DOUBLE AS u, embedding[2]::DOUBLE AS v FROM embeddings, range(10) a(k)", "axis", "axis::INTEGER AS axis, count(*) AS n, round(avg((y = g)::INTEGER), 6) + 0 AS accuracy"))
def two_feature_decoding(t):
    """Each class against the rest from two features, a discriminant that SQL can state."""
    e = t.embeddings.select("vec_id", F.slice("embedding", 1, 2).alias("f"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("axis"), "label").withColumn("y", (F.col("label") == F.col("axis")).cast("int"))
    return DI.decode(e, ["axis"], "vec_id", "f", "y").select("axis", "n", r6(F.col("accuracy")).alias("accuracy"))


_LOCALIZER = f"SELECT 0 AS one, p_partkey AS i, substr(p_brand, 7, 1)::INTEGER AS y, p_size::DOUBLE + substr(p_brand, 7, 1)::INTEGER * 7 AS u, p_retailprice AS v FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY {_draw('p_partkey', 1718)}, p_partkey) k FROM part) WHERE k <= 41"


@query(_discriminant(_LOCALIZER, "one", "y, g::INTEGER AS predicted, count(*) AS n"))
def localizer_decoding(t):
    """Domains of the balanced localizer set, decoded from two features: how often each was taken for each."""
    domain = F.substring("p_brand", 7, 1).cast("int")
    rows = t.part.select("p_brand", "p_partkey", domain.alias("y"), F.array(F.col("p_size") + domain * 7.0, F.col("p_retailprice")).alias("f"))
    chosen = TR.balanced_set(rows, "p_brand", "p_partkey", 41, 1718)
    return DI.cross_validated(chosen, [], "p_partkey", "f", "y").groupBy("y", "predicted").agg(F.count("*").alias("n"))


@query("""
WITH v AS (SELECT label, vec_id, embedding[1]::DOUBLE y, embedding[9]::DOUBLE x FROM embeddings), f AS (SELECT label, regr_slope(y, x) s, regr_intercept(y, x) i FROM v WHERE vec_id % 3 <> 0 GROUP BY label)
SELECT label, vec_id, round(y - i - s * x, 5) + 0 AS residual FROM v JOIN f USING (label)
""")
def single_feature_residuals(t):
    """What one feature leaves of another, a fit that SQL can state."""
    e = t.embeddings.select("label", "vec_id", F.slice("embedding", 1, 1).alias("target"), F.slice("embedding", 9, 1).alias("source"))
    out = M.feature_residuals(e, ["label"], "vec_id", "target", "source", F.col("vec_id") % 3 != 0)
    return out.select("label", "vec_id", (F.round(F.col("residual")[0], 5) + F.lit(0.0)).alias("residual"))


@query()
def feature_residuals(t):
    e = t.embeddings.select("label", "vec_id", F.slice("embedding", 1, 8).alias("target"), F.slice("embedding", 9, 8).alias("source"))
    return M.feature_residuals(e, ["label"], "vec_id", "target", "source", F.col("vec_id") % 3 != 0).select("label", "vec_id", F.transform("residual", lambda x: F.round(x, 3)).alias("residual"))


@query("""
WITH v AS (SELECT vec_id, label, embedding[1]::DOUBLE a, embedding[2]::DOUBLE b, embedding[3]::DOUBLE c FROM embeddings), f AS (SELECT label, regr_slope(a, b) s, regr_intercept(a, b) i, regr_r2(a, b) r FROM v GROUP BY label)
SELECT label, round(s, 5) + 0 AS slope, round(i, 5) + 0 AS intercept, round(r, 5) + 0 AS r2 FROM f
""")
def size_eccentricity_fit(t):
    a, b = F.col("embedding")[0].cast("double"), F.col("embedding")[1].cast("double")
    five = lambda c: F.round(c, 5) + F.lit(0.0)
    return t.embeddings.groupBy("label").agg(five(F.regr_slope(a, b)).alias("slope"), five(F.regr_intercept(a, b)).alias("intercept"), five(F.regr_r2(a, b)).alias("r2"))


@query("""
WITH v AS (SELECT label, vec_id, unnest(embedding)::DOUBLE v, unnest(range(0, 64)) f FROM embeddings), w AS (SELECT vec_id, embedding[64]::DOUBLE y FROM embeddings)
SELECT label, f::INTEGER AS feat_ix, round(covar_pop(v, y) / nullif(sqrt(var_pop(v) * var_pop(y)), 0), 6) + 0 AS r FROM v JOIN w USING (vec_id) GROUP BY ALL
""")
def feature_tuning(t):
    """Correlation of each feature with a response, by group."""
    from ..functions.stats import corr

    rows = t.embeddings.select("label", F.col("embedding")[63].cast("double").alias("y"), F.posexplode("embedding").alias("feat_ix", "v"))
    return rows.groupBy("label", "feat_ix").agg(r6(corr(F.col("v").cast("double"), F.col("y"))).alias("r"))
