"""Grids, masks, pixel statistics, colours and boxes."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import color as C
from ..functions import geometry as G
from ..functions.stats import r6
from ..operators import grids as GR
from ..operators import pixels as PX
from .registry import query


def _log_points(n, low, high, less=0.0):
    return f"(SELECT i, exp({math.log(low)!r} + i * {(math.log(high) - math.log(low)) / (n - 1)!r}) - {less!r} AS v FROM range({n}) g(i))"


def _polar_sql(sig, ecc, centre=0.0):
    return f"""
    WITH e AS (SELECT i, (CASE WHEN abs(v) < 1e-9 THEN {centre!r} ELSE v END)::FLOAT AS v FROM {_log_points(ecc[2], ecc[0] + 0.1, ecc[1] + 0.1, 0.1)}),
    s AS (SELECT i, v::FLOAT AS v FROM {_log_points(sig[2], sig[0], sig[1])}),
    a AS (SELECT i, (i * {2 * math.pi / 16!r})::FLOAT::DOUBLE AS v FROM range(16) g(i)),
    g AS (SELECT (s.i * {ecc[2]} + e.i) * 16 + a.i AS pos, (e.v * cos(a.v)::FLOAT)::FLOAT + 0.0::FLOAT AS x, (e.v * sin(a.v)::FLOAT)::FLOAT + 0.0::FLOAT AS y, s.v AS sigma FROM e, a, s),
    u AS (SELECT x, y, sigma, min(pos) pos FROM g GROUP BY ALL),
    w AS (SELECT * FROM u WHERE x - sigma <= 0.5 AND x + sigma >= -0.5 AND y + sigma >= -0.5 AND y - sigma <= 0.5)
    SELECT (row_number() OVER (ORDER BY pos) - 1)::INTEGER AS prf_ix, round(x::DOUBLE, 5) + 0 AS x, round(y::DOUBLE, 5) + 0 AS y, round(sigma::DOUBLE, 5) AS sigma FROM w"""


def _lattice_sql(sizes, aperture, extra=False):
    values = ", ".join(f"({k}, {s!r}, {n})" for k, (s, n) in enumerate(sizes))
    wide = f" UNION ALL SELECT {len(sizes)}, 0, 0, 0.0, 0.0, 10.0" if extra else ""
    return f"""
    WITH s(k, sigma, n) AS (VALUES {values}), g AS (
      SELECT k, j.j, i.i, {-aperture / 2!r} + i.i * {aperture!r} / (n - 1) AS x, {-aperture / 2!r} + j.j * {aperture!r} / (n - 1) AS y, sigma FROM s, range(60) i(i), range(60) j(j) WHERE i.i < n AND j.j < n{wide})
    SELECT (row_number() OVER (ORDER BY k, j, i) - 1)::INTEGER AS prf_ix, round(x, 5) + 0 AS x, round(y, 5) + 0 AS y, round(sigma, 5)::DOUBLE AS sigma FROM g"""


def _rounded(df):
    return df.select("prf_ix", *((F.round(c, 5) + F.lit(0.0)).alias(c) for c in ("x", "y")), F.round("sigma", 5).alias("sigma"))


_GRIDS = {
    1: _lattice_sql([(s, math.ceil(1.1 / (s * 1.4))) for s in GR.log_points(8, 0.04, 0.4)], 1.1),
    2: _lattice_sql(list(zip(GR.log_points(9, 0.04, 0.8), GR.PYRAMID_SIDES, strict=True)), 1.1, extra=True),
    4: _polar_sql((0.04, 1.0, 12), (0.0, 1.4, 12)),
    5: _polar_sql((0.02, 1.0, 10), (0.0, 7 / 8.4, 10), 2.0**-56),
    6: f"""
    WITH e AS (SELECT i, CASE WHEN abs(v) < 1e-9 THEN 0 ELSE v END AS v FROM {_log_points(10, 0.1, 7 / 8.4 + 0.1, 0.1)}),
    a AS (SELECT i, (i * {2 * math.pi / 16!r})::FLOAT::DOUBLE AS v FROM range(16) g(i)),
    g AS (SELECT (e.i * 3 + s.k) * 16 + a.i AS pos, (e.v::FLOAT * cos(a.v)::FLOAT)::FLOAT AS x, (e.v::FLOAT * sin(a.v)::FLOAT)::FLOAT AS y, ((e.v * 0.7 + 0.05) * s.m)::FLOAT AS sigma FROM e, a, (VALUES (0, 0.5), (1, 1.0), (2, 1.5)) s(k, m)),
    w AS (SELECT * FROM g WHERE x - sigma <= 0.5 AND x + sigma >= -0.5 AND y + sigma >= -0.5 AND y - sigma <= 0.5)
    SELECT (row_number() OVER (ORDER BY pos) - 1)::INTEGER AS prf_ix, round(x::DOUBLE, 5) + 0 AS x, round(y::DOUBLE, 5) + 0 AS y, round(sigma::DOUBLE, 5) AS sigma FROM w""",
    7: """
    WITH g AS (SELECT j * 25 + i AS pos, -0.52 + i * 1.04 / 24 AS x, -0.52 + j * 1.04 / 24 AS y FROM range(25) a(i), range(25) b(j)),
    w AS (SELECT * FROM g WHERE x - 0.04 <= 0.5 AND x + 0.04 >= -0.5 AND y + 0.04 >= -0.5 AND y - 0.04 <= 0.5)
    SELECT (row_number() OVER (ORDER BY pos) - 1)::INTEGER AS prf_ix, round(x, 5)::DOUBLE + 0 AS x, round(y, 5)::DOUBLE + 0 AS y, 0.04::DOUBLE AS sigma FROM w""",
}
_GRIDS[3] = _GRIDS[2]


def _of_channels(t, grid):
    """Each channel (customer) with the field of a grid that is its own."""
    k = F.col("c_custkey")
    return t.customer.select(k.alias("voxel_ix"), (k % grid.count()).cast("int").alias("prf_ix")).join(grid, "prf_ix")


def _of_channels_sql(grid):
    return f"WITH g AS ({grid}) SELECT c_custkey AS voxel_ix, g.* FROM customer JOIN g ON g.prf_ix = c_custkey % (SELECT count(*) FROM g)"


def _add_grid(which):
    def grid(t):
        return _of_channels(t, _rounded(GR.prf_grid(t.spark, which)))

    grid.__name__ = f"prf_grid_{which}"
    query(_of_channels_sql(_GRIDS[which]))(grid)


for _which in sorted(_GRIDS):
    _add_grid(_which)


@query(_of_channels_sql("SELECT 0 AS prf_ix, NULL::DOUBLE AS x, NULL::DOUBLE AS y, NULL::DOUBLE AS sigma"))
def prf_grid_0(t):
    return _of_channels(t, GR.prf_grid(t.spark, 0))


@query(f"""
WITH m AS ({_GRIDS[5]}), r AS (SELECT prf_ix, dense_rank() OVER (ORDER BY round(sqrt(x * x + y * y) * 8.4, 2)) e, dense_rank() OVER (ORDER BY round(sigma * 8.4, 2)) s FROM m)
SELECT c_custkey AS voxel_ix, prf_ix FROM customer JOIN r ON prf_ix = c_custkey % (SELECT count(*) FROM m) WHERE e <= 8 AND s > 5
""")
def decoding_fields(t):
    """Channels whose field is one of those used for decoding."""
    grid = GR.prf_grid(t.spark, 5)
    return _of_channels(t, grid).join(GR.decoding_fields(grid).select("prf_ix"), "prf_ix", "left_semi").select("voxel_ix", "prf_ix")


@query("SELECT s_suppkey, a.i * 9 + b.i * 3 + c.i AS pos, round((a.i * 0.5::DOUBLE + 1) * s_acctbal + (b.i * 0.5::DOUBLE + 1) * s_nationkey + (c.i * 0.5::DOUBLE + 1), 4) + 0 AS total FROM supplier, range(3) a(i), range(3) b(i), range(3) c(i)")
def value_combinations(t):
    """Every combination of three weights, applied to each supplier."""
    weights = GR.combinations(t.spark, [1.0, 1.5, 2.0], 3)
    one = t.supplier.withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(26)))).join(weights, "pos")
    return one.select("s_suppkey", F.col("pos").cast("long").alias("pos"), (F.round(F.col("v0") * F.col("s_acctbal") + F.col("v1") * F.col("s_nationkey") + F.col("v2"), 4) + F.lit(0.0)).alias("total"))


def _penalty_sql(kind):
    n, top = GR.PENALTY_GRIDS[kind]
    return f"SELECT '{kind}' AS kind, i::INTEGER AS lambda_ix, CASE WHEN i = 0 THEN 0 ELSE round(exp(ln(0.01) + (ln({top} + 0.01) - ln(0.01)) * i / {n - 1}) - 0.01, 3) END AS \"lambda\" FROM range({n}) g(i)"


@query(f"""
WITH p AS ({" UNION ALL ".join(_penalty_sql(k) for k in GR.PENALTY_GRIDS)}), s AS (SELECT label, sum(embedding[1]::DOUBLE * embedding[2]::DOUBLE) xy, sum(pow(embedding[1]::DOUBLE, 2)) xx FROM embeddings GROUP BY label)
SELECT label, kind, lambda_ix, "lambda", round(xy / (xx + "lambda"), 5) + 0 AS weight FROM s, p
""")
def ridge_penalties(t):
    """One weight of each class under every penalty of every kind of features."""
    rows = [(kind, i, v) for kind in GR.PENALTY_GRIDS for i, v in enumerate(GR.ridge_penalties(kind))]
    penalties = F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(i).alias("lambda_ix"), F.lit(round(v, 3)).alias("lambda")) for kind, i, v in rows])
    x, y = F.col("embedding")[0].cast("double"), F.col("embedding")[1].cast("double")
    sums = t.embeddings.groupBy("label").agg(F.sum(x * y).alias("xy"), F.sum(x * x).alias("xx")).select("*", F.explode(penalties).alias("p"))
    return sums.select("label", "p.*", (F.round(F.col("xy") / (F.col("xx") + F.col("p.lambda")), 5) + F.lit(0.0)).alias("weight"))


_SMALL = "(SELECT i AS prf_ix, (i % 3 - 1) * 0.3 AS x, (i // 3 - 1) * 0.35 AS y, 0.05 + 0.03 * (i % 4) AS sigma FROM range(9) g(i))"


def _small(t):
    i = F.col("id")
    return t.spark.range(9).select(i.alias("prf_ix"), ((i % 3 - 1) * 0.3).alias("x"), ((F.floor(i / 3) - 1) * 0.35).alias("y"), (0.05 + 0.03 * (i % 4)).alias("sigma"))


#: A field for each supplier.
_OWN = "(SELECT s_suppkey AS prf_ix, (s_suppkey % 3 - 1) * 0.3 AS x, (s_suppkey % 7 - 3) * 0.11 AS y, 0.05 + 0.03 * (s_suppkey % 4) AS sigma FROM supplier)"


def _own(t):
    i = F.col("s_suppkey")
    return t.supplier.select(i.alias("prf_ix"), ((i % 3 - 1) * 0.3).alias("x"), ((i % 7 - 3) * 0.11).alias("y"), (0.05 + 0.03 * (i % 4)).alias("sigma"))


_PIXELS = f"(SELECT f.prf_ix, r.r AS row, c.c AS col, exp(-(pow(-0.5 + c.c / 19.0 - x, 2) + pow(-0.5 + r.r / 19.0 + y, 2)) / (2 * sigma * sigma)) AS g FROM {_SMALL} f, range(20) r(r), range(20) c(c))"


_OWN_PIXELS = _PIXELS.replace(_SMALL, _OWN)


@query(f"SELECT prf_ix, row::INTEGER AS row, col::INTEGER AS col, round(g / sum(g) OVER (PARTITION BY prf_ix), 8) + 0 AS w FROM {_OWN_PIXELS}")
def gaussian_weights(t):
    return GR.gaussian_weights(_own(t), 20).withColumn("w", F.round("w", 8) + F.lit(0.0))


@query(f"SELECT prf_ix, row::INTEGER AS row, col::INTEGER AS col FROM (SELECT *, g / max(g) OVER (PARTITION BY prf_ix) h FROM {_OWN_PIXELS}) WHERE h > 0.14")
def field_masks(t):
    return GR.field_masks(_own(t), 20)


_IMG = "(SELECT s_suppkey AS image_ix, r.r AS row, c.c AS col, ((s_suppkey * 31 + r.r * r.r * 7 + c.c * 13 + r.r * c.c) % 256)::DOUBLE AS v, ((s_suppkey * 17 + r.r * 5 + c.c * c.c * 3) % 256)::DOUBLE AS u FROM supplier o, range(20) r(r), range(20) c(c))"


_W = f"(SELECT prf_ix, row, col, g / sum(g) OVER (PARTITION BY prf_ix) w FROM {_PIXELS})"


@query(f"""
WITH j AS (SELECT image_ix, prf_ix, w, v FROM {_IMG} i JOIN {_W} USING (row, col)), m AS (SELECT *, sum(w * v) OVER (PARTITION BY image_ix, prf_ix) mu FROM j),
s AS (SELECT image_ix, prf_ix, any_value(mu) mu, sum(w * pow(v - mu, 2)) + 1e-6 v, sum(w * pow(v - mu, 3)) c3, sum(w * pow(v - mu, 4)) c4 FROM m GROUP BY ALL)
SELECT image_ix, prf_ix, round(mu, 4) + 0 AS mean, round(v, 4) + 0 AS var, round(c3 / pow(v, 1.5), 4) + 0 AS skew, round(c4 / (v * v), 4) + 0 AS kurtosis FROM s
""")
def weighted_pixel_moments(t):
    out = PX.by_field(PX.image_moments(_arrays(t), _small(t), 20, ["image_ix"]), ["image_ix"], ["mean", "var", "skew", "kurtosis"])
    return out.select("image_ix", "prf_ix", *((F.round(c, 4) + F.lit(0.0)).alias(c) for c in ("mean", "var", "skew", "kurtosis")))


@query(f"""
WITH j AS (SELECT image_ix, prf_ix, w, v, u FROM {_IMG} i JOIN {_W} USING (row, col))
SELECT image_ix, prf_ix, round(sum(w * v * u) - sum(w * v) * sum(w * u), 3) + 0 AS cross FROM j GROUP BY ALL
""")
def weighted_cross_covariance(t):
    return PX.by_field(PX.image_cross(_pairs(t), _small(t), 20, ["image_ix"]), ["image_ix"], ["cross"]).withColumn("cross", F.round("cross", 3) + F.lit(0.0))


@query(f"""
WITH m AS (SELECT image_ix, prf_ix, sum(w * v) AS mv, sum(w * u) AS mu FROM {_IMG} JOIN {_W} USING (row, col) GROUP BY ALL),
z AS (SELECT image_ix, prf_ix, row, col, (v - mv) * sqrt(w) AS a, (u - mu) * sqrt(w) AS b FROM {_IMG} JOIN {_W} USING (row, col) JOIN m USING (image_ix, prf_ix))
SELECT x.image_ix, x.prf_ix, dy.d AS dy, dx.d AS dx, round(sum(x.a * y.b), 2) + 0 AS cross FROM z x, range(-1, 2) dy(d), range(-1, 2) dx(d), z y
WHERE y.image_ix = x.image_ix AND y.prf_ix = x.prf_ix AND y.row = x.row + dy.d AND y.col = x.col + dx.d GROUP BY ALL
""")
def shifted_cross_covariance(t):
    """Weighted covariance of two maps of every image at nine shifts."""
    f = PX.cross_correlations(_pairs(t), _small(t), 20, ["image_ix"], 1)
    long = f.select("image_ix", F.posexplode("cross").alias("k", "cross"))
    k = F.col("k")
    return long.select("image_ix", F.floor(k / 9).alias("prf_ix"), (F.floor(k % 9 / 3) - 1).alias("dy"), (k % 3 - 1).cast("long").alias("dx"), (F.round("cross", 2) + F.lit(0.0)).alias("cross"))


@query(f"SELECT image_ix, prf_ix, round(sum(w * v), 4) + 0 AS f FROM {_IMG} i JOIN {_W} USING (row, col) GROUP BY ALL")
def pooled_features(t):
    return PX.by_field(PX.pooled_images(_arrays(t), _small(t), 20, ["image_ix"]), ["image_ix"], ["f"]).withColumn("f", F.round("f", 4) + F.lit(0.0))


def _arrays(t, layers: int = 1):
    """(image_ix, layer, px): the images of _images as arrays by row."""
    k, i = F.col("s_suppkey"), F.sequence(F.lit(0), F.lit(399))
    rows = t.supplier.select(k, F.explode(F.sequence(F.lit(0), F.lit(layers - 1))).alias("layer"))
    r, c = lambda p: F.floor(p / 20), lambda p: p % 20
    px = F.transform(i, lambda p: F.pmod(k * 31 + F.col("layer") * 5 + r(p) * r(p) * 7 + c(p) * 13 + r(p) * c(p), F.lit(256)).cast("double"))
    return rows.select(k.alias("image_ix"), "layer", px.alias("px"))


def _pairs(t):
    """(image_ix, px, other): two maps of each image."""
    k, i = F.col("image_ix"), F.sequence(F.lit(0), F.lit(399))
    other = F.transform(i, lambda p: F.pmod(k * 17 + F.floor(p / 20) * 5 + (p % 20) * (p % 20) * 3, F.lit(256)).cast("double"))
    return _arrays(t).select("image_ix", "px", other.alias("other"))


def _map_sql(grid, layers):
    pixels = f"(SELECT f.prf_ix, r.r AS row, c.c AS col, exp(-(pow(-0.5 + c.c / 19.0 - x, 2) + pow(-0.5 + r.r / 19.0 + y, 2)) / (2 * sigma * sigma)) AS g FROM ({grid}) f, range(20) r(r), range(20) c(c))"
    images = f"(SELECT s_suppkey AS image_ix, k.k::INTEGER AS layer, r.r AS row, c.c AS col, ((s_suppkey * 31 + k.k * 5 + r.r * r.r * 7 + c.c * 13 + r.r * c.c) % 256)::DOUBLE AS v FROM supplier, range({layers}) k(k), range(20) r(r), range(20) c(c))"
    return f"WITH w AS (SELECT prf_ix, row, col, g / sum(g) OVER (PARTITION BY prf_ix) w FROM {pixels}), f AS (SELECT image_ix, layer, prf_ix, sum(w * v) f FROM {images} JOIN w USING (row, col) GROUP BY ALL)"


_FULL = "SELECT i AS prf_ix, (i % 40) / 40.0 - 0.5 AS x, (i // 40) / 40.0 - 0.45 AS y, 0.03 + 0.01 * (i % 11) AS sigma FROM range(1456) g(i)"


@query(f"{_map_sql(_FULL, 1)} SELECT image_ix, count(*) AS fields, round(min(f), 4) + 0 AS least, round(max(f), 4) + 0 AS most, round(sum(f * (prf_ix % 7)), 2) + 0 AS mixed FROM f GROUP BY ALL")
def pooled_all_fields(t):
    """Every image under 1,456 fields."""
    i = F.col("id")
    grid = t.spark.range(1456).select(i.alias("prf_ix"), (i % 40 / 40.0 - 0.5).alias("x"), (F.floor(i / 40) / 40.0 - 0.45).alias("y"), (0.03 + 0.01 * (i % 11)).alias("sigma"))
    f = PX.pooled_images(_arrays(t), grid, 20, ["image_ix"])
    mixed = F.aggregate(F.transform("f", lambda v, k: v * (k % 7)), F.lit(0.0), lambda a, v: a + v)
    four = lambda c: F.round(c, 4) + F.lit(0.0)
    return f.select("image_ix", F.size("f").cast("long").alias("fields"), four(F.array_min("f")).alias("least"), four(F.array_max("f")).alias("most"), (F.round(mixed, 2) + F.lit(0.0)).alias("mixed"))


@query(f"{_map_sql(_SMALL, 3)} SELECT image_ix, layer, prf_ix, round(f, 4) + 0 AS f FROM f")
def pooled_maps(t):
    """Stored maps of several channels, as a network gives them, pooled by field."""
    f = PX.pooled_images(_arrays(t, 3), _small(t), 20, ["image_ix", "layer"])
    return f.select("image_ix", "layer", F.posexplode("f").alias("prf_ix", "f")).select("image_ix", "layer", F.col("prf_ix").cast("long").alias("prf_ix"), (F.round("f", 4) + F.lit(0.0)).alias("f"))


@query(f"SELECT image_ix, prf_ix, round(avg(v * (g - lo) / (hi - lo)), 4) + 0 AS f FROM {_IMG} i JOIN (SELECT *, min(g) OVER (PARTITION BY prf_ix) lo, max(g) OVER (PARTITION BY prf_ix) hi FROM {_PIXELS}) USING (row, col) GROUP BY ALL")
def scaled_pool(t):
    return PX.by_field(PX.pooled_images(_arrays(t), _small(t), 20, ["image_ix"], scaled=True), ["image_ix"], ["f"]).withColumn("f", F.round("f", 4) + F.lit(0.0))


@query(f"""
WITH k AS (SELECT s_suppkey % 2 AS roi, s_suppkey % 3 AS subject, s_suppkey % 9 AS prf_ix FROM supplier WHERE s_acctbal > 0), h AS (SELECT prf_ix, row, col, g / max(g) OVER (PARTITION BY prf_ix) h FROM {_PIXELS})
SELECT roi, subject, row::INTEGER AS row, col::INTEGER AS col, round(avg(h), 6) + 0 AS mean, round(max(h), 6) + 0 AS max FROM k JOIN h USING (prf_ix) GROUP BY ALL
""")
def field_coverage(t):
    k = F.col("s_suppkey")
    members = t.supplier.where("s_acctbal > 0").select((k % 2).alias("roi"), (k % 3).alias("subject"), (k % 9).alias("prf_ix"))
    out = PX.coverage(members, ["roi", "subject"], GR.gaussian_weights(_small(t), 20))
    return out.select("roi", "subject", "row", "col", r6(F.col("mean")).alias("mean"), r6(F.col("max")).alias("max"))


@query(f"""
WITH a AS (SELECT prf_ix, row, col FROM (SELECT *, g / max(g) OVER (PARTITION BY prf_ix) h FROM {_PIXELS}) WHERE h > 0.14),
b AS (SELECT s_suppkey AS id, r.r AS row, c.c AS col FROM supplier, range(20) r(r), range(20) c(c) WHERE r.r BETWEEN s_suppkey % 13 AND s_suppkey % 13 + 4 AND c.c BETWEEN s_suppkey % 11 AND s_suppkey % 11 + 5)
SELECT id AS left_id, prf_ix AS right_id, count(*) AS pixels FROM b JOIN a USING (row, col) GROUP BY ALL HAVING count(*) > 10
""")
def mask_overlap(t):
    """Which fields hold over ten pixels of which mask."""
    from ..operators.joins import pixel_overlap

    k = F.col("s_suppkey")
    b = t.supplier.select(k.alias("id"), F.explode(F.sequence(k % 13, k % 13 + 4)).alias("row"), (k % 11).alias("c")).select("id", F.col("row").cast("int").alias("row"), F.explode(F.sequence(F.col("c").cast("int"), F.col("c").cast("int") + 5)).alias("col"))
    return pixel_overlap(b, GR.field_masks(_small(t), 20).withColumnRenamed("prf_ix", "id"), [])


_RGB = "(SELECT p_partkey, (p_partkey * 37 % 256)::DOUBLE r, (p_partkey * 91 % 256)::DOUBLE g, (p_size * 53 % 256)::DOUBLE b FROM part)"
_LIN = lambda c: f"CASE WHEN {c} / 255 <= 0.04045 THEN {c} / 255 / 12.92 ELSE pow(({c} / 255 + 0.055) / 1.055, 2.4) END"
_F = lambda c: f"CASE WHEN {c} < 216.0 / 24389 THEN {c} / (3 * pow(6.0 / 29, 2)) + 4.0 / 29 ELSE pow({c}, 1.0 / 3) END"


@query(f"""
WITH l AS (SELECT *, {_LIN('r')} lr, {_LIN('g')} lg, {_LIN('b')} lb FROM {_RGB}),
x AS (SELECT *, 0.4124564 * lr + 0.3575761 * lg + 0.1804375 * lb x, 0.2126729 * lr + 0.7151522 * lg + 0.0721750 * lb y, 0.0193339 * lr + 0.1191920 * lg + 0.9503041 * lb z FROM l),
f AS (SELECT *, {_F('(x / 0.95047)')} fx, {_F('y')} fy, {_F('(z / 1.08883)')} fz FROM x)
SELECT p_partkey, round(lr, 6) + 0 AS linear_r, round(x, 6) + 0 AS x, round(y, 6) + 0 AS y, round(z, 6) + 0 AS z, round(116 * fy - 16, 5) + 0 AS l, round(500 * (fx - fy), 5) + 0 AS a, round(200 * (fy - fz), 5) + 0 AS b,
  round(CASE WHEN greatest(r, g, f.b) = 0 THEN 0 ELSE (greatest(r, g, f.b) - least(r, g, f.b)) / greatest(r, g, f.b) END, 6) + 0 AS saturation, round((0.2126 * r + 0.7152 * g + 0.0722 * f.b) / 255, 6) + 0 AS luma FROM f
""")
def colours(t):
    p = F.col("p_partkey")
    rgb = [(p * 37 % 256).cast("double"), (p * 91 % 256).cast("double"), (F.col("p_size") * 53 % 256).cast("double")]
    five = lambda c: F.round(c, 5) + F.lit(0.0)
    return t.part.select(p, r6(C.linear(rgb[0])).alias("linear_r"), *(r6(c).alias(n) for c, n in zip(C.xyz(*rgb), "xyz", strict=True)), *(five(c).alias(n) for c, n in zip(C.lab(*rgb), "lab", strict=True)), r6(C.saturation(*rgb)).alias("saturation"), r6(C.luma(*rgb)).alias("luma"))


_CRGB = "(SELECT s_suppkey AS image_ix, r.r AS row, c.c AS col, ((s_suppkey * 37 + r.r * 11) % 256)::DOUBLE r, ((s_suppkey * 91 + c.c * 7) % 256)::DOUBLE g, ((s_suppkey * 53 + r.r * c.c) % 256)::DOUBLE b FROM supplier, range(20) r(r), range(20) c(c))"


@query(f"""
WITH l AS (SELECT *, {_LIN('r')} lr, {_LIN('g')} lg, {_LIN('b')} lb FROM {_CRGB}),
x AS (SELECT *, 0.4124564 * lr + 0.3575761 * lg + 0.1804375 * lb x, 0.2126729 * lr + 0.7151522 * lg + 0.0721750 * lb y, 0.0193339 * lr + 0.1191920 * lg + 0.9503041 * lb z FROM l),
f AS (SELECT *, {_F('(x / 0.95047)')} fx, {_F('y')} fy, {_F('(z / 1.08883)')} fz FROM x),
k AS (SELECT image_ix, row, col, 116 * fy - 16 AS l, 500 * (fx - fy) AS a, 200 * (fy - fz) AS b, CASE WHEN greatest(r, g, f.b) = 0 THEN 0 ELSE (greatest(r, g, f.b) - least(r, g, f.b)) / greatest(r, g, f.b) END AS s FROM f)
SELECT image_ix, prf_ix, round(sum(w * l), 4) + 0 AS l, round(sum(w * a), 4) + 0 AS a, round(sum(w * b), 4) + 0 AS b, round(sum(w * s), 5) + 0 AS saturation FROM k JOIN {_W} USING (row, col) GROUP BY ALL
""")
def colour_features(t):
    """Lightness, opponent colours and saturation of every image, averaged within each field."""
    i = F.col("s_suppkey")
    row, col = (lambda p: F.floor(p / 20)), (lambda p: p % 20)
    rgb = lambda p: [F.pmod(v, F.lit(256)).cast("double") for v in (i * 37 + row(p) * 11, i * 91 + col(p) * 7, i * 53 + row(p) * col(p))]
    every = F.transform(F.sequence(F.lit(0), F.lit(399)), lambda p: F.struct(*[v.alias(n) for v, n in zip(rgb(p), "RGB", strict=True)]))
    px = t.supplier.select(i.alias("image_ix"), every.alias("px"))
    maps = px.select("image_ix", F.transform("px", lambda v: F.struct(*[c.alias(n) for c, n in zip((*C.lab(v["R"], v["G"], v["B"]), C.saturation(v["R"], v["G"], v["B"])), ("l", "a", "b", "saturation"), strict=True)])).alias("m"))
    names = ["l", "a", "b", "saturation"]
    maps = maps.select("image_ix", *[F.col(f"m.{n}").alias(n) for n in names])
    f = PX.by_field(PX.pooled_images(maps, _small(t), 20, ["image_ix"], names), ["image_ix"], names)
    return f.select("image_ix", "prf_ix", *((F.round(n, 4) + F.lit(0.0)).alias(n) for n in "lab"), (F.round("saturation", 5) + F.lit(0.0)).alias("saturation"))


@query(f"""
SELECT prf_ix, round((x * 8.4)::DOUBLE, 6) + 0 AS x, round((y * 8.4)::DOUBLE, 6) + 0 AS y, round((sigma * 8.4)::DOUBLE, 6) + 0 AS size, round(sqrt((x * x + y * y)::DOUBLE) * 8.4, 6) + 0 AS eccentricity FROM {_OWN}
""")
def field_degrees(t):
    """Place and size of fields in degrees of a screen 8.4 wide."""
    x, y, s = (F.col(k) * 8.4 for k in ("x", "y", "sigma"))
    return _own(t).select("prf_ix", r6(x).alias("x"), r6(y).alias("y"), r6(s).alias("size"), r6(F.sqrt(x * x + y * y)).alias("eccentricity"))


@query("""
WITH g AS (SELECT p_partkey AS prf_ix, (p_partkey % 40) / 40.0::DOUBLE - 0.497 AS x, p_partkey % 1456 // 40 / 40.0::DOUBLE - 0.447 AS y, 0.013 + 0.01 * (p_partkey % 11) AS s FROM part),
c AS (SELECT prf_ix, ceil(s * 2 * 240) AS reach, 120.0 - y * 240 AS r0, x * 240 + 120.0 AS c0 FROM g),
n AS (SELECT prf_ix, reach, CASE WHEN ceil(r0) = floor(r0) THEN r0 + 0.0001 ELSE r0 END AS r, CASE WHEN ceil(c0) = floor(c0) THEN c0 + 0.0001 ELSE c0 END AS c FROM c)
SELECT prf_ix, greatest(least(floor(r - reach), 240), 0)::INTEGER AS xmin, greatest(least(ceil(r + reach), 240), 0)::INTEGER AS xmax, greatest(least(floor(c - reach), 240), 0)::INTEGER AS ymin, greatest(least(ceil(c + reach), 240), 0)::INTEGER AS ymax FROM n
""")
def clipped_boxes(t):
    """Pixel boxes of a field for each part, clipped to the image."""
    i = F.col("p_partkey")
    g = t.part.select(i.alias("prf_ix"), (i % 40 / 40.0 - 0.497).alias("x"), (F.floor(i % 1456 / 40) / 40.0 - 0.447).alias("y"), (0.013 + 0.01 * (i % 11)).alias("sigma"))
    return g.select("prf_ix", G.prf_box(F.col("x"), F.col("y"), F.col("sigma"), 240).alias("b")).select("prf_ix", "b.*")


@query("""
WITH p AS (SELECT s_suppkey, (s_suppkey * 37 % 360)::DOUBLE a, (s_suppkey % 50) / 6.0 + 0.01 e FROM supplier), c AS (SELECT *, e * cos(radians(a)) x, e * sin(radians(a)) y FROM p), b AS (SELECT *, degrees(atan2(y, x)) d FROM c)
SELECT s_suppkey, round(x, 6) + 0 AS x, round(y, 6) + 0 AS y, round(CASE WHEN d < -1e-9 THEN d + 360 ELSE d END, 5) + 0 AS angle, round(sqrt(x * x + y * y), 6) + 0 AS eccentricity, round(2 * exp(3 * (cos((a - 90) / 180 * pi()) - 1)) + 1, 6) AS von_mises FROM b
""")
def polar_coordinates(t):
    k = F.col("s_suppkey")
    a, e = (k * 37 % 360).cast("double"), (k % 50) / 6.0 + 0.01
    x, y = G.pol_to_cart(a, e)
    rows = t.supplier.select(k, a.alias("a"), x.alias("x"), y.alias("y"))
    angle, ecc = G.cart_to_pol(F.col("x"), F.when(F.abs("y") < 1e-12, 0.0).otherwise(F.col("y")))
    vm = G.scaled_curve(G.von_mises(F.col("a"), 90.0, 3.0), F.lit(0.0), F.lit(1.0), 2.0, 1.0, normalise=False)
    return rows.select(k, r6(F.col("x")).alias("x"), r6(F.col("y")).alias("y"), (F.round(angle, 5) + F.lit(0.0)).alias("angle"), r6(ecc).alias("eccentricity"), F.round(vm, 6).alias("von_mises"))


@query("""
WITH b AS (SELECT p_partkey, 100 + p_size * 3 AS h, 120 + p_partkey % 90 AS w, (p_partkey % 10) / 50.0 t, (p_partkey % 7) / 40.0 b, (p_partkey % 5) / 30.0 l, (p_partkey % 3) / 20.0 r FROM part)
SELECT p_partkey, floor(t * h)::BIGINT AS hmin, floor(h - b * h)::BIGINT AS hmax, floor(l * w)::BIGINT AS wmin, floor(w - r * w)::BIGINT AS wmax,
  round(CASE WHEN h > w THEN abs((w / (h * 1.0) - 1) / 2) ELSE 0 END, 6) + 0.0::DOUBLE AS cut_high, round(CASE WHEN h > w THEN 0 ELSE abs((h / (w * 1.0) - 1) / 2) END, 6) + 0.0::DOUBLE AS cut_wide FROM b
""")
def crop_boxes(t):
    k = F.col("p_partkey")
    h, w = (100 + F.col("p_size") * 3).cast("double"), (120 + k % 90).cast("double")
    box = G.crop_box_pixels([k % 10 / 50.0, k % 7 / 40.0, k % 5 / 30.0, k % 3 / 20.0], h, w)
    cut = G.square_crop(h, w)
    return t.part.select(k, *(c.alias(n) for c, n in zip(box, ("hmin", "hmax", "wmin", "wmax"), strict=True)), r6(cut[0]).alias("cut_high"), r6(cut[2]).alias("cut_wide"))


@query("""
WITH b AS (SELECT p_partkey, (p_partkey % 60) * 1.5 AS x, (p_partkey % 40) * 1.25 AS y, (p_size + 3) * 1.0 AS w, (p_size % 9 + 2) * 1.0 AS h FROM part),
v AS (SELECT p_partkey, unnest([x, x + w, x + w, x]) px, unnest([y, y, y + h, y + h]) py, unnest(range(4)) i FROM b)
SELECT p_partkey, i AS vertex, round((px - 5) / 80 * 200, 6) + 0 AS cropped_x, round((py - 10) / 60 * 100, 6) + 0 AS cropped_y, round((px * 2)::DOUBLE, 6) + 0 AS scaled_x, round((py * 0.5)::DOUBLE, 6) + 0 AS scaled_y FROM v
""")
def polygons(t):
    k, s = F.col("p_partkey"), F.col("p_size")
    poly = G.polygon_of_box(k % 60 * 1.5, k % 40 * 1.25, (s + 3) * 1.0, (s % 9 + 2) * 1.0)
    d = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    rows = t.part.select(k, poly.alias("p"))
    rows = rows.select(k, G.polygon_cropped(F.col("p"), d(10, 70, 5, 85), d(100, 200)).alias("c"), G.polygon_scaled(F.col("p"), (100.0, 100.0), (50.0, 200.0)).alias("s"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i"))
    at = lambda a, o: r6(F.get(a, F.col("i") * 2 + o))
    return rows.select(k, F.col("i").cast("long").alias("vertex"), at("c", 0).alias("cropped_x"), at("c", 1).alias("cropped_y"), at("s", 0).alias("scaled_x"), at("s", 1).alias("scaled_y"))


@query("""
WITH p AS (SELECT i, 2.0 + i % 5 x1, 3.0 + i % 4 y1, 14.0 - i % 3 x2, 4.5 + i % 2 y2, 8.0 + i % 6 x3, 15.0 - i % 5 y3 FROM (SELECT p_partkey AS i FROM part)),
q AS (SELECT i, c.c + 0.5 AS x, r.r + 0.5 AS y, p.* FROM p, range(18) r(r), range(18) c(c))
SELECT i AS id, count(*) AS pixels FROM q
WHERE (CASE WHEN (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / nullif(y2 - y1, 0) + x1 THEN 1 ELSE 0 END + CASE WHEN (y2 > y) <> (y3 > y) AND x < (x3 - x2) * (y - y2) / nullif(y3 - y2, 0) + x2 THEN 1 ELSE 0 END + CASE WHEN (y3 > y) <> (y1 > y) AND x < (x1 - x3) * (y - y3) / nullif(y1 - y3, 0) + x3 THEN 1 ELSE 0 END) % 2 = 1 GROUP BY i
""")
def polygon_masks(t):
    i = F.col("id")
    p = t.part.select(F.col("p_partkey").alias("id")).select(i, F.array(*[c.cast("double") for c in (2.0 + i % 5, 3.0 + i % 4, 14.0 - i % 3, 4.5 + i % 2, 8.0 + i % 6, 15.0 - i % 5)]).alias("p"))
    px = p.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(17)))).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(17))))
    return px.where(G.inside_polygon(F.col("col") + 0.5, F.col("row") + 0.5, F.col("p"))).groupBy("id").agg(F.count("*").alias("pixels"))


@query()
def field_boxes(t):
    """Pixel boxes of each channel's field of the default grid; tested against a plain loop."""
    g = _of_channels(t, GR.prf_grid(t.spark, 5))
    return g.select("voxel_ix", "prf_ix", G.prf_box(F.col("x"), F.col("y"), F.col("sigma"), 240).alias("b"), G.prf_box(F.col("x"), F.col("y"), F.col("sigma"), 240, min_pix=8, square=True).alias("s")).select("prf_ix", "b.*", *(F.col(f"s.{c}").alias(f"square_{c}") for c in ("xmin", "xmax", "ymin", "ymax")))


@query("""
WITH z AS (SELECT s_suppkey, cos(s_suppkey * 0.3) * (s_suppkey % 7 + 1) re, sin(s_suppkey * 0.3) * (s_suppkey % 7 + 1) im FROM supplier)
SELECT s_suppkey, round(sqrt(re * re + im * im) * cos(2 * atan2(im, re)), 6) + 0 AS re, round(sqrt(re * re + im * im) * sin(2 * atan2(im, re)), 6) + 0 AS im FROM z
""")
def double_phase(t):
    k = F.col("s_suppkey")
    z = G.double_phase(F.cos(k * 0.3) * (k % 7 + 1), F.sin(k * 0.3) * (k % 7 + 1))
    return t.supplier.select(k, z.alias("z")).select(k, r6(F.col("z.re")).alias("re"), r6(F.col("z.im")).alias("im"))
