"""Image kernels over generated images, one row an image."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import kernels as K
from ..operators import templates as TE
from ..operators.ranking import top
from ..sources import hdf5 as H
from ..sources import ingest as IN
from ..sources.shared import scratch
from .registry import query


def _images(t, side: int = 32, per_task: int | None = None):
    """Deterministic images, one for each supplier; where per_task is given, the keys are dealt to tasks of about so many images first."""
    k = F.col("s_suppkey")
    i = F.sequence(F.lit(0), F.lit(side * side - 1))
    px = F.transform(i, lambda p: (F.pmod(k * 31 + F.floor(p / side) * F.floor(p / side) * 7 + (p % side) * 13 + F.floor(p / side) * (p % side), F.lit(256))).cast("double"))
    suppliers = t.supplier if per_task is None else t.supplier.repartition(max(1, -(-t.supplier.count() // per_task)))
    return suppliers.select(k.alias("image_ix"), F.lit(side).alias("w"), px.alias("px"))


def _short(df):
    return df.select("image_ix", F.transform("f", lambda x: F.round(x, 4)).alias("f"))


@query()
def gabor_features(t):
    """Mean Gabor energy of each filter."""
    return _short(K.per_image(_images(t), lambda x: K.gabor_energy(x, 6, 3).mean(axis=(-2, -1))))


@query()
def gabor_maps(t):
    """Gabor energy without averaging: the largest value of each 4 by 4 block of each filter's map."""
    return _short(K.per_image(_images(t), lambda x: K.max_pool(K.gabor_energy(x, 4, 2), 4)))


@query()
def gist_features(t):
    """Scene descriptors. A few MB of suppliers are one task when read, so their keys are dealt out."""
    return _short(K.per_image(_images(t, per_task=512), K.gist))


@query()
def texture_features(t):
    """All 641 texture statistics under one field."""
    import numpy as np

    return _short(K.per_image(_images(t), lambda x: np.concatenate(list(K.texture_statistics(x, (0.0, 0.0, 0.2)).values()), axis=-1)))


_SIDE = "(SELECT s_suppkey AS image_ix, r, c, ((s_suppkey * 31 + r * r * 7 + c * 13 + r * c) % 256)::DOUBLE v FROM supplier, range(32) a(r), range(32) b(c))"


@query(f"""
WITH g AS (SELECT r, c, exp(-(pow(-0.5 + c / 31.0 - 0.1, 2) + pow(-0.5 + r / 31.0 + 0.2, 2)) / (2 * 0.15 * 0.15)) g FROM range(32) a(r), range(32) b(c)), w AS (SELECT r, c, g / sum(g) OVER () w FROM g),
m AS (SELECT image_ix, sum(w * v) m FROM {_SIDE} JOIN w USING (r, c) GROUP BY ALL),
s AS (SELECT image_ix, any_value(m) m, sum(w * pow(v - m, 2)) + 1e-6 var, sum(w * pow(v - m, 3)) c3, sum(w * pow(v - m, 4)) c4, min(v) low, max(v) high FROM {_SIDE} JOIN w USING (r, c) JOIN m USING (image_ix) GROUP BY ALL)
SELECT image_ix, round(m, 5) + 0 AS mean, round(var, 4) + 0 AS var, round(c3 / pow(var, 1.5), 5) + 0 AS skew, round(c4 / (var * var), 5) + 0 AS kurtosis, low, high FROM s
""")
def texture_pixel_stats(t):
    """The texture statistics' first group, which SQL can state."""
    f = K.per_image(_images(t), lambda x: K.texture_statistics(x, (0.1, 0.2, 0.15))["pixel_stats"])
    places = (5, 4, 5, 5, 1, 1)
    return f.select("image_ix", *((F.round(F.col("f")[k], n) + F.lit(0.0)).alias(name) for k, (name, n) in enumerate(zip(("mean", "var", "skew", "kurtosis", "low", "high"), places, strict=True))))


@query()
def curvature_features(t):
    banks = [[K.bent_kernel(0.4, b, o, 15, c) for o in (0, 45, 90, 135)] for b, c in ((0.1, True), (0.4, False), (0.0, True))]
    return _short(K.per_image(_images(t), lambda x: K.curvature_scores(x, *banks)))


@query("""
WITH p AS (SELECT s_suppkey AS image_ix, r, c, ((s_suppkey * 31 + r * r * 7 + c * 13 + r * c) % 256)::DOUBLE v FROM supplier, range(32) a(r), range(32) b(c)),
k AS (SELECT image_ix, i, j, avg(v) m FROM p, range(5) x(i), range(5) y(j) WHERE r >= i * 32 // 5 AND r < (i + 1) * 32 // 5 AND c >= j * 32 // 5 AND c < (j + 1) * 32 // 5 GROUP BY ALL)
SELECT image_ix, i AS block_row, j AS block_col, round(m, 4) + 0 AS mean FROM k
""")
def block_means(t):
    f = K.per_image(_images(t), lambda x: K.block_means(x, 5))
    out = f.select("image_ix", F.posexplode("f").alias("k", "m"))
    return out.select("image_ix", F.floor(F.col("k") / 5).alias("block_row"), (F.col("k") % 5).cast("long").alias("block_col"), (F.round("m", 4) + F.lit(0.0)).alias("mean"))


@query("""
WITH r AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(64)) AS k, label FROM embeddings)
SELECT label, count(DISTINCT vec_id) AS n, round(sum(v), 5) + 0 AS total, round(sum(v * k), 4) + 0 AS mixed FROM r GROUP BY label
""")
def container_rows(t):
    """Embeddings written as HDF5 containers by many tasks, read back by row, and summed by class."""
    H.register(t.spark)
    path = scratch(t.spark, "containers")
    e = t.embeddings.select(F.col("vec_id").alias("row"), F.transform("embedding", lambda x: x.cast("double")).alias("values"))
    e.write.format("hdf5").option("path", path).mode("append").save()
    read = t.spark.read.format("hdf5").option("path", path)
    ids = read.option("dataset", "row").load().select("file", "row", F.col("values")[0].alias("vec_id"))
    values = read.option("dataset", "values").load().join(ids, ["file", "row"]).join(t.embeddings.select("vec_id", "label"), "vec_id")
    total = F.aggregate("values", F.lit(0.0), lambda a, v: a + v)
    mixed = F.aggregate(F.transform("values", lambda v, k: v * k), F.lit(0.0), lambda a, v: a + v)
    return values.groupBy("label").agg(F.count("*").alias("n"), (F.round(F.sum(total), 5) + F.lit(0.0)).alias("total"), (F.round(F.sum(mixed), 4) + F.lit(0.0)).alias("mixed"))


def _tiles(t):
    """A tile of 8 by 8 pixels for each part."""
    k = F.col("p_partkey")
    px = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda p: F.pmod(k * 31 + F.floor(p / 8) * F.floor(p / 8) * 7 + (p % 8) * 13 + F.floor(p / 8) * (p % 8) * (k % 5), F.lit(256)).cast("double"))
    return t.part.select(k.alias("image_ix"), F.lit(8).alias("w"), px.alias("px"))


_BANK = TE.Bank((0.5, 0.8), (0.0, 0.3), (0.0, 40.0, 80.0, 120.0), 5)


def _kernels(which):
    return ", ".join(f"({k}, {f!r}::DOUBLE, {b!r}::DOUBLE, {a!r}::DOUBLE)" for k, (f, b, a) in enumerate(which))


#: Squared response of each kernel of the bank at each place, from u, v, the wave less its weighted mean, and unit norm.
_RESPONSES = f"""
WITH kernel AS (SELECT 0 AS curved, * FROM (VALUES {_kernels(_BANK.linear)}) a(n, f, b, t) UNION ALL SELECT 1, * FROM (VALUES {_kernels(_BANK.curved)}) c(n, f, b, t)),
q AS (SELECT curved, n, f, i.i, j.j, (j.j - 2) * cos(radians(t)) + (i.i - 2) * sin(radians(t)) + b * pow(-(j.j - 2) * sin(radians(t)) + (i.i - 2) * cos(radians(t)), 2) AS u, -(j.j - 2) * sin(radians(t)) + (i.i - 2) * cos(radians(t)) AS v FROM kernel, range(5) i(i), range(5) j(j)),
g AS (SELECT *, exp(-f * f / 2 * (u * u + v * v / 4)) AS g, cos(pi() * f * u) AS re, sin(pi() * f * u) AS im FROM q),
m AS (SELECT curved, n, sum(g * re) / sum(g) AS re, sum(g * im) / sum(g) AS im FROM g GROUP BY ALL),
k AS (SELECT g.curved, g.n, i, j, g * (g.re - m.re) AS re, g * (g.im - m.im) AS im FROM g JOIN m ON g.curved = m.curved AND g.n = m.n),
z AS (SELECT curved, n, sqrt(sum(re * re + im * im)) AS norm FROM k GROUP BY ALL),
px AS (SELECT p_partkey AS image_ix, r.r AS r, c.c AS c, ((p_partkey * 31 + r.r * r.r * 7 + c.c * 13 + r.r * c.c * (p_partkey % 5)) % 256)::DOUBLE AS x FROM part, range(8) r(r), range(8) c(c)),
o AS (SELECT image_ix, k.curved, k.n, (r + i - 2 + 8) % 8 AS y, (c + j - 2 + 8) % 8 AS x0, sum(x * k.re) / any_value(norm) AS re, sum(x * k.im) / any_value(norm) AS im FROM px, k JOIN z ON z.curved = k.curved AND z.n = k.n GROUP BY ALL),
p AS (SELECT image_ix, curved, n, round(max(sqrt(re * re + im * im)), 6) AS response FROM o GROUP BY ALL)"""


@query(f"""{_RESPONSES}
SELECT image_ix, round(max(response) FILTER (curved = 0), 4) + 0 AS linear, round(max(response) FILTER (curved = 1), 4) + 0 AS curved FROM p GROUP BY ALL
""")
def template_curvature(t):
    """The strongest straight and the strongest bent filter's response to each tile."""
    four = lambda c: F.round(c, 4) + F.lit(0.0)
    return TE.best_kernels(_tiles(t), _BANK).select("image_ix", four("linear").alias("linear"), four("curved").alias("curved"))


_TILE_PIXELS = "px AS (SELECT p_partkey AS image_ix, r.r AS r, c.c AS c, ((p_partkey * 31 + r.r * r.r * 7 + c.c * 13 + r.r * c.c * (p_partkey % 5)) % 256)::DOUBLE AS x FROM part, range(8) r(r), range(8) c(c))"


@query(f"""
WITH g AS (SELECT a.a AS a, i.i AS i, j.j AS j, exp(-(pow(j.j / 7.0 - 0.5, 2) + pow(i.i / 7.0 - 0.5, 2)) * 18) AS g, 6 * pi() * ((j.j / 7.0 - 0.5) * cos(a.a * pi() / 2) + (i.i / 7.0 - 0.5) * sin(a.a * pi() / 2)) AS phase FROM range(2) a(a), range(8) i(i), range(8) j(j)),
m AS (SELECT a, sum(g * sin(phase + pi() / 2)) / sum(g) AS mean FROM g GROUP BY a),
k AS (SELECT a, i, j, g * (sin(phase + pi() / 2) - mean) AS re, g * sin(phase) AS im FROM g JOIN m USING (a)),
n AS (SELECT a, sum(sqrt(re * re + im * im)) AS total FROM k GROUP BY a),
{_TILE_PIXELS},
o AS (SELECT image_ix, k.a, (r + i + 4) % 8 AS y, (c + j + 4) % 8 AS x0, sqrt(pow(sum(x * re), 2) + pow(sum(x * im), 2)) / any_value(total) AS e FROM px, k JOIN n USING (a) GROUP BY ALL)
SELECT image_ix, round(avg(ln(1 + sqrt(e))) FILTER (a = 0), 5) + 0 AS level, round(avg(ln(1 + sqrt(e))) FILTER (a = 1), 5) + 0 AS upright FROM o GROUP BY ALL
""")
def gabor_tiles(t):
    """Mean compressed Gabor energy of each tile at one frequency and two orientations, which SQL can state."""
    f = K.per_image(_tiles(t), lambda x: K.gabor_energy(x, 2, 1).mean(axis=(-2, -1)))
    return f.select("image_ix", *[(F.round(F.col("f")[k], 5) + F.lit(0.0)).alias(n) for k, n in enumerate(("level", "upright"))])


@query(f"""
WITH q AS (SELECT family, a.a AS a, i.i AS i, j.j AS j, (j.j - 2) * cos(radians(a.a * 40)) + (i.i - 2) * sin(radians(a.a * 40)) AS u0, -(j.j - 2) * sin(radians(a.a * 40)) + (i.i - 2) * cos(radians(a.a * 40)) AS v FROM (VALUES (0), (1), (2)) f(family), range(2) a(a), range(5) i(i), range(5) j(j)),
w AS (SELECT *, u0 + CASE family WHEN 0 THEN 0.3 * v * v WHEN 1 THEN 0.4 * abs(v) ELSE 0 END AS u FROM q),
g AS (SELECT *, exp(-0.125 * (u * u + v * v / 4)) AS g, cos(pi() * u / 2) AS re, sin(pi() * u / 2) AS im FROM w),
m AS (SELECT family, a, sum(g * re) / sum(g) AS re, sum(g * im) / sum(g) AS im FROM g GROUP BY ALL),
k AS (SELECT g.family, g.a, i, j, g * (g.re - m.re) AS re, g * (g.im - m.im) AS im FROM g JOIN m ON g.family = m.family AND g.a = m.a),
z AS (SELECT family, a, sqrt(sum(re * re + im * im)) AS norm FROM k GROUP BY ALL),
{_TILE_PIXELS},
o AS (SELECT image_ix, k.family, k.a, (r + i - 2 + 8) % 8 AS y, (c + j - 2 + 8) % 8 AS x0, sqrt(pow(sum(x * re), 2) + pow(sum(x * im), 2)) / any_value(norm) AS e FROM px, k JOIN z ON z.family = k.family AND z.a = k.a GROUP BY ALL),
p AS (SELECT image_ix, family, a, avg(e) AS power FROM o GROUP BY ALL)
SELECT image_ix, round(avg(power) FILTER (family = 0), 4) + 0 AS curved, round(avg(power) FILTER (family = 1), 4) + 0 AS angular, round(avg(power) FILTER (family = 2), 4) + 0 AS linear FROM p GROUP BY ALL
""")
def curvature_tiles(t):
    """Mean response of three families of bent kernels to each tile, which SQL can state."""
    banks = [[K.bent_kernel(0.5, b, o, 5, c) for o in (0, 40)] for b, c in ((0.3, True), (0.4, False), (0.0, True))]
    f = K.per_image(_tiles(t), lambda x: K.curvature_scores(x, *banks))
    return f.select("image_ix", *[(F.round(F.col("f")[k], 4) + F.lit(0.0)).alias(n) for k, n in enumerate(("curved", "angular", "linear"))])


@query()
def template_table(t):
    """Frequency, bend and angle of each tile; those of junctions are straight. Tested against a plain search."""
    straight = t.part.where("p_size % 4 = 0").select(F.col("p_partkey").alias("image_ix"))
    return TE.template_table(_tiles(t), _BANK, straight).select("image_ix", "is_curved", "frequency", "bend", "angle", F.round("response", 4).alias("response"))


@query(f"""{_RESPONSES},
s AS (SELECT l_suppkey, l_partkey, round(avg(l_discount), 8) v FROM lineitem GROUP BY ALL), h AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY v DESC, l_partkey) k FROM s QUALIFY k <= 10),
b AS (SELECT image_ix, max(response) FILTER (curved = 1) / max(response) FILTER (curved = 0) AS bent FROM p GROUP BY ALL)
SELECT l_suppkey, count(*) AS n, round(avg(bent), 4) + 0 AS bent FROM h JOIN b ON image_ix = l_partkey GROUP BY ALL
""")
def top_image_curvature(t):
    """Mean curvature of each channel's ten best images; pixels are read only for images that are some channel's best."""
    s = t.lineitem.groupBy("l_suppkey", "l_partkey").agg(F.round(F.avg("l_discount"), 8).alias("v"))
    best = top(s, ["l_suppkey"], F.col("v"), "l_partkey", 10).select("l_suppkey", F.col("l_partkey").alias("image_ix"))
    out = TE.scored_top_images(best, _tiles(t), _BANK).groupBy("l_suppkey")
    return out.agg(F.count("*").alias("n"), (F.round(F.avg("bent"), 4) + F.lit(0.0)).alias("bent"))


@query("""
WITH p AS (SELECT s_suppkey AS image_ix, r.r AS r, c.c AS c, (s_suppkey * 31 + r.r * r.r * 7 + c.c * 13 + r.r * c.c) % 256 AS v FROM supplier, range(32) r(r), range(32) c(c) WHERE r.r BETWEEN 4 AND 27 AND c.c BETWEEN 4 AND 27),
b AS (SELECT image_ix, (r - 4) // 2 AS y, (c - 4) // 2 AS x, floor(sum(v) / 4 + 0.5) AS v FROM p GROUP BY ALL)
SELECT image_ix, count(*) AS n, sum(v)::BIGINT AS total, sum(v * (y * 12 + x))::BIGINT AS mixed FROM b GROUP BY ALL
""")
def ingested_images(t):
    """Decoded images, cut to their middle by a crop box, halved by the mean of each four pixels, stored by number and read back."""
    packed = F.unhex(F.array_join(F.transform("px", lambda v: F.lpad(F.hex(v.cast("long")), 2, "0")), ""))
    decoded = _images(t).select("image_ix", F.col("w").alias("height"), "w", F.lit(1).alias("channels"), packed.alias("data"), F.array(*[F.lit(0.125)] * 4).alias("crop_box"))
    path = scratch(t.spark, "images")
    IN.store_images(IN.ingested(decoded, 12, channels=1, kernel="box"), path)
    total = lambda f: F.aggregate(F.transform("px", f), F.lit(0.0), lambda a, v: a + v).cast("long")
    return IN.stored_images(t.spark, path).select("image_ix", F.size("px").cast("long").alias("n"), total(lambda v: v).alias("total"), total(lambda v, k: v * k).alias("mixed"))
