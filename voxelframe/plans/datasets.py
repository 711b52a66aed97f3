"""Trials, sessions, selections and regions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stats import noise_ceiling, r6
from ..operators import rois as RO
from ..operators import trials as TR
from ..sources import stores as ST
from .registry import query


@query("SELECT o_orderkey AS trial_ix, (o_orderkey // 750)::BIGINT AS session FROM orders")
def session_index(t):
    return t.orders.select(F.col("o_orderkey").alias("trial_ix"), TR.session_of(F.col("o_orderkey")).alias("session"))


@query("SELECT o_orderkey AS trial_ix, o_custkey - 1 AS image_ix FROM orders")
def trial_images(t):
    return TR.trial_order(t.orders, "o_orderkey", "o_custkey")


@query("SELECT o_orderkey, CASE WHEN o_orderkey >= 10 THEN (o_orderkey - 10) // 64 END AS batch, round(o_totalprice / 1073741824.0, 12) AS gigabytes FROM orders")
def batches(t):
    k = F.col("o_orderkey")
    return t.orders.select(k, TR.batch_of(k, 10, 64).alias("batch"), F.round(TR.gigabytes(F.col("o_totalprice")), 12).alias("gigabytes"))


@query("""
WITH v AS (SELECT l_suppkey AS voxel_ix, l_linenumber AS session, l_orderkey % 750 AS trial, l_extendedprice AS value FROM lineitem WHERE l_linenumber IN (3, 1) AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)),
z AS (SELECT voxel_ix, session, CASE session WHEN 3 THEN 0 ELSE 750 END + trial AS trial_ix, (value / 300 - avg(value / 300) OVER w) / (stddev_pop(value / 300) OVER w + 1e-6) z FROM v WINDOW w AS (PARTITION BY voxel_ix, session))
SELECT voxel_ix, session, trial_ix, count(*) AS n, round(sum(z), 5) + 0 AS z FROM z GROUP BY ALL
""")
def session_responses(t):
    """Two sessions of the masked voxels, standardised and numbered on."""
    v = t.lineitem.select(F.col("l_suppkey").alias("voxel_ix"), F.col("l_linenumber").alias("session"), (F.col("l_orderkey") % 750).alias("trial"), F.col("l_extendedprice").alias("value"))
    mask = t.supplier.where("s_acctbal > 0").select(F.col("s_suppkey").alias("voxel_ix"))
    out = TR.session_responses(v, [3, 1], mask).groupBy("voxel_ix", "session", "trial_ix")
    return out.agg(F.count("*").alias("n"), (F.round(F.sum("z"), 5) + F.lit(0.0)).alias("z"))


@query("""
WITH m AS (SELECT user_id AS voxel_ix, event_type, avg(value) v FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY user_id HAVING count(*) > 5) GROUP BY ALL)
SELECT voxel_ix, round(max(v) FILTER (event_type = 'view'), 6) + 0 AS view, round(max(v) FILTER (event_type = 'click') * 0.01, 6) + 0 AS click, round(max(v) FILTER (event_type = 'purchase'), 6) + 0 AS purchase FROM m WHERE event_type IN ('view', 'click', 'purchase') GROUP BY ALL
""")
def voxel_attributes(t):
    """Maps side by side for the masked voxels, one of them in percent."""
    maps = t.events.groupBy(F.col("user_id").alias("voxel_ix"), F.col("event_type").alias("name")).agg(F.avg("value").alias("value"))
    mask = t.events.groupBy(F.col("user_id").alias("voxel_ix")).count().where("count > 5")
    out = TR.voxel_attributes(maps, ["view", "click", "purchase"], mask, {"click": 0.01})
    return out.select("voxel_ix", *(r6(F.col(c)).alias(c) for c in ("view", "click", "purchase")))


@query("""
SELECT s_suppkey AS voxel_ix, round(100 * pow(s_acctbal / 5000, 2) / (pow(s_acctbal / 5000, 2) + 1.0 / 3), 6) + 0 AS ceiling FROM supplier WHERE s_acctbal > 0
""")
def masked_ceilings(t):
    """Noise ceilings of the voxels of a mask."""
    rows = t.supplier.where("s_acctbal > 0")
    return rows.select(F.col("s_suppkey").alias("voxel_ix"), r6(noise_ceiling(F.col("s_acctbal") / 5000, 3)).alias("ceiling"))


@query("""
SELECT o.o_orderkey AS trial_ix, o.o_custkey AS image_ix, l.n, c.c_nationkey FROM (SELECT * FROM orders WHERE o_orderstatus = 'P') o JOIN (SELECT l_orderkey, count(*) n FROM lineitem GROUP BY ALL) l ON l.l_orderkey = o.o_orderkey JOIN customer c ON c.c_custkey = o.o_custkey
""")
def trial_lookup(t):
    trials = t.orders.select(F.col("o_orderkey").alias("trial_ix"), F.col("o_custkey").alias("image_ix"))
    responses = t.lineitem.groupBy(F.col("l_orderkey").alias("trial_ix")).agg(F.count("*").alias("n"))
    images = t.customer.select(F.col("c_custkey").alias("image_ix"), "c_nationkey")
    wanted = t.orders.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("trial_ix"))
    return TR.trial_rows(trials, responses, images, wanted).select("trial_ix", "image_ix", "n", "c_nationkey")


def _features(t):
    """features(prf_ix, image_ix, f): field p holds entries 16p to 16p + 15 of an embedding."""
    f = F.slice(F.transform("embedding", lambda x: x.cast("double")), F.col("prf_ix") * 16 + 1, F.lit(16))
    return t.embeddings.withColumn("prf_ix", F.explode(F.sequence(F.lit(0), F.lit(3)))).select("prf_ix", F.col("vec_id").alias("image_ix"), f.alias("f"))


@query("""
WITH x AS (SELECT f.f AS prf_ix, vec_id AS image_ix, k.k, embedding[f.f * 16 + k.k + 1]::DOUBLE v FROM embeddings, (VALUES (1), (3)) f(f), range(16) k(k) WHERE label < 5),
z AS (SELECT prf_ix, image_ix, k, (v - avg(v) OVER w) / stddev_pop(v) OVER w z FROM x WINDOW w AS (PARTITION BY prf_ix, k))
SELECT prf_ix, image_ix, round(sum(z), 5) + 0 AS total, round(max(z), 5) + 0 AS largest FROM z GROUP BY ALL
""")
def selected_features(t):
    """Two fields of the images of five classes, standardised."""
    images = t.embeddings.where("label < 5").select(F.col("vec_id").alias("image_ix"))
    rows = TR.selected_features(_features(t), images, [1, 3], zscore=True)
    five = lambda c: F.round(c, 5) + F.lit(0.0)
    return rows.select("prf_ix", "image_ix", five(F.aggregate("f", F.lit(0.0), lambda a, v: a + v)).alias("total"), five(F.array_max("f")).alias("largest"))


@query("""
WITH f AS (SELECT o_custkey, max((o_orderstatus = 'F')::INTEGER) a, max((o_orderpriority = '1-URGENT')::INTEGER) b, max((o_orderpriority = '2-HIGH')::INTEGER) c FROM orders GROUP BY ALL)
SELECT n.i::INTEGER AS prf_ix, o_custkey, a AS filled, greatest(b, c) AS pressing FROM f, range(3) n(i)
""")
def field_labels(t):
    """Labels by set, of whole images, repeated for each field."""
    is_ = lambda c, v: F.max((F.col(c) == v).cast("int"))
    flags = t.orders.groupBy("o_custkey").agg(is_("o_orderstatus", "F").alias("a"), is_("o_orderpriority", "1-URGENT").alias("b"), is_("o_orderpriority", "2-HIGH").alias("c"))
    chosen = TR.label_set(flags, ["o_custkey"], {"filled": ["a"], "pressing": ["b", "c"]})
    return TR.by_field(chosen, t.spark.range(3).select(F.col("id").cast("int").alias("prf_ix")))


def _draw(key, seed):
    return f"((({key}) + 1) * 48271 + (({seed}) + 1) * 69621 + (({key}) % 7919) * (({seed}) % 7907 + 1) * 31) % 1000003"


@query(f"SELECT p_brand, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY {_draw('p_partkey', 1718)}, p_partkey) k FROM part) WHERE k <= 41")
def balanced_set(t):
    return TR.balanced_set(t.part.select("p_brand", "p_partkey"), "p_brand", "p_partkey", 41, 1718)


@query("""
SELECT c_custkey AS voxel_ix, c_nationkey AS prf_ix, (n_nationkey % 5 - 2) / 5.0 AS x, (n_nationkey // 5 - 2) / 5.0 AS y FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
""")
def precomputed_fields(t):
    k = F.col("n_nationkey")
    grid = t.nation.select(k.alias("prf_ix"), ((k % 5 - 2) / 5.0).alias("x"), ((F.floor(k / 5) - 2) / 5.0).alias("y"), F.lit(0.1).alias("sigma"))
    fields = t.customer.select(F.col("c_custkey").alias("voxel_ix"), F.col("c_nationkey").alias("prf_ix"))
    return TR.fields_of_channels(t.customer.select(F.col("c_custkey").alias("voxel_ix")), fields, grid).select("voxel_ix", "prf_ix", "x", "y")


@query("""
WITH s AS (SELECT l_partkey, l_suppkey, round(avg(l_discount), 8) v FROM lineitem GROUP BY ALL)
SELECT l_partkey, min_by(l_suppkey, struct_pack(s := -v, k := l_suppkey)) AS best, round(max(v), 6) + 0 AS score FROM s GROUP BY ALL
""")
def best_kernel(t):
    """The kernel of largest response for each image."""
    rows = t.lineitem.groupBy("l_partkey", "l_suppkey").agg(F.round(F.avg("l_discount"), 8).alias("v"))
    return TR.best_of(rows, ["l_partkey"], "v", "l_suppkey").withColumn("score", r6(F.col("score")))


@query("""
WITH s AS (SELECT s_suppkey, s_nationkey % 4 AS a, s_suppkey % 5 AS b, s_acctbal FROM supplier),
l AS (SELECT s_suppkey AS voxel_ix, CASE WHEN a > 0 THEN 'ret:' || a WHEN b > 0 THEN 'cat:' || b END AS label, s_acctbal AS ceiling FROM s)
SELECT voxel_ix, label, round(ceiling, 4) + 0 AS ceiling FROM l WHERE label IS NOT NULL OR ceiling > 2000
""")
def voxel_regions(t):
    """Labels by priority, and voxels over a ceiling."""
    k = F.col("s_suppkey")
    named = F.create_map(F.lit("ret"), (F.col("s_nationkey") % 4).cast("double"), F.lit("cat"), (k % 5).cast("double"), F.lit("nc"), F.col("s_acctbal"))
    maps = t.supplier.select(k.alias("voxel_ix"), F.explode(named).alias("name", "value"))
    return RO.voxel_table(maps, ["ret", "cat"], ["ret", "cat"], "nc", 2000.0).select("voxel_ix", "label", (F.round("ceiling", 4) + F.lit(0.0)).alias("ceiling"))


@query("SELECT c_custkey AS voxel_ix, c_nationkey AS roi FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = (SELECT min(n_name) FROM nation)")
def region_members(t):
    names = t.nation.select(F.col("n_nationkey").alias("roi"), F.col("n_name").alias("name"))
    rois = t.customer.select(F.col("c_custkey").alias("voxel_ix"), F.col("c_nationkey").alias("roi"))
    return RO.members(rois, names, name=names.agg(F.min("name")).first()[0])


@query("""
SELECT 'a' AS subject, s_suppkey AS voxel_ix, s_nationkey AS roi FROM supplier UNION ALL SELECT 'b', c_custkey + (SELECT max(s_suppkey) + 1 FROM supplier), c_nationkey FROM customer
""")
def subject_regions(t):
    """Two subjects' regions, voxels numbered on."""
    a = t.supplier.select(F.col("s_suppkey").alias("voxel_ix"), F.col("s_nationkey").alias("roi"))
    b = t.customer.select(F.col("c_custkey").alias("voxel_ix"), F.col("c_nationkey").alias("roi"))
    return RO.all_subjects({"a": a, "b": b})


@query("SELECT o_orderkey AS voxel_ix, s_nationkey AS roi FROM orders LEFT JOIN supplier ON s_suppkey = o_orderkey")
def region_map(t):
    cells = t.orders.select(F.col("o_orderkey").alias("voxel_ix"))
    return RO.roi_map(cells, t.supplier.select(F.col("s_suppkey").alias("voxel_ix"), F.col("s_nationkey").alias("roi")))


@query("""
WITH r AS (SELECT l_orderkey AS trial_ix, sum(l_quantity) - 100 AS residual FROM lineitem GROUP BY ALL) SELECT trial_ix, round(residual, 4) + 0 AS residual FROM r WHERE trial_ix IN (SELECT o_orderkey FROM orders)
""")
def checked_residuals(t):
    """Residuals that cover exactly the trials of the model they are added to."""
    rows = t.lineitem.groupBy(F.col("l_orderkey").alias("trial_ix")).agg((F.sum("l_quantity") - 100).alias("residual"))
    trials = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select(F.col("o_orderkey").alias("trial_ix"))
    return TR.checked_residuals(rows.join(t.orders.select(F.col("o_orderkey").alias("trial_ix")), "trial_ix", "left_semi"), trials).withColumn("residual", F.round("residual", 4) + F.lit(0.0))


@query("""
WITH x AS (SELECT f.f AS prf_ix, label, k.k AS feat_ix, embedding[f.f * 16 + k.k + 1]::DOUBLE v FROM embeddings, range(4) f(f), range(16) k(k)),
a AS (SELECT prf_ix, feat_ix, c.c AS axis, v, (label = c.c)::INTEGER l FROM x, range(10) c(c))
SELECT prf_ix::INTEGER AS prf_ix, feat_ix, axis, count(*) AS n, round(covar_pop(v, l) / nullif(sqrt(var_pop(v) * var_pop(l)), 0), 6) + 0 AS r FROM a GROUP BY ALL
""")
def field_label_correlations(t):
    """Correlation of each feature of each field with each label, from one pass over sums by class."""
    f = _features(t).join(t.embeddings.select(F.col("vec_id").alias("image_ix"), "label"), "image_ix")
    long = f.select("prf_ix", "label", F.posexplode("f").alias("feat_ix", "v"))
    sums = long.groupBy("prf_ix", "feat_ix", "label").agg(F.count("*").alias("c"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))
    each = sums.withColumn("axis", F.explode(F.sequence(F.lit(0), F.lit(9))))
    hit = F.col("label") == F.col("axis")
    a = each.groupBy("prf_ix", "feat_ix", "axis").agg(F.sum("c").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.when(hit, F.col("c")).otherwise(0)).alias("k"), F.sum(F.when(hit, F.col("s")).otherwise(0.0)).alias("p"))
    n, k = F.col("n"), F.col("k")
    r = F.try_divide(F.col("p") / n - F.col("s") / n * (k / n), F.nullif(F.sqrt((F.col("q") / n - F.col("s") / n * (F.col("s") / n)) * (k / n) * (1 - k / n)), F.lit(0.0)))
    return a.select("prf_ix", F.col("feat_ix").cast("long").alias("feat_ix"), F.col("axis").cast("long").alias("axis"), "n", r6(r).alias("r"))


@query("""
WITH s AS (SELECT label AS "set", vec_id FROM embeddings UNION ALL SELECT 100 + vec_id % 3, vec_id FROM embeddings), f AS (SELECT vec_id, k.k AS feat_ix, embedding[k.k + 1]::DOUBLE v FROM embeddings, range(64) k(k))
SELECT "set", feat_ix, count(*) n, round(avg(v), 6) + 0 AS mean, round(var_pop(v), 6) + 0 AS var FROM s JOIN f USING (vec_id) GROUP BY ALL
""")
def feature_stats_by_set(t):
    """Mean and variance of each feature over sets of trials that overlap."""
    from ..operators.aggregates import feature_stats

    k = F.col("vec_id")
    sets = t.embeddings.select(F.col("label").cast("long").alias("set"), k).union(t.embeddings.select((100 + k % 3).cast("long"), k))
    rows = sets.join(t.embeddings.select("vec_id", "embedding"), "vec_id").select("set", F.posexplode("embedding").alias("feat_ix", "v")).withColumn("v", F.col("v").cast("double"))
    out = feature_stats(rows, ["set", "feat_ix"], "v")
    return out.select("set", F.col("feat_ix").cast("long").alias("feat_ix"), "n", r6(F.col("mean")).alias("mean"), r6(F.col("var")).alias("var"))


@query("""
WITH s AS (SELECT l_suppkey, l_partkey, round(avg(l_discount), 8) v FROM lineitem GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY v DESC, l_partkey) k FROM s)
SELECT l_suppkey, round(avg(p_retailprice) FILTER (k <= 10), 4) + 0 AS top, round(avg(p_retailprice), 4) + 0 AS "all" FROM k JOIN part ON p_partkey = l_partkey GROUP BY ALL
""")
def top_image_scores(t):
    """Mean score of each channel's ten best images beside that of all its images."""
    from ..operators.ranking import top

    s = t.lineitem.groupBy("l_suppkey", "l_partkey").agg(F.round(F.avg("l_discount"), 8).alias("v"))
    scores = t.part.select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    mean = lambda df, name: df.join(scores, "l_partkey").groupBy("l_suppkey").agg((F.round(F.avg("p_retailprice"), 4) + F.lit(0.0)).alias(name))
    return mean(top(s, ["l_suppkey"], F.col("v"), "l_partkey", 10), "top").join(mean(s, "all"), "l_suppkey")


@query()
def simulation_fields(t):
    """Channels whose field is in a spread subset of the default grid; the subset is tested against a plain loop."""
    from ..operators.grids import prf_grid

    grid = prf_grid(t.spark, 5)
    channels = t.customer.select(F.col("c_custkey").alias("voxel_ix"), (F.col("c_custkey") % grid.count()).cast("int").alias("prf_ix"))
    return channels.join(TR.spread_grid(grid), "prf_ix")


@query(f"""
WITH n AS (SELECT s_suppkey AS image_ix, p, ({_draw('s_suppkey * 65537 + p', 5)} + 0.5) / 1000003 AS u FROM supplier, range(64) b(p))
SELECT image_ix, sum(CASE WHEN u < 0.5 THEN 1 ELSE 0 END)::BIGINT AS below, count(*) AS n FROM n GROUP BY ALL
""")
def noise_images(t):
    """Pixels under the mean of a noise image for each supplier."""
    px = ST.noise_images(t.supplier.select(F.col("s_suppkey").alias("image_ix")), 8, 5).select("image_ix", F.explode("px").alias("v"))
    return px.groupBy("image_ix").agg(F.count_if(F.col("v") < 127.5).alias("below"), F.count("*").alias("n"))


@query("SELECT s_suppkey AS image_ix, round(avg(((s_suppkey * 31 + p * 7) % 256) / 255.0), 6) + 0 AS mean FROM supplier, range(64) g(p) GROUP BY ALL")
def scaled_images(t):
    k = F.col("s_suppkey")
    px = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda p: (F.pmod(k * 31 + p * 7, F.lit(256))).cast("double"))
    scaled = ST.scaled_images(t.supplier.select(k.alias("image_ix"), F.lit(8).alias("w"), px.alias("px")))
    return scaled.select("image_ix", r6(F.aggregate("px", F.lit(0.0), lambda a, v: a + v) / 64).alias("mean"))
