"""Dictionaries, masks, selections and composed scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stats import r6
from ..operators import catalogue as C
from ..operators import ranking as R
from .registry import query

_GROUPS = ", ".join(f"({k}, '{name}', {n}, {C.SIMPLE.index(simple)}, '{simple}')" for k, (name, n, simple) in enumerate(C.TEXTURE_GROUPS))


@query(f"""
WITH g(group_ix, group_name, n, simple_ix, simple_name) AS (VALUES {_GROUPS}), c AS (SELECT (row_number() OVER (ORDER BY group_ix, k) - 1)::INTEGER AS "column", group_ix, group_name, simple_ix, simple_name, (row_number() OVER (ORDER BY group_ix, k) - 1) < 49 AS low_level FROM (SELECT *, unnest(range(n)) k FROM g))
SELECT p_partkey, c.* FROM part JOIN c ON "column" = p_partkey % 641
""")
def texture_columns(t):
    """The group of the texture column that each part stands for."""
    return t.part.select("p_partkey", (F.col("p_partkey") % 641).cast("int").alias("column")).join(C.texture_columns(t.spark), "column")


@query(f"""
WITH g(group_ix, group_name, n, simple_ix, simple_name) AS (VALUES {_GROUPS})
SELECT p_partkey, simple_ix FROM part JOIN g ON group_ix = p_partkey % 14
""")
def component_groups(t):
    """Components of a decomposition by group and scale, in the ten simple groups."""
    names = F.array(*[F.lit(name) for name, *_ in C.TEXTURE_GROUPS])
    name = F.concat(F.get(names, (F.col("p_partkey") % 14).cast("int")), F.lit("_scale"), (F.col("p_size") % 4).cast("string"))
    return t.part.select("p_partkey", C.component_groups(name).alias("simple_ix"))


@query(f"""
WITH g(group_ix, group_name, n, simple_ix, simple_name) AS (VALUES {_GROUPS}), u AS (SELECT *, unnest(range(n)) k FROM g), c AS (SELECT *, row_number() OVER (ORDER BY group_ix, k) - 1 AS place FROM u)
SELECT group_name, CASE WHEN group_ix IN (1, 2) THEN k // 4 WHEN group_ix IN (8, 9) THEN k // 6 WHEN group_ix = 10 THEN 1 + k // 16 WHEN group_ix = 11 THEN 1 + k // 32 WHEN group_ix > 11 THEN 0
  WHEN group_ix = 3 THEN nullif(k // 2 - 1, -1) WHEN group_ix = 6 THEN CASE WHEN k < 5 THEN NULL WHEN k < 10 THEN 0 WHEN k < 23 THEN 1 WHEN k < 48 THEN 2 ELSE 3 END
  WHEN group_ix = 5 THEN CASE WHEN k < 20 THEN 0 WHEN k < 72 THEN 1 WHEN k < 172 THEN 2 ELSE 3 END END::INTEGER AS scale, count(*) AS n, round(avg(p_retailprice), 4) + 0 AS mean
FROM c JOIN part ON p_partkey % 641 = place GROUP BY ALL
""")
def texture_scales(t):
    """Parts by the group and scale of the texture column that each stands for."""
    labels = [(k, *row) for k, row in enumerate(C.texture_labels())]
    columns = t.spark.createDataFrame(labels, "at long, group_name string, scale int, orientation int, other int")
    rows = t.part.select((F.col("p_partkey") % 641).alias("at"), "p_retailprice").join(columns, "at")
    return rows.groupBy("group_name", "scale").agg(F.count("*").alias("n"), (F.round(F.avg("p_retailprice"), 4) + F.lit(0.0)).alias("mean"))


@query("""
WITH p AS (SELECT p_brand, p_size % 4 AS scale, dense_rank() OVER (ORDER BY p_brand, p_size % 4) - 1 AS pair_ix FROM (SELECT DISTINCT p_brand, p_size FROM part))
SELECT DISTINCT p_partkey, pair_ix FROM part JOIN p ON p.p_brand = part.p_brand AND p.scale = part.p_size % 4
""")
def scale_groups(t):
    c = t.part.select("p_partkey", "p_brand", (F.col("p_size") % 4).alias("scale"))
    return C.scale_groups(c, "p_brand", "scale").select("p_partkey", F.col("pair_ix").cast("long").alias("pair_ix"))


@query(f"""
SELECT p_partkey, i AS cluster, i IN {C.DOUBLE_LINES} AS double, i IN {C.JUNCTIONS} AS junction, i NOT IN {C.DOUBLE_LINES + C.JUNCTIONS + C.OTHER_CLUSTERS} AS single, i = 107 AS other FROM (SELECT p_partkey, p_partkey % 150 AS i FROM part)
""")
def cluster_groups(t):
    """The groups of the cluster that each part belongs to."""
    flags = C.cluster_groups(F.col("cluster"))
    return t.part.select("p_partkey", (F.col("p_partkey") % 150).alias("cluster")).select("p_partkey", "cluster", *(f.alias(n) for f, n in zip(flags, ("double", "junction", "single", "other"), strict=True)))


@query("""
WITH v AS (SELECT version, unnest(cols) AS "column" FROM (VALUES
  ('full_combined', [0,1,2,3,4,5]), ('just_gabor', [0,1,2]), ('just_semantic', [3,4,5]),
  ('semantic_just_a_no_other_modules', [3]), ('semantic_just_b_no_other_modules', [4,5]), ('semantic_just_a_plus_other_modules', [0,1,2,3]), ('semantic_just_b_plus_other_modules', [0,1,2,4,5])) x(version, cols))
SELECT vec_id, version, count(*) AS width, round(sum(embedding["column" + 1]::DOUBLE), 5) + 0 AS total FROM embeddings, v GROUP BY ALL
""")
def combined_versions(t):
    """Sums of the columns that each version of a combined model uses."""
    found = C.combined_versions({"gabor": {"all": 3}, "semantic": {"a": 1, "b": 2}})
    versions = F.array(*[F.struct(F.lit(k).alias("version"), F.array(*[F.lit(c) for c in cols]).alias("cols")) for k, cols in found.items()])
    total = F.aggregate(F.col("v.cols"), F.lit(0.0), lambda acc, c: acc + F.get("embedding", c).cast("double"))
    return t.embeddings.select("vec_id", "embedding", F.explode(versions).alias("v")).select("vec_id", "v.version", F.size("v.cols").cast("long").alias("width"), (F.round(total, 5) + F.lit(0.0)).alias("total"))


@query("""
SELECT vec_id, g.i::INTEGER AS prf_ix, round(embedding[g.i + 1], 5) + 0.0::DOUBLE AS first, round(embedding[60]::DOUBLE + label, 5) + 0 AS last, 3 AS width FROM embeddings, range(3) g(i)
""")
def combined_features(t):
    """A set by field beside a whole-image set."""
    e = t.embeddings.select("vec_id", "label", "embedding")
    a = e.withColumn("prf_ix", F.explode(F.sequence(F.lit(0), F.lit(2)))).select("vec_id", "prf_ix", F.array(F.get("embedding", F.col("prf_ix")).cast("double"), F.lit(1.0)).alias("f"))
    b = e.select("vec_id", F.lit(0).alias("prf_ix"), F.array(F.get("embedding", F.lit(59)).cast("double") + F.col("label")).alias("f"))
    c = C.combined_features([a, b], ["vec_id", "prf_ix"], [False, True])
    five = lambda k: F.round(F.get("f", F.lit(k)), 5) + F.lit(0.0)
    return c.select("vec_id", "prf_ix", five(0).alias("first"), five(2).alias("last"), F.size("f").alias("width"))


@query("SELECT vec_id, round(embedding[label + 1], 5) + 0.0::DOUBLE AS chosen FROM embeddings")
def select_along_axis(t):
    return t.embeddings.select("vec_id", (F.round(F.get("embedding", F.col("label")).cast("double"), 5) + F.lit(0.0)).alias("chosen"))


@query("SELECT c_nationkey AS roi, count(*) AS n FROM customer WHERE c_nationkey >= 0 GROUP BY ALL")
def roi_sizes(t):
    return t.customer.groupBy(F.col("c_nationkey").alias("roi")).agg(F.count("*").alias("n"))


@query("""
WITH s AS (SELECT user_id, event_type, round(avg(value), 6) v FROM events GROUP BY ALL), f AS (SELECT * FROM s WHERE user_id % 7 <> 0 AND v > 0),
k AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY v DESC, user_id) k FROM f) SELECT event_type, user_id, k AS rank FROM k WHERE k <= 20
""")
def semantic_voxel_groups(t):
    s = t.events.groupBy("user_id", "event_type").agg(r6(F.avg("value")).alias("v"))
    gone = s.where("user_id % 7 = 0")
    return C.voxel_groups(s, "user_id", "event_type", "v", gone, 20).select("event_type", "user_id", F.col("rank").cast("long").alias("rank"))


@query("""
WITH k AS (SELECT o_custkey, CASE WHEN o_orderkey % 5 = 0 THEN 'val' WHEN o_orderkey % 5 = 1 THEN 'holdout' ELSE 'trn' END s, o_orderkey FROM orders)
SELECT o_custkey, s AS split, o_orderkey FROM k WHERE o_custkey IN (SELECT o_custkey FROM k GROUP BY o_custkey HAVING count(DISTINCT s) = 3)
""")
def complete_fields(t):
    k = F.col("o_orderkey") % 5
    s = t.orders.select("o_custkey", F.when(k == 0, "val").when(k == 1, "holdout").otherwise("trn").alias("split"), "o_orderkey")
    return C.complete_fields(s, "o_custkey", "split", ["trn", "holdout", "val"])


@query("""
WITH s AS (SELECT user_id, CAST(ts AS DATE) AS session, event_id, value FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-12'),
z AS (SELECT user_id, session, event_id, (value / 300 - avg(value / 300) OVER w) / (stddev_pop(value / 300) OVER w + 1e-6) z FROM s WINDOW w AS (PARTITION BY user_id, session))
SELECT user_id, day(session)::INTEGER AS session, count(*) AS n, round(avg(z), 6) + 0 AS mean, round(var_pop(z), 4) + 0 AS var FROM z GROUP BY ALL
""")
def session_scan(t):
    """Chosen sessions, all channels, standardised within a session, averaged."""
    from ..operators.aggregates import session_zscore

    e = t.events.withColumn("session", F.to_date("ts")).where("session between date'2024-01-05' and date'2024-01-12'")
    z = session_zscore(e, ["user_id", "session"], "value")
    return z.groupBy("user_id", F.dayofmonth("session").alias("session")).agg(F.count("*").alias("n"), r6(F.avg("z")).alias("mean"), (F.round(F.var_pop("z"), 4) + F.lit(0.0)).alias("var"))


@query("""
WITH p AS (SELECT c_nationkey g, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 place, c_acctbal v FROM customer),
o AS (SELECT g, place, (row_number() OVER (PARTITION BY g ORDER BY (place * 7) % 13, place) - 1) AS shuffled FROM p)
SELECT p.g, p.place, p.v, b.v AS mixed FROM p JOIN o USING (g, place) JOIN o x ON x.g = p.g AND x.shuffled = p.place JOIN p b ON b.g = p.g AND b.place = x.place
""")
def unshuffle(t):
    from pyspark.sql.window import Window

    p = t.customer.select(F.col("c_nationkey").alias("g"), (F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")) - 1).cast("long").alias("place"), F.col("c_acctbal").alias("v"))
    o = p.select("g", "place", (F.row_number().over(Window.partitionBy("g").orderBy((F.col("place") * 7) % 13, "place")) - 1).cast("long").alias("shuffled"))
    mixed = p.join(o, ["g", "place"]).select("g", "shuffled", "v")
    back = R.unshuffled(mixed, ["g"], "v", "shuffled", o)
    return back.join(mixed.select("g", F.col("shuffled").alias("place"), F.col("v").alias("mixed")), ["g", "place"])


@query("""
WITH l AS (SELECT doc_id, q.k AS axis, CASE q.k WHEN 'quality' THEN quality ELSE toxic END AS label FROM labels, (VALUES ('quality'), ('toxic')) q(k))
SELECT axis, source, count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1, count(*) FILTER (label IS NULL) AS n_undefined, count(*) AS n FROM l JOIN documents USING (doc_id) GROUP BY GROUPING SETS ((axis, source), (axis))
""")
def label_totals(t):
    """Counts at both levels from one aggregation."""
    d = t.labels.join(t.documents.select("doc_id", "source"), "doc_id")
    long = d.select("source", F.explode(F.create_map(F.lit("quality"), "quality", F.lit("toxic"), "toxic")).alias("axis", "label"))
    counts = [F.count_if(F.col("label") == 0).alias("n0"), F.count_if(F.col("label") == 1).alias("n1"), F.count_if(F.col("label").isNull()).alias("n_undefined"), F.count("*").alias("n")]
    return long.groupingSets([["axis", "source"], ["axis"]], "axis", "source").agg(*counts).select("axis", "source", "n0", "n1", "n_undefined", "n")


@query("""
WITH e AS (SELECT label AS g, embedding[1]::DOUBLE a, embedding[2]::DOUBLE b, vec_id % 2 = 0 AS k FROM embeddings)
SELECT g, count(*) n, round(sum(pow(a - b, 2)), 5) + 0 AS sse, round(max(a) FILTER (k), 5) + 0 AS best FROM e GROUP BY g
""")
def losses(t):
    from ..functions.stats import sse

    a, b = F.col("embedding")[0].cast("double"), F.col("embedding")[1].cast("double")
    five = lambda c: F.round(c, 5) + F.lit(0.0)
    return t.embeddings.groupBy(F.col("label").alias("g")).agg(F.count("*").alias("n"), five(sse(a, b)).alias("sse"), five(F.max(F.when(F.col("vec_id") % 2 == 0, a))).alias("best"))


@query("""
WITH r AS (SELECT l_suppkey, l_returnflag, round(avg(l_discount), 8) v FROM lineitem GROUP BY ALL) SELECT l_suppkey, max_by(l_returnflag, struct_pack(v, l_returnflag)) AS best FROM r GROUP BY l_suppkey
""")
def best_layer(t):
    """The layer of largest score for each channel; ties by name."""
    r = t.lineitem.groupBy("l_suppkey", "l_returnflag").agg(F.round(F.avg("l_discount"), 8).alias("v"))
    return r.groupBy("l_suppkey").agg(F.max_by("l_returnflag", F.struct("v", "l_returnflag")).alias("best"))
