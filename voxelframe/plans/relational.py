"""Labels, joins, ranks, peaks and resampling over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.stats import r6
from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import labels as L
from ..operators import ranking as R
from ..operators import sampling as P
from ..sources import tables as T
from .registry import query


@query("SELECT l_partkey, l_suppkey, round(avg(l_quantity), 6) + 0 AS mean, count(*) AS repeats FROM lineitem GROUP BY ALL")
def repeat_average(t):
    return A.repeat_average(t.lineitem, ["l_partkey", "l_suppkey"], "l_quantity").withColumn("mean", r6(F.col("mean")))


@query("""
SELECT event_id, round((value / 300 - avg(value / 300) OVER w) / (stddev_pop(value / 300) OVER w + 1e-6), 6) + 0 AS z
FROM events WINDOW w AS (PARTITION BY user_id, CAST(ts AS DATE))
""")
def session_zscore(t):
    e = t.events.withColumn("session", F.to_date("ts"))
    return A.session_zscore(e, ["user_id", "session"], "value").select("event_id", r6(F.col("z")).alias("z"))


@query("""
SELECT c_custkey, round((c_acctbal - avg(CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal END) OVER w) / nullif(stddev_pop(CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal END) OVER w, 0), 6) + 0 AS z
FROM customer WINDOW w AS (PARTITION BY c_nationkey)
""")
def train_zscore(t):
    return A.zscore(t.customer, ["c_nationkey"], "c_acctbal", F.col("c_custkey") % 3 != 0).select("c_custkey", r6(F.col("z")).alias("z"))


@query("""
SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER w) / nullif(stddev_pop(c_acctbal) OVER w, 0), 6) + 0 AS z FROM customer WINDOW w AS (PARTITION BY c_mktsegment)
""")
def group_zscore(t):
    return A.zscore(t.customer, ["c_mktsegment"], "c_acctbal").select("c_custkey", r6(F.col("z")).alias("z"))


_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("SELECT user_id, " + ", ".join(f"max(CASE WHEN event_type = '{k}' THEN 1 ELSE 0 END) AS is_{k}" for k in ("view", "click", "purchase", "signup", "logout")) + " FROM events GROUP BY user_id")
def category_flags(t):
    return L.flags(t.events, "user_id", "event_type", ["view", "click", "purchase", "signup", "logout"])


@query("SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') THEN 1 ELSE 0 END AS flag FROM customer")
def membership_flag(t):
    members = t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return L.in_category(t.customer.select("c_custkey"), "c_custkey", members)


@query("""
SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey
  WHERE r_name = 'ASIA' AND o_orderstatus = 'P') THEN 1 ELSE 0 END AS flag FROM customer
""")
def supercategory_flag(t):
    """Membership through the category's supercategory."""
    suppliers = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(t.region.where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("s_suppkey").alias("l_suppkey"))
    lines = t.lineitem.select("l_orderkey", "l_suppkey").join(suppliers, "l_suppkey", "left_semi")
    members = t.orders.where("o_orderstatus = 'P'").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select(F.col("o_custkey").alias("c_custkey"))
    return L.in_category(t.customer.select("c_custkey"), "c_custkey", members)


@query("SELECT r_name AS supercategory, array_to_string(list(n_name ORDER BY n_nationkey), ',') AS categories, count(*) n FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY r_name")
def category_info(t):
    c = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("r_name").alias("supercategory"))
    return T.category_info(c).select("supercategory", F.array_join(F.transform("members", lambda m: m["name"]), ",").alias("categories"), F.size("members").cast("long").alias("n"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY (doc_id * 2654435761 + 0) % 1000003, doc_id LIMIT 100")
def unused_sample(t):
    return J.unused_sample(t.documents.select("doc_id"), t.labels, "doc_id", 100)


@query("""
WITH d AS (SELECT doc_id, lang, CASE WHEN quality = 1 AND toxic = 0 THEN 1 WHEN toxic = 1 AND quality = 0 THEN 0 END AS axis FROM documents LEFT JOIN labels USING (doc_id))
SELECT lang, count(*) FILTER (axis = 0) AS n0, count(*) FILTER (axis = 1) AS n1, count(*) FILTER (axis IS NULL) AS n_undefined, count(*) AS n FROM d GROUP BY lang
""")
def axis_counts(t):
    d = t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left")
    axis = L.exclusive(F.coalesce(F.col("quality") == 1, F.lit(False)), F.coalesce(F.col("toxic") == 1, F.lit(False)))
    return L.label_counts(d.withColumn("axis", axis), ["lang"], "axis")


@query("""
WITH c AS (SELECT user_id, count(*) FILTER (event_type IN ('view', 'click')) a, count(*) FILTER (event_type IN ('purchase', 'signup')) b, count(*) FILTER (event_type = 'logout') m FROM events GROUP BY user_id)
SELECT user_id, CASE WHEN a > b THEN 1 WHEN b > a THEN 0 END AS majority,
  CASE WHEN a > 0 AND a = greatest(a, m, b) THEN 1 ELSE 0 END AS has_small, CASE WHEN m > 0 AND m = greatest(a, m, b) THEN 1 ELSE 0 END AS has_medium, CASE WHEN b > 0 AND b = greatest(a, m, b) THEN 1 ELSE 0 END AS has_large,
  CASE WHEN (b > 0 AND b = greatest(a, m, b)) AND NOT (a > 0 AND a = greatest(a, m, b)) THEN 1 WHEN (a > 0 AND a = greatest(a, m, b)) AND NOT (b > 0 AND b = greatest(a, m, b)) THEN 0 END AS small_large,
  CASE WHEN b > 0 AND a = 0 THEN 1 WHEN a > 0 AND b = 0 THEN 0 END AS small_large_field
FROM c
""")
def conflict_labels(t):
    """Majority of votes; size groups over the whole and within a field."""
    e = F.col("event_type")
    c = t.events.groupBy("user_id").agg(F.count_if(e.isin("view", "click")).alias("a"), F.count_if(e.isin("purchase", "signup")).alias("b"), F.count_if(e == "logout").alias("m"))
    whole, field = (L.size_groups(F.col("a"), F.col("m"), F.col("b"), w) for w in (True, False))
    names = ("has_small", "has_medium", "has_large", "small_large")
    return c.select("user_id", L.majority(F.col("a"), F.col("b")).alias("majority"), *(x.alias(n) for x, n in zip(whole, names, strict=True)), field[3].alias("small_large_field"))


@query("""
WITH d AS (SELECT source, quality q, toxic x FROM labels JOIN documents USING (doc_id))
SELECT source, count(*) FILTER (q = 0 AND x = 0) n00, count(*) FILTER (q = 0 AND x = 1) n01, count(*) FILTER (q = 1 AND x = 0) n10, count(*) FILTER (q = 1 AND x = 1) n11,
  round(covar_pop(q, x) / nullif(sqrt(var_pop(q) * var_pop(x)), 0), 6) + 0 AS r FROM d GROUP BY source
""")
def label_contingency(t):
    d = t.labels.join(t.documents.select("doc_id", "source"), "doc_id")
    return L.contingency(d, ["source"], "quality", "toxic").withColumn("r", r6(F.col("r")))


@query("""
WITH s AS (SELECT DISTINCT l_orderkey, l_suppkey % 40 AS g FROM lineitem)
SELECT a.g AS group_a, b.g AS group_b, count(*) AS n FROM s a JOIN s b ON a.l_orderkey = b.l_orderkey AND a.g < b.g GROUP BY ALL
""")
def group_overlap(t):
    return J.overlap_counts(t.lineitem.select("l_orderkey", (F.col("l_suppkey") % 40).alias("g")), "l_orderkey", "g")


@query("""
WITH m AS (SELECT c_custkey, CASE c_nationkey WHEN 3 THEN 2 WHEN 7 THEN 5 ELSE c_nationkey END k FROM customer),
d AS (SELECT k, dense_rank() OVER (ORDER BY k) - 1 n FROM (SELECT DISTINCT k FROM m WHERE k NOT IN (0, 9)))
SELECT c_custkey, coalesce(n, -1) AS new_label FROM m LEFT JOIN d USING (k)
""")
def relabel(t):
    return J.relabelled(t.customer, "c_nationkey", {3: 2, 7: 5}, [0, 9]).select("c_custkey", F.col("new_label").cast("long").alias("new_label"))


@query("SELECT s_suppkey, coalesce(nullif(s_suppkey % 3, 0), nullif(s_suppkey % 5, 0), nullif(s_nationkey, 0)) AS label FROM supplier")
def label_priority(t):
    k = F.col("s_suppkey")
    return t.supplier.select("s_suppkey", J.prior(k % 3, k % 5, F.col("s_nationkey").cast("long")).alias("label"))


@query("SELECT g.i AS cell, round(s_acctbal, 2) AS value FROM range(2000) g(i) LEFT JOIN supplier ON s_suppkey = g.i")
def scatter_volume(t):
    last = t.supplier.agg(F.max("s_suppkey")).first()[0] or 0
    cells = t.spark.range(max(2000, last + 1)).withColumnRenamed("id", "cell")
    return J.scattered(cells, t.supplier.select(F.col("s_suppkey").alias("cell"), F.round("s_acctbal", 2).alias("value")), "cell")


@query("""
WITH a AS (SELECT (l_orderkey * 8 + l_linenumber)::BIGINT id, (l_partkey % 190)::INTEGER x0, (l_suppkey % 170)::INTEGER y0, (l_linenumber * 7)::INTEGER w FROM lineitem),
l AS (SELECT id, x0, x0 + w x1, y0, y0 + 9 y1 FROM a),
r AS (SELECT n_nationkey::BIGINT id, (n_nationkey % 13 * 15)::INTEGER x0, (n_nationkey % 13 * 15 + 25)::INTEGER x1, (n_nationkey % 7 * 25)::INTEGER y0, (n_nationkey % 7 * 25 + 20)::INTEGER y1 FROM nation)
SELECT l.id AS left_id, r.id AS right_id, ((least(l.x1, r.x1) - greatest(l.x0, r.x0)) * (least(l.y1, r.y1) - greatest(l.y0, r.y0)))::BIGINT AS pixels
FROM l, r WHERE least(l.x1, r.x1) > greatest(l.x0, r.x0) AND least(l.y1, r.y1) > greatest(l.y0, r.y0)
  AND (least(l.x1, r.x1) - greatest(l.x0, r.x0)) * (least(l.y1, r.y1) - greatest(l.y0, r.y0)) > 10
""")
def box_overlap(t):
    """Boxes of all line items against a fixed set of fields."""
    li = t.lineitem.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long").alias("id"), (F.col("l_partkey") % 190).cast("int").alias("x0"), (F.col("l_suppkey") % 170).cast("int").alias("y0"), (F.col("l_linenumber") * 7).cast("int").alias("w"))
    left = li.select("id", "x0", (F.col("x0") + F.col("w")).alias("x1"), "y0", (F.col("y0") + 9).alias("y1"))
    k = F.col("n_nationkey")
    right = t.nation.select(k.cast("long").alias("id"), (k % 13 * 15).cast("int").alias("x0"), (k % 13 * 15 + 25).cast("int").alias("x1"), (k % 7 * 25).cast("int").alias("y0"), (k % 7 * 25 + 20).cast("int").alias("y1"))
    return J.box_overlap(left, right, 16).withColumn("pixels", F.col("pixels").cast("long"))


@query("""
WITH g AS (SELECT i % 11 AS gx, i // 11 AS gy, i AS ix FROM range(121) r(i)),
p AS (SELECT c_custkey, (c_custkey * 37 % 1000) / 1000.0 - 0.5 AS x, (c_custkey * 61 % 1000) / 1000.0 - 0.5 AS y FROM customer),
d AS (SELECT c_custkey, ix, round(sqrt(pow(gx / 10.0 - 0.5 - x, 2) + pow(gy / 10.0 - 0.5 - y, 2)), 9) AS d FROM p, g)
SELECT c_custkey, min_by(ix, struct_pack(d, ix))::INTEGER AS prf_ix, round(min(d), 6) AS distance FROM d GROUP BY c_custkey
""")
def nearest_field(t):
    i = F.col("id")
    grid = t.spark.range(121).select(i.cast("int").alias("prf_ix"), ((i % 11) / 10.0 - 0.5).alias("x"), (F.floor(i / 11) / 10.0 - 0.5).alias("y"), F.lit(0.1).alias("sigma"))
    k = F.col("c_custkey")
    points = t.customer.select(k, ((k * 37 % 1000) / 1000.0 - 0.5).alias("x"), ((k * 61 % 1000) / 1000.0 - 0.5).alias("y"), F.lit(0.2).alias("sigma"))
    return J.nearest_field(points, "c_custkey", grid).withColumn("distance", F.round("distance", 6))


@query("""
WITH m AS (SELECT l_suppkey, l_partkey, avg(l_extendedprice) v FROM lineitem GROUP BY ALL)
SELECT l_suppkey, l_partkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY round(v, 4) DESC, l_partkey) AS rank FROM m
""")
def image_ranks(t):
    m = t.lineitem.groupBy("l_suppkey", "l_partkey").agg(F.avg("l_extendedprice").alias("v"))
    return R.ranked(m, ["l_suppkey"], F.round("v", 4), "l_partkey").select("l_suppkey", "l_partkey", F.col("rank").cast("long").alias("rank"))


@query("SELECT o_custkey, o_orderkey, rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 12")
def top_k(t):
    return R.top(t.orders, ["o_custkey"], F.col("o_totalprice"), "o_orderkey", 12).select("o_custkey", "o_orderkey", F.col("rank").cast("long").alias("rank"))


@query("SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_retailprice, p_partkey) - 1 AS position FROM part")
def double_sort(t):
    return R.sorted_twice(t.part, ["p_brand"], "p_size", "p_retailprice", "p_partkey").select("p_partkey", F.col("position").cast("long").alias("position"))


@query("""
WITH p AS (SELECT c_nationkey g, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 place, c_acctbal v FROM customer),
s AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY v, place) - 1 inverse FROM p)
SELECT a.g, a.place, a.inverse, b.place AS "order" FROM s a JOIN s b ON a.g = b.g AND a.place = b.inverse
""")
def invertible_sort(t):
    p = t.customer.select(F.col("c_nationkey").alias("g"), (F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")) - 1).cast("long").alias("place"), F.col("c_acctbal").alias("v"))
    return R.with_inverse(p, ["g"], "v", "place").select("g", "place", F.col("inverse").cast("long").alias("inverse"), "order")


_CURVE = "(SELECT user_id, hour(ts)::INTEGER AS h, round(avg(value), 6) AS v FROM events GROUP BY ALL)"


def _curve(t):
    return t.events.groupBy("user_id", F.hour("ts").alias("h")).agg(F.round(F.avg("value"), 6).alias("v"))


_RING = "coalesce(lag(v) OVER w, last_value(v) OVER a) b, coalesce(lead(v) OVER w, first_value(v) OVER a) n"
_RING_W = "WINDOW w AS (PARTITION BY user_id ORDER BY h), a AS (PARTITION BY user_id ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"


@query(f"SELECT user_id, h, v FROM (SELECT *, {_RING} FROM {_CURVE} {_RING_W}) WHERE v > b AND v > n")
def circular_peaks(t):
    return R.circular_peaks(_curve(t), ["user_id"], "h", "v")


@query(f"SELECT user_id, h, v FROM (SELECT *, {_RING} FROM {_CURVE} {_RING_W}) WHERE v < b AND v < n")
def circular_troughs(t):
    return R.circular_peaks(_curve(t), ["user_id"], "h", "v", troughs=True)


_TAIL = """, q AS (SELECT *, max(v - low) OVER (PARTITION BY user_id) top FROM p WHERE v > b AND v > n AND v >= 0),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY v DESC, h) peak_rank FROM q WHERE (v - low) / nullif(top, 0) > 0.5)"""


@query(f"WITH p AS (SELECT *, lag(v, 1, -2.0) OVER w b, lead(v, 1, -2.0) OVER w n, min(v) OVER (PARTITION BY user_id) low FROM {_CURVE} WINDOW w AS (PARTITION BY user_id ORDER BY h)){_TAIL} SELECT user_id, h, v, peak_rank FROM k")
def frequency_peaks(t):
    return R.curve_peaks(_curve(t), ["user_id"], "h", "v").withColumn("peak_rank", F.col("peak_rank").cast("long"))


@query(f"WITH p AS (SELECT *, {_RING}, min(v) OVER (PARTITION BY user_id) low FROM {_CURVE} {_RING_W}){_TAIL} SELECT user_id, h, v, peak_rank FROM k")
def orientation_peaks(t):
    return R.curve_peaks(_curve(t), ["user_id"], "h", "v", circular=True).withColumn("peak_rank", F.col("peak_rank").cast("long"))


def _frequent(size):
    return f"""
    WITH s AS (SELECT o_custkey, list_sort(list(m)) items FROM (SELECT DISTINCT o_custkey, month(o_orderdate)::INTEGER m FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY o_custkey HAVING count(*) = {size}),
    b AS (SELECT items, row_number() OVER (ORDER BY count(*) DESC, items) - 1 g FROM s GROUP BY items QUALIFY g < 4)
    SELECT o_custkey, array_to_string(s.items, '/') AS peaks, coalesce(b.g, 4)::BIGINT AS "group" FROM s LEFT JOIN b ON s.items = b.items"""


for _size, _name in ((2, "bimodal_groups"), (3, "trimodal_groups")):

    def _groups(t, size=_size):
        peaks = t.orders.where("o_orderpriority = '1-URGENT'").select("o_custkey", F.month("o_orderdate").alias("m")).distinct()
        return R.frequent_sets(peaks, "o_custkey", "m", size, 4).select("o_custkey", F.array_join("items", "/").alias("peaks"), F.col("group").cast("long").alias("group"))

    _groups.__name__ = _name
    query(_frequent(_size))(_groups)


@query("""
WITH a AS (SELECT n_regionkey, c_nationkey, c_mktsegment, avg(c_acctbal) m FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL)
SELECT n_regionkey, c_mktsegment, round(avg(m), 6) + 0 AS mean, round(stddev_pop(m) / sqrt(count(m)), 6) + 0 AS sem, count(m) AS n FROM a GROUP BY ALL
""")
def two_level_mean(t):
    c = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return A.two_level_mean(c, ["c_nationkey"], ["n_regionkey", "c_mktsegment"], "c_acctbal").select("n_regionkey", "c_mktsegment", r6(F.col("mean")).alias("mean"), r6(F.col("sem")).alias("sem"), "n")


def _draw(key, seed):
    return f"((({key}) + 1) * 48271 + (({seed}) + 1) * 69621 + (({key}) % 7919) * (({seed}) % 7907 + 1) * 31) % 1000003"


@query(f"""
WITH r AS (SELECT o_orderkey, o_orderkey % 10 = 0 AS sh, o_orderstatus FROM orders),
k AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus, sh ORDER BY {_draw('o_orderkey', 0)}, o_orderkey) k, count(*) OVER (PARTITION BY o_orderstatus, sh) n FROM r)
SELECT o_orderkey, CASE WHEN sh THEN 'val' WHEN k <= ceil(n * 0.1 - 1e-9) THEN 'holdout' ELSE 'trn' END AS split FROM k
""")
def holdout_split(t):
    return P.split(t.orders, ["o_orderstatus"], "o_orderkey", F.col("o_orderkey") % 10 == 0).select("o_orderkey", "split")


@query(f"""
WITH d AS (SELECT doc_id, quality, toxic FROM labels), n AS (SELECT min(c) n FROM (SELECT count(*) c FROM d GROUP BY quality, toxic)),
k AS (SELECT d.*, i AS iter, row_number() OVER (PARTITION BY quality, toxic, i ORDER BY {_draw('doc_id', 'i')}, doc_id) k FROM d, range(5) g(i))
SELECT quality, toxic, doc_id, iter::INTEGER AS iter FROM k, n WHERE k <= n
""")
def balanced_trials(t):
    return P.balanced(t.labels, [], ["quality", "toxic"], "doc_id", 5)


@query(f"""
WITH d AS (SELECT source, quality, doc_id FROM labels JOIN documents USING (doc_id)),
c AS (SELECT source, min(c) // 2 * 2 n FROM (SELECT source, quality, count(*) c FROM d GROUP BY ALL) GROUP BY source HAVING count(*) = 2),
k AS (SELECT d.*, i AS iter, n, row_number() OVER (PARTITION BY source, quality, i ORDER BY {_draw('doc_id', 'i')}, doc_id) k FROM d JOIN c USING (source), range(3) g(i))
SELECT source, 'only_' || quality AS "set", doc_id, iter::INTEGER AS iter FROM k WHERE k <= n
UNION ALL SELECT source, 'mixed', doc_id, iter::INTEGER FROM k WHERE k <= n / 2
""")
def separate_category_sets(t):
    d = t.labels.join(t.documents.select("doc_id", "source"), "doc_id")
    return P.separate_sets(d, ["source"], "quality", "doc_id", 3)


@query(f"""
WITH d AS (SELECT source, quality, doc_id FROM labels JOIN documents USING (doc_id)),
c AS (SELECT source, min(c) n FROM (SELECT source, quality, count(*) c FROM d GROUP BY ALL) GROUP BY source HAVING count(*) = 2), m AS (SELECT min(n) n FROM c),
k AS (SELECT d.*, i AS iter, row_number() OVER (PARTITION BY source, quality, i ORDER BY {_draw('doc_id', 'i')}, doc_id) k FROM d JOIN c USING (source), range(3) g(i))
SELECT source, quality, doc_id, iter::INTEGER AS iter FROM k, m WHERE k <= n
""")
def matched_decoding_sets(t):
    d = t.labels.join(t.documents.select("doc_id", "source"), "doc_id")
    return P.balanced(d, ["source"], ["quality"], "doc_id", 3, everywhere=True, expected=2)


@query(f"""
WITH k AS (SELECT c_nationkey, c_custkey, i AS iter, row_number() OVER (PARTITION BY c_nationkey, i ORDER BY {_draw('c_custkey', 'i')}, c_custkey) k, count(*) OVER (PARTITION BY c_nationkey, i) n FROM customer, range(2) g(i))
SELECT c_nationkey, s AS share, c_custkey, iter::INTEGER AS iter FROM k, (VALUES (0.05::DOUBLE), (0.3), (0.9)) x(s) WHERE k <= round(n * s)
""")
def downsampled_sets(t):
    return P.downsampled(t.customer, ["c_nationkey"], "c_custkey", [0.05, 0.3, 0.9], 2)


@query(f"SELECT vec_id, (row_number() OVER (PARTITION BY label ORDER BY {_draw('vec_id', 0)}, vec_id) - 1) % 10 AS fold FROM embeddings")
def cross_validation_folds(t):
    return P.folds(t.embeddings, ["label"], "vec_id").select("vec_id", F.col("fold").cast("long").alias("fold"))


@query(f"""
WITH d AS (SELECT o_custkey, o_orderkey, o_totalprice - 150000 AS d FROM orders), r AS (SELECT o_custkey, round(avg(d), 6) m FROM d GROUP BY ALL),
s AS (SELECT o_custkey, i, round(avg(d * CASE WHEN {_draw('o_orderkey', 'i')} % 2 = 0 THEN 1 ELSE -1 END), 6) s FROM d, range(50) g(i) GROUP BY ALL)
SELECT o_custkey, round(any_value(m), 4) + 0 AS mean_diff, round(least(2 * least(avg(CASE WHEN m >= s THEN 1.0 ELSE 0 END), avg(CASE WHEN m <= s THEN 1.0 ELSE 0 END)), 1), 6) + 0.0::DOUBLE AS p FROM s JOIN r USING (o_custkey) GROUP BY o_custkey HAVING count(*) > 0
""")
def sign_flip_test(t):
    d = t.orders.withColumn("base", F.lit(150000.0))
    return P.sign_flip_p(d, ["o_custkey"], "o_orderkey", "o_totalprice", "base", 50).select("o_custkey", (F.round("mean_diff", 4) + F.lit(0.0)).alias("mean_diff"), r6(F.col("p")).alias("p"))


@query(f"""
WITH k AS (SELECT label, vec_id, i AS iter, row_number() OVER (PARTITION BY label, i ORDER BY {_draw('vec_id', P.PLACES)}, vec_id) p, row_number() OVER (PARTITION BY label, i ORDER BY {_draw('vec_id', 'i')}, vec_id) m FROM embeddings, range(3) g(i))
SELECT a.label, a.iter::INTEGER AS iter, a.vec_id, b.vec_id AS source FROM k a JOIN k b ON a.label = b.label AND a.iter = b.iter AND a.p = b.m
""")
def permutation_plan(t):
    return P.permutation(t.embeddings.select("label", "vec_id"), ["label"], "vec_id", 3)


@query(f"""
WITH n AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY {_draw('vec_id', P.PLACES)}, vec_id) - 1 p, count(*) OVER (PARTITION BY label) n FROM embeddings),
s AS (SELECT n.*, i AS iter, ({_draw('p * 31 + 7', 'i')}) % n AS s FROM n, range(3) g(i))
SELECT s.label, s.iter::INTEGER AS iter, s.vec_id, b.vec_id AS source FROM s JOIN n b ON b.label = s.label AND b.p = s.s
""")
def bootstrap_plan(t):
    return P.bootstrap(t.embeddings.select("label", "vec_id"), ["label"], "vec_id", 3)


@query(f"""
WITH d AS (SELECT o_orderstatus g, o_orderkey k, o_totalprice v FROM orders), real AS (SELECT g, avg(CASE WHEN k % 2 = 0 THEN v END) - avg(CASE WHEN k % 2 = 1 THEN v END) r FROM d GROUP BY g),
s AS (SELECT g, i, avg(CASE WHEN {_draw('k', 'i')} % 2 = 0 THEN v END) - avg(CASE WHEN {_draw('k', 'i')} % 2 = 1 THEN v END) s FROM d, range(40) x(i) GROUP BY ALL)
SELECT g, round(avg(CASE WHEN r <= s THEN 1.0 ELSE 0 END), 6) + 0.0::DOUBLE AS p FROM s JOIN real USING (g) GROUP BY g
""")
def permutation_test(t):
    d = t.orders.select(F.col("o_orderstatus").alias("g"), F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    gap = lambda bit: F.avg(F.when(bit == 0, F.col("v"))) - F.avg(F.when(bit == 1, F.col("v")))
    real = d.groupBy("g").agg(gap(F.col("k") % 2).alias("d"))
    moved = d.withColumn("iter", F.explode(F.sequence(F.lit(0), F.lit(39)))).groupBy("g", "iter").agg(gap(P.draw(F.col("k"), F.col("iter")) % 2).alias("d"))
    return P.permutation_p(real, moved, ["g"], "d").withColumn("p", r6(F.col("p")))


@query("""
WITH f AS (SELECT user_id, strftime(max(ts), '%b-%d-%Y_%H%M_%S') AS name, max(ts) m FROM events GROUP BY user_id, CAST(ts AS DATE)),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY date_trunc('second', m) DESC, name) k FROM f)
SELECT user_id, name, date_trunc('second', m)::TIMESTAMP AS run_time FROM k WHERE k = 2
""")
def recent_run(t):
    f = t.events.groupBy("user_id", F.to_date("ts").alias("d")).agg(F.max("ts").alias("m")).select("user_id", F.date_format("m", "MMM-dd-yyyy_HHmm_ss").alias("name"))
    return T.recent_runs(f, ["user_id"], "name", 1).select("user_id", "name", F.col("run_time").cast("timestamp_ntz").alias("run_time"))
