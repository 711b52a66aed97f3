"""Statistics over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats as S
from ..functions.stats import r6
from ..operators import aggregates as A
from .registry import query

_CLASSES = ", ".join(f"({k})" for k in range(10))


def features(t):
    """(vec_id, label, feat_ix, v): embeddings, one row an entry."""
    return t.embeddings.select("vec_id", "label", F.posexplode("embedding").alias("feat_ix", "v")).withColumn("v", F.col("v").cast("double"))


_FEATURES = "(SELECT vec_id, label, unnest(range(0, 64))::INTEGER AS feat_ix, unnest(embedding)::DOUBLE AS v FROM embeddings)"


def _sums(t):
    """Per feature and class: n, sum, sum of squares. One scan and one aggregation serve all axes."""
    return features(t).groupBy("feat_ix", "label").agg(F.count("*").alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))


@query(f"""
WITH f AS {_FEATURES},
g AS (SELECT feat_ix, label, count(*) n, sum(v) s, sum(v * v) q FROM f GROUP BY ALL),
a AS (SELECT g.feat_ix, x.axis, sum(CASE WHEN label = axis THEN n END) n1, sum(CASE WHEN label <> axis THEN n END) n0,
  sum(CASE WHEN label = axis THEN s END) s1, sum(CASE WHEN label <> axis THEN s END) s0,
  sum(CASE WHEN label = axis THEN q END) q1, sum(CASE WHEN label <> axis THEN q END) q0
  FROM g, (VALUES {_CLASSES}) x(axis) GROUP BY ALL),
m AS (SELECT *, s1 / n1 m1, s0 / n0 m0, (q1 - s1 * s1 / n1) w1, (q0 - s0 * s0 / n0) w0 FROM a)
SELECT axis, feat_ix, n0::BIGINT n0, n1::BIGINT n1, round(m0, 6) + 0 AS mean0, round(m1, 6) + 0 AS mean1,
  round((m1 - m0) / sqrt((w1 + w0) / (n1 + n0 - 2) * (1.0 / n1 + 1.0 / n0)), 6) + 0 AS t,
  round((m1 - m0) * sqrt(n1 * n0 / ((n1 + n0) * 1.0)) / sqrt(w1 + w0 + (n1 * n0 / ((n1 + n0) * 1.0)) * (m1 - m0) * (m1 - m0)), 6) + 0 AS r
FROM m
""")
def semantic_discrim(t):
    """Flagship: t and point-biserial correlation of each feature for each class against the rest."""
    axis = F.explode(F.sequence(F.lit(0), F.lit(9))).alias("axis")
    one = F.col("label") == F.col("axis")
    rows = _sums(t).select("*", axis)
    part = lambda c, hit, name: F.sum(F.when(one if hit else ~one, F.col(c))).alias(name)
    a = rows.groupBy("axis", "feat_ix").agg(*[part(c, hit, f"{c}{int(hit)}") for c in "nsq" for hit in (True, False)])
    m1, m0 = F.col("s1") / F.col("n1"), F.col("s0") / F.col("n0")
    w = (F.col("q1") - F.col("s1") * m1) + (F.col("q0") - F.col("s0") * m0)
    n = F.col("n1") + F.col("n0")
    share = F.col("n1") * F.col("n0") / n
    tt = (m1 - m0) / F.sqrt(w / (n - 2) * (1 / F.col("n1") + 1 / F.col("n0")))
    r = (m1 - m0) * F.sqrt(share) / F.sqrt(w + share * (m1 - m0) * (m1 - m0))
    return a.select("axis", "feat_ix", "n0", "n1", r6(m0).alias("mean0"), r6(m1).alias("mean1"), r6(tt).alias("t"), r6(r).alias("r"))


@query("""
SELECT l_returnflag, l_linestatus, count(*) n,
  round(corr(l_quantity, l_extendedprice), 6) + 0 AS r,
  round(1 - sum(pow(l_extendedprice - 1500 * l_quantity, 2)) / (var_pop(l_extendedprice) * count(*)), 6) + 0 AS r2,
  round(regr_slope(l_extendedprice, l_quantity), 6) + 0 AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) + 0 AS intercept,
  round(regr_r2(l_extendedprice, l_quantity), 6) + 0 AS fit_r2
FROM lineitem GROUP BY ALL
""")
def correlation_and_fit(t):
    x, y = F.col("l_quantity"), F.col("l_extendedprice")
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), r6(S.corr(x, y)).alias("r"), r6(S.r2(y, 1500 * x)).alias("r2"), r6(F.regr_slope(y, x)).alias("slope"), (F.round(F.regr_intercept(y, x), 4) + F.lit(0.0)).alias("intercept"), r6(F.regr_r2(y, x)).alias("fit_r2")
    )


@query("""
WITH g AS (SELECT c_nationkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 1 WHEN c_mktsegment = 'MACHINERY' THEN 0 END k, c_acctbal v FROM customer),
a AS (SELECT c_nationkey, count(v) FILTER (k = 1) n1, count(v) FILTER (k = 0) n0, avg(v) FILTER (k = 1) m1, avg(v) FILTER (k = 0) m0,
  var_samp(v) FILTER (k = 1) v1, var_samp(v) FILTER (k = 0) v0 FROM g GROUP BY ALL)
SELECT c_nationkey, n1, n0,
  round((m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2) * (1.0 / n1 + 1.0 / n0)), 6) + 0 AS t_pooled,
  round((m1 - m0) / sqrt(v1 / n1 + v0 / n0), 6) + 0 AS t_welch FROM a
""")
def two_sample_t(t):
    seg, v = F.col("c_mktsegment"), F.col("c_acctbal")
    k = F.when(seg == "BUILDING", True).when(seg == "MACHINERY", False)
    return t.customer.withColumn("k", k).groupBy("c_nationkey").agg(F.count(F.when(F.col("k"), v)).alias("n1"), F.count(F.when(~F.col("k"), v)).alias("n0"), r6(S.pooled_t(v, F.col("k"))).alias("t_pooled"), r6(S.welch_t(v, F.col("k"))).alias("t_welch"))


def _integral(low, high, power):
    """Simpson's rule in SQL over x of power(x), on 1000 intervals."""
    x = f"(({low}) + (({high}) - ({low})) * k / 1000.0)"
    return f"(SELECT (({high}) - ({low})) / 3000.0 * sum(CASE WHEN k IN (0, 1000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * {power(x)}) FROM range(1001) s(k))"


def t_tail(t, dof):
    """Two-sided tail of t in SQL: the density over angles whose tangent is t / sqrt(dof), by the root of the angle from the right one."""
    density = lambda x: f"pow(abs(sin({x} * {x})), ({dof}) - 1) * 2 * {x}"
    return f"2 * exp(lgamma((({dof}) + 1) / 2.0) - lgamma(({dof}) / 2.0)) / sqrt(pi()) * " + _integral("0.0", f"sqrt(pi() / 2 - atan(abs({t}) / sqrt({dof})))", density)


def _f_tail(f, between, within):
    """Tail of a variance ratio in SQL: the beta density over angles."""
    density = lambda x: f"pow(abs(sin({x})), ({within}) - 1) * pow(abs(cos({x})), ({between}) - 1)"
    top = f"asin(sqrt(({within}) / (({within}) + ({between}) * ({f}))))"
    return f"2 * exp(lgamma((({within}) + ({between})) / 2.0) - lgamma(({within}) / 2.0) - lgamma(({between}) / 2.0)) * " + _integral("0.0", top, density)


@query(f"""
WITH g AS (SELECT c_nationkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 1 WHEN c_mktsegment = 'MACHINERY' THEN 0 END k, c_acctbal v FROM customer),
a AS (SELECT c_nationkey, count(v) FILTER (k = 1) n1, count(v) FILTER (k = 0) n0, avg(v) FILTER (k = 1) m1, avg(v) FILTER (k = 0) m0, var_samp(v) FILTER (k = 1) v1, var_samp(v) FILTER (k = 0) v0 FROM g GROUP BY ALL),
t AS (SELECT c_nationkey, (m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2) * (1.0 / n1 + 1.0 / n0)) t, n1 + n0 - 2.0 d, (m1 - m0) / sqrt(v1 / n1 + v0 / n0) w, pow(v1 / n1 + v0 / n0, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v0 / n0, 2) / (n0 - 1)) e FROM a WHERE n1 > 1 AND n0 > 1)
SELECT c_nationkey, round(e, 5) + 0 AS welch_dof, round({t_tail('t', 'd')}, 6) + 0 AS p_pooled, round({t_tail('w', 'e')}, 6) + 0 AS p_welch FROM t
""")
def two_sample_p(t):
    """Two-sided p of the pooled and the unequal-variance t."""
    seg, v = F.col("c_mktsegment"), F.col("c_acctbal")
    k = F.col("k")
    rows = t.customer.withColumn("k", F.when(seg == "BUILDING", True).when(seg == "MACHINERY", False)).groupBy("c_nationkey")
    n1, n0 = F.count(F.when(k, v)), F.count(F.when(~k, v))
    rows = rows.agg(n1.alias("n1"), n0.alias("n0"), S.pooled_t(v, k).alias("t"), S.welch_t(v, k).alias("w"), S.welch_dof(v, k).alias("e")).where("n1 > 1 and n0 > 1")
    return rows.select("c_nationkey", (F.round("e", 5) + F.lit(0.0)).alias("welch_dof"), r6(S.t_p(F.col("t"), F.col("n1") + F.col("n0") - 2)).alias("p_pooled"), r6(S.t_p(F.col("w"), F.col("e"))).alias("p_welch"))


@query(f"""
WITH e AS (SELECT user_id, event_type, count(value) n, avg(value) m, coalesce(var_pop(value) * count(value), 0) w FROM events GROUP BY ALL),
g AS (SELECT user_id, sum(n) n, count(*) k, sum(n * m) / sum(n) gm, sum(n * m * m) - sum(n) * pow(sum(n * m) / sum(n), 2) b, sum(w) w FROM e GROUP BY user_id),
f AS (SELECT user_id, k - 1.0 AS b, (n - k) * 1.0 AS w, (b / (k - 1)) / (w / (n - k)) f FROM g WHERE k > 1 AND n > k AND w > 0)
SELECT user_id, round({_f_tail('f', 'b', 'w')}, 5) + 0 AS p FROM f
""")
def anova_p(t):
    """p of the one-way F."""
    rows = S.anova_f(t.events, ["user_id"], "event_type", "value").where("f is not null")
    return rows.select("user_id", (F.round(S.f_p(F.col("f"), F.col("groups") - 1, F.col("n") - F.col("groups")), 5) + F.lit(0.0)).alias("p"))


@query("""
WITH e AS (SELECT user_id, event_type, count(value) n, avg(value) m, coalesce(var_pop(value) * count(value), 0) w FROM events GROUP BY ALL),
g AS (SELECT user_id, sum(n) n, count(*) k, sum(n * m) / sum(n) gm, sum(n * m * m) - sum(n) * pow(sum(n * m) / sum(n), 2) b, sum(w) w FROM e GROUP BY user_id)
SELECT user_id, n::BIGINT n, k AS groups, round(CASE WHEN k > 1 AND n > k AND w > 0 THEN (b / (k - 1)) / (w / (n - k)) END, 5) + 0 AS f FROM g
""")
def anova(t):
    return S.anova_f(t.events, ["user_id"], "event_type", "value").select("user_id", "n", "groups", (F.round("f", 5) + F.lit(0.0)).alias("f"))


@query(f"""
WITH f AS {_FEATURES}, w AS (SELECT vec_id, max(CASE WHEN feat_ix = 0 THEN v END) c, max(CASE WHEN feat_ix = 1 THEN v END) y FROM f GROUP BY vec_id),
r AS (SELECT feat_ix, corr(v, y) rxy, corr(v, c) rxc, corr(y, c) ryc FROM f JOIN w USING (vec_id) WHERE feat_ix > 1 GROUP BY feat_ix)
SELECT feat_ix, round((rxy - rxc * ryc) / sqrt((1 - rxc * rxc) * (1 - ryc * ryc)), 6) + 0 AS partial_r, round((rxy - rxc * ryc) / (1 - rxc * rxc), 6) + 0 AS beta FROM r
""")
def partial_correlation(t):
    rows = t.embeddings.select(F.col("embedding")[0].cast("double").alias("c"), F.col("embedding")[1].cast("double").alias("y"), F.posexplode("embedding").alias("feat_ix", "v")).where("feat_ix > 1").withColumn("v", F.col("v").cast("double"))
    r = rows.groupBy("feat_ix").agg(S.corr(F.col("v"), F.col("y")).alias("a"), S.corr(F.col("v"), F.col("c")).alias("b"), S.corr(F.col("y"), F.col("c")).alias("d"))
    args = [F.col(k) for k in "abd"]
    return r.select("feat_ix", r6(S.partial_corr(*args)).alias("partial_r"), r6(S.standardised_beta(*args)).alias("beta"))


@query("""
WITH c AS (SELECT user_id, (hour(ts) * 60 + minute(ts)) / 1440.0 * 2 * pi() x, day(ts) / 31.0 * 2 * pi() y FROM events),
s AS (SELECT user_id, count(*) n, sum(cos(x) * cos(y)) a, sum(sin(x) * sin(y)) b, sum(cos(x) * sin(y)) c, sum(sin(x) * cos(y)) d,
  sum(cos(2 * x)) e, sum(sin(2 * x)) f, sum(cos(2 * y)) g, sum(sin(2 * y)) h FROM c GROUP BY user_id)
SELECT user_id, n, round(4 * (a * b - c * d) / sqrt((n * n - e * e - f * f) * (n * n - g * g - h * h)), 5) + 0 AS rho FROM s WHERE n > 2
""")
def circular_correlation(t):
    x = (F.hour("ts") * 60 + F.minute("ts")) / 1440.0 * 2 * F.pi()
    y = F.dayofmonth("ts") / 31.0 * 2 * F.pi()
    rows = t.events.select("user_id", x.alias("x"), y.alias("y"))
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), (F.round(S.circular_corr(F.col("x"), F.col("y")), 5) + F.lit(0.0)).alias("rho")).where("n > 2")


_PVALUES = "(SELECT c_nationkey AS family, c_custkey AS id, ((c_custkey * 7919) % 10007 + 1) / 10007.0 * CASE WHEN c_custkey % 5 = 0 THEN 0.001 ELSE 1 END AS p FROM customer)"


def _pvalues(t):
    p = ((F.col("c_custkey") * 7919) % 10007 + 1) / F.lit(10007.0) * F.when(F.col("c_custkey") % 5 == 0, 0.001).otherwise(1.0)
    return t.customer.select(F.col("c_nationkey").alias("family"), F.col("c_custkey").alias("id"), p.alias("p"))


@query(f"""
WITH r AS (SELECT *, count(*) OVER (PARTITION BY family) n, row_number() OVER (PARTITION BY family ORDER BY p) k FROM {_PVALUES}),
h AS (SELECT family, sum(1.0 / i) c FROM (SELECT DISTINCT family, n FROM r) f, range(1, 100001) g(i) WHERE i <= n GROUP BY family)
SELECT family, id, round(least(min(p * n / k) OVER w, 1), 6) + 0 AS p_bh, round(least(min(p * n * c / k) OVER w, 1), 6) + 0 AS p_by
FROM r JOIN h USING (family) WINDOW w AS (PARTITION BY family ORDER BY k DESC)
""")
def adjusted_p(t):
    bh = S.adjusted(_pvalues(t), "p", ["family"]).withColumnRenamed("p_adj", "p_bh")
    both = S.adjusted(bh, "p", ["family"], "by").withColumnRenamed("p_adj", "p_by")
    return both.select("family", "id", r6(F.col("p_bh")).alias("p_bh"), r6(F.col("p_by")).alias("p_by"))


@query(f"""
WITH r AS (SELECT *, count(*) OVER (PARTITION BY family) n, row_number() OVER (PARTITION BY family ORDER BY p) k FROM {_PVALUES}),
h AS (SELECT family, sum(1.0 / i) c FROM (SELECT DISTINCT family, n FROM r) f, range(1, 100001) g(i) WHERE i <= n GROUP BY family),
x AS (SELECT *, min(CASE WHEN p <= 0.05 / (n - k + 1) THEN 1 ELSE 0 END) OVER (PARTITION BY family ORDER BY k) ok FROM r JOIN h USING (family))
SELECT family, round(coalesce(max(CASE WHEN p <= k / (n * 1.0) * 0.05 THEN p END), 0), 8) AS bh, round(coalesce(max(CASE WHEN p <= k / (n * 1.0) * 0.05 / c THEN p END), 0), 8) AS by_,
  round(coalesce(max(CASE WHEN p <= 0.05 / (n - k + 1) THEN p END), 0), 8) AS step_up, round(coalesce(max(CASE WHEN ok = 1 THEN p END), 0), 8) AS holm
FROM x GROUP BY family
""")
def significance_thresholds(t):
    p, out = _pvalues(t), None
    for method, name in (("bh", "bh"), ("by", "by_"), ("holm_step_up", "step_up"), ("holm", "holm")):
        one = S.step_up_threshold(p, "p", ["family"], 0.05, method).select("family", F.round("threshold", 8).alias(name))
        out = one if out is None else out.join(one, "family")
    return out


@query(f"""
WITH r AS (SELECT *, count(*) OVER (PARTITION BY family) n, row_number() OVER (PARTITION BY family ORDER BY p) k FROM {_PVALUES}),
l AS (SELECT i, exp(ln(0.1) + (ln(0.000001) - ln(0.1)) * i / 99) q FROM range(100) g(i)),
t AS (SELECT family, i, q, coalesce(max(CASE WHEN p <= k / (n * 1.0) * q THEN p END), 0) c FROM l, r GROUP BY ALL)
SELECT family, id, round(coalesce(min(CASE WHEN p <= c THEN q END), 1), 9) AS level FROM r JOIN t USING (family) GROUP BY ALL
""")
def threshold_scan(t):
    """The smallest of 100 levels at which each value passes: the first that is not under its adjusted p."""
    levels = F.array(*[F.lit(q) for q in S.scan_thresholds()])
    passed = F.array_min(F.filter(levels, lambda q: q >= F.col("p_adj")))
    return S.adjusted(_pvalues(t), "p", ["family"]).select("family", "id", F.round(F.coalesce(passed, F.lit(1.0)), 9).alias("level"))


@query("""
WITH v AS (SELECT p_partkey, (p_retailprice % 100) / 100.0 c, (p_size % 30) / 50.0 a, (p_partkey % 17) / 40.0 b FROM part)
SELECT p_partkey, round(a + b - c, 6) + 0 AS shared, round(c - b, 6) + 0 AS unique_a, round(c - a, 6) + 0 AS unique_b,
  round(CASE WHEN c > 0 THEN least(greatest((a + b - c) / c, 0), 1) END, 6) + 0 AS shared_share FROM v
""")
def variance_partition(t):
    v = t.part.select("p_partkey", ((F.col("p_retailprice") % 100) / 100.0).alias("c"), ((F.col("p_size") % 30) / 50.0).alias("a"), ((F.col("p_partkey") % 17) / 40.0).alias("b"))
    args = [F.col(k) for k in "cab"]
    plain, share = S.shared_unique(*args), S.shared_unique(*args, proportion=True, clip=True, drop_bad=True)
    return v.select("p_partkey", *(r6(c).alias(n) for c, n in zip(plain, ("shared", "unique_a", "unique_b"), strict=True)), r6(share[0]).alias("shared_share"))


@query("""
WITH k AS (SELECT count(*) FILTER (r >= 3) a, count(*) FILTER (r = 2) b, count(*) FILTER (r = 1) d FROM (SELECT l_orderkey, count(*) r FROM lineitem GROUP BY ALL)),
s AS (SELECT s_suppkey, abs(s_acctbal) / 5000 x FROM supplier)
SELECT s_suppkey, round(100 * x * x / (x * x + 1.0 / 3), 6) + 0 AS nc3, round(100 * x * x / (x * x + (a / 3.0 + b / 2.0 + d) / (a + b + d)), 6) + 0 AS nc_unequal FROM s, k
""")
def noise_ceilings(t):
    reps = t.lineitem.groupBy("l_orderkey").count()
    k = reps.agg(*[F.count_if(c).cast("double").alias(n) for c, n in ((F.col("count") >= 3, "a"), (F.col("count") == 2, "b"), (F.col("count") == 1, "d"))])
    rows = t.supplier.select("s_suppkey", (F.abs("s_acctbal") / 5000).alias("x"), F.lit(1).alias("one")).join(F.broadcast(k.withColumn("one", F.lit(1))), "one")
    return rows.select("s_suppkey", r6(S.noise_ceiling(F.col("x"), 3)).alias("nc3"), r6(S.noise_ceiling_unequal(F.col("x"), F.col("a"), F.col("b"), F.col("d"))).alias("nc_unequal"))


@query("""
WITH d AS (SELECT o_custkey % 25 g, o_orderstatus a, CASE WHEN o_orderkey % 4 = 0 THEN 'F' WHEN o_orderkey % 4 = 1 THEN 'O' ELSE o_orderstatus END p FROM orders WHERE o_orderstatus IN ('F', 'O'))
SELECT g, count(*) n, round(count(*) FILTER (p = 'F' AND a = 'F') / (count(*) FILTER (a = 'F') * 1.0), 6) AS hit_f, round(count(*) FILTER (p = 'F' AND a = 'O') / (count(*) FILTER (a = 'O') * 1.0), 6) AS alarm_f FROM d GROUP BY g
""")
def hit_rates(t):
    d = _predictions(t)
    rate = lambda p, a: F.round(F.try_divide(F.count_if((F.col("p") == p) & (F.col("a") == a)).cast("double"), F.count_if(F.col("a") == a)), 6)
    return d.groupBy("g").agg(F.count("*").alias("n"), rate("F", "F").alias("hit_f"), rate("F", "O").alias("alarm_f"))


def _predictions(t):
    k = F.col("o_orderkey") % 4
    return t.orders.where("o_orderstatus in ('F', 'O')").select((F.col("o_custkey") % 25).alias("g"), F.col("o_orderstatus").alias("a"), F.when(k == 0, "F").when(k == 1, "O").otherwise(F.col("o_orderstatus")).alias("p"))


def _sql_inverse_normal(p):
    """Acklam's rational approximation in SQL, by the same fixed coefficients."""
    horner = lambda cs, x: "(" * (len(cs) - 1) + f"{cs[0]!r}" + "".join(f") * {x} + {c!r}" for c in cs[1:])
    tail = lambda q: f"(({horner(S._C, q)}) / ({horner((*S._D, 1.0), q)}))"
    q = f"({p} - 0.5)"
    middle = f"(({horner(S._A, f'({q} * {q})')}) * {q} / ({horner((*S._B, 1.0), f'({q} * {q})')}))"
    return f"(CASE WHEN {p} < 0.02425 THEN {tail(f'sqrt(-2 * ln({p}))')} WHEN {p} > 1 - 0.02425 THEN -{tail(f'sqrt(-2 * ln(1 - {p}))')} ELSE {middle} END)"


@query(f"""
WITH d AS (SELECT o_custkey % 25 g, o_orderstatus a, CASE WHEN o_orderkey % 4 = 0 THEN 'F' WHEN o_orderkey % 4 = 1 THEN 'O' ELSE o_orderstatus END p FROM orders WHERE o_orderstatus IN ('F', 'O')),
c AS (SELECT g, k.k, count(*) n, count(*) FILTER (a = k) real, count(*) FILTER (a = k AND p = k) hit, count(*) FILTER (a <> k AND p = k) said FROM d, (VALUES ('F'), ('O')) k(k) GROUP BY ALL),
r AS (SELECT g, n, CASE hit WHEN 0 THEN 1 / (2.0 * n) WHEN real THEN 1 - 1 / (2.0 * n) ELSE hit / (real * 1.0::DOUBLE) END h, CASE said WHEN 0 THEN 1 / (2.0 * n) WHEN n - real THEN 1 - 1 / (2.0 * n) ELSE said / ((n - real) * 1.0::DOUBLE) END f, real FROM c)
SELECT g, n, CASE WHEN min(real) > 0 THEN round(avg(CASE WHEN real > 0 AND real < n THEN {_sql_inverse_normal('h::DOUBLE')} - {_sql_inverse_normal('f::DOUBLE')} END), 6) + 0 END AS dprime FROM r GROUP BY g, n
""")
def dprime(t):
    return S.dprime(_predictions(t), ["g"], "a", "p").withColumn("dprime", r6(F.col("dprime")))


for _kind, _edges in (("linear", "SELECT i, lo + (hi + 0.0001 - lo) / 8 * i e FROM (SELECT min(c_acctbal) lo, max(c_acctbal) hi FROM customer), range(9) g(i)"), ("density", "SELECT i, quantile_cont(c_acctbal, i / 8.0) + CASE WHEN i = 8 THEN 0.0001 ELSE 0 END e FROM customer, range(9) g(i) GROUP BY i")):
    _sql = f"""
    WITH e AS ({_edges if _kind == "linear" else "SELECT g.i, (SELECT list(x) FROM (SELECT unnest(quantile_cont(c_acctbal, [0, 0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875, 1])) x FROM customer))[g.i + 1] + CASE WHEN g.i = 8 THEN 0.0001 ELSE 0 END e FROM range(9) g(i)"})
    SELECT a.i AS bin, round((a.e + b.e) / 2, 4) + 0 AS centre, round(avg(c_custkey), 4) + 0 AS mean, round(stddev_pop(c_custkey), 4) + 0 AS sd, round(sum(c_custkey)::DOUBLE, 4) + 0 AS total, count(*) n
    FROM e a JOIN e b ON b.i = a.i + 1 JOIN customer ON c_acctbal >= a.e AND c_acctbal < b.e GROUP BY ALL"""

    def _binned(t, kind=_kind):
        out = A.binned(t.customer, "c_acctbal", "c_custkey", 8, kind)
        return out.select(F.col("bin").cast("long").alias("bin"), *((F.round(c, 4) + F.lit(0.0)).alias(c) for c in ("centre", "mean", "sd", "total")), "n")

    _binned.__name__ = f"binned_{_kind}"
    query(_sql)(_binned)


@query("""
SELECT row_number() OVER (ORDER BY p_size)::BIGINT - 1 AS bin, p_size::DOUBLE AS centre, round(avg(p_retailprice), 4) + 0 AS mean, round(sum(p_retailprice), 3) + 0 AS total, count(*) n FROM part GROUP BY p_size
""")
def binned_unique(t):
    return A.binned(t.part, "p_size", "p_retailprice", 0, "unique").select(F.col("bin").cast("long").alias("bin"), "centre", (F.round("mean", 4) + F.lit(0.0)).alias("mean"), (F.round("total", 3) + F.lit(0.0)).alias("total"), "n")


@query(f"WITH f AS {_FEATURES} SELECT label, feat_ix, round(avg(v), 6) + 0 AS mean, round(var_pop(v), 6) + 0 AS var, count(*) n FROM f GROUP BY ALL")
def feature_stats(t):
    return A.feature_stats(features(t), ["label", "feat_ix"], "v").select("label", "feat_ix", r6(F.col("mean")).alias("mean"), r6(F.col("var")).alias("var"), "n")


@query(f"WITH f AS {_FEATURES} SELECT a.feat_ix AS i, b.feat_ix AS j, round(covar_samp(a.v, b.v), 6) + 0 AS cov FROM f a JOIN f b ON a.vec_id = b.vec_id AND a.feat_ix <= b.feat_ix GROUP BY ALL")
def feature_covariance(t):
    return A.covariance(t.embeddings, "embedding", 64).select("i", "j", r6(F.col("cov")).alias("cov"))
