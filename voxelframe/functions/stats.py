"""Statistics as aggregate expressions and DataFrame functions.

Zero variance gives NULL, never NaN and never an error.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.joins import same_keys


def r6(c: Column) -> Column:
    """Rounded to 6 places, without a negative zero."""
    return F.round(c, 6) + F.lit(0.0)


def mean_pop(c: Column) -> Column:
    return F.avg(c)


def corr(x: Column, y: Column) -> Column:
    """Pearson correlation; NULL where either side does not vary."""
    return F.try_divide(F.covar_pop(x, y), F.nullif(F.sqrt(F.var_pop(x) * F.var_pop(y)), F.lit(0.0)))


def r2(actual: Column, predicted: Column) -> Column:
    """1 - SSE / SST about the mean of the actual values; may be negative."""
    return 1 - F.try_divide(F.sum(F.pow(predicted - actual, F.lit(2))), F.nullif(F.var_pop(actual) * F.count(actual), F.lit(0.0)))


def sse(actual: Column, predicted: Column) -> Column:
    return F.sum(F.pow(predicted - actual, F.lit(2)))


def pooled_t(value: Column, group: Column) -> Column:
    """Equal-variance t of group true against group false."""
    a, b = F.when(group, value), F.when(~group, value)
    na, nb = F.count(a), F.count(b)
    var = F.try_divide((na - 1) * F.var_samp(a) + (nb - 1) * F.var_samp(b), na + nb - 2)
    return F.try_divide(F.avg(a) - F.avg(b), F.nullif(F.sqrt(var * (F.try_divide(F.lit(1.0), na) + F.try_divide(F.lit(1.0), nb))), F.lit(0.0)))


def welch_t(value: Column, group: Column) -> Column:
    """Unequal-variance t of group true against group false."""
    a, b = F.when(group, value), F.when(~group, value)
    return F.try_divide(F.avg(a) - F.avg(b), F.nullif(F.sqrt(F.try_divide(F.var_samp(a), F.count(a)) + F.try_divide(F.var_samp(b), F.count(b))), F.lit(0.0)))


# Lanczos's approximation of the gamma function, g = 7: fixed coefficients.
_LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function of x >= 0.5."""
    series = F.lit(_LANCZOS[0])
    for k, c in enumerate(_LANCZOS[1:]):
        series = series + c / (x + k)
    t = x + 6.5
    return math.log(2 * math.pi) / 2 + (x - 0.5) * F.log(t) - t + F.log(series)


def beta_share(a: Column, b: Column, x: Column) -> Column:
    """Regularised incomplete beta function for a, b >= 0.5 (Lentz's continued fraction, in as many steps as a and b need)."""
    turned = x > (a + 1) / (a + b + 2)
    state = lambda c, d, h: F.struct(c.alias("c"), d.alias("d"), h.alias("h"))
    bind = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))
    safe = lambda v: F.when(F.abs(v) < 1e-300, 1e-300).otherwise(v)

    def fraction(s):
        p, q, y = s["p"], s["q"], s["y"]

        def half(t, term):
            d, c = 1 / safe(1 + term * t["d"]), safe(1 + term / t["c"])
            return bind(F.struct(c.alias("c"), d.alias("d"), t["h"].alias("h")), lambda u: state(u["c"], u["d"], u["h"] * u["c"] * u["d"]))

        def step(t, m):
            first = m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m))
            second = -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))
            return bind(half(t, first), lambda u: half(u, second))

        start = bind(1 / safe(1 - (p + q) * y / (p + 1)), lambda d: state(F.lit(1.0), d, d))
        steps = F.transform(F.sequence(F.lit(1), (F.lit(40) + 4 * F.sqrt(F.greatest(p, q))).cast("int")), lambda m: m.cast("double"))
        front = F.exp(log_gamma(p + q) - log_gamma(p) - log_gamma(q) + p * F.log(y) + q * F.log(1 - y))
        return front * F.aggregate(steps, start, step, lambda t: t["h"]) / p

    parts = F.struct(F.when(turned, b).otherwise(a).cast("double").alias("p"), F.when(turned, a).otherwise(b).cast("double").alias("q"), F.when(turned, 1 - x).otherwise(x).cast("double").alias("y"))
    inside = bind(parts, fraction)
    return F.when(x.isNull() | a.isNull() | b.isNull(), None).when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(F.when(turned, 1 - inside).otherwise(inside))


def t_p(t: Column, dof: Column) -> Column:
    """Two-sided p of t with dof degrees of freedom; NULL without any."""
    return F.when(dof > 0, beta_share(dof / 2.0, F.lit(0.5), dof / (dof + t * t)))


def f_p(f: Column, between: Column, within: Column) -> Column:
    """p of a variance ratio; NULL without degrees of freedom."""
    return F.when((between > 0) & (within > 0), beta_share(within / 2.0, between / 2.0, within / (within + between * f)))


def welch_dof(value: Column, group: Column) -> Column:
    """Degrees of freedom of welch_t (Welch and Satterthwaite)."""
    a, b = F.when(group, value), F.when(~group, value)
    va, vb = F.try_divide(F.var_samp(a), F.count(a)), F.try_divide(F.var_samp(b), F.count(b))
    return F.try_divide((va + vb) * (va + vb), F.nullif(F.try_divide(va * va, F.count(a) - 1) + F.try_divide(vb * vb, F.count(b) - 1), F.lit(0.0)))


def anova_f(df: DataFrame, by: list[str], group: str, value: str) -> DataFrame:
    """One-way F for each key of by: (by, n, groups, f). Two partial aggregations, no join."""
    each = df.groupBy(*by, group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.coalesce(F.var_pop(value) * F.count(value), F.lit(0.0)).alias("w"))
    n, k = F.sum("n"), F.count_if(F.col("n") > 0)
    grand = F.try_divide(F.sum(F.col("n") * F.col("m")), n)
    between = F.sum(F.col("n") * F.col("m") * F.col("m")) - n * grand * grand
    f = F.try_divide(F.try_divide(between, F.nullif(k - 1, F.lit(0))), F.nullif(F.try_divide(F.sum("w"), F.nullif(n - k, F.lit(0))), F.lit(0.0)))
    return each.groupBy(*by).agg(n.alias("n"), k.alias("groups"), f.alias("f"))


def circular_corr(x: Column, y: Column) -> Column:
    """Fisher and Lee's correlation of two angles in radians."""
    s = lambda c: F.sum(c)
    a, b = s(F.cos(x) * F.cos(y)), s(F.sin(x) * F.sin(y))
    c, d = s(F.cos(x) * F.sin(y)), s(F.sin(x) * F.cos(y))
    e, f, g, h = s(F.cos(2 * x)), s(F.sin(2 * x)), s(F.cos(2 * y)), s(F.sin(2 * y))
    n = F.count(x) * F.count(x)
    return F.try_divide(4 * (a * b - c * d), F.nullif(F.sqrt((n - e * e - f * f) * (n - g * g - h * h)), F.lit(0.0)))


def partial_corr(rxy: Column, rxc: Column, ryc: Column) -> Column:
    """Correlation of x and y given one covariate c, from the three correlations."""
    return F.try_divide(rxy - rxc * ryc, F.nullif(F.sqrt((1 - rxc * rxc) * (1 - ryc * ryc)), F.lit(0.0)))


def standardised_beta(rxy: Column, rxc: Column, ryc: Column) -> Column:
    """Standardised weight of x for y beside one covariate c."""
    return F.try_divide(rxy - rxc * ryc, F.nullif(1 - rxc * rxc, F.lit(0.0)))


def shared_unique(combined: Column, just_a: Column, just_b: Column, proportion: bool = False, clip: bool = False, drop_bad: bool = False) -> list[Column]:
    """(shared, unique a, unique b) of explained variance."""
    if drop_bad:
        good = combined > 0
        combined, just_a, just_b = (F.when(good, c) for c in (combined, just_a, just_b))
    parts = [just_a + just_b - combined, combined - just_b, combined - just_a]
    if proportion:
        parts = [F.try_divide(p, F.nullif(combined, F.lit(0.0))) for p in parts]
    if clip:
        parts = [F.when(p.isNotNull(), F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))) for p in parts]
    return parts


def noise_ceiling(ncsnr: Column, repeats: int = 1) -> Column:
    """100 s^2 / (s^2 + 1/n)."""
    return 100 * ncsnr * ncsnr / (ncsnr * ncsnr + F.lit(1.0 / repeats))


def noise_ceiling_unequal(ncsnr: Column, three: Column, two: Column, one: Column) -> Column:
    """As noise_ceiling, when so many images have three, two and one repetitions."""
    noise = (three / 3 + two / 2 + one) / (three + two + one)
    return 100 * ncsnr * ncsnr / (ncsnr * ncsnr + noise)


# The inverse normal by Acklam's rational approximation (error below 1.2e-9): fixed coefficients.
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)


def _poly(coefficients, x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def inverse_normal(p: Column) -> Column:
    """z with that share of the normal distribution below it, for 0 < p < 1."""
    tail = lambda q: _poly(_C, q) / _poly((*_D, 1.0), q)
    q = p - 0.5
    middle = _poly(_A, q * q) * q / _poly((*_B, 1.0), q * q)
    return F.when(p < 0.02425, tail(F.sqrt(-2 * F.log(p)))).when(p > 1 - 0.02425, -tail(F.sqrt(-2 * F.log(1 - p)))).otherwise(middle)


def dprime(df: DataFrame, by: list[str], actual: str, predicted: str) -> DataFrame:
    """Mean over classes of z(hit rate) - z(false-alarm rate) for each key: (by, n, dprime).

    Rates of 0 and 1 become 1/2N and 1 - 1/2N. NULL where a predicted class is
    no actual class, or only one class exists.
    """
    cells = df.groupBy(*by, actual, predicted).agg(F.count("*").alias("c"))
    key = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    cells = cells.withColumn("n", F.sum("c").over(key))
    rows = cells.groupBy(*by, actual).agg(F.sum("c").alias("real"), F.sum(F.when(F.col(actual) == F.col(predicted), F.col("c")).otherwise(0)).alias("hit"), F.first("n").alias("n"))
    guessed = cells.groupBy(*by, predicted).agg(F.sum("c").alias("said")).withColumnRenamed(predicted, actual)
    both = rows.join(guessed, [*by, actual], "full")
    rate = lambda a, b: F.try_divide(a.cast("double"), b)
    fix = lambda p: F.when(p == 0, 1 / (2 * F.col("n"))).when(p == 1, 1 - 1 / (2 * F.col("n"))).otherwise(p)
    hit = fix(rate(F.col("hit"), F.col("real")))
    alarm = fix(rate(F.coalesce("said", F.lit(0)) - F.col("hit"), F.nullif(F.col("n") - F.col("real"), F.lit(0))))
    z = inverse_normal(hit) - inverse_normal(alarm)
    bad = F.max(F.when(F.col("real").isNull() | (F.col("real") == F.col("n")), 1).otherwise(0)) == 1
    return both.groupBy(*by).agg(F.max("n").alias("n"), F.when(~bad, F.avg(z)).alias("dprime"))


#: Ranges of p-values that ranks are counted in, finer near 0.
P_BUCKETS = 1024


def _ranked(df: DataFrame, p: str, by: list[str]) -> DataFrame:
    """df without null p, with bucket __b, rank __r and size __n within the keys by.

    Ranks are counted within buckets of p, and buckets by their counts, so that
    no task sorts a whole family.
    """
    rows = df.where(F.col(p).isNotNull()).withColumn("__b", F.least(F.floor(F.pow(F.col(p), F.lit(0.25)) * P_BUCKETS), F.lit(P_BUCKETS - 1)).cast("int"))
    family = Window.partitionBy(*by)
    counts = rows.groupBy(*by, "__b").agg(F.count("*").alias("__k"))
    counts = counts.select(*by, "__b", (F.sum("__k").over(family.orderBy("__b")) - F.col("__k")).alias("__before"), F.sum("__k").over(family).alias("__n"))
    ranked = rows.withColumn("__w", F.row_number().over(Window.partitionBy(*by, "__b").orderBy(p)))
    ranked = same_keys(ranked, counts, [*by, "__b"])
    return ranked.withColumn("__r", F.col("__before") + F.col("__w")).drop("__before", "__w")


def _harmonic(n: Column) -> Column:
    """1 + 1/2 + ... + 1/n; from 1000 on by its asymptotic series, which is exact to double precision there."""
    n = n.cast("double")
    small = F.aggregate(F.sequence(F.lit(1), F.least(n, F.lit(1000.0)).cast("int")), F.lit(0.0), lambda acc, k: acc + 1 / k.cast("double"))
    return F.when(n < 1000, small).otherwise(F.log(n) + 0.5772156649015329 + 1 / (2 * n) - 1 / (12 * n * n))


def adjusted(df: DataFrame, p: str, by: list[str], method: str = "bh") -> DataFrame:
    """Benjamini-Hochberg (bh) or -Yekutieli (by) adjusted p for each row, within the keys by, as p_adj; null for a null p.

    Ties share the largest rank's value. The least value over all later ranks
    is that of the row's own bucket of p and of the later buckets.
    """
    ranked = _ranked(df, p, by)
    factor = F.lit(1.0) if method == "bh" else _harmonic(F.col("__n"))
    ranked = ranked.withColumn("__raw", F.col(p) * F.col("__n") * factor / F.col("__r"))
    least = ranked.groupBy(*by, "__b").agg(F.min("__raw").alias("__least"))
    later = Window.partitionBy(*by).orderBy(F.col("__b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    least = least.select(*by, "__b", F.min("__least").over(later).alias("__later"))
    own = Window.partitionBy(*by, "__b").orderBy(F.col("__r").desc()).rowsBetween(Window.unboundedPreceding, 0)
    out = same_keys(ranked.withColumn("__own", F.min("__raw").over(own)), least, [*by, "__b"])
    out = out.select(*df.columns, F.least("__own", "__later", F.lit(1.0)).alias("p_adj"))
    return out.union(df.where(F.col(p).isNull()).select(*df.columns, F.lit(None).cast("double").alias("p_adj")))


def step_up_threshold(df: DataFrame, p: str, by: list[str], q: float, method: str = "bh") -> DataFrame:
    """The largest p of each family that passes: (by, threshold), 0 where none does.

    method: bh, by (rank / n * q / c) or holm_step_up (q / (n - rank + 1), the
    last rank that passes) or holm (the first that fails ends it).
    """
    ranked = _ranked(df, p, by)
    n, r = F.col("__n"), F.col("__r")
    if method in ("bh", "by"):
        c = F.lit(1.0) if method == "bh" else _harmonic(n)
        passes = F.col(p) <= r / n * q / c
    else:
        passes = F.col(p) <= F.lit(q) / (n - r + 1)
        if method == "holm":
            first = ranked.groupBy(*by).agg(F.min(F.when(~passes, r)).alias("__first"))
            ranked = same_keys(ranked, first, by)
            passes = F.coalesce(r < F.col("__first"), F.lit(True))
    return ranked.groupBy(*by).agg(F.coalesce(F.max(F.when(passes, F.col(p))), F.lit(0.0)).alias("threshold"))


def scan_thresholds(points: int = 100, high: float = 0.1, low: float = 1e-6) -> list[float]:
    """Log-spaced levels of the threshold scan."""
    a, b = math.log(high), math.log(low)
    return [math.exp(a + (b - a) * k / (points - 1)) for k in range(points)]
