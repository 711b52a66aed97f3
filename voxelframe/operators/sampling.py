"""Splits and balanced draws by a hash of the key: repeatable, and the same in any engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .joins import same_keys

MODULUS = 1_000_003


def draw(key: Column, seed) -> Column:
    """An integer below MODULUS that key and seed decide; linear, so any SQL engine computes it alike."""
    seed = F.lit(seed) if isinstance(seed, int) else seed
    return F.pmod((key.cast("long") + 1) * 48271 + (seed.cast("long") + 1) * 69621 + (key.cast("long") % 7919) * (seed.cast("long") % 7907 + 1) * 31, F.lit(MODULUS))


#: Parts of the range of draws, so that no sort holds a whole group.
BUCKETS = 256


def _bucket(order: Column) -> Column:
    return F.floor(order * BUCKETS / MODULUS).cast("int")


def _upto(rows: DataFrame, by: list[str], *more: Column) -> DataFrame:
    """Rows before each bucket of each group, and the group's rows: (by, __bucket, __before, __all, more)."""
    counts = rows.groupBy(*by, "__bucket").agg(F.count("*").alias("__k"), *more)
    group = Window.partitionBy(*by)
    before = F.sum("__k").over(group.orderBy("__bucket")) - F.col("__k")
    return counts.withColumn("__before", before).withColumn("__all", F.sum("__k").over(group)).drop("__k")


def ranked_by_draw(rows: DataFrame, by: list[str], order: Column, key: str, rank: str, n: str | None = None) -> DataFrame:
    """rows with their rank from 1 by (order, key) within by, and with n the group's rows.

    order is a draw. Ranks are counted within buckets of draws, and buckets
    by their counts: no task sorts a whole group.
    """
    rows = rows.withColumn("__order", order).withColumn("__bucket", _bucket(F.col("__order")))
    within = F.row_number().over(Window.partitionBy(*by, "__bucket").orderBy("__order", key))
    out = same_keys(rows.withColumn("__within", within), _upto(rows, by), [*by, "__bucket"])
    out = out.withColumn(rank, F.col("__before") + F.col("__within"))
    if n:
        out = out.withColumn(n, F.col("__all"))
    return out.drop("__order", "__bucket", "__within", "__before", "__all")


def first_by_draw(rows: DataFrame, by: list[str], order: Column, key: str, n: str) -> DataFrame:
    """The n (a column, equal within by) rows of each group that come first by (order, key), with their rank as __r.

    Buckets of draws past the n-th row are dropped before any shuffle of rows.
    """
    rows = rows.withColumn("__order", order).withColumn("__bucket", _bucket(F.col("__order")))
    edges = _upto(rows, by, F.first(n).alias("__least")).where("__before < __least").drop("__least", "__all")
    out = same_keys(rows, edges, [*by, "__bucket"])
    out = out.withColumn("__r", F.col("__before") + F.row_number().over(Window.partitionBy(*by, "__bucket").orderBy("__order", key)))
    return out.where(F.col("__r") <= F.col(n)).drop("__order", "__bucket", "__before")


def split(df: DataFrame, by: list[str], key: str, shared: Column, holdout: float = 0.1, seed: int = 0) -> DataFrame:
    """split: val for shared rows; of the others ceil(holdout * n) by draw are holdout, the rest trn."""
    out = df.withColumn("__shared", F.coalesce(shared, F.lit(False)))
    out = ranked_by_draw(out, [*by, "__shared"], draw(F.col(key), seed), key, "__rank", "__n")
    part = F.when(F.col("__shared"), "val").when(F.col("__rank") <= F.ceil(F.col("__n") * F.lit(holdout) - 1e-9), "holdout").otherwise("trn")
    return out.withColumn("split", part).drop("__shared", "__rank", "__n")


def _iterated(df: DataFrame, iterations: int) -> DataFrame:
    return df.withColumn("iter", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))))


def balanced(df: DataFrame, by: list[str], cells: list[str], key: str, iterations: int = 1, even: bool = False, seed: int = 0, everywhere: bool = False, expected: int | None = None, ranks: bool = False) -> DataFrame:
    """For each iteration equally many rows of each cell: (by, cells, key, iter), with ranks also the place __r of __n.

    The size is the smallest cell's of its by-group (of all groups with
    everywhere), rounded down to even with even. Rows with a null cell value
    are out. expected: number of cells a group must have, else it has no rows.
    """
    full = df.where(" and ".join(f"{c} is not null" for c in cells))
    counts = full.groupBy(*by, *cells).agg(F.count("*").alias("__c"))
    smallest = counts.groupBy(*by).agg(F.min("__c").alias("__n"), F.count("*").alias("__cells"))
    if expected:
        smallest = smallest.where(F.col("__cells") == expected)
    if everywhere:
        least = smallest.agg(F.min("__n").alias("__n"))
        smallest = smallest.drop("__n").withColumn("__one", F.lit(1)).join(least.withColumn("__one", F.lit(1)), "__one").drop("__one")
    n = F.floor(F.col("__n") / 2) * 2 if even else F.col("__n")
    rows = full.select(*by, *cells, key)
    rows = same_keys(rows, smallest.select(*by, n.alias("__n")), by) if by else rows.withColumn("__one", F.lit(1)).join(smallest.select(n.alias("__n"), F.lit(1).alias("__one")), "__one").drop("__one")
    rows = first_by_draw(_iterated(rows, iterations), [*by, *cells, "iter"], draw(F.col(key), F.col("iter") + seed), key, "__n")
    return rows.select(*by, *cells, key, "iter", *(["__r", "__n"] if ranks else []))


def separate_sets(df: DataFrame, by: list[str], label: str, key: str, iterations: int = 1, seed: int = 0) -> DataFrame:
    """Sets of one even size for each by-group and iteration: only_0, only_1, and mixed (half of each).

    (by, set, key, iter); groups that lack a label have none.
    """
    ranked = balanced(df, by, [label], key, iterations, even=True, seed=seed, expected=2, ranks=True).withColumn("__mixed", F.col("__r") <= F.col("__n") / 2)
    one = ranked.select(*by, F.concat(F.lit("only_"), F.col(label).cast("string")).alias("set"), key, "iter")
    return one.union(ranked.where("__mixed").select(*by, F.lit("mixed").alias("set"), key, "iter"))


def downsampled(df: DataFrame, by: list[str], key: str, shares: list[float], iterations: int = 1, seed: int = 0) -> DataFrame:
    """round(n * share) rows of each group for each share and iteration: (by, share, key, iter)."""
    rows = ranked_by_draw(_iterated(df.select(*by, key), iterations), [*by, "iter"], draw(F.col(key), F.col("iter") + seed), key, "__r", "__n")
    rows = rows.withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares])))
    return rows.where(F.col("__r") <= F.round(F.col("__n") * F.col("share"))).select(*by, "share", key, "iter")


def folds(df: DataFrame, by: list[str], key: str, k: int = 10, seed: int = 0) -> DataFrame:
    """fold from 0 to k - 1, even within by."""
    return ranked_by_draw(df, by, draw(F.col(key), seed), key, "__rank").withColumn("fold", F.pmod(F.col("__rank") - 1, F.lit(k))).drop("__rank")


#: Seed of the order that permutations and bootstraps count places in.
PLACES = 7906


def permutation(df: DataFrame, by: list[str], key: str, iterations: int, seed: int = 0) -> DataFrame:
    """(by, iter, key, source): for each iteration and group a permutation of the keys.

    The key at a place of one draw takes the key at that place of another.
    """
    places = ranked_by_draw(df.select(*by, key), by, draw(F.col(key), PLACES), key, "__p")
    moved = ranked_by_draw(_iterated(df.select(*by, key), iterations), [*by, "iter"], draw(F.col(key), F.col("iter") + seed), key, "__p")
    return same_keys(places, moved.withColumnRenamed(key, "source"), [*by, "__p"]).select(*by, "iter", key, "source")


def bootstrap(df: DataFrame, by: list[str], key: str, iterations: int, seed: int = 0) -> DataFrame:
    """(by, iter, key, source): for each place one draw with replacement among the group's keys."""
    numbered = ranked_by_draw(df.select(*by, key), by, draw(F.col(key), PLACES), key, "__p", "__n").withColumn("__p", F.col("__p") - 1)
    rows = _iterated(numbered, iterations).withColumn("__s", F.pmod(draw(F.col("__p") * 31 + 7, F.col("iter") + seed), F.col("__n")))
    source = numbered.select(*by, F.col("__p").alias("__s"), F.col(key).alias("source"))
    return same_keys(rows, source, [*by, "__s"]).select(*by, "iter", key, "source")


def sign_flip_p(df: DataFrame, by: list[str], key: str, a: str, b: str, iterations: int, seed: int = 0) -> DataFrame:
    """Paired two-sided permutation p by random signs: (by, mean_diff, p) with p = 2 min(share above, share below), at most 1."""
    diff = df.select(*by, key, (F.col(a) - F.col(b)).alias("d")).where("d is not null")
    real = diff.groupBy(*by).agg(F.avg("d").alias("mean_diff"))
    sign = F.when(draw(F.col(key), F.col("iter") + seed) % 2 == 0, 1).otherwise(-1)
    flipped = _iterated(diff, iterations).groupBy(*by, "iter").agg(F.avg(F.col("d") * sign).alias("m"))
    both = flipped.join(real, by) if by else flipped.withColumn("__1", F.lit(1)).join(real.withColumn("__1", F.lit(1)), "__1").drop("__1")
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    # rounded, so that equal means tie whatever the order of summation
    real_, moved = F.round("mean_diff", 6), F.round("m", 6)
    p = F.least(2 * F.least(share(real_ >= moved), share(real_ <= moved)), F.lit(1.0))
    return both.groupBy(*by).agg(F.first("mean_diff").alias("mean_diff"), p.alias("p"))


def permutation_p(real: DataFrame, shuffled: DataFrame, by: list[str], value: str) -> DataFrame:
    """Share of shuffled values that reach the real one, with no 1 added: (by, p)."""
    both = shuffled.select(*by, F.col(value).alias("__s")).join(real.select(*by, value), by)
    return both.groupBy(*by).agg(F.avg(F.when(F.col(value) <= F.col("__s"), 1.0).otherwise(0.0)).alias("p"))
