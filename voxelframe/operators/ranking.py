"""Ranks, peaks and frequent groups. Every order ends in a key, so ties are settled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ranked(df: DataFrame, by: list[str], value: Column, tie: str, descending: bool = True, name: str = "rank") -> DataFrame:
    """Place of each row from 1 within by."""
    order = value.desc_nulls_last() if descending else value.asc_nulls_last()
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(order, tie)))


def top(df: DataFrame, by: list[str], value: Column, tie: str, k: int) -> DataFrame:
    """The k largest of each group; Spark keeps only k rows of a group before the shuffle."""
    return ranked(df, by, value, tie).where(F.col("rank") <= k)


def sorted_twice(df: DataFrame, by: list[str], first: str, second: str, tie: str) -> DataFrame:
    """Position from 0 in the order by first, then second."""
    w = Window.partitionBy(*by).orderBy(first, second, tie)
    return df.withColumn("position", F.row_number().over(w) - 1)


def with_inverse(df: DataFrame, by: list[str], value: str, place: str) -> DataFrame:
    """order: place of the row that sorts to this one's place; inverse: where this row sorts to."""
    sort = df.withColumn("inverse", F.row_number().over(Window.partitionBy(*by).orderBy(value, place)) - 1)
    order = sort.select(*by, F.col("inverse").alias(place), F.col(place).alias("order"))
    return sort.join(order, [*by, place])


def unshuffled(df: DataFrame, by: list[str], value: str, shuffled_place: str, order: DataFrame) -> DataFrame:
    """Values at their places before a shuffle order(by, shuffled_place, place)."""
    return df.join(order, [*by, shuffled_place]).select(*by, "place", value)


def circular_peaks(df: DataFrame, by: list[str], place: str, value: str, troughs: bool = False) -> DataFrame:
    """Strict local maxima of curves whose ends meet (minima with troughs)."""
    w = Window.partitionBy(*by).orderBy(place)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    v = -F.col(value) if troughs else F.col(value)
    out = df.withColumn("__v", v)
    before = F.coalesce(F.lag("__v").over(w), F.last("__v").over(whole))
    after = F.coalesce(F.lead("__v").over(w), F.first("__v").over(whole))
    return out.where(F.col("__v").isNotNull()).withColumn("__b", before).withColumn("__a", after).where((F.col("__v") > F.col("__b")) & (F.col("__v") > F.col("__a"))).drop("__v", "__b", "__a")


def curve_peaks(df: DataFrame, by: list[str], place: str, value: str, ratio: float = 0.5, circular: bool = False) -> DataFrame:
    """Peaks that are not negative and whose height over the curve's minimum is more than ratio of the largest peak's.

    (by, place, value, peak_rank): by height, ties by place. An open curve is
    padded with -2 at both ends, so its ends can be peaks.
    """
    w = Window.partitionBy(*by).orderBy(place)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    v = F.col(value)
    if circular:
        before, after = F.coalesce(F.lag(v).over(w), F.last(v).over(whole)), F.coalesce(F.lead(v).over(w), F.first(v).over(whole))
    else:
        before, after = F.lag(v, 1, -2.0).over(w), F.lead(v, 1, -2.0).over(w)
    out = df.withColumn("__b", before).withColumn("__a", after).withColumn("__low", F.min(v).over(Window.partitionBy(*by)))
    out = out.where((v > F.col("__b")) & (v > F.col("__a")) & (v >= 0))
    height = v - F.col("__low")
    out = out.withColumn("__top", F.max(height).over(Window.partitionBy(*by)))
    out = out.where(F.try_divide(height, F.nullif(F.col("__top"), F.lit(0.0))) > ratio)
    return out.select(*by, place, value, F.row_number().over(Window.partitionBy(*by).orderBy(v.desc(), place)).alias("peak_rank"))


def frequent_sets(peaks: DataFrame, key: str, item: str, size: int, groups: int) -> DataFrame:
    """Keys with exactly size items, by how common their unordered set is: group 0.., then groups for the others."""
    sets = peaks.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("items")).where(F.size("items") == size)
    counts = sets.groupBy("items").agg(F.count("*").alias("n"))
    # the commonest sets only: a top-k of bounded size
    best = counts.orderBy(F.desc("n"), "items").limit(groups)
    best = best.select("items", (F.row_number().over(Window.orderBy(F.desc("n"), "items")) - 1).alias("g"))
    return sets.join(F.broadcast(best), "items", "left").select(key, "items", F.coalesce("g", F.lit(groups)).alias("group"))
