"""Category flags and tri-state labels; NULL is ambiguous or undefined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flags(members: DataFrame, key: str, category: str, categories: list) -> DataFrame:
    """One row for each key, a 0/1 column for each of a fixed list of categories (one aggregation, no join)."""
    return members.groupBy(key).agg(*[F.max(F.when(F.col(category) == c, 1).otherwise(0)).alias(f"is_{c}".lower().replace(" ", "_")) for c in categories])


def in_category(rows: DataFrame, key: str, members: DataFrame, name: str = "flag") -> DataFrame:
    """rows and whether their key is among members(key)."""
    known = members.select(key).distinct().withColumn("__in", F.lit(1))
    return rows.join(known, key, "left").withColumn(name, F.coalesce("__in", F.lit(0))).drop("__in")


def exclusive(one: Column, zero: Column) -> Column:
    """1 where only one holds, 0 where only zero does, else NULL."""
    return F.when(one & ~zero, 1).when(zero & ~one, 0)


def majority(one_count: Column, zero_count: Column) -> Column:
    """The side with more votes when both have some; a tie and no votes are NULL."""
    return F.when(one_count > zero_count, 1).when(zero_count > one_count, 0)


def size_groups(small: Column, medium: Column, large: Column, whole_image: bool) -> list[Column]:
    """(has small, has medium, has large, small-large label) from counts.

    Over a whole image only the groups with the largest count remain; within a
    field any count does.
    """
    top = F.greatest(small, medium, large)
    has = [(c > 0) & (c == top) if whole_image else c > 0 for c in (small, medium, large)]
    return [*(F.when(h, 1).otherwise(0) for h in has), exclusive(has[2], has[0])]


def label_counts(df: DataFrame, by: list[str], label: str) -> DataFrame:
    """Counts of 0, 1 and undefined; they sum to n."""
    c = F.col(label)
    return df.groupBy(*by).agg(F.count_if(c == 0).alias("n0"), F.count_if(c == 1).alias("n1"), F.count_if(c.isNull()).alias("n_undefined"), F.count("*").alias("n"))


def contingency(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """2 x 2 counts and correlation of two labels over rows with both."""
    from ..functions.stats import corr

    x, y = F.col(a), F.col(b)
    both = df.where(x.isNotNull() & y.isNotNull())
    cells = [F.count_if((x == i) & (y == j)).alias(f"n{i}{j}") for i in (0, 1) for j in (0, 1)]
    return both.groupBy(*by).agg(*cells, corr(x.cast("double"), y.cast("double")).alias("r"))
