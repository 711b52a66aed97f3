"""Joins by key, membership, place and overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def same_keys(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """left with right's other columns where all keys are equal, or both null; an equi-join."""
    there = right.select(*(F.col(c).alias(f"__on_{c}") for c in on), *(c for c in right.columns if c not in on))
    condition = F.lit(True)
    for c in on:
        condition = condition & F.col(c).eqNullSafe(F.col(f"__on_{c}"))
    return left.join(there, condition).drop(*(f"__on_{c}" for c in on))


def unused_sample(candidates: DataFrame, used: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n candidates that are not used, drawn by a hash of the key; a top-k, so no full sort."""
    free = candidates.join(used.select(key).distinct(), key, "left_anti")
    return free.orderBy(F.pmod(F.col(key) * F.lit(2654435761) + F.lit(seed), F.lit(1_000_003)), key).limit(n)


def nearest_field(points: DataFrame, key: str, grid: DataFrame, rows_limit: int = 20_000) -> DataFrame:
    """The nearest grid row for each point: least distance of centres, then least difference of size, then prf_ix.

    The grid is a generated table (thousands of rows); its size is checked
    before it is sent to the points as one array. A null place counts as 0.
    """
    rows = grid.select("prf_ix", "x", "y", "sigma").limit(rows_limit + 1).collect()
    if len(rows) > rows_limit:
        raise ValueError("the grid is too large to be sent to every task")
    cells = F.array(*[F.struct(F.lit(r.prf_ix).alias("prf_ix"), F.lit(r.x).alias("x"), F.lit(r.y).alias("y"), F.lit(r.sigma).alias("sigma")) for r in rows])
    at = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    # rounded, so that equal distances tie whatever the order of operations
    distance = lambda g: F.round(F.sqrt((g["x"] - F.col("px")) * (g["x"] - F.col("px")) + (g["y"] - F.col("py")) * (g["y"] - F.col("py"))), 9)
    keyed = points.select("*", at("x").alias("px"), at("y").alias("py"), at("sigma").alias("ps"))
    best = F.array_min(F.transform(cells, lambda g: F.struct(distance(g).alias("d"), F.round(F.abs(F.col("ps") - g["sigma"]), 9).alias("s"), g["prf_ix"].alias("prf_ix"))))
    return keyed.select(key, best.getField("prf_ix").alias("prf_ix"), best.getField("d").alias("distance"))


def box_overlap(left: DataFrame, right: DataFrame, cell: int, more_than: int = 10) -> DataFrame:
    """(left_id, right_id, pixels) of boxes(id, x0, x1, y0, y1; ends exclusive) that share over more_than pixels.

    Boxes meet through the grid cells they touch (an equi-join); a pair is
    counted in the cell of its overlap's corner only, so no distinct follows.
    """

    def cells(df, side):
        c = lambda v: F.floor(v / cell)
        out = df.select(*(F.col(k).alias(f"{side}_{k}") for k in ("id", "x0", "x1", "y0", "y1")))
        x = F.sequence(c(F.col(f"{side}_x0")), c(F.col(f"{side}_x1") - 1))
        y = F.sequence(c(F.col(f"{side}_y0")), c(F.col(f"{side}_y1") - 1))
        valid = (F.col(f"{side}_x1") > F.col(f"{side}_x0")) & (F.col(f"{side}_y1") > F.col(f"{side}_y0"))
        return out.where(valid).withColumn("cx", F.explode(x)).withColumn("cy", F.explode(y))

    both = cells(left, "l").join(cells(right, "r"), ["cx", "cy"])
    x0, y0 = F.greatest("l_x0", "r_x0"), F.greatest("l_y0", "r_y0")
    w, h = F.least("l_x1", "r_x1") - x0, F.least("l_y1", "r_y1") - y0
    both = both.where((w > 0) & (h > 0) & (F.floor(x0 / cell) == F.col("cx")) & (F.floor(y0 / cell) == F.col("cy")))
    return both.select(F.col("l_id").alias("left_id"), F.col("r_id").alias("right_id"), (w * h).alias("pixels")).where(F.col("pixels") > more_than)


def separate_boxes(boxes: DataFrame, least: float = 0.9, overlap: float = 0.4) -> DataFrame:
    """Detections(image_ix, id, x0, x1, y0, y1, score) of at least that score, without those that share over that part of the union with a better one of their image that stays; ties by id."""
    import numpy as np
    import pandas as pd

    columns = ["image_ix", "id", "x0", "x1", "y0", "y1", "score"]
    types = dict(boxes.dtypes)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "id"], ascending=[False, True])
        x0, x1, y0, y1 = (pdf[c].to_numpy(float) for c in columns[2:6])
        area, left, kept = (x1 - x0) * (y1 - y0), np.ones(len(pdf), bool), []
        for k in range(len(pdf)):
            if left[k]:
                kept.append(k)
                both = np.clip(np.minimum(x1[k], x1) - np.maximum(x0[k], x0), 0, None) * np.clip(np.minimum(y1[k], y1) - np.maximum(y0[k], y0), 0, None)
                left &= both <= overlap * (area + area[k] - both)
        return pdf.iloc[kept][columns]

    return boxes.where(F.col("score") >= least).select(*columns).groupBy("image_ix").applyInPandas(one, ", ".join(f"{c} {types[c]}" for c in columns))


def pixel_overlap(left: DataFrame, right: DataFrame, by: list[str], more_than: int = 10) -> DataFrame:
    """Shared pixels of two masks(id, row, col) for each pair of ids that has over more_than."""
    l = left.select(F.col("id").alias("left_id"), "row", "col", *by)  # noqa: E741
    r = right.select(F.col("id").alias("right_id"), "row", "col", *by)
    return l.join(r, ["row", "col", *by]).groupBy(*by, "left_id", "right_id").agg(F.count("*").alias("pixels")).where(F.col("pixels") > more_than)


def overlap_counts(members: DataFrame, item: str, group: str) -> DataFrame:
    """Items that two groups share, for each pair that shares any: (group_a, group_b, n).

    Each item's groups become one sorted set, whose pairs are counted: the
    work follows the groups of an item, not the items of a group.
    """
    sets = members.select(item, group).distinct().groupBy(item).agg(F.array_sort(F.collect_set(group)).alias("g"))
    first = sets.select(F.posexplode("g").alias("i", "group_a"), "g")
    pairs = first.select("group_a", F.explode(F.expr("slice(g, i + 2, size(g))")).alias("group_b"))
    return pairs.groupBy("group_a", "group_b").agg(F.count("*").alias("n"))


def relabelled(df: DataFrame, label: str, merge: dict, skip: list) -> DataFrame:
    """Merge labels, drop skipped ones (-1) and number the rest densely from 0, as new_label.

    Dense numbers come from the distinct labels, not from a window over all rows.
    """
    merged = F.col(label)
    for old, new in merge.items():
        merged = F.when(F.col(label) == old, F.lit(new)).otherwise(merged)
    out = df.withColumn("__m", merged)
    kept = out.select("__m").distinct().where(F.col("__m").isNotNull() & ~F.col("__m").isin(skip))
    numbers = kept.select("__m", (F.dense_rank().over(Window.orderBy("__m")) - 1).alias("__k"))
    return out.join(numbers, "__m", "left").withColumn("new_label", F.coalesce("__k", F.lit(-1))).drop("__m", "__k")


def prior(*labels):
    """The first label that is set (not null and not 0)."""
    return F.coalesce(*[F.nullif(c, F.lit(0)) for c in labels])


def scattered(cells: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """Every cell, with NULL where there is no value."""
    return cells.join(values, key, "left")
