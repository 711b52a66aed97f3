"""Trials, sessions, feature selections and stored results as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .aggregates import session_zscore
from .sampling import draw, first_by_draw

#: Trials of a session.
SESSION_TRIALS = 750


def session_of(trial: Column, size: int = SESSION_TRIALS) -> Column:
    """Session of a trial, both from 0."""
    return F.floor(trial / size)


def batch_of(place: Column, start: int, size: int) -> Column:
    """Number of the batch of size places from start on that a place is in; null before start."""
    return F.when(place >= start, F.floor((place - start) / size))


def gigabytes(size: Column) -> Column:
    return size / float(1 << 30)


def trial_order(order: DataFrame, trial: str, image: str) -> DataFrame:
    """(trial_ix, image_ix) from a table of images numbered from 1."""
    return order.select(F.col(trial).alias("trial_ix"), (F.col(image) - 1).alias("image_ix"))


def session_responses(volumes: DataFrame, sessions: list[int], mask: DataFrame | None = None, zscore: bool = True, divide: float = 300.0) -> DataFrame:
    """(voxel_ix, session, trial_ix, z) of the chosen sessions and voxels of volumes(session, trial, voxel_ix, value).

    Values are divided and, with zscore, standardised by voxel and session;
    trials are numbered on across sessions in the order given. mask(voxel_ix)
    is a semi join, sessions prune the scan.
    """
    rows = volumes.where(F.col("session").isin(sessions))
    if mask is not None:
        rows = rows.join(mask.select("voxel_ix").distinct(), "voxel_ix", "left_semi")
    rows = session_zscore(rows, ["voxel_ix", "session"], "value", divide) if zscore else rows.withColumn("z", F.col("value") / divide)
    place = F.array_position(F.array(*[F.lit(s) for s in sessions]), F.col("session")) - 1
    return rows.select("voxel_ix", "session", (place * SESSION_TRIALS + F.col("trial")).alias("trial_ix"), "z")


def voxel_attributes(maps: DataFrame, names: list[str], mask: DataFrame | None = None, scale: dict[str, float] | None = None) -> DataFrame:
    """One row a voxel with a column for each named map of maps(voxel_ix, name, value), scaled; null where a map has no value."""
    rows = maps if mask is None else maps.join(mask.select("voxel_ix").distinct(), "voxel_ix", "left_semi")
    wide = rows.where(F.col("name").isin(names)).groupBy("voxel_ix").pivot("name", names).agg(F.first("value"))
    return wide.select("voxel_ix", *((F.col(f"`{n}`") * (scale or {}).get(n, 1.0)).alias(n) for n in names))


def trial_rows(trials: DataFrame, responses: DataFrame, images: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted(trial_ix) trials with their responses and images: trials(trial_ix, image_ix), responses by trial_ix, images by image_ix."""
    chosen = trials.join(wanted.select("trial_ix").distinct(), "trial_ix", "left_semi")
    return chosen.join(responses, "trial_ix").join(images, "image_ix")


def selected_features(features: DataFrame, images: DataFrame | None = None, fields: list[int] | None = None, zscore: bool = False) -> DataFrame:
    """(prf_ix, image_ix, f) of chosen fields and images; the field filter prunes partitions of a stored table.

    With zscore each feature is standardised within its field over the chosen
    images (no epsilon; NULL where it does not vary). A null or missing entry
    is an undefined feature and stays null.
    """
    rows = features if fields is None else features.where(F.col("prf_ix").isin(fields))
    rows = rows if images is None else rows.join(images.select("image_ix").distinct(), "image_ix", "left_semi")
    rows = rows.select("prf_ix", "image_ix", "f")
    if not zscore:
        return rows
    long = rows.select("prf_ix", F.posexplode("f").alias("k", "v")).withColumn("v", F.nanvl(F.col("v"), F.lit(None).cast("double")))
    stats = long.groupBy("prf_ix", "k").agg(F.avg("v").alias("m"), F.nullif(F.stddev_pop("v"), F.lit(0.0)).alias("s"))
    stats = stats.groupBy("prf_ix").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "m", "s"))), lambda x: F.struct(x["m"].alias("m"), x["s"].alias("s"))).alias("stats"))
    return rows.join(stats, "prf_ix").select("prf_ix", "image_ix", F.zip_with("f", "stats", lambda v, s: (v - s["m"]) / s["s"]).alias("f"))


def defined_columns(features: DataFrame) -> DataFrame:
    """(prf_ix, k, defined): whether column k of a field has a value in every row."""
    long = features.select("prf_ix", F.posexplode("f").alias("k", "v"))
    return long.groupBy("prf_ix", "k").agg(F.bool_and(F.col("v").isNotNull() & ~F.coalesce(F.isnan("v"), F.lit(False))).alias("defined"))


def label_set(labels: DataFrame, key: list[str], groups: dict[str, list[str]]) -> DataFrame:
    """key and a flag for each group of label columns: 1 where any of them is set, null where all are null."""
    return labels.select(*key, *((F.greatest(*cols) if len(cols) > 1 else F.col(cols[0])).cast("int").alias(name) for name, cols in groups.items()))


def by_field(whole: DataFrame, fields: DataFrame) -> DataFrame:
    """Whole-image rows repeated for each field of a table of checked size: (prf_ix, whole's columns)."""
    rows = [r.prf_ix for r in fields.select("prf_ix").distinct().orderBy("prf_ix").limit(20_001).collect()]
    if len(rows) > 20_000:
        raise ValueError("too many fields to be repeated")
    return whole.select(F.explode(F.array(*[F.lit(k) for k in rows])).alias("prf_ix"), "*")


def balanced_set(df: DataFrame, category: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows of each category by draw (all of a smaller one)."""
    return first_by_draw(df.withColumn("__n", F.lit(n)), [category], draw(F.col(key), seed), key, "__n").drop("__n", "__r")


def checked_residuals(residuals: DataFrame, trials: DataFrame) -> DataFrame:
    """residuals(trial_ix, ...) if they cover exactly the trials; an error names what differs."""
    have, want = residuals.select("trial_ix").distinct(), trials.select("trial_ix").distinct()
    off = have.join(want, "trial_ix", "left_anti").select("trial_ix", F.lit("unknown").alias("kind")).union(want.join(have, "trial_ix", "left_anti").select("trial_ix", F.lit("missing")))
    found = off.groupBy("kind").agg(F.count("*").alias("n"), F.min("trial_ix").alias("first")).collect()
    if found:
        raise ValueError("; ".join(f"{r.n} {r.kind} trials from {r['first']}" for r in found))
    return residuals


def spread_grid(grid: DataFrame, scale: float = 8.4) -> DataFrame:
    """A subset of a grid(prf_ix, x, y, sigma) of checked size for simulations: (prf_ix) of the least city-block distance to every second eccentricity (without the first and the last two), angle and size."""
    import math

    rows = grid.select("prf_ix", "x", "y", "sigma").orderBy("prf_ix").limit(20_001).collect()
    if len(rows) > 20_000:
        raise ValueError("the grid is too large")
    angle = lambda r: round(math.degrees(math.atan2(r.y, r.x)) % 360, 2)
    distance = lambda r: round(math.hypot(r.x, r.y) * scale, 2)
    distances, angles, sizes = (sorted({f(r) for r in rows}) for f in (distance, angle, lambda r: round(r.sigma, 2)))
    chosen = set()
    for e in distances[1:-2:2]:
        for a in angles[::2]:
            x, y = e / scale * math.cos(math.radians(a)), e / scale * math.sin(math.radians(a))
            chosen |= {min(rows, key=lambda r: (abs(r.x - x) + abs(r.y - y) + abs(r.sigma - s), r.prf_ix)).prf_ix for s in sizes[::2]}  # noqa: B023
    return grid.sparkSession.createDataFrame([(k,) for k in sorted(chosen)], "prf_ix int")


def fields_of_channels(channels: DataFrame, fields: DataFrame, grid: DataFrame) -> DataFrame:
    """channels(voxel_ix, ...) with their fitted field's number and place; null where none was fitted."""
    placed = fields.select("voxel_ix", "prf_ix").join(grid.select("prf_ix", "x", "y", "sigma"), "prf_ix", "left")
    return channels.join(placed, "voxel_ix", "left")


def best_of(rows: DataFrame, by: list[str], score: str, value: str) -> DataFrame:
    """The value of largest score for each key, the first value on ties: (by, best, score)."""
    s = F.min(F.struct((-F.col(score)).alias("s"), F.col(value).alias("v"))).alias("s")
    return rows.where(F.col(score).isNotNull()).groupBy(*by).agg(s).select(*by, F.col("s.v").alias("best"), (-F.col("s.s")).alias("score"))


def concatenated(parts: dict[str, DataFrame], key: str) -> DataFrame:
    """The parts one below the other, with their name as subject and key numbered on by the largest key of the parts before."""
    out, before = None, 0
    for name, df in parts.items():
        rows = df.select(F.lit(name).alias("subject"), (F.col(key) + before).alias(key), *(c for c in df.columns if c != key))
        out = rows if out is None else out.unionByName(rows)
        last = df.agg(F.max(key)).first()[0]
        before += 0 if last is None else last + 1
    return out
