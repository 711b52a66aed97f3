"""Grouped means, bins and feature statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .joins import same_keys


def repeat_average(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean and number of repeats."""
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), F.count(value).alias("repeats"))


def session_zscore(df: DataFrame, by: list[str], value: str, divide: float = 300.0, epsilon: float = 1e-6) -> DataFrame:
    """z of value / divide within by (population deviation plus epsilon); NULL becomes 0."""
    v = F.col(value) / divide
    z = (v - F.col("__mean")) / (F.coalesce("__sd", F.lit(0.0)) + epsilon)
    return _with_moments(df, by, v).withColumn("z", F.coalesce(z, F.lit(0.0))).drop("__mean", "__sd")


def _with_moments(df: DataFrame, by: list[str], value: Column) -> DataFrame:
    """df with the mean and population deviation of value within by; sums are partial before any shuffle, and rows stay where they are if the groups are few."""
    return same_keys(df, df.groupBy(*by).agg(F.avg(value).alias("__mean"), F.stddev_pop(value).alias("__sd")), by)


def zscore(df: DataFrame, by: list[str], value: str, train: Column | None = None, epsilon: float = 0.0) -> DataFrame:
    """z of value by the statistics of the train rows of by (all rows without train); NULL where they do not vary."""
    v = F.col(value)
    out = _with_moments(df, by, v if train is None else F.when(train, v))
    return out.withColumn("z", F.try_divide(v - F.col("__mean"), F.nullif(F.col("__sd") + epsilon, F.lit(0.0)))).drop("__mean", "__sd")


def binned(df: DataFrame, x: str, y: str, bins: int, kind: str = "linear") -> DataFrame:
    """(bin, centre, mean, sd, total, n) of y over bins of x; empty bins are left out.

    kind: linear (even edges), density (quantile edges, linear interpolation)
    or unique (a bin for each value). Bins hold their lower edge; the last edge
    is moved up by 0.0001 so that the largest x is in. Edges are one row.
    """
    rows = df.where(F.col(x).isNotNull())
    stats = [F.avg(y).alias("mean"), F.stddev_pop(y).alias("sd"), F.sum(y).alias("total"), F.count("*").alias("n")]
    if kind == "unique":
        return numbered(rows.groupBy(F.col(x).cast("double").alias("centre")).agg(*stats), "centre", "bin").select("bin", "centre", "mean", "sd", "total", "n")
    if kind == "linear":
        low, high = rows.agg(F.min(x), F.max(x)).first()
        if low is None:
            return rows.limit(0).groupBy(F.lit(0).alias("bin"), F.lit(0.0).alias("centre")).agg(*stats)
        width = (high + 0.0001 - low) / bins
        edges = [low + width * k for k in range(bins)] + [high + 0.0001]
        centres = [e + width / 2 for e in edges[:-1]]
    else:
        edges = quantiles(rows.select(F.col(x).cast("double").alias("x")), [k / bins for k in range(bins + 1)])
        edges[-1] += 0.0001
        centres = [(a + b) / 2 for a, b in zip(edges, edges[1:], strict=False)]
    number = sum((F.when(F.col(x) >= e, 1).otherwise(0) for e in edges[1:-1]), F.lit(0))
    out = rows.groupBy(number.alias("bin")).agg(*stats)
    return out.select("bin", F.get(F.array(*[F.lit(float(c)) for c in centres]), F.col("bin")).alias("centre"), "mean", "sd", "total", "n")


#: Rows that one task numbers, and the most stretches that rows are numbered in.
NUMBERED, STRETCHES = 100_000, 1024


def numbered(rows: DataFrame, key: str, name: str) -> DataFrame:
    """rows with their place from 0 in the order of a key of different doubles.

    The key's quantiles cut the rows into stretches, whose counts give the
    number that each starts from; a task sorts a stretch, not the table.
    """
    n = rows.count()
    pieces = min(max(1, -(-n // NUMBERED)), STRETCHES)
    edges = quantiles(rows.where(~F.isnan(key)).select(F.col(key).alias("x")), [k / pieces for k in range(1, pieces)]) if pieces > 1 else []
    stretch = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e <= F.col(key))) if edges else F.lit(0)
    rows = rows.withColumn("__stretch", stretch)
    starts, total = {}, 0
    for k, count in sorted(rows.groupBy("__stretch").count().collect()):
        starts[k], total = total, total + count
    base = F.get(F.array(*[F.lit(starts.get(k, 0)).cast("long") for k in range(pieces)]), F.col("__stretch"))
    return rows.withColumn(name, base + F.row_number().over(Window.partitionBy("__stretch").orderBy(key)) - 1).drop("__stretch")


def quantiles(values: DataFrame, shares: list[float], buckets: int = 1024, few: int = 4096) -> list[float]:
    """Exact quantiles of the column x with linear interpolation; 0 for no values.

    Each pass counts the values of the open intervals in even buckets and goes
    on in those that hold a wanted rank, until one has few values or a single
    one. A bounded number of counts reaches the driver.
    """
    low, high, n = values.agg(F.min("x"), F.max("x"), F.count("x")).first()
    if not n:
        return [0.0] * len(shares)
    places = [s * (n - 1) for s in shares]
    found: dict[int, float] = {}
    intervals = [(low, high, 0, n)]  # ends (both in), values before, values
    wanted = sorted({r for p in places for r in (int(p), min(int(p) + 1, n - 1))})
    while intervals:
        small = [i for i in intervals if i[0] == i[1] or i[3] <= few]
        for a, b, before, count in small:
            mine = [r for r in wanted if before <= r < before + count]
            if a == b:
                found |= dict.fromkeys(mine, a)
                continue
            listed = sorted(r.x for r in values.where(F.col("x").between(a, b)).collect())
            found |= {r: listed[r - before] for r in mine}
        intervals = [i for i in intervals if i not in small]
        if not intervals:
            break
        number, bucket = F.lit(None).cast("int"), F.lit(None).cast("int")
        for k, (a, b, *_) in enumerate(intervals):
            inside = F.col("x").between(a, b)
            number = F.when(inside, k).otherwise(number)
            bucket = F.when(inside, F.least(F.floor((F.col("x") - a) / (b - a) * buckets), F.lit(buckets - 1)).cast("int")).otherwise(bucket)
        counts = values.select("x", number.alias("k"), bucket.alias("b")).where("k is not null").groupBy("k", "b").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count("*").alias("n")).collect()
        nexts = []
        for k, (_, _, before, _) in enumerate(intervals):
            for r in sorted((r for r in counts if r.k == k), key=lambda r: r.b):
                if any(before <= w < before + r.n for w in wanted):
                    nexts.append((r.low, r.high, before, r.n))
                before += r.n
        intervals = nexts
    return [found[int(p)] + (found[min(int(p) + 1, n - 1)] - found[int(p)]) * (p - int(p)) for p in places]


def two_level_mean(df: DataFrame, within: list[str], across: list[str], value: str) -> DataFrame:
    """Mean of the within-groups' means for each of across, and its standard error (population deviation)."""
    first = df.groupBy(*across, *within).agg(F.avg(value).alias("m"))
    return first.groupBy(*across).agg(F.avg("m").alias("mean"), F.try_divide(F.stddev_pop("m"), F.sqrt(F.count("m"))).alias("sem"), F.count("m").alias("n"))


def feature_stats(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean and population variance."""
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), F.var_pop(value).alias("var"), F.count(value).alias("n"))


def gram(df: DataFrame, vector: str, width: int, by: list[str] | None = None) -> DataFrame:
    """(by, i, j, n, s, si, sj): sums of products of vector entries for i <= j.

    Sums are kept beside each task's rows (one array of partial sums a task),
    instead of a self-join of the exploded entries.
    """
    import numpy as np
    import pyarrow as pa

    by = by or []

    def partial(batches):
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            data = batch.column(len(by)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(len(by))), strict=True)) or [()] * len(data)
            rows: dict[tuple, list[int]] = {}
            for k, key in enumerate(keys):
                rows.setdefault(key, []).append(k)
            for key, at in rows.items():
                x = np.concatenate([data[at], np.ones((len(at), 1))], axis=1)
                sums[key] = sums.get(key, 0) + x.T @ x
        i, j = np.triu_indices(width)
        for key, g in sums.items():
            cols = [pa.array([v] * len(i)) for v in key]
            yield pa.RecordBatch.from_arrays([*(c.cast(t) for c, t in zip(cols, kinds, strict=True)), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(np.full(len(i), g[-1, -1])), pa.array(g[i, j]), pa.array(g[i, -1]), pa.array(g[j, -1])], [*by, "i", "j", "n", "s", "si", "sj"])

    chosen = df.select(*by, vector).where(F.col(vector).isNotNull())
    types = dict(chosen.dtypes)
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(chosen.schema[b].dataType) for b in by]
    schema = ", ".join([*(f"{b} {types[b]}" for b in by), "i int, j int, n double, s double, si double, sj double"])
    part = chosen.mapInArrow(partial, schema)
    return part.groupBy(*by, "i", "j").agg(*(F.sum(c).alias(c) for c in ("n", "s", "si", "sj")))


def covariance(df: DataFrame, vector: str, width: int, by: list[str] | None = None) -> DataFrame:
    """(by, i, j, cov): sample covariance of vector entries, i <= j."""
    g = gram(df, vector, width, by)
    return g.select(*(by or []), "i", "j", F.try_divide(F.col("s") - F.col("si") * F.col("sj") / F.col("n"), F.nullif(F.col("n") - 1, F.lit(0.0))).alias("cov"))
