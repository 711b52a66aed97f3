"""Linear discriminant analysis from sums of classes and folds.

Rows are read twice: once for the counts, means and products of each group,
fold and class, which are merged, and once to be scored. A fold is left out by
taking its sums from those of all folds, so no task holds a group's rows and no
fold is fitted from rows again.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .models import _keys, dprime_of, scatter
from .sampling import folds

#: Models of at most so many numbers are sent to every task; the rows of larger ones are dealt to SALTS keys.
MOST_NUMBERS, SALTS = 4_000_000, 16


def without(whole: tuple[float, np.ndarray, np.ndarray], part: tuple[float, np.ndarray, np.ndarray]) -> tuple[float, np.ndarray, np.ndarray]:
    """(n, mean, products about the mean) of a whole less one part of it."""
    n = whole[0] - part[0]
    if n <= 0:
        return 0.0, np.zeros_like(whole[1]), np.zeros_like(whole[2])
    mean = (whole[0] * whole[1] - part[0] * part[1]) / n
    d = part[1] - mean
    return n, mean, whole[2] - part[2] - np.outer(d, d) * (n * part[0] / whole[0])


def merged(a: tuple[float, np.ndarray, np.ndarray], b: tuple[float, np.ndarray, np.ndarray]) -> tuple[float, np.ndarray, np.ndarray]:
    n = a[0] + b[0]
    d = b[1] - a[1]
    return n, a[1] + d * (b[0] / n), a[2] + b[2] + np.outer(d, d) * (a[0] * b[0] / n)


def coefficients(sums: dict[int, tuple[float, np.ndarray, np.ndarray]]) -> tuple[list[int], np.ndarray, np.ndarray]:
    """(classes, weights, offsets) of the discriminant from (n, mean, products) of each class; the largest w x + b is the class.

    The covariance is pooled; directions under 1e-4 of the largest are left out.
    """
    classes = sorted(c for c, s in sums.items() if s[0] > 0)
    total = sum(sums[c][0] for c in classes)
    means = np.stack([sums[c][1] for c in classes])
    inverse = np.linalg.pinv(sum(sums[c][2] for c in classes) / max(total - len(classes), 1), rcond=1e-4)
    weights = means @ inverse
    return classes, weights, np.log([sums[c][0] / total for c in classes]) - 0.5 * (weights * means).sum(axis=1)


def fold_models(rows: DataFrame, by: list[str], vector: str) -> DataFrame:
    """(by, fold, classes, weights, offsets): the discriminant without each fold of rows(by, fold, y, vector).

    Groups with one class or one fold have none. The weights of the classes
    follow each other.
    """
    types = dict(rows.dtypes)
    sums = scatter(rows, [*by, "fold", "y"], vector)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        cells = {(int(r.fold), int(r.y)): (float(r.n), np.asarray(r["mean"]), np.asarray(r.squares).reshape(len(r["mean"]), -1)) for _, r in pdf.iterrows()}
        classes, numbers, out = sorted({c for _, c in cells}), sorted({f for f, _ in cells}), []
        if len(classes) > 1 and len(numbers) > 1:
            whole = {c: reduce(merged, [cells[f, c] for f in numbers if (f, c) in cells]) for c in classes}
            for f in numbers:
                found, w, b = coefficients({c: without(whole[c], cells[f, c]) if (f, c) in cells else whole[c] for c in classes})
                out.append((f, found, w.ravel(), b))
        head = {b: _keys(list(pdf[b][:1]) * len(out)) for b in by}
        return pd.DataFrame(out, columns=["fold", "classes", "weights", "offsets"]).assign(**head)[[*by, "fold", "classes", "weights", "offsets"]]

    schema = ", ".join([*(f"{b} {types[b]}" for b in by), "fold int, classes array<int>, weights array<double>, offsets array<double>"])
    return sums.groupBy(*by).applyInPandas(fit, schema)


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on keys of which nulls are equal; those of b go."""
    named = b.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in b.columns if c not in keys])
    on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return a.join(named, on).drop(*[f"__{k}" for k in keys])


def predicted(rows: DataFrame, by: list[str], vector: str, models: DataFrame) -> DataFrame:
    """rows with `predicted`, each by the model without its fold; the first class on ties. Rows without a model go."""
    size = models.agg(F.sum(F.size("weights"))).first()[0] or 0
    keys = [*by, "fold"]
    if size <= MOST_NUMBERS:
        both = _same(rows, F.broadcast(models), keys)
    else:
        salted = models.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        both = _same(rows.withColumn("salt", F.pmod(F.xxhash64(vector), F.lit(SALTS)).cast("int")), salted, [*keys, "salt"]).drop("salt")
    width = F.size(vector)
    dot = lambda i: F.aggregate(F.zip_with(vector, F.slice("weights", i * width + 1, width), lambda x, w: x * w), F.lit(0.0), lambda acc, v: acc + v)
    scores = F.transform("offsets", lambda b, i: b + dot(i))
    both = both.withColumn("__scores", scores)
    return both.withColumn("predicted", F.get("classes", F.array_position("__scores", F.array_max("__scores")).cast("int") - 1)).drop("__scores", "classes", "weights", "offsets")


def cross_validated(df: DataFrame, by: list[str], key: str, vector: str, label: str, k: int = 10) -> DataFrame:
    """(by, key, y, fold, predicted) of k-fold discriminant analysis; folds by a hash order of key, null labels left out."""
    rows = df.where(F.col(label).isNotNull() & F.col(vector).isNotNull()).select(*by, key, F.transform(vector, lambda x: x.cast("double")).alias("__v"), F.col(label).cast("int").alias("y"))
    rows = folds(rows, by, key, k).withColumn("fold", F.col("fold").cast("int"))
    return predicted(rows, by, "__v", fold_models(rows, by, "__v")).select(*by, key, "y", "fold", "predicted")


def decode(df: DataFrame, by: list[str], key: str, vector: str, label: str, k: int = 10) -> DataFrame:
    """(by, n, accuracy, dprime) of k-fold discriminant analysis; null accuracy and dprime with one class or one fold."""
    types = dict(df.dtypes)
    counts = cross_validated(df, by, key, vector, label, k).groupBy(*by, "y", "predicted").agg(F.count("*").alias("n"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        y, p, n = pdf.y.to_numpy(), pdf.predicted.to_numpy(), pdf.n.to_numpy()
        return pd.DataFrame({**{b: _keys(pdf[b][:1]) for b in by}, "accuracy": [float(n[p == y].sum() / n.sum())], "dprime": [dprime_of(p, y, n)]})

    head = ", ".join(f"{b} {types[b]}" for b in by)
    found = counts.groupBy(*by).applyInPandas(one, f"{head + ', ' if by else ''}accuracy double, dprime double")
    sizes = df.where(F.col(label).isNotNull() & F.col(vector).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"))
    if not by:
        return sizes.where("n > 0").join(found.select("accuracy", "dprime"), how="left")
    named = found.select(*[F.col(b).alias(f"__{b}") for b in by], "accuracy", "dprime")
    on = reduce(lambda x, y: x & y, [F.col(b).eqNullSafe(F.col(f"__{b}")) for b in by])
    return sizes.join(named, on, "left").select(*by, "n", "accuracy", "dprime")
