"""Product codes of vectors, with nearest entries found by slicing and intersecting bitmasks.

A vector's components become integers floor(scale * x) and are cut into equal
parts; each part is written as the number of the nearest entry of its part's
codebook. The codebooks start as the parts of the vectors of least id and are
moved to the floors of their members' means in a fixed number of rounds.

Search: along each dimension a codebook's coordinates are sorted, and each
sorted place carries the mask of the entries before it, one bit for each entry.
The nearest neighbours along single dimensions give an initial radius that the
answer cannot exceed; in each dimension the coordinates within it are a range,
the masks at its two ends differ by the entries in it, and the AND over all
dimensions leaves the candidates, which are compared exactly. Nothing is
missed: an entry outside of a range is farther than the radius in that
dimension alone. All arithmetic is on integers; components too large for
machine words go the same way as Python integers.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import Stage

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Components up to this magnitude keep squared distances of 64 of them within a long.
SMALL = 1 << 27
#: Sums are sent in digits of this base.
BASE = 1 << 48
#: Arrow rows that are searched at once.
ROWS = 4096
LONGEST = (1 << 63) - 1
#: Label totals of at most so many rows are sent to every task.
BROADCAST_ROWS = 100_000
SALTS = 64


def integers(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of finite numbers, exactly: int64, or Python integers where one is beyond SMALL."""
    values = values.astype(np.float64)
    if not len(values) or np.abs(values).max() <= SMALL / scale:
        return np.floor(values * scale).astype(np.int64)
    exact = [scale * a // b for a, b in (float(x).as_integer_ratio() for x in values)]
    return np.array([*exact, None], object)[:-1]


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return (d * d).sum(axis=1)


class Codebook:
    """The entries of one part, at most 64, sorted along each dimension, with prefix masks."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        order = np.argsort(entries, axis=0, kind="stable")
        self.order = order.T
        self.coordinates = np.take_along_axis(entries, order, axis=0).T
        bits = np.left_shift(np.uint64(1), self.order.astype(np.uint64))
        self.prefix = np.zeros((len(self.order), len(entries) + 1), np.uint64)
        np.bitwise_or.accumulate(bits, axis=1, out=self.prefix[:, 1:])

    def radius(self, x: np.ndarray) -> np.ndarray:
        """A whole number that the distance to the nearest entry does not exceed: the nearest of the neighbours along each dimension."""
        best = None
        for values, order, column in zip(self.coordinates, self.order, x.T, strict=True):
            at = np.searchsorted(values, column)
            for k in (np.maximum(at - 1, 0), np.minimum(at, len(order) - 1)):
                d = _squares(x, self.entries[order[k]])
                best = d if best is None else np.minimum(best, d)
        if best.dtype == object:
            return np.array([*(math.isqrt(b) + 1 for b in best), None], object)[:-1]
        return np.sqrt(best.astype(np.float64)).astype(np.int64) + 1

    def candidates(self, x: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Mask of the entries that are within the radius in every dimension."""
        mask = np.full(len(x), ~np.uint64(0))
        for values, prefix, column in zip(self.coordinates, self.prefix, x.T, strict=True):
            mask &= prefix[np.searchsorted(values, column + radius, "right")] ^ prefix[np.searchsorted(values, column - radius, "left")]
        return mask

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each row; ties go to the lower entry."""
        if x.dtype != self.entries.dtype:  # one of them has large components
            if x.dtype != object:
                x = x.astype(object)
            else:
                return Codebook(self.entries.astype(object)).nearest(x)
        mask = self.candidates(x, self.radius(x))
        found, least = np.full(len(x), -1), np.zeros(len(x), x.dtype)
        live = np.arange(len(x))
        while len(live):  # the lowest bit of each mask that is left, so the lower entry comes first
            m = mask[live]
            low = m & (~m + np.uint64(1))
            entry = np.frexp(low.astype(np.float64))[1] - 1
            d = _squares(x[live], self.entries[entry])
            better = (found[live] < 0) | (d < least[live]).astype(bool)
            found[live[better]], least[live[better]] = entry[better], d[better]
            mask[live] = m ^ low
            live = live[mask[live] != 0]
        return found, least


class Codebooks:
    """One codebook for each part."""

    def __init__(self, entries: list[np.ndarray]):
        self.parts = [Codebook(e) for e in entries]

    def digest(self) -> str:
        """SHA-256 of all components as decimal text, by part, entry and place, comma-joined."""
        return hashlib.sha256(",".join(str(c) for p in self.parts for e in p.entries.tolist() for c in e).encode()).hexdigest()

    def assign(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, parts) numbers of entries and (rows, parts) squared distances."""
        cut = np.split(vectors, len(self.parts), axis=1)
        found = [book.nearest(x) for book, x in zip(self.parts, cut, strict=True)]
        return np.stack([f[0] for f in found], axis=1), np.stack([f[1].astype(object) if any(g[1].dtype == object for g in found) else f[1] for f in found], axis=1)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """The integer vectors that rows of codes stand for."""
        return np.concatenate([book.entries[c] for book, c in zip(self.parts, codes.T, strict=True)], axis=1)


def usable(vector: Column) -> Column:
    """True for a vector that is not null and has only finite components."""
    return vector.isNotNull() & F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def _vectors(batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of the batches with the integer vectors of their last column."""
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS):
            part = batch.slice(k, ROWS)
            yield part, integers(part.column(part.num_columns - 1).flatten().to_numpy(zero_copy_only=False), scale).reshape(part.num_rows, -1)


def _digits(total: int) -> Iterator[tuple[int, int]]:
    """(place, signed digit in BASE) of a whole number."""
    sign, rest, place = (1, total, 0) if total >= 0 else (-1, -total, 0)
    while rest:
        rest, low = divmod(rest, BASE)
        yield place, sign * low
        place += 1


def _moved(rows: DataFrame, books: Codebooks, scale: int) -> Codebooks:
    """The codebooks with every used entry at the floor of its members' mean.

    Each task sends one set of sums, which Spark adds; parts x entries x
    (components + 1) whole numbers reach the driver, whatever the input.
    """
    parts, entries = len(books.parts), len(books.parts[0].entries)
    width = books.parts[0].entries.shape[1]

    def sums(batches):
        count = np.zeros((parts, entries), np.int64)
        total = np.zeros((parts, entries, width), object)
        for _, x in _vectors(batches, scale):
            codes, _ = books.assign(x)
            for p, v in enumerate(np.split(x, parts, axis=1)):
                here = np.zeros((entries, width), x.dtype)
                np.add.at(here, codes[:, p], v)
                total[p] += here.astype(object)
                count[p] += np.bincount(codes[:, p], minlength=entries)
        out = [(p, e, d, place, digit) for p, e in np.argwhere(count).tolist() for d, whole in enumerate([*total[p, e].tolist(), int(count[p, e])]) for place, digit in _digits(whole)]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(5)], ["part", "entry", "place", "digit", "total"])

    found = rows.mapInArrow(sums, "part long, entry long, place long, digit long, total long")
    found = found.groupBy("part", "entry", "place", "digit").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    whole = np.zeros((parts, entries, width + 1), object)
    for r in found:
        whole[r["part"], r["entry"], r["place"]] += int(r["total"]) * BASE ** r["digit"]
    out = []
    for p, book in enumerate(books.parts):
        moved = [[t // n for t in totals] if n else old for (*totals, n), old in zip(whole[p].tolist(), book.entries.tolist(), strict=True)]
        large = any(abs(c) > SMALL for e in moved for c in e)
        out.append(np.array(moved, object if large else np.int64).reshape(entries, width))
    return Codebooks(out)


def compress_vectors(
    table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> tuple[DataFrame, Codebooks | None]:
    """((id, label, codes array<int>, error long), codebooks): one row for every usable vector of the table.

    Unusable vectors (null, or with a null or non-finite component) are
    dropped, and so are those whose length differs from the commonest one (the
    longer of two as common; empty vectors never count). That length has to be
    a multiple of parts. Of fewer usable rows than entries, each gives an entry;
    without any, there is no row and no codebook (None). Repeated ids and null
    ids (last) count as rows of their own, equal ids by their vectors. error:
    squared distances, summed; beyond a long, the greatest long. At most 64
    entries. Other columns are ignored, whatever their names.
    """
    if not 0 < entries <= 64:
        raise ValueError("a mask holds at most 64 entries")
    label = F.col(label_col) if label_col else F.lit(None).cast("int")
    rows = table.select(F.col(id_col).alias("id"), label.alias("label"), F.col(vector_col).cast("array<double>").alias("vector")).where(usable(F.col("vector")))
    lengths = rows.groupBy(F.size("vector").alias("n")).count().where("n > 0").orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = f"id {kinds['id']}, label {kinds['label']}, codes array<int>, error long"
    if not lengths:
        return table.sparkSession.createDataFrame([], schema), None
    width = lengths[0]["n"]
    if width % parts:
        raise ValueError(f"vectors of {width} components have no {parts} equal parts")
    rows = rows.where(F.size("vector") == width)
    first = rows.orderBy(F.asc_nulls_last("id"), "vector").limit(entries).select("vector").collect()
    start = integers(np.array([x for r in first for x in r["vector"]], float), scale).reshape(len(first), width)
    books = Codebooks(np.split(start, parts, axis=1))
    for _ in range(rounds):
        books = _moved(rows.select("vector"), books, scale)

    def assigned(batches):
        for part, x in _vectors(batches, scale):
            codes, distances = books.assign(x)
            error = distances.sum(axis=1)
            if error.dtype == object:
                error = [min(int(e), LONGEST) for e in error]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(list(codes.astype(np.int32)), pa.list_(pa.int32())), pa.array(error, pa.int64())], ["id", "label", "codes", "error"])

    return rows.mapInArrow(assigned, schema), books


def total_by_label(coded: DataFrame) -> DataFrame:
    """coded (a stored table) with label_error, error summed over equal labels, nulls together; at most the greatest long.

    Sums are combined before they are shuffled. Few labels are sent to every
    task; where there are many, the rows of each label are dealt to SALTS keys.
    """
    totals = coded.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONGEST)).cast("long").alias("label_error")).withColumnRenamed("label", "of")
    if totals.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return coded.join(F.broadcast(totals), F.col("label").eqNullSafe(F.col("of"))).drop("of")
    salted = totals.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = coded.withColumn("dealt", F.pmod(F.xxhash64("id", "codes"), F.lit(SALTS)).cast("int"))
    return rows.join(salted, F.col("label").eqNullSafe(F.col("of")) & (F.col("dealt") == F.col("salt"))).drop("of", "salt", "dealt")


def vector_codes(table: DataFrame, **options) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every usable vector: the digest form of compress_vectors."""
    coded, books = compress_vectors(table, **options)
    coded = total_by_label(Stage(table.sparkSession, "codes").put(coded, "coded"))
    code = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    return coded.select(F.col("id").alias("vec_id"), code.alias("code"), "error", "label_error", F.lit(books.digest() if books else hashlib.sha256(b"").hexdigest()).alias("codebooks_sha256"))
