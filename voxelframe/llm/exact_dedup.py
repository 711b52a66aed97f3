"""Exact dedup over a cuckoo-filter index of live digests.

Digests of the normalised texts are combined within each map batch, dealt out
by digest, and each task keeps a cuckoo filter (four 16-bit fingerprints to a
bucket) beside its bucketed content: the full digests. A filter hit is
verified against the content of its bucket, so false hits cost a comparison
and never a wrong answer; an insertion that finds no place doubles the table
and refills it from the stored keys. Digests can be taken out again.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import Stage

SLOTS = 4
MAX_KICKS = 128


class CuckooIndex:
    """digest (bytes, 8 or more) -> value, with insertion, deletion and growth."""

    def __init__(self, buckets: int = 1024):
        self._reset(1 << max(1, (buckets - 1).bit_length()))
        self.resizes = 0

    def _reset(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.prints = [0] * (buckets * SLOTS)
        self.content: list[list | None] = [None] * (buckets * SLOTS)
        self.size = 0

    def _place(self, digest: bytes) -> tuple[int, int, int]:
        word = int.from_bytes(digest[:8], "little")
        mark = (word >> 48) or 1
        first = word & self.mask
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995)) & self.mask

    def _slot(self, digest: bytes) -> int:
        mark, first, second = self._place(digest)
        for bucket in (first, second):
            for at in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.prints[at] == mark and self.content[at][0] == digest:
                    return at
        return -1

    def get(self, digest: bytes):
        """The live value of digest, or None."""
        at = self._slot(digest)
        return self.content[at][1] if at >= 0 else None

    def insert(self, digest: bytes, value) -> None:
        """Add a live digest, or replace its value."""
        at = self._slot(digest)
        if at >= 0:
            self.content[at][1] = value
            return
        record = [digest, value]
        while record is not None:
            record = self._push(record)
            if record is not None:
                self._grow()

    def _push(self, record: list) -> list | None:
        mark, first, second = self._place(record[0])
        for bucket in (first, second):
            for at in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if not self.prints[at]:
                    self.prints[at], self.content[at] = mark, record
                    self.size += 1
                    return None
        bucket = second
        for k in range(MAX_KICKS):
            at = bucket * SLOTS + k % SLOTS
            self.prints[at], mark = mark, self.prints[at]
            self.content[at], record = record, self.content[at]
            bucket = self._other(bucket, mark)
            for at in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if not self.prints[at]:
                    self.prints[at], self.content[at] = mark, record
                    self.size += 1
                    return None
        return record

    def _grow(self) -> None:
        held = [r for r in self.content if r is not None]
        buckets = 2 * (self.mask + 1)
        while True:
            self._reset(buckets)
            self.resizes += 1
            if all(self._push(r) is None for r in held):
                return
            buckets *= 2

    def delete(self, digest: bytes) -> bool:
        """Take a digest out; False if it is not live."""
        at = self._slot(digest)
        if at < 0:
            return False
        self.prints[at], self.content[at] = 0, None
        self.size -= 1
        return True

    def items(self):
        return ((r[0], r[1]) for r in self.content if r is not None)


#: Rows whose digests one task's index holds at most, but for chance.
TASK_ROWS = 500_000
_COMBINED = "digest binary, no_id boolean, doc_id long, row long, live long, removed long"


def _order(no_id, doc_id, row):
    return (no_id, doc_id, row)


def _emit(items):
    items = list(items)
    for k in range(0, len(items), 20_000):
        part = items[k : k + 20_000]
        yield pa.RecordBatch.from_arrays(
            [pa.array([d for d, _ in part], pa.binary()), *(pa.array([v[i] for _, v in part], t) for i, t in enumerate((pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64())))],
            ["digest", "no_id", "doc_id", "row", "live", "removed"],
        )


def _combine(batches):
    """Within a map task's batch: a row for each digest, with its best live row and its counts."""
    for batch in batches:
        best: dict[bytes, tuple] = {}
        for digest, no_id, doc_id, row, live, removed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            value = (no_id, doc_id, row, live, removed)
            best[digest] = _merge(best[digest], value) if digest in best else value
        yield from _emit(best.items())


def _merge(a: tuple, b: tuple) -> tuple:
    if not a[3] or b[3] and _order(*b[:3]) < _order(*a[:3]):
        head = b[:3] if b[3] else a[:3]
    else:
        head = a[:3]
    return (*head, a[3] + b[3], a[4] + b[4])


def _index(batches):
    """The index of one task's digests; gives the live ones."""
    index = CuckooIndex()
    for batch in batches:
        for digest, *value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            value = tuple(value)
            live = index.get(digest)
            index.insert(digest, value if live is None else _merge(live, value))
    for digest in [d for d, v in index.items() if not v[3]]:  # every row of it was removed
        index.delete(digest)
    yield from _emit(index.items())


def normal_digest(text: Column) -> Column:
    """SHA-256 of the text with each run of blanks as one space; null counts as empty."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " "), 256))


def exact_dedup(docs: DataFrame, text_col: str = "text", removed: DataFrame | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of docs.

    doc_id is an integer of any width; others raise an error when cast.
    Texts are equal when identical after each run of blanks ([ \\t-\\r]) became
    one space; null counts as empty. Of equal texts the row with the smallest
    doc_id stays; of rows that repeat a doc_id and text, one; a row with a
    null doc_id stays only when the whole group has none, and keep_id is then
    null. removed: doc_ids to take out of the index again; their rows are
    returned with kept false and count in no group. Other columns are ignored.
    """
    stage = Stage(docs.sparkSession, "exact")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normal_digest(F.col(text_col)).alias("digest"), F.monotonically_increasing_id().alias("row"))
    gone = F.lit(0).cast("long")
    if removed is not None:
        rows = rows.join(removed.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(1).cast("long").alias("gone")).distinct(), "doc_id", "left")
        gone = F.coalesce("gone", F.lit(0).cast("long"))
    rows = stage.put(rows.select("doc_id", "digest", "row", gone.alias("gone")), "rows")
    keyed = rows.select("digest", F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("doc_id"), "row", (1 - F.col("gone")).alias("live"), F.col("gone").alias("removed"))
    parts = rows.count() // TASK_ROWS
    spread = ("digest",) if parts <= int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) else (parts, "digest")
    live = keyed.mapInArrow(_combine, _COMBINED).repartition(*spread).mapInArrow(_index, _COMBINED)
    live = live.select("digest", F.when(~F.col("no_id"), F.col("doc_id")).alias("keep_id"), F.col("row").alias("keep_row"), F.col("live").alias("group_size"))
    out = rows.join(live, "digest", "left")
    return out.select(
        "doc_id",
        "keep_id",
        F.coalesce("group_size", F.lit(0).cast("long")).alias("group_size"),
        ((F.col("gone") == 0) & F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
