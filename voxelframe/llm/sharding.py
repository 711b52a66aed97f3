"""Sharding by sampled splitters, with DataFrame functions only.

Rows are ordered by (hash of the text, doc_id, row), so equal texts stand
together. A size-weighted sample gives splitters at quantiles, first between
texts only; ranges that exact byte counts then show to be overfull (a text
with very many copies) are sampled anew and subdivided between rows. Whole
ranges go to shards by their exact cumulated bytes, and a row's slot is its
range's offset in the shard plus its number in the range, so no task ever
holds a shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import Stage

#: Splitters aimed at for each shard, and sampled rows for each splitter.
RANGES_PER_SHARD, SAMPLES_PER_RANGE = 128, 8
#: A range is overfull beyond this part of an even shard.
OVERFULL = 1 / 32
ROUNDS = 6


def _unit(*cols) -> Column:
    """A number in [0, 1) that the columns decide."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 30)) / float(1 << 30)


def _sample(rows: DataFrame, bytes_: int, want: int, seed: int) -> list[tuple[str, int]]:
    """About want keys (never more than about twice that), drawn by size: (key, weight) in order."""
    expected = F.col("size") * (want / max(bytes_, 1))
    drawn = F.floor(expected) + F.when(_unit("key", F.lit(seed)) < expected - F.floor(expected), 1).otherwise(0)
    found = rows.select("key", drawn.cast("long").alias("weight")).where("weight > 0").collect()
    return sorted((r.key, r.weight) for r in found)


def _quantiles(sample: list[tuple[str, int]], parts: int) -> list[str]:
    total, seen, out = sum(w for _, w in sample), 0, []
    for key, weight in sample:
        if seen * parts // total != (seen + weight) * parts // total:
            out.append(key)
        seen += weight
    return out


def _array(values: list, kind: str) -> Column:
    """A constant array, folded from one text instead of built value by value."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def _range_of(key: Column, splitters: list[str]) -> Column:
    """Number of splitters <= key, by binary search."""
    if not splitters:
        return F.lit(0)
    bounds, steps = _array(splitters, "string"), [1 << k for k in range(len(splitters).bit_length() - 1, -1, -1)]
    return F.aggregate(
        F.lit(steps),
        F.lit(0),
        lambda low, step: F.when((low + step <= len(splitters)) & (F.coalesce(F.get(bounds, low + step - 1), F.lit("~")) <= key), low + step).otherwise(low),
    )


def shard(docs: DataFrame, n_shards: int = 24, text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of docs.

    doc_id is an integer of any width; others raise an error when cast.
    size is the text's UTF-8 bytes plus 8; a null text has none and the CRC of
    the empty text. law is 'bytes': the shards' sizes are near equal; they
    differ by about a splitter's range (an even shard over 128) or a part of a
    large group of copies, or a single longer text. Copies of a text stay in
    one shard except where a shard's border cuts a group that alone is over
    1/32 of an even shard. slot counts a shard's rows from 0 without gaps;
    grown_shard is null (it belongs to another law). Null doc_ids sort first;
    repeated rows each get a slot. Other columns are ignored.
    """
    stage = Stage(docs.sparkSession, "shard")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    hexed = lambda c: F.lpad(F.hex(c), 16, "0")
    id_ = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.concat(hexed(F.xxhash64(text)), hexed(id_.bitwiseXOR(F.lit(-(1 << 63)))), hexed(F.monotonically_increasing_id())).alias("key"),
    )
    rows = stage.put(rows, "rows")
    total = rows.agg(F.sum("size")).first()[0] or 0
    if not total:
        return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    parts = n_shards * RANGES_PER_SHARD
    splitters = sorted({key[:16] for key in _quantiles(_sample(rows, total, parts * SAMPLES_PER_RANGE, 0), parts)})
    for k in range(1, ROUNDS + 1):
        ranges = rows.withColumn("range", _range_of(F.col("key"), splitters))
        counts = {r.range: r for r in ranges.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()}
        limit = total * OVERFULL / n_shards
        overfull = [r for r in counts.values() if r.bytes > limit and r.n > 1]
        if not overfull or k == ROUNDS:
            break
        numbers = _array([r.range for r in overfull], "int")
        bytes_ = sum(r.bytes for r in overfull)
        want = min(parts * SAMPLES_PER_RANGE, int(bytes_ / limit * 4 * SAMPLES_PER_RANGE) + 1)
        sample = _sample(ranges.where(F.array_contains(numbers, F.col("range"))), bytes_, want, k)
        more = set(_quantiles(sample, max(2, int(bytes_ / limit * 4)))) - set(splitters)
        if not more:
            break
        splitters = sorted({*splitters, *more})
    at, before, slots = [0] * (len(splitters) + 1), 0, [0] * (len(splitters) + 1)
    filled = [0] * n_shards
    for number in sorted(counts):
        r = counts[number]
        at[number] = min(n_shards - 1, int((before + r.bytes / 2) * n_shards / total))
        slots[number], filled[at[number]] = filled[at[number]], filled[at[number]] + r.n
        before += r.bytes
    within = F.row_number().over(Window.partitionBy("range").orderBy("key")) - 1
    return ranges.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.get(_array(at, "int"), F.col("range")).alias("shard"),
        (F.get(_array(slots, "long"), F.col("range")) + within).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
