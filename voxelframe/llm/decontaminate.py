"""Benchmark decontamination: Wu-Manber search for item windows in whole texts.

Patterns are windows of 10 consecutive item words (a shorter item is one
window). For each window length L, a table over blocks of B words holds how
far a window's end is at least from the block; blocks of no window have the
full shift s = L - B + 1. Any occurrence holds exactly one block that ends at
a multiple of s, so only those positions are looked up; those with a smaller
shift are followed to the possible ends, where the suffix-block table, then
the hash of the whole window, and last a comparison of the words themselves
decide.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Stage
from .words import ALNUM_SPLIT, U64, mix, slices, text_buffer, word_hashes

WINDOW = 10
_WEIGHTS = mix(np.arange(501, 501 + 64, dtype=U64)) | U64(1)
_OTHERS = mix(np.arange(701, 701 + 64, dtype=U64)) | U64(1)
#: Bytes of benchmark text that one compiled set of tables holds; they are about 16 times as large.
BLOCK_BYTES = 8 << 20


def _combine(h: np.ndarray, last: np.ndarray, n: int, weights: np.ndarray = _WEIGHTS) -> np.ndarray:
    """Hash of the n words that end at each of last."""
    out = np.zeros(len(last), U64)
    for k in range(n):
        out += h[last - (n - 1 - k)] * weights[k]
    return mix(out)


class Patterns:
    """The compiled windows of a bounded set of (item_id, text): arrays over their words."""

    def __init__(self, items: list[tuple[str, str]]):
        self.names = [name for name, _ in items]
        self.raw, offsets = text_buffer(pa.array([text for _, text in items], pa.string()))
        parts = [(i, *word_hashes(self.raw, offsets[i : j + 1], ALNUM_SPLIT)) for i, j in slices(offsets)]
        joined = lambda k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64)
        h, self.starts, self.ends = joined(1).astype(U64), joined(3), joined(4)
        sizes = np.concatenate([np.diff(p[2]) for p in parts]) if parts else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        whole = sizes[owner]
        self.groups = []
        for n in range(1, WINDOW + 1):
            last = np.flatnonzero((place == n - 1) & (whole == n) if n < WINDOW else place >= n - 1)
            if len(last):
                self.groups.append(self._compile(h, n, last, owner[last]))

    @staticmethod
    def _compile(h: np.ndarray, length: int, last: np.ndarray, owner: np.ndarray) -> dict:
        """Tables of the windows of one length that end at the words last."""
        block = min(3, length)
        size = 1 << max(12, (8 * len(last)).bit_length())
        mask = U64(size - 1)
        slot = lambda ends: (_combine(h, ends, block) & mask).astype(np.int64)
        shift = np.full(size, length - block + 1, np.int8)
        for back in range(length - block, -1, -1):  # the least comes last
            shift[slot(last - back)] = back
        suffix = np.zeros(size, bool)
        suffix[slot(last)] = True
        whole, other = _combine(h, last, length), _combine(h, last, length, _OTHERS)
        order = np.lexsort((owner, other, whole))
        whole, other, last, owner = whole[order], other[order], last[order], owner[order]
        new = np.ones(len(whole), bool)  # the first of each different window
        new[1:] = (whole[1:] != whole[:-1]) | (other[1:] != other[:-1])
        once = new.copy()  # the first of each window and item
        once[1:] |= owner[1:] != owner[:-1]
        at = np.flatnonzero(new)
        items_at = np.append(np.cumsum(once)[at] - 1, once.sum())
        return {"length": length, "block": block, "shift": shift, "suffix": suffix, "mask": mask, "whole": whole[at], "last": last[at], "items": owner[once], "items_at": items_at}

    def items(self, group: int, window: int) -> list[str]:
        """The names of the items that have a window."""
        g = self.groups[group]
        return [self.names[k] for k in g["items"][g["items_at"][window] : g["items_at"][window + 1]].tolist()]

    def search(self, raw: np.ndarray, h: np.ndarray, owner: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """Yield (first word, last word, group, window) of each occurrence within one text."""
        for number, g in enumerate(self.groups):
            n, block, step = g["length"], g["block"], g["length"] - g["block"] + 1
            if len(h) < n:
                continue
            at = np.arange(-(-(block - 1) // step) * step, len(h), step)
            shift = g["shift"][(_combine(h, at, block) & g["mask"]).astype(np.int64)]
            at, shift = at[shift < step], shift[shift < step]
            last = np.concatenate([at[shift <= d] + d for d in range(step)]) if len(at) else at
            last = last[(last >= n - 1) & (last < len(h))]
            last = last[owner[last] == owner[last - (n - 1)]]
            last = last[g["suffix"][(_combine(h, last, block) & g["mask"]).astype(np.int64)]]
            if not len(last):
                continue
            whole = _combine(h, last, n)
            k = np.searchsorted(g["whole"], whole)
            same = (k < len(g["whole"])) & (g["whole"][np.minimum(k, len(g["whole"]) - 1)] == whole)
            for e, p, same_hash in zip(last[same].tolist(), k[same].tolist(), whole[same], strict=True):
                spelt = [raw[starts[i] : ends[i]].tobytes().lower() for i in range(e - n + 1, e + 1)]
                while p < len(g["whole"]) and g["whole"][p] == same_hash:
                    w = int(g["last"][p])
                    if spelt == [self.raw[self.starts[i] : self.ends[i]].tobytes().lower() for i in range(w - n + 1, w + 1)]:
                        yield e - n + 1, e, number, p
                        break
                    p += 1


def _found(held, batch: pa.RecordBatch) -> list[tuple[int, list[int], list[str]]]:
    """(number of words, spans, items) of each text (column 1) of a batch; without patterns only the words are counted."""
    raw, offsets = text_buffer(batch.column(1))
    out = []
    for i, j in slices(offsets):
        h, first, starts, ends = word_hashes(raw, offsets[i : j + 1], ALNUM_SPLIT)
        owner = np.repeat(np.arange(j - i), np.diff(first))
        spans: dict[int, list[int]] = {}
        windows: dict[int, set[tuple[int, int]]] = {}
        for a, b, *window in held.value.search(raw, h, owner, starts, ends) if held else ():
            d = int(owner[a])
            spans.setdefault(d, []).extend((a - int(first[d]), b - int(first[d])))
            windows.setdefault(d, set()).add(tuple(window))
        out += [(int(first[d + 1] - first[d]), spans.get(d, []), sorted({x for w in windows.get(d, ()) for x in held.value.items(*w)})) for d in range(j - i)]
    return out


_RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, spans array<long>"


def _result(ids: pa.Array, out: list[tuple[int, list[int], list[str]]]) -> pa.RecordBatch:
    n_hit = [_covered(n, s) for n, s, _ in out]
    digest = [hashlib.sha256(",".join(m).encode()).hexdigest() for *_, m in out]
    return pa.RecordBatch.from_arrays(
        [ids, pa.array([n for n, *_ in out], pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(m) for *_, m in out], pa.int64()), pa.array(digest, pa.string()), pa.array([x > 0 for x in n_hit], pa.bool_()), pa.array([m for *_, m in out], pa.list_(pa.string())), pa.array([s for _, s, _ in out], pa.list_(pa.int64()))],
        ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "spans"],
    )


def _scan(held):
    """Texts to results, for a benchmark of one block."""

    def run(batches):
        for batch in batches:
            yield _result(batch.column(0), _found(held, batch))

    return run


def _hits(held):
    """(doc_id, digest, spans, items) of the texts that a block hits, without the texts."""

    def run(batches):
        for batch in batches:
            out = _found(held, batch)
            at = [k for k, (_, s, _) in enumerate(out) if s]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), batch.column(2).take(pa.array(at, pa.int64())), pa.array([out[k][1] for k in at], pa.list_(pa.int64())), pa.array([out[k][2] for k in at], pa.list_(pa.string()))], ["doc_id", "digest", "spans", "items"])

    return run


def _words(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([n for n, *_ in _found(None, batch)], pa.int64())], ["doc_id", "digest", "n_words"])


def _finished(batches):
    for batch in batches:
        n, spans, items = (batch.column(k).to_pylist() for k in (1, 2, 3))
        yield _result(batch.column(0), [(a, b or [], c or []) for a, b, c in zip(n, spans, items, strict=True)])


def _covered(n: int, spans: list[int]) -> int:
    if not spans:
        return 0
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, spans[::2], 1)
    np.add.at(step, np.array(spans[1::2]) + 1, -1)
    return int((np.cumsum(step) > 0).sum())


def pattern_blocks(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", limit: int = BLOCK_BYTES):
    """Compiled pattern sets of at most limit bytes of text each (or one longer item)."""
    held, size = [], 0
    rows = benchmark.select(F.col(item_col).cast("string"), F.col(text_col).cast("string")).dropna()
    for item, text in rows.toLocalIterator():
        if held and size + len(text) > limit:
            yield Patterns(held)
            held, size = [], 0
        held.append((item, text))
        size += len(text.encode())
    yield Patterns(held)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items, spans) for every row of docs.

    spans: first and last word (from 0) of each occurrence, flat. A null or
    empty text has no words. Benchmark rows without item_id or text are left
    out; rows that repeat an item count once. An empty benchmark hits
    nothing. A benchmark over block_bytes is searched in blocks, one pass over
    the texts each, and driver and executors hold one block at a time. Of a pass
    only the hits are kept, under doc_id and digest of the text (equal rows have
    equal hits); they are joined with the numbers of words at the end, so no
    text is ever written.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.col(text_col).cast("string").alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    blocks = pattern_blocks(benchmark, limit=block_bytes)
    patterns, more = next(blocks), next(blocks, None)
    if more is None:
        return rows.mapInArrow(_scan(spark.sparkContext.broadcast(patterns)), f"doc_id {kind}, {_RESULT}")
    stage, hits = Stage(spark, "decontaminate"), None
    keyed = rows.select("doc_id", "text", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"))
    number = 0
    while patterns is not None:
        held = spark.sparkContext.broadcast(patterns)
        found = keyed.mapInArrow(_hits(held), f"doc_id {kind}, digest binary, spans array<long>, items array<string>")
        found = stage.put(found.dropDuplicates(["doc_id", "digest"]), f"hits-{number}")
        held.destroy()
        hits = found if hits is None else hits.union(found)
        patterns, more, number = more, next(blocks, None) if more is not None else None, number + 1
    hits = hits.groupBy("doc_id", "digest").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    hits = hits.select(F.col("doc_id").alias("id"), F.col("digest").alias("of"), "spans", "items")
    counted = keyed.mapInArrow(_words, f"doc_id {kind}, digest binary, n_words long")
    both = counted.join(hits, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("of")), "left").select("doc_id", "n_words", "spans", "items")
    return both.mapInArrow(_finished, f"doc_id {kind}, {_RESULT}")
