"""MinHash near-duplicates by a multi-index Hamming join.

A text's signature has 64 symbols of 16 bits (the low part of 64 minima). Two
sets of Jaccard similarity J differ in each symbol with probability 1 - J. The
join returns ALL pairs of signatures that differ in at most MAX_ERRORS = 31
symbols: the signature is split into 16 chunks of 4 symbols; by pigeonhole 31
errors leave some chunk with at most one; so each chunk is indexed four times,
once for each symbol that may be in error, under its other three symbols. At
J = 0.75 a pair has over 31 errors with probability 8e-6, less above it. All
candidates are then confirmed on the full shingle sets.

Data flow, per stage:

1. One scan makes counts, set digests and signatures. Equal sets collapse to
   the row with the least doc_id before any join (partial aggregation).
2. Keys that at least two representatives share are found by a partly
   aggregated count; only their members go on.
3. Each key links its members to the member with the most shared keys (the
   original of a family of copies), never to each other: edges are linear. A
   centre's set goes to each of a number of groups, so that the members of a
   large family are confirmed in many tasks.
4. Confirmed links give components. Keys whose members lie in more than one
   component are searched for the remaining pairs across components, under the
   signature bound; keys with over BLOCK members are first refined by two
   symbols of another chunk (an exact step: 31 errors leave one of the other
   15 chunks with at most two). Groups that are still larger are cut into parts
   of about BLOCK members, and each two parts meet in a task of their own. The
   pairs are not listed: families of texts are cut into verification blocks of
   about VERIFY texts or VERIFY_SHINGLES shingles, and a text goes once, with
   its full set, to each block that holds a candidate for it; there the
   intersections with the whole block are counted through an inverted index.
5. Confirmed links of both steps give the final components.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components
from .shingles import SYMBOLS, set_digest, shingle_sets, signature
from .store import Stage

CHUNK = 4
CHUNKS = SYMBOLS // CHUNK
MAX_ERRORS = 2 * CHUNKS - 1
BLOCK = 4096
#: Texts of a verification block, and texts sent to one copy of it.
VERIFY, SENT = 1024, 4096
#: Groups that a centre's members are dealt to, at least, and members of a group if one centre had them all.
GROUPS, MEMBERS = 256, 256
#: Shingles of a verification block (or one longer text).
VERIFY_SHINGLES = 1 << 20
_TRIPLES = list(combinations(range(CHUNK), CHUNK - 1))
_PAIRS = list(combinations(range(CHUNK), 2))
#: 64-bit words of the id filter, at least and at most (64 MB).
_FILTER_WORDS = (1 << 14, 1 << 23)


def _sketch(batches):
    for batch in batches:
        ids, rows = batch.column(0), []
        for s in shingle_sets(batch.column(1)):
            rows.append((len(s), *set_digest(s), signature(s)) if len(s) else (0, 0, 0, None))
        n, a, b, sig = zip(*rows, strict=True) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sig, pa.binary())], ["doc_id", "n_shingles", "d1", "d2", "sig"])


def _symbols(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, SYMBOLS)


def index_keys(sig: np.ndarray) -> np.ndarray:
    """(rows, 64) keys: three symbols, the chunk and the symbol left out."""
    s = sig.astype(np.int64).reshape(-1, CHUNKS, CHUNK)
    out = np.empty((len(s), CHUNKS, CHUNK), np.int64)
    for k, (x, y, z) in enumerate(_TRIPLES):
        out[:, :, k] = s[:, :, x] | s[:, :, y] << 16 | s[:, :, z] << 32 | k << 48
    out |= np.arange(CHUNKS, dtype=np.int64)[None, :, None] << 50
    return out.reshape(len(s), -1)


def _keys(batches):
    for batch in batches:
        for k in range(0, batch.num_rows, 2048):
            part = batch.slice(k, 2048)
            keys = index_keys(_symbols(part.column(1)))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(part.column(0).to_numpy(zero_copy_only=False), keys.shape[1]))], ["key", "id"])


def _close(batches):
    """Keep pairs whose signatures differ in at most MAX_ERRORS symbols."""
    for batch in batches:
        if batch.num_rows:
            errors = (_symbols(batch.column(2)) != _symbols(batch.column(3))).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["id", "centre"]).filter(pa.array(errors <= MAX_ERRORS))


_REST = "key long, sub long, id long, component long, rank long, block long, part int, sig binary"


def _refined(batches):
    """Members of a very frequent key, under that key and two symbols of another chunk."""
    for batch in batches:
        for k in range(0, batch.num_rows, 1024):
            part = batch.slice(k, 1024)
            own = part.column(0).to_numpy() >> 50
            s = _symbols(part.column(7)).astype(np.int64).reshape(-1, CHUNKS, CHUNK)
            for c in range(CHUNKS):
                rows = np.flatnonzero(own != c)
                for m, (x, y) in enumerate(_PAIRS):
                    sub = pa.array(s[rows, c, x] | s[rows, c, y] << 16 | (c * 8 + m) << 32)
                    taken = part.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays([taken.column(0), sub, *taken.columns[2:]], taken.schema.names)


def _candidates(key, ids, comp, rank, block, part, sig):
    """(id, block) of each text and each block with a text of another component under the signature bound.

    Of a pair, the text of the smaller component (higher rank) is sent, under
    the first key that the pair shares. Where two parts of a group meet (part
    is not -1), pairs within a part are left to another task.
    """
    keys = index_keys(sig)
    for i in range(0, len(ids), 256):
        left, sent = slice(i, i + 256), []
        for j in range(0, len(ids), 256):
            right = slice(j, j + 256)
            errors = np.zeros((len(ids[left]), len(ids[right])), np.uint8)
            for c in range(SYMBOLS):
                errors += sig[left, c][:, None] != sig[right, c][None, :]
            apart = (part[left][:, None] != part[right][None, :]) | (part[left][:, None] == -1)
            x, y = np.nonzero((errors <= MAX_ERRORS) & (comp[left][:, None] != comp[right][None, :]) & apart)
            x, y = x + i, y + j
            up = (rank[x] > rank[y]) | ((rank[x] == rank[y]) & (ids[x] > ids[y]))
            x, y = x[up], y[up]
            up = keys[x, (keys[x] == keys[y]).argmax(axis=1)] == key
            sent.append(np.unique(np.stack([x[up], block[y[up]]]), axis=1))
        x, to = np.unique(np.concatenate(sent, axis=1), axis=1)
        yield ids[x], to


def _search(batches):
    """_candidates of each (key, sub); input sorted by both."""
    group, held = None, []

    def flush():
        if sum(len(h[0]) for h in held) > 1:
            cols = [np.concatenate([h[k] for h in held]) for k in range(6)]
            if (cols[1] != cols[1][0]).any():
                yield from _candidates(group[0], *cols)

    out, n = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        key, sub = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cols = [batch.column(k).to_numpy() for k in range(2, 7)] + [_symbols(batch.column(7))]
        cuts = np.flatnonzero((key[1:] != key[:-1]) | (sub[1:] != sub[:-1])) + 1
        for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)], strict=True):
            if group != (key[s], sub[s]):
                for found in flush():
                    out.append(found)
                    n += len(found[0])
                group, held = (key[s], sub[s]), []
            held.append([c[s:e] for c in cols])
        if n > 10_000:
            yield _id_blocks(out)
            out, n = [], 0
    out += list(flush())
    if out:
        yield _id_blocks(out)


def _id_blocks(found):
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[k] for f in found])) for k in range(2)], ["id", "block"])


def _confirm(batches):
    """Links of the texts sent to a block: one for each text and component at most.

    Input sorted by (block, salt, sent): the block's own texts come first and
    make the inverted index, the sent ones are streamed against it.
    """
    group, own, index = None, [], None
    for batch in batches:
        a, b = [], []
        block, salt, sent, ids, comp = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(5))
        sets = batch.column(5)
        for k in range(batch.num_rows):
            if group != (block[k], salt[k]):
                group, own, index = (block[k], salt[k]), [], None
            values = sets[k].values.to_numpy(zero_copy_only=False)
            if not sent[k]:
                own.append((ids[k], comp[k], values))
                continue
            if not own:
                continue
            if index is None:
                flat = np.concatenate([v for *_, v in own])
                order = np.argsort(flat, kind="stable")
                index = flat[order], np.repeat(np.arange(len(own)), [len(v) for *_, v in own])[order], np.array([len(v) for *_, v in own]), np.array([c for _, c, _ in own]), np.array([i for i, *_ in own])
            flat, texts, sizes, comps, names = index
            low, high = np.searchsorted(flat, values), np.searchsorted(flat, values, "right")
            n = high - low
            at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
            shared = np.bincount(texts[at], minlength=len(own))
            linked = np.flatnonzero((100 * shared >= 75 * (sizes + len(values) - shared)) & (comps != comp[k]))
            for m in linked[np.unique(comps[linked], return_index=True)[1]]:
                a.append(min(ids[k], names[m]))
                b.append(max(ids[k], names[m]))
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _id_filter(spark: SparkSession, ids: DataFrame):
    """(bits, broadcast bitmap) over hashed ids: eight bits an id up to 64 MB; false hits only, never false misses."""
    low, high = _FILTER_WORDS
    n = min(high, max(low, 1 << (ids.count() // 8).bit_length()))
    bit = F.pmod(F.xxhash64("id"), F.lit(n * 64))
    rows = ids.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")).toArrow()
    words = np.zeros(n, np.int64)
    words[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
    return n * 64, spark.sparkContext.broadcast(words)


def _full_sets(docs: DataFrame, ids: DataFrame, text_col: str) -> DataFrame:
    """(id, set) of the texts whose doc_id is in ids(id), distinct."""
    bits, words = _id_filter(docs.sparkSession, ids)

    def sets(batches):
        for batch in batches:
            bit = batch.column(2).to_numpy()
            batch = batch.filter(pa.array((words.value[bit >> 6] >> (bit & 63)) & 1 == 1))
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                found = [s.view(np.int64) for s in shingle_sets(part.column(1))]
                ends = np.cumsum([0, *map(len, found)])
                flat = pa.array(np.concatenate(found) if found else np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], ["id", "set"])

    bit = F.pmod(F.xxhash64("id"), F.lit(bits)).alias("bit")
    full = docs.select(F.col("doc_id").cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null").select("id", "text", bit)
    return full.mapInArrow(sets, "id long, set array<long>").join(ids, "id", "left_semi")


def _confirmed(docs: DataFrame, rows: DataFrame, text_col: str, stage: Stage, name: str) -> DataFrame:
    """Links (a, b) of rows(block, salt, sent, id, component): of each text sent to a (block, salt) with those that are not sent."""
    rows = stage.put(rows, f"{name}-rows")
    full = _full_sets(docs, rows.select("id").distinct(), text_col)
    dealt = rows.join(full, "id").select("block", "salt", "sent", "id", "component", "set").repartition("block", "salt").sortWithinPartitions("block", "salt", "sent")
    return stage.put(dealt.mapInArrow(_confirm, "a long, b long").distinct(), name)


def _verified_stars(docs: DataFrame, star: DataFrame, text_col: str, stage: Stage, name: str) -> DataFrame:
    """The links between the members and centres of star(id, centre).

    A centre's members are dealt to groups by their ids, and the centre is
    copied to the groups that have any: at most one copy a member. No step
    brings a centre's members together.
    """
    groups = max(GROUPS, star.count() // MEMBERS)
    sent = star.select(F.col("centre").alias("block"), F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int").alias("salt"), F.lit(True).alias("sent"), "id", F.col("id").alias("component"))
    own = sent.select("block", "salt").distinct().select("block", "salt", F.lit(False).alias("sent"), F.col("block").alias("id"), F.col("block").alias("component"))
    return _confirmed(docs, sent.union(own), text_col, stage, name)


def _verified_in_blocks(docs: DataFrame, sent: DataFrame, texts: DataFrame, text_col: str, stage: Stage, name: str) -> DataFrame:
    """Links between texts sent(id, block) and the texts(id, component, block) of those blocks."""
    salts = sent.groupBy("block").agg(F.floor((F.count("*") - 1) / SENT + 1).cast("int").alias("salts"))
    sent = sent.join(salts, "block").join(texts.select("id", "component"), "id").select("block", F.pmod(F.hash("id"), "salts").alias("salt"), F.lit(True).alias("sent"), "id", "component")
    own = texts.join(salts, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(False).alias("sent"), "id", "component")
    return _confirmed(docs, sent.union(own), text_col, stage, name)


def _in_parts(refined: DataFrame) -> DataFrame:
    """refined with groups (key, sub) of over BLOCK members cut into parts, each two of which meet under a sub of their own."""
    sizes = refined.groupBy("key", "sub").agg(F.floor((F.count("*") - 1) / BLOCK + 1).cast("int").alias("parts")).where("parts > 1")
    dealt = refined.drop("part").join(sizes, ["key", "sub"], "left").withColumn("own", F.pmod(F.hash("id"), F.coalesce("parts", F.lit(1))))
    dealt = dealt.withColumn("met", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    sub = F.when(F.col("parts").isNull(), F.col("sub")).otherwise(F.xxhash64("sub", F.least("own", "met"), F.greatest("own", "met")))
    part = F.when(F.col("parts").isNull() | (F.col("own") == F.col("met")), -1).otherwise(F.col("own"))
    return dealt.select("key", sub.alias("sub"), "id", "component", "rank", "block", part.alias("part"), "sig")


def near_duplicates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs(doc_id, text).

    doc_id is an integer of any width; others raise an error when cast.
    Null, empty and wordless texts have no shingles and link with nothing.
    Rows that repeat a doc_id are one node: its component follows from all its
    texts. A row with a null doc_id is a node of its own: component_id is null
    and the row is kept. Other columns are ignored.
    """
    spark = docs.sparkSession
    stage = Stage(spark, "neardup")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketch = stage.put(base.mapInArrow(_sketch, "doc_id long, n_shingles long, d1 long, d2 long, sig binary"), "sketch")
    some = sketch.where("n_shingles > 0 and doc_id is not null")
    classes = stage.put(some.groupBy("n_shingles", "d1", "d2").agg(F.min(F.struct("doc_id", "sig")).alias("r")).select("n_shingles", "d1", "d2", F.col("r.doc_id").alias("id"), F.col("r.sig").alias("sig")), "classes")
    signatures = classes.select("id", "sig")
    keys = signatures.mapInArrow(_keys, "key long, id long")
    shared = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select("key", "n")
    members = stage.put(keys.join(shared, "key").select("key", "id", "n"), "members")
    weight = members.groupBy("id").agg(F.sum(F.col("n") - 1).alias("weight"))
    centre = members.join(weight, "id").groupBy("key").agg(F.min(F.struct((-F.col("weight")).alias("w"), "id")).alias("c")).select("key", F.col("c.id").alias("centre"), "c.w")
    centred = stage.put(members.join(centre, "key"), "centred")
    star = centred.where("id <> centre").select("id", "centre").distinct()
    of_centre = signatures.select(F.col("id").alias("centre"), F.col("sig").alias("centre_sig"))
    star = star.join(signatures, "id").join(of_centre, "centre").select("id", "centre", "sig", "centre_sig").mapInArrow(_close, "id long, centre long")
    links = _verified_stars(base, stage.put(star, "star"), "text", stage, "star-links")

    first = connected_components(links, stage, "first")
    ranks = first.groupBy("component").agg((-F.count("*")).alias("rank"))
    first = first.join(ranks, "component")
    placed = centred.join(first, "id", "left").select("key", "id", "n", "centre", "w", F.coalesce("component", "id").alias("component"), F.coalesce("rank", F.lit(-1).cast("long")).alias("rank"))
    apart = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    rest = stage.put(placed.join(apart, "key", "left_semi"), "rest")
    stage.drop("members", "centred", "first-both")
    family = rest.groupBy("id", "component").agg(F.min(F.struct("w", "centre")).alias("f")).select("id", "component", F.col("f.centre").alias("family"))
    family = family.join(classes.select("id", "n_shingles"), "id")
    blocks = family.groupBy("family").agg(F.greatest(F.floor((F.count("*") - 1) / VERIFY + 1), F.floor(F.sum("n_shingles") / VERIFY_SHINGLES) + 1).alias("blocks"))
    family = family.join(blocks, "family").select("id", "component", F.xxhash64("family", F.pmod(F.xxhash64("id"), "blocks")).alias("block"))
    family = stage.put(family, "family")
    cols = ["key", "sub", "id", "component", "rank", "block", "part", "sig"]
    rest = rest.join(family.select("id", "block"), "id").join(signatures, "id").withColumn("sub", F.lit(-1).cast("long")).withColumn("part", F.lit(-1))
    small, large = rest.where(F.col("n") <= BLOCK).select(*cols), rest.where(F.col("n") > BLOCK).select(*cols)
    if large.limit(1).count():
        large = _in_parts(stage.put(large.mapInArrow(_refined, _REST), "refined"))
    sent = small.union(large).repartition("key", "sub").sortWithinPartitions("key", "sub").mapInArrow(_search, "id long, block long").distinct()
    links = links.union(_verified_in_blocks(base, stage.put(sent, "sent"), family, "text", stage, "more-links"))

    same = some.join(classes.select("n_shingles", "d1", "d2", "id"), ["n_shingles", "d1", "d2"]).where("doc_id <> id").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    placed = connected_components(links.union(same), stage, "all")
    out = sketch.select("doc_id", "n_shingles").join(placed.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
