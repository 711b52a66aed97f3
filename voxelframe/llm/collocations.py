"""Phrase collocations by set-oriented mining over sorted occurrence relations.

Texts are read once: a pass of Arrow batches gives each as an array of 64-bit
codes of its words, with the words and counts of each slice beside them. Should
two words share a code, the words themselves are joined instead.

The occurrence relation of length k has a row (piece, pos, id) for each place
where a frequent phrase of k words begins. Places are counted through a whole
text, whose number stands for its pieces; a separator takes a place without a
word, so no phrase goes over the border of two pieces. The relation is kept as
a table that is dealt by text and sorted by text and place, so its merge-join
with itself on the same text and the next place needs no shuffle. Each joined pair
is an occurrence of a phrase of k + 1 words, named by its first and its last k
words; groups of pairs are counted, and a semi-join with the frequent groups
gives the relation of the next length. Nothing frequent is lost: all parts of
a frequent phrase are at least as frequent.
"""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import Stage
from .words import U64, mix, slices, text_buffer, word_hashes

LONGEST, LEAST, TOP, SCALE = 3, 10, 2000, 1_000_000
#: A candidate inside a longer one that has this share of its occurrences is dropped.
SHARE_PERCENT = 50
#: Characters between words, and between pieces, inside a regular expression's brackets.
_BLANKS, _BORDERS = r"\x20\x09", r".,;:!?\x0A-\x0D"
#: Rows of a relation to one file.
FILE_ROWS = 2_000_000
#: Dictionaries of at most so many rows of numbers or words, and tables of at most so many phrases, are sent to every task.
BROADCAST_ROWS, BROADCAST_PHRASES = 1_000_000, 50_000
#: A key with at least 1 / HOT of all rows is joined apart or dealt to SALTS tasks; there are at most HOT of them for each length.
HOT = 1000
SALTS = 8
#: Bytes of texts whose words are told apart together.
SLICE = 1 << 23
_IS_WORD, _IS_BORDER, _ALL = np.ones(256, bool), np.zeros(256, bool), np.ones(256, bool)
_IS_BORDER[[*b".,;:!?\n\x0b\x0c\r"]] = True
_IS_WORD[[*b" \t", *np.flatnonzero(_IS_BORDER)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_CODED = "lang string, piece long, codes array<long>, code long, word string, a long"
#: Counts as decimals: products of three of them and SCALE stay exact.
_COUNT = "decimal(15,0)"
#: A table dealt by piece serves joins by piece and place, is read in its order, and is written in the order of its rows.
_IN_PLACE = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.legacy.bucketedTableScan.outputOrdering": "true", "spark.sql.maxConcurrentOutputFileWriters": "64"}


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    """The session with other settings, for the actions inside."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def lowered(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(docs: DataFrame, text_col: str = "text", group_col: str = "lang") -> DataFrame:
    """(lang, piece, body) of every text with a word, numbered; null groups are und, null texts have none."""
    found = docs.select(F.coalesce(F.col(group_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("body"))
    return found.where(F.col("body").rlike(f"[^{_BLANKS}{_BORDERS}]")).select("lang", F.monotonically_increasing_id().alias("piece"), "body")


def occurrences(found: DataFrame) -> DataFrame:
    """(lang, piece, pos, word) of every word of the texts and of every run of separators, which takes the place between two pieces."""
    tokens = F.regexp_extract_all("body", F.lit(f"[^{_BLANKS}{_BORDERS}]+|[{_BORDERS}]+"), F.lit(0))
    return found.select("lang", "piece", F.posexplode(tokens).alias("pos", "word"))


def _strings(column: pa.Array) -> np.ndarray:
    """A hash of each string of a column."""
    raw, offsets = text_buffer(column)
    out = np.zeros(len(column), U64)
    out[np.diff(offsets) > 0] = word_hashes(raw, offsets, _ALL)[0]
    return out


def _codes(words: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """A code of each word (by hash) in its group; never 0, which stands for separators."""
    codes = mix(words + mix(groups + U64(1)))
    return np.where(codes == 0, U64(1), codes).view(np.int64)


def _coded_slice(lang: pa.Array, piece: pa.Array, body: pa.Array, coding) -> list[pa.RecordBatch]:
    raw, at = text_buffer(body)
    raw, at = raw[at[0] : at[-1]], at - at[0]
    inside = _IS_WORD[raw]
    edge, before = np.zeros(len(raw) + 1, bool), np.zeros(len(raw), bool)
    edge[at], before[1:] = True, inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    upto = np.cumsum(inside, dtype=np.int32)  # word bytes up to each byte
    offsets, letters = np.append(upto[starts] - 1, upto[-1:]).astype(np.int64), _LOWER[raw[inside]]
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]).dictionary_encode()
    groups = lang.dictionary_encode()
    first = np.searchsorted(starts, at)
    group = np.repeat(groups.indices.to_numpy().astype(np.int64), np.diff(first))
    pairs = pa.array(group * len(words.dictionary) + words.indices.to_numpy()).dictionary_encode()
    group, word = np.divmod(pairs.dictionary.to_numpy(), max(len(words.dictionary), 1))
    code, pair = coding(_strings(words.dictionary)[word], _strings(groups.dictionary)[group]), pairs.indices.to_numpy()
    borders = np.cumsum(_IS_BORDER[raw], dtype=np.int32)[starts]
    parted = np.zeros(len(starts), np.int64)
    parted[1:] = borders[1:] != borders[:-1]
    parted[first[:-1][np.diff(first) > 0]] = 0
    parted = np.cumsum(parted)
    codes = np.zeros(len(starts) + int(parted[-1] if len(parted) else 0), np.int64)
    codes[np.arange(len(starts)) + parted] = code[pair]
    ends = (first + np.concatenate([[0], parted])[first]).astype(np.int32)
    texts, found = len(body), len(code)
    empty = lambda n, kind: pa.nulls(n, kind)
    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(codes))
    names = ["lang", "piece", "codes", "code", "word", "a"]
    spelled = words.dictionary.cast(pa.large_string(), safe=False).take(pa.array(word)).cast(pa.string())
    return [
        pa.RecordBatch.from_arrays([empty(texts, pa.string()), piece, lists, empty(texts, pa.int64()), empty(texts, pa.string()), empty(texts, pa.int64())], names),
        pa.RecordBatch.from_arrays([groups.dictionary.take(pa.array(group)).cast(pa.string()), empty(found, pa.int64()), empty(found, lists.type), pa.array(code), spelled, pa.array(np.bincount(pair, minlength=found))], names),
    ]


def coded(found: DataFrame) -> DataFrame:
    """(lang, piece, codes, code, word, a): a row for each text with its words' codes, 0 between two pieces, and rows of the different words of each slice with their codes and counts."""
    coding, most = _codes, SLICE

    def run(batches):
        for batch in batches:
            lang, piece, body = batch.columns
            for i, j in slices(text_buffer(body)[1], most):
                yield from _coded_slice(lang.slice(i, j - i), piece.slice(i, j - i), body.slice(i, j - i), coding)

    return found.mapInArrow(run, _CODED)


def _few(table: DataFrame, most: int) -> bool:
    return table.limit(most + 1).count() <= most


def _short_ids(table: DataFrame) -> DataFrame:
    """table, whose ids are monotonically increasing ones, with ids of four bytes where they all fit, so that two make one key of a join."""
    part, row = F.shiftright("id", 33), F.col("id").bitwiseAND((1 << 33) - 1)
    parts, rows = table.agg(F.max(part), F.max(row)).first()
    if parts is None or (parts + 1) * (rows + 1) >= 1 << 31:
        return table
    return table.withColumn("id", (part * (rows + 1) + row).cast("int"))


def _numbered(rows: DataFrame, dictionary: DataFrame, keys: list[str], total: int) -> tuple[DataFrame, bool]:
    """(rows with the id of their entry in dictionary(*keys, a, id); rows without one go, whether rows stay in their partitions).

    A dictionary too large to send is joined in two ways: the entries with a
    large share of all rows are few and go to every task, the others are
    joined by a shuffle in which no key is large.
    """
    if _few(dictionary, BROADCAST_ROWS):
        return rows.join(F.broadcast(dictionary.drop("a")), keys), True
    hot = F.broadcast(dictionary.where(F.col("a") * HOT >= total).drop("a"))
    rest = rows.join(hot.drop("id"), keys, "left_anti").join(dictionary.where(F.col("a") * HOT < total).drop("a"), keys)
    return rows.join(hot, keys).unionByName(rest), False


def _looked_up(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """rows joined with a table of counts or phrases; a key that many rows may share, as its weight is a large share of total, is dealt to SALTS tasks."""
    if _few(table, BROADCAST_PHRASES):
        return rows.join(F.broadcast(table), keys)
    large = F.col(weight) * HOT >= total
    hot = F.broadcast(table.where(large).select(*keys, F.lit(True).alias("hot")))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")).otherwise(0)
    dealt = rows.join(hot, keys, "left").withColumn("salt", salt).drop("hot")
    copies = F.when(large, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return dealt.join(table.withColumn("salt", F.explode(copies)), [*keys, "salt"]).drop("salt")


def _adjacent(relation: list[DataFrame]) -> DataFrame:
    """(piece, pos, l, r): each place of the relation merge-joined with the next one of its piece; pos is that of l."""
    first, second = relation
    left = first.select("piece", F.col("next").alias("pos"), F.col("id").alias("l"))
    return left.join(second.select("piece", "pos", F.col("id").alias("r")).hint("merge"), ["piece", "pos"]).select("piece", (F.col("pos") - 1).alias("pos"), "l", "r")


def frequent_phrases(docs: DataFrame, text_col: str = "text", group_col: str = "lang", longest: int = LONGEST, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """((lang, words, a) of every phrase of 1 to longest words with at least `least` occurrences, (lang, n) of all words)."""
    spark = docs.sparkSession
    stage = Stage(spark, "phrases")
    texts = stage.put(coded(pieces(docs, text_col, group_col)), "coded")
    written = stage.put(texts.where(F.col("word").isNotNull()).groupBy("lang", "code", "word").agg(F.sum("a").alias("a")), "written")
    sizes = stage.put(written.groupBy("lang").agg(F.sum("a").alias("n")), "sizes")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    phrases = [_short_ids(stage.put(written.where(F.col("a") >= least).select(F.monotonically_increasing_id().alias("id"), "lang", F.array("word").alias("words"), "a", "code"), "phrases"))]
    buckets = min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // FILE_ROWS + 1), 100_000)

    clash = written.groupBy("code").count().where("count > 1").limit(1).count() > 0

    def kept(rows: DataFrame, placed: bool, name: str) -> list[DataFrame]:
        """The relation as a table that is sorted by (piece, pos) and so by (piece, next) as well; rows that stay in place are in order."""
        rows = rows.select("piece", "pos", (F.col("pos") + 1).alias("next"), "id")
        rows = rows if placed else rows.repartition(buckets, "piece").sortWithinPartitions("piece", "pos")
        return stage.put_dealt(rows, name, "piece", [["piece", "next"], ["piece", "pos"]], buckets)

    with _settings(spark, _IN_PLACE):
        if clash:
            dealt = pieces(docs, text_col, group_col).repartition(buckets, "piece").sortWithinPartitions("piece")
            rows, words = occurrences(dealt).withColumn("word", lowered(F.col("word"))), phrases[0].select("lang", F.col("words")[0].alias("word"), "a", "id")
            relation = kept(*_numbered(rows, words, ["lang", "word"], total), "relation")
        else:
            dealt = texts.where(F.col("piece").isNotNull()).select("piece", "codes").repartition(buckets, "piece").sortWithinPartitions("piece")
            rows = dealt.select("piece", F.posexplode("codes").alias("pos", "code")).where("code != 0")
            relation = kept(*_numbered(rows, phrases[0].select("code", "a", "id"), ["code"], total), "relation")
        stage.drop("coded", "written")
        for size in range(2, longest + 1):
            pairs = _adjacent(relation)
            counted = _short_ids(stage.put(pairs.groupBy("l", "r").agg(F.count("*").alias("a")).where(F.col("a") >= least).select("l", "r", "a", F.monotonically_increasing_id().alias("id")), f"groups-{size}"))
            if size < longest:
                relation = kept(*_numbered(pairs, counted, ["l", "r"], total), f"relation-{size}")
                stage.drop("relation" if size == 2 else f"relation-{size - 1}")
            known = phrases[-1]
            longer = _looked_up(counted, known.select(F.col("id").alias("l"), "lang", "words", F.col("a").alias("of_l")), ["l"], "of_l", total)
            longer = _looked_up(longer, known.select(F.col("id").alias("r"), F.element_at("words", -1).alias("last"), F.col("a").alias("of_r")), ["r"], "of_r", total)
            phrases.append(stage.put(longer.select("id", "lang", F.concat("words", F.array("last")).alias("words"), "a"), f"phrases-{size}"))
    out = phrases[0].select("lang", "words", "a")
    for more in phrases[1:]:
        out = out.union(more.select("lang", "words", "a"))
    return stage.put(out, "all"), sizes


def collocations(docs: DataFrame, text_col: str = "text", group_col: str = "lang", longest: int = LONGEST, least: int = LEAST, share_percent: int = SHARE_PERCENT, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each group's best phrases of 2 to longest words.

    a: occurrences of the phrase within pieces, at least `least`; l and r: those
    of the two parts of its lowest-scoring cut; n: all words of the group;
    score: floor(SCALE * a * a / (l * r)). A phrase inside a longer frequent
    one with at least share_percent of its occurrences is dropped. Order: score
    and a descending, then phrase. Null, empty and blank texts have no words;
    repeated rows count each; a null group is und. Other columns are ignored.
    """
    phrases, sizes = frequent_phrases(docs, text_col, group_col, longest, least)
    total = sizes.agg(F.sum("n")).first()[0] or 0
    text = lambda words: F.array_join(words, " ")
    counts = phrases.select("lang", text(F.col("words")).alias("part"), "a")
    candidates = phrases.where(F.size("words") > 1)
    cuts = candidates.select("lang", "words", "a", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "words", "a", "k", text(F.slice("words", F.lit(1), F.col("k"))).alias("first"), text(F.slice("words", F.col("k") + 1, F.size("words"))).alias("rest"))
    cuts = _looked_up(cuts, counts.select("lang", F.col("part").alias("first"), F.col("a").alias("l")), ["lang", "first"], "l", total)
    cuts = _looked_up(cuts, counts.select("lang", F.col("part").alias("rest"), F.col("a").alias("r")), ["lang", "rest"], "r", total)
    exact = lambda c: F.col(c).cast(_COUNT)
    cuts = cuts.withColumn("up", exact("a") * exact("a") * F.lit(SCALE).cast("decimal(7,0)")).withColumn("down", exact("l") * exact("r"))
    scored = cuts.groupBy("lang", "words", "a").agg(F.min(F.struct(F.expr("up div down").alias("score"), "k", "l", "r")).alias("cut"))

    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.size("words") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.size("words") - m + 1), lambda i: F.slice("words", i, m))))
    inner = candidates.where(F.size("words") > 2).select("lang", F.col("a").alias("of"), F.explode(spans).alias("words")).groupBy("lang", "words").agg(F.max("of").alias("of"))
    kept = scored.join(inner, ["lang", "words"], "left").where(F.col("of").isNull() | (100 * F.col("of") < share_percent * F.col("a")))
    kept = kept.select("lang", text(F.col("words")).alias("phrase"), "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
