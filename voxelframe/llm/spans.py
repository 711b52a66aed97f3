"""Spans of regular-expression matches, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_OPEN, _CLOSE = "\x01", "\x02"
SPAN = "array<struct<start:long,end:long,match:string>>"
#: Values to a block, and levels of blocks, of running sums.
BLOCK, LEVELS = 64, 3


def plain(text: Column) -> Column:
    """text with the two marking characters exchanged for another one of equal length; null becomes empty."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), _OPEN + _CLOSE, "\x03\x03")


#: Of the characters that marks and escapes are made of, what each is written as.
_ESCAPES = (("\x03", "\x03\x06"), (_OPEN, "\x03\x04"), (_CLOSE, "\x03\x05"))


def escaped(text: Column) -> Column:
    """text without the marking characters, for unescaped() to undo; null becomes empty."""
    out = F.coalesce(text.cast("string"), F.lit(""))
    for plain_, code in _ESCAPES:
        out = F.replace(out, F.lit(plain_), F.lit(code))
    return out


def unescaped(text: Column) -> Column:
    """The text that escaped() was given."""
    for plain_, code in reversed(_ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain_))
    return text


def marked(text: Column, pattern: str) -> Column:
    """plain text with each leftmost non-overlapping match between marks."""
    return F.regexp_replace(text, pattern, f"{_OPEN}$0{_CLOSE}")


def pieces(marked_text: Column) -> Column:
    """Alternately the text between matches and a match; the first and last are text."""
    return F.split(marked_text, f"[{_OPEN}{_CLOSE}]", -1)


def with_before(rows: DataFrame, values: str, out: str, zero: Column, add: Callable[[Column, Column], Column]) -> DataFrame:
    """rows with the array out: for each place of the array values, zero and all values before it added up.

    Blocks of BLOCK values are added up, the sums before each block are found in
    the same way, and then those within the blocks: time grows with the number
    of values (up to BLOCK ** LEVELS times some thousands), not with its square.
    Each step is a column of its own, so it is worked out once.
    """
    total = lambda part: F.aggregate(part, zero, add)
    within = lambda part: F.when(F.size(part) > 0, F.transform(F.sequence(F.lit(0), F.size(part) - 1), lambda k: total(F.slice(part, F.lit(1), k)))).otherwise(part)
    blocks = lambda v: F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(v) - 1) / BLOCK).cast("int"), F.lit(0))), lambda b: F.slice(v, b * BLOCK + 1, F.lit(BLOCK)))
    at, parts = F.col(values), []
    for level in range(LEVELS):
        parts.append(f"__parts{level}")
        rows = rows.withColumn(parts[-1], blocks(at)).withColumn(f"__sums{level}", F.transform(parts[-1], total))
        at = F.col(f"__sums{level}")
    rows = rows.withColumn("__offsets", within(at))
    for part in reversed(parts):
        rows = rows.withColumn("__offsets", F.flatten(F.zip_with(part, "__offsets", lambda p, offset: F.transform(within(p), lambda x: add(offset, x)))))
    return rows.withColumn(out, F.col("__offsets")).drop("__offsets", *parts, *[f"__sums{k}" for k in range(LEVELS)])


def with_found(rows: DataFrame, name: str) -> DataFrame:
    """rows with the marked text of a column replaced by the array of (start, end, match) in code points, end exclusive.

    Time grows with the number of matches; a text without any is not walked.
    """
    none = F.array().cast("array<string>")
    rows = rows.withColumn("__texts", F.when(F.contains(name, F.lit(_OPEN)), pieces(F.col(name))).otherwise(none)).drop(name)
    rows = with_before(rows.withColumn("__lengths", F.transform("__texts", lambda p: F.length(p).cast("long"))), "__lengths", "__starts", F.lit(0).cast("long"), lambda a, b: a + b)
    one = lambda i: F.struct(F.get("__starts", i).alias("start"), (F.get("__starts", i) + F.get("__lengths", i)).alias("end"), F.get("__texts", i).alias("match"))
    spans = F.when(F.size("__texts") > 1, F.transform(F.sequence(F.lit(1), F.size("__texts") - 2, F.lit(2)), one)).otherwise(F.array().cast(SPAN))
    return rows.withColumn(name, spans).drop("__texts", "__lengths", "__starts")


def with_apart(rows: DataFrame, spans: str, others: str, out: str) -> DataFrame:
    """rows with the array out of the spans that overlap none of the others, both of (start, end), by start; in time that grows with their number times its logarithm."""
    bare = lambda k: lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("kind"), s["end"].alias("end"))
    least, most = F.lit(-1).cast("long"), F.lit(1 << 62).cast("long")
    rows = rows.withColumn("__both", F.array_sort(F.concat(F.transform(others, bare(0)), F.transform(spans, bare(1)))))
    rows = rows.withColumn("__ends", F.transform("__both", lambda s: F.when(s["kind"] == 0, s["end"]).otherwise(least)))
    rows = rows.withColumn("__begins", F.reverse(F.transform("__both", lambda s: F.when(s["kind"] == 0, s["start"]).otherwise(most))))
    rows = with_before(rows, "__ends", "__last", least, lambda a, b: F.greatest(a, b))
    rows = with_before(rows, "__begins", "__next", most, lambda a, b: F.least(a, b)).withColumn("__next", F.reverse("__next"))
    free = F.filter("__both", lambda s, i: (s["kind"] == 1) & (F.get("__last", i) <= s["start"]) & (F.get("__next", i) >= s["end"]))
    return rows.withColumn(out, F.transform(free, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))).drop("__both", "__ends", "__begins", "__last", "__next")
