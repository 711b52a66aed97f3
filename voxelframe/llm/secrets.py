"""Secret scan with a battery of randomness tests, with DataFrame functions only.

Base spans come from three patterns. The method adds spans: runs of 20 and
more key characters whose inferred encoding (decimal, hex, base32,
alphanumeric, base64) passes for uniformly random and is told from natural
text. Randomness: the chi-squared statistic of the alphabet (standardised by its
exact mean and variance at that length), the runs test about the middle of the
alphabet, and the serial correlation at lag one give
T = max(z_chi, 0)^2 + z_runs^2 + z_serial^2, which must not be over T_MOST.

False discoveries: the null hypothesis is natural text written in that encoding
(letters as words, with capitals and separators, or as their character codes).
Its letter frequencies give the exact mean and variance of the sum of squared
character counts at the run's own length, and so a one-sided p-value that a
natural run repeats its characters so seldom; short runs cannot have a small
one. The Benjamini-Hochberg procedure at FDR is applied apart in each encoding
and length class, over all runs of all documents. Runs of letters of one case
are natural words and are never added.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import marked, plain, with_apart, with_found
from .store import Stage

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
RUN = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "random")
#: The 0.999 point of chi-squared with 3 degrees of freedom.
T_MOST = 16.266
#: z-values of the natural null are counted in steps of 1 / STEPS, up to LEVELS steps.
STEPS, LEVELS = 20, 400
#: Percent of each letter a to z in English text.
LETTERS = (8.17, 1.49, 2.78, 4.25, 12.70, 2.23, 2.02, 6.09, 6.97, 0.15, 0.77, 4.03, 2.41, 6.75, 7.51, 1.93, 0.10, 5.99, 6.33, 9.06, 2.76, 0.98, 2.36, 0.15, 1.97, 0.07)
#: In natural runs of both cases, the share of capitals and that of separators.
CAPITALS, SEPARATORS = 1 / 6, 1 / 7
FDR = 0.05
_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Name, pattern of the whole run, alphabet in code order.
ENCODINGS = (
    ("decimal", r"^[0-9]+$", _DIGITS),
    ("hex", r"^[0-9a-f]+$", _DIGITS + "abcdef"),
    ("hex_upper", r"^[0-9A-F]+$", _DIGITS + "ABCDEF"),
    ("base32", r"^[A-Z2-7]+$", _UPPER + "234567"),
    ("alnum_lower", r"^[a-z0-9]+$", _DIGITS + _LOWER),
    ("alnum", r"^[A-Za-z0-9]+$", _DIGITS + _UPPER + _LOWER),
    ("base64", r"^.+$", _UPPER + _LOWER + _DIGITS + "+/-_="),
)


def natural(encoding: str) -> list[float]:
    """Shares of the characters of natural text written in an encoding, in any order."""
    p = [x / sum(LETTERS) for x in LETTERS]
    if encoding in ("alnum_lower", "base32"):
        return p
    cased = [x * share for x in p for share in (1 - CAPITALS, CAPITALS)]
    if encoding == "alnum":
        return cased
    if encoding == "base64":
        return [x * (1 - SEPARATORS) for x in cased] + [SEPARATORS / 3] * 3
    form = "{:d}" if encoding == "decimal" else "{:x}"  # character codes
    shares: dict[str, float] = {}
    for k, x in enumerate(p):
        for c in form.format(ord("a") + k):
            shares[c] = shares.get(c, 0.0) + x
    return [x / sum(shares.values()) for x in shares.values()]


def natural_moments(encoding: str) -> tuple[float, float]:
    """Sums of the squared and of the cubed shares."""
    p = natural(encoding)
    return sum(x**2 for x in p), sum(x**3 for x in p)


def _tested(runs: Column) -> Column:
    """(start, end, tests: (encoding, length class, word, T, level)) of each run.

    Built in steps whose results are fields, since whatever a lambda over
    characters names is worked out anew for each character.
    """
    encoding = lambda s: F.coalesce(*[F.when(s["match"].rlike(p), F.lit(k)) for k, (_, p, _) in enumerate(ENCODINGS)])
    alphabets = F.array(*[F.lit(a) for *_, a in ENCODINGS])
    second, third = (F.array(*[F.lit(natural_moments(e)[k]) for e, *_ in ENCODINGS]) for k in range(2))
    out = F.transform(runs, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["match"].alias("match"), encoding(s).alias("encoding")))
    out = F.transform(out, lambda s: _with(s, ["start", "end", "match", "encoding"], alphabet=F.get(alphabets, s["encoding"])))
    out = F.transform(
        out,
        lambda s: _with(
            s,
            ["start", "end", "match", "encoding"],
            n=F.length(s["match"]).cast("double"),
            size=F.length(s["alphabet"]).cast("double"),
            half=F.floor(F.length(s["alphabet"]) / 2).cast("double"),
            second=F.get(second, s["encoding"]),
            third=F.get(third, s["encoding"]),
            codes=F.transform(F.split(s["match"], ""), lambda c: F.position(c, s["alphabet"]).cast("double")),
        ),
    )
    pairs = lambda s, f: F.aggregate(F.zip_with(F.slice(s["codes"], F.lit(1), F.size(s["codes"]) - 1), F.slice(s["codes"], F.lit(2), F.size(s["codes"]) - 1), f), F.lit(0.0), lambda acc, x: acc + x)
    out = F.transform(
        out,
        lambda s: _with(
            s,
            ["start", "end", "match", "encoding", "n", "size", "half", "second", "third"],
            squares=F.aggregate(F.array_distinct(s["codes"]), F.lit(0.0), lambda acc, c: acc + F.pow(F.size(F.filter(s["codes"], lambda x: x == c)).cast("double"), F.lit(2.0))),
            changes=pairs(s, lambda x, y: F.when((x <= s["half"]) != (y <= s["half"]), 1.0).otherwise(0.0)),
            serial=pairs(s, lambda x, y: (x - (s["size"] + 1) / 2) * (y - (s["size"] + 1) / 2)),
        ),
    )

    def tests(s):
        n, size = s["n"], s["size"]
        z_chi = F.greatest((s["squares"] * size / n - n - (size - 1)) / F.sqrt(2 * (size - 1) * (n - 1) / n), F.lit(0.0))
        change = 2 * s["half"] / size * (1 - s["half"] / size)
        z_runs = (s["changes"] - (n - 1) * change) / F.sqrt((n - 1) * change * (1 - change))
        z_serial = s["serial"] / ((size * size - 1) / 12 * F.sqrt(n - 1))
        t = z_chi * z_chi + z_runs * z_runs + z_serial * z_serial
        word = s["match"].rlike("^([A-Z]?[a-z]+|[A-Z]+)$")
        s2, s3 = s["second"], s["third"]
        spread = 4 * n * (n - 1) * (n - 2) * (s3 - s2 * s2) + 2 * n * (n - 1) * (s2 - s2 * s2)
        z = (n + n * (n - 1) * s2 - s["squares"]) / F.sqrt(spread)
        level = F.greatest(F.least(F.floor(z * STEPS), F.lit(LEVELS)), F.lit(0)).cast("int")
        return F.struct(s["encoding"].alias("encoding"), F.floor(F.log2(n / 10) * 2).cast("int").alias("size_class"), word.alias("word"), t.alias("t"), level.alias("level"))

    return F.transform(out, lambda s: _with(s, ["start", "end"], tests=tests(s)))


def _with(s: Column, kept: list[str], **more: Column) -> Column:
    return F.struct(*[s[k].alias(k) for k in kept], *[c.alias(k) for k, c in more.items()])


def _cuts(scanned: DataFrame) -> dict[tuple[int, int], int]:
    """The least level of each (encoding, length class) that is a discovery.

    Benjamini-Hochberg over all tested runs of the class, with the p-value at
    the lower end of each level. A bounded number of counts reaches the driver.
    """
    runs = scanned.select(F.explode("runs").alias("r")).where("not r.tests.word")
    counts = runs.groupBy("r.tests.encoding", "r.tests.size_class", F.when(F.col("r.tests.t") <= T_MOST, F.col("r.tests.level")).otherwise(-1).alias("level")).count().collect()
    classes: dict[tuple[int, int], dict[int, int]] = {}
    for r in counts:
        classes.setdefault((r["encoding"], r["size_class"]), {})[r["level"]] = r["count"]
    cuts, tail = {}, NormalDist()
    for key, levels in classes.items():
        tested, discovered = sum(levels.values()), 0
        for level in sorted((x for x in levels if x >= 0), reverse=True):
            discovered += levels[level]
            if tail.cdf(-level / STEPS) * tested <= FDR * discovered:
                cuts[key] = level
    return cuts


def scan_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random) for every row of docs.

    spans: kind:start:end in code points, end exclusive, by start and then
    kind, comma-joined. A null text counts as empty. An added span overlaps no
    base span. Other columns are ignored; repeated rows are scanned each.
    """
    stage = Stage(docs.sparkSession, "secrets")
    rows = docs.select("doc_id", plain(F.col(text_col)).alias("text"))
    rows = rows.select("doc_id", *[marked(F.col("text"), p).alias(k) for k, p in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("run", RUN))])
    for kind in ("assign", "access", "hex", "run"):
        rows = with_found(rows, kind)
    assign = F.filter("assign", lambda s: F.length(F.regexp_extract(s["match"], ASSIGN, 2)) >= 6)
    access = F.filter("access", lambda s: F.length(s["match"]) >= 20)
    keep = lambda c: F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    scanned = stage.put(rows.select("doc_id", keep(assign).alias("assign"), keep(access).alias("access"), keep(F.col("hex")).alias("hex"), _tested(F.col("run")).alias("runs")), "scanned")
    cuts = _cuts(scanned)
    table = F.create_map(*[F.lit(x) for (e, c), cut in sorted(cuts.items()) for x in (e * 1000 + c, cut)]) if cuts else None
    of_kind = lambda i: lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("kind"), s["end"].alias("end"))
    base = F.concat(*[F.transform(k, of_kind(i)) for i, k in enumerate(KINDS[:3])])
    scanned = scanned.withColumn("base", F.array_sort(base))
    if table is None:
        more = F.array().cast("array<struct<start:long,kind:int,end:long>>")
    else:
        random = lambda s: (~s["tests"]["word"]) & (s["tests"]["t"] <= T_MOST) & F.coalesce(s["tests"]["level"] >= F.try_element_at(table, s["tests"]["encoding"] * 1000 + s["tests"]["size_class"]), F.lit(False))
        scanned = with_apart(scanned.withColumn("random", F.filter("runs", random)), "random", "base", "random")
        more = F.transform("random", lambda s: F.struct(s["start"].alias("start"), F.lit(3).alias("kind"), s["end"].alias("end")))
    names = F.array(*[F.lit(k) for k in KINDS])
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    return scanned.withColumn("more", more).select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(text(F.col("base")), 256).alias("base_sha256"),
        text(F.array_sort(F.concat("base", "more"))).alias("spans"),
        F.size("more").cast("long").alias("n_random"),
    )
