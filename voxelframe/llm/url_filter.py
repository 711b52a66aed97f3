"""URL filter: host and path rules, and boosted trees on lexical features for what no rule fits.

A rule is a host and a path prefix; it fits its host and all subdomains, and the
longest one that fits decides. Other URLs are judged by gradient-boosted
regression trees on the logistic loss, learnt from labelled URLs (by default
those that a rule decides). Features: lengths, depth, digit ratios, entropy of
characters, parameters, and statistics of the host's last one and last two
labels among the labelled URLs. A labelled URL's own fold is left out of the
statistics that it learns from.

The fit takes at most MAX_LABELLED different labelled URLs, those with the
least hash. Their features are cut at quantiles; each level of a tree is one
aggregation of gradients by node, feature and bin, in whole numbers, so sums
don't depend on order. Only those sums, of a bounded number, reach the driver.
The trees become one column expression. DataFrame functions only.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import Stage

RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
MAX_LABELLED = 20_000
TREES, DEPTH, RATE, RIDGE, LEAST_ROWS, BINS = 16, 3, 0.3, 1.0, 10, 16
#: Gradients are summed in steps of 1 / STEPS.
STEPS = 1 << 30
#: Statistics of a suffix start from so many URLs of the overall share.
PRIOR = 10.0
FOLDS = 2
LEXICAL = (
    "url_length", "host_length", "path_length", "depth", "labels", "longest_label", "digit_ratio", "host_digits", "hyphens", "host_entropy", "path_entropy",
    "parameters", "query_length", "fragment", "secure", "escapes",
)
SUFFIXES = ("suffix_1", "suffix_2")
FEATURES = (*LEXICAL, *(f"{s}_{k}" for s in SUFFIXES for k in ("rate", "seen")))


def parts(url: Column) -> tuple[Column, Column, Column]:
    """(host with A-Z lower-cased, path, query) of a URL; all empty for null and without ://."""
    whole = F.coalesce(url.cast("string"), F.lit(""))
    part = lambda k: F.regexp_extract(whole, r"(?s)^.*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?", k)
    return F.translate(part(1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), part(2), part(3)


def ruled(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, the first of several as long; nulls where none fits."""
    found = []
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(slash + rest))
        found.append((fits, rule, verdict))
    pick = lambda k: F.coalesce(*[F.when(f[0], F.lit(f[k])) for f in found], F.lit(None).cast("string"))
    return pick(1), pick(2)


def _entropy(text: Column) -> Column:
    """Bits a character, by the runs of the sorted characters."""
    ordered = F.array_join(F.array_sort(F.split(text, "")), "")
    runs = F.regexp_extract_all(ordered, F.lit(r"(?s)(.)\1*"), F.lit(0))
    n = F.length(text).cast("double")
    weighted = F.aggregate(runs, F.lit(0.0), lambda acc, r: acc + F.length(r) * F.log2(F.length(r)))
    return F.when(n > 0, F.log2(n) - weighted / n).otherwise(0.0)


def _count(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def with_lexical(urls: DataFrame) -> DataFrame:
    """urls(url, ...) with host, path, the LEXICAL features as doubles, and the two suffixes of the host."""
    host, path, query = parts(F.col("url"))
    rows = urls.withColumns({"url": F.coalesce(F.col("url").cast("string"), F.lit("")), "host": host, "path": path, "query": query})
    url, host, path, query = (F.col(c) for c in ("url", "host", "path", "query"))
    ratio = lambda text: F.when(F.length(text) > 0, _count(text, "[0-9]") / F.length(text)).otherwise(0.0)
    values = (
        F.length(url), F.length(host), F.length(path), _count(path, "/"), F.when(host != "", _count(host, r"\.") + 1).otherwise(0),
        F.array_max(F.transform(F.split(host, r"\."), F.length)), ratio(url), ratio(host), _count(host, "-"), _entropy(host), _entropy(path),
        F.when(query != "", _count(query, "&") + 1).otherwise(0), F.length(query), F.contains(url, F.lit("#")).cast("int"), F.startswith(url, F.lit("https:")).cast("int"), _count(url, "%"),
    )
    names = {name: F.round(v.cast("double"), 6) for name, v in zip(LEXICAL, values, strict=True)}
    return rows.withColumns(names | {s: F.substring_index(host, ".", -k - 1) for k, s in enumerate(SUFFIXES)}).drop("query")


def suffix_statistics(sample: DataFrame, overall: float) -> DataFrame:
    """(suffix, without, rate, seen) from sample(y, fold, suffixes): the share of y = 1, drawn to the overall one, and the log count of each suffix.

    Once without each fold, and once with all of them (without = -1). It has at
    most 2 * (FOLDS + 1) rows for each row of the sample.
    """
    suffix = sample.select("y", "fold", F.explode(F.array_distinct(F.array(*SUFFIXES))).alias("suffix"))
    every = [-1, *range(FOLDS)]
    sums = suffix.groupBy("suffix").agg(*[agg.alias(f"{name}{k}") for k in every for name, agg in (("n", F.sum((F.col("fold") != k).cast("long"))), ("b", F.sum(F.when(F.col("fold") != k, F.col("y")).otherwise(0))))])
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("without"), F.col(f"n{k}").alias("n"), F.col(f"b{k}").alias("b")) for k in every]))
    rate = F.round((F.col("s.b") + PRIOR * overall) / (F.col("s.n") + PRIOR), 6)
    return sums.select("suffix", each.alias("s")).select("suffix", "s.without", rate.alias("rate"), F.round(F.log1p(F.col("s.n").cast("double")), 6).alias("seen"))


def _with_statistics(rows: DataFrame, statistics: DataFrame, overall: float) -> DataFrame:
    """rows(without, suffixes) with the statistics of their suffixes; unseen ones have the overall share."""
    for s in SUFFIXES:
        found = statistics.select(F.col("suffix").alias(s), "without", F.col("rate").alias(f"{s}_rate"), F.col("seen").alias(f"{s}_seen"))
        rows = rows.join(F.broadcast(found), [s, "without"], "left")
    return rows.withColumns({f"{s}_{k}": F.coalesce(f"{s}_{k}", F.lit(v)) for s in SUFFIXES for k, v in (("rate", overall), ("seen", 0.0))})


@dataclass
class Split:
    """A node: rows with feature's bin up to bin go left."""

    feature: int
    bin: int
    left: Split | float
    right: Split | float


def _walk(node: Split | float, goes_left: Callable[[int, int], str]) -> str:
    """SQL of the leaf value of a row; goes_left(feature, bin) is the test of a node."""
    if not isinstance(node, Split):
        return f"{float(node)!r}D"
    return f"CASE WHEN {goes_left(node.feature, node.bin)} THEN {_walk(node.left, goes_left)} ELSE {_walk(node.right, goes_left)} END"


def _total(start: float, trees: list[Split], goes_left: Callable[[int, int], str]) -> Column:
    return F.expr(" + ".join([f"{start!r}D", *(_walk(t, goes_left) for t in trees)]))


@dataclass
class Boosted:
    """The start, the cuts of each feature, and the trees of a fitted model."""

    start: float
    cuts: list[list[float]]
    trees: list[Split]

    def chance(self, features: Sequence[str]) -> Column:
        """Probability of label 1 from feature columns."""
        total = _total(self.start, self.trees, lambda f, b: f"{features[f]} <= {self.cuts[f][b]!r}D")
        return F.round(1 / (1 + F.exp(-total)), 9)


def _best(bins: list[tuple[int, int, int, int, int]], totals: tuple[int, int, int]) -> tuple | None:
    """(gain, feature, bin, left sums) of the best split of a node; the lowest feature and bin of several as good."""
    gain = lambda g, h: (g / STEPS) ** 2 / (h / STEPS + RIDGE)
    best, at, left = None, None, (0, 0, 0)
    for feature, bin_, *sums in sorted(bins):
        left = tuple(a + b for a, b in zip(left if feature == at else (0, 0, 0), sums, strict=True))
        at = feature
        right = tuple(a - b for a, b in zip(totals, left, strict=True))
        if min(left[2], right[2]) >= LEAST_ROWS:
            more = round(gain(*left[:2]) + gain(*right[:2]) - gain(*totals[:2]), 9)
            if more > 0 and (best is None or more > best[0]):
                best = (more, feature, bin_, left)
    return best


def fit_boosted(rows: DataFrame, features: Sequence[str], stage: Stage, trees: int = TREES, depth: int = DEPTH) -> Boosted:
    """Boosted trees from rows(y 0 or 1, *features), a bounded sample that one task can hold.

    Without rows the chance is a half; with one class there is no tree.
    """
    counts = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0)), *[F.percentile(f, F.array(*[F.lit(k / BINS) for k in range(1, BINS)])) for f in features]).first()
    n, ones = counts[0], counts[1]
    model = Boosted(round(math.log((ones + 0.5) / (n - ones + 0.5)), 9), [sorted(set(c or [])) for c in counts[2:]], [])
    if not 0 < ones < n:
        return model
    number = lambda f, cuts: F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c < F.col(f)))
    binned = stage.put(rows.select("y", F.array(*[number(f, c) for f, c in zip(features, model.cuts, strict=True)]).alias("b")).coalesce(1), "binned").coalesce(1)
    goes_left = lambda f, b: f"b[{f}] <= {b}"
    for _ in range(trees):
        p = 1 / (1 + F.exp(-_total(model.start, model.trees, goes_left)))
        whole = lambda c: F.round(c * STEPS).cast("long")
        moved = binned.select("b", p.alias("p"), "y").select("b", whole(F.col("y") - F.col("p")).alias("g"), whole(F.col("p") * (1 - F.col("p"))).alias("h"))
        value = lambda g, h: round(RATE * (g / STEPS) / (h / STEPS + RIDGE), 12)
        root: list[Split | float] = [0.0]  # in a list, so that a leaf is replaced by (its holder, its key)
        open_: dict[int, tuple] = {0: (root, 0)}
        path = "0"
        for _ in range(depth):
            sums = moved.select(F.expr(path).alias("node"), "g", "h", F.posexplode("b").alias("feature", "bin")).where("node is not null").groupBy("node", "feature", "bin").agg(F.sum("g"), F.sum("h"), F.count("*")).collect()
            nodes: dict[int, list] = {}
            for node, *bin_ in sums:
                nodes.setdefault(node, []).append(tuple(bin_))
            after, below = {}, []
            for node, bins in sorted(nodes.items()):
                totals = tuple(sum(b[k] for b in bins if b[0] == 0) for k in (2, 3, 4))
                holder, key = open_[node]
                best = _best(bins, totals)
                split = best and Split(best[1], best[2], value(*best[3][:2]), value(*(a - b for a, b in zip(totals[:2], best[3][:2], strict=True))))
                if isinstance(holder, Split):
                    setattr(holder, key, split or getattr(holder, key))
                else:
                    holder[key] = split or value(*totals[:2])
                if split:
                    after |= {2 * node: (split, "left"), 2 * node + 1: (split, "right")}
                    below.append(f"WHEN {node} THEN {2 * node} + int(NOT {goes_left(split.feature, split.bin)})")
            if not after:
                break
            open_, path = after, f"CASE {path} {' '.join(below)} END"
        if not isinstance(root[0], Split):
            break
        model.trees.append(root[0])
    return model


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, labelled: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for every row of pages.

    labelled(url, y): y is 1 for URLs to block; without it, the URLs of pages
    that a rule decides. Rows of it without url or label are left out; repeated
    ones count once. rule is null where none fits; there the verdict is block if
    the score, the trees' chance that the URL is to be blocked, is over a half.
    Null and empty URLs, and those without ://, have an empty host and path and
    are judged like others. Repeated rows are judged each; other columns of
    pages are ignored.
    """
    stage = Stage(pages.sparkSession, "urls")
    urls = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    host, path, _ = parts(F.col("url"))
    if labelled is None:
        decided = urls.select("url", host.alias("host"), path.alias("path"))
        labelled = decided.select("url", (ruled(F.col("host"), F.col("path"), rules)[1] == "block").cast("int").alias("y"))
    sample = labelled.select(F.col("url").cast("string").alias("url"), F.col("y").cast("int").alias("y")).where("url is not null and y in (0, 1)").distinct()
    sample = sample.orderBy(F.xxhash64("url"), "url", "y").limit(max_labelled).withColumn("fold", F.pmod(F.xxhash64("url", F.lit(1)), F.lit(FOLDS)).cast("int"))
    sample = stage.put(with_lexical(sample), "sample")
    overall = round(sample.agg(F.coalesce(F.avg("y"), F.lit(0.5))).first()[0], 6)
    statistics = stage.put(suffix_statistics(sample, overall), "statistics")
    model = fit_boosted(_with_statistics(sample.withColumnRenamed("fold", "without"), statistics, overall), FEATURES, stage)
    rows = _with_statistics(with_lexical(urls.withColumn("without", F.lit(-1))), statistics.where("without = -1"), overall)
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), model.chance(FEATURES).alias("score"))
    return rows.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("score") > 0.5, "block").otherwise("allow")).alias("verdict"), "score")
