"""Quality scores from a Bradley-Terry ranking of labelled documents.

Every text has a vector of surface features (character classes, word shapes,
repetition). Preference pairs set a label-1 document over a label-0 one; the
weights minimise the logistic loss of the pairs' feature differences (Newton
steps with a ridge). The cut is the quantile of the training scores with the
fewest labels wrong; the score is the logistic function of the distance to
it. The fit uses at most MAX_LABELLED labelled rows (those with the least hash
of their doc_id) and MAX_PAIRS pairs; scoring covers every whole text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import BLANK_SPLIT, slices, text_buffer, word_hashes

MAX_LABELLED, MAX_PAIRS, RIDGE = 20_000, 200_000, 1e-3
FEATURES = (
    "lower", "upper", "digit", "blank", "newline", "stop", "exclaim", "symbol", "bar", "beyond",
    "log_words", "word_bytes", "long_words", "short_words", "distinct", "top_word", "shouted", "marked_words", "words_per_line", "repeated_pairs",
)
_CLASSES = [np.zeros(256, np.int64) for _ in range(10)]
for _k, _bytes in enumerate((range(97, 123), range(65, 91), range(48, 58), (32, 9), (10, 13), b".,;:?", b"!", b"#$%&*@^~<>{}[]\\/=+_", b"|", range(128, 256))):
    _CLASSES[_k][list(_bytes)] = 1
_CODE = np.full(256, 10, np.uint8)
for _k, _c in enumerate(_CLASSES):
    _CODE[_c == 1] = _k


def features(column: pa.Array) -> np.ndarray:
    """(rows, features); null, empty and wordless texts have defined values."""
    raw, offsets = text_buffer(column)
    out = np.zeros((len(offsets) - 1, len(FEATURES)))
    for i, j in slices(offsets):
        h, first, starts, ends = word_hashes(raw, offsets[i : j + 1], BLANK_SPLIT)
        code = _CODE[raw[offsets[i] : offsets[j]]]
        size = ends - starts
        plain_upper = np.zeros(len(h), bool)
        marked = np.zeros(len(h), bool)
        if len(h):
            base = offsets[i]
            total = np.zeros((3, len(code) + 1), np.int32)
            for k, which in enumerate((1, 0, 7)):
                np.cumsum(code == which, out=total[k, 1:])
            part = total[:, ends - base] - total[:, starts - base]
            plain_upper = (part[0] >= 2) & (part[1] == 0)
            marked = part[2] > 0
        for d in range(j - i):
            a, b = int(first[d]), int(first[d + 1])
            lo, hi = int(offsets[i + d] - offsets[i]), int(offsets[i + d + 1] - offsets[i])
            n, nb = b - a, hi - lo
            row = out[i + d]
            if nb:
                row[:10] = np.bincount(code[lo:hi], minlength=11)[:10] / nb
            row[10] = np.log1p(n)
            if n:
                s, w = size[a:b], h[a:b]
                _, counts = np.unique(w, return_counts=True)
                lines = row[4] * nb + 1
                row[11:20] = (
                    s.mean(), (s > 12).mean(), (s < 3).mean(), len(counts) / n, counts.max() / n, plain_upper[a:b].mean(), marked[a:b].mean(), np.log1p(n / lines),
                    1 - len(np.unique(w[1:] * np.uint64(3) + w[:-1])) / (n - 1) if n > 1 else 0.0,
                )
    return out


def _expand(x: np.ndarray) -> np.ndarray:
    """Features and their square roots, which spread the shares near zero."""
    return np.concatenate([x, np.sqrt(np.abs(x))], axis=1)


class Model:
    """Weights, scaling and cut of a fitted ranking."""

    def __init__(self, x: np.ndarray, y: np.ndarray, max_pairs: int = MAX_PAIRS):
        x = _expand(x)
        self.mean, self.scale = (x.mean(axis=0), x.std(axis=0) + 1e-6) if len(x) else (np.zeros(2 * len(FEATURES)), np.ones(2 * len(FEATURES)))
        self.weights, self.cut = np.zeros(x.shape[1]), 0.0
        good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        if not len(good) or not len(bad):  # nothing to rank: the share of label 1 decides
            self.cut = -1.0 if len(good) or not len(bad) else 1.0
            return
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        rng = np.random.default_rng(20)
        n = min(max_pairs, 20 * len(x))
        d = z[rng.choice(good, n)] - z[rng.choice(bad, n)]
        w = self.weights
        for _ in range(12):
            p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
            g = d.T @ p / n - RIDGE * w
            hess = (d * (p * (1 - p))[:, None]).T @ d / n + RIDGE * np.eye(len(w))
            step = np.linalg.solve(hess, g)
            w = w + step
            if np.abs(step).max() < 1e-6:
                break
        self.weights = w
        s = z @ w
        cuts = np.quantile(s, np.linspace(0.0005, 0.9995, 1999))
        wrong = np.searchsorted(np.sort(s[good]), cuts) + len(bad) - np.searchsorted(np.sort(s[bad]), cuts)
        best = np.flatnonzero(wrong == wrong.min())
        self.cut = float(cuts[best[len(best) // 2]])

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((_expand(x) - self.mean) / self.scale, -8, 8)
        return 1 / (1 + np.exp(np.clip(self.cut - z @ self.weights, -30, 30)))


def held_out():
    """True where crc32(doc_id as text) mod 3 is 1: such rows teach nothing."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", max_labelled: int = MAX_LABELLED) -> Model:
    """A model from the labelled documents that are not held out.

    Labels other than 0 and 1, and rows without doc_id, are left out; a
    document counts once for each different label; of rows that repeat a
    doc_id, the one with the least features counts.
    """
    chosen = labels.select("doc_id", "quality").where("quality in (0, 1) and doc_id is not null").where(~held_out())
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_labelled)
    rows = docs.select("doc_id", F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("text", F.col("quality").cast("int").alias("y"), "doc_id")
    kind = dict(rows.dtypes)["doc_id"]

    def vectors(batches):
        for batch in batches:
            x = features(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column(1), batch.column(2)], ["x", "y", "doc_id"])

    found = rows.mapInArrow(vectors, f"x array<double>, y int, doc_id {kind}").groupBy("doc_id", "y").agg(F.min("x").alias("x")).select("x", "y").toArrow()
    x = np.array(found.column(0).to_pylist(), float).reshape(-1, len(FEATURES))
    y = found.column(1).to_numpy().astype(int)
    order = np.lexsort((*x.T, y))  # whatever order the rows arrive in
    return Model(x[order], y[order])


def score_quality(docs: DataFrame, labels: DataFrame, text_col: str = "text", model: Model | None = None) -> DataFrame:
    """Every column of docs, then held_out, score and predicted, for every row.

    Null and empty texts are scored as texts without characters. Without
    usable labels of both kinds every score is the same. Columns of docs named
    like the three results are replaced.
    """
    model = model or fit(docs, labels, text_col)

    def scored(batches):
        at = None
        for batch in batches:
            at = batch.schema.get_field_index(name) if at is None else at
            s = model.score(features(batch.column(at)))
            keep = [k for k in range(batch.num_columns) if own or k != at]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(s, pa.float64())], [*(batch.schema.names[k] for k in keep), "score"])

    rows = docs.drop("held_out", "score", "predicted")
    own = dict(rows.dtypes).get(text_col) == "string"  # else the text is not among the columns, or no string
    name = text_col if own else "__text"
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    out = (rows if own else docs.drop("held_out", "score", "predicted").withColumn("__text", docs[text_col].cast("string"))).mapInArrow(scored, f"{schema}, score double")
    names = rows.columns
    return out.select(*names, held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
