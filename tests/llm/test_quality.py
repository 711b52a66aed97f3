import zlib

import numpy as np
import pyarrow as pa

from voxelframe.llm import quality as Q


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    truth = {r.doc_id: r.quality for r in labels.collect()}
    rows = Q.score_quality(docs.select("doc_id", "text"), labels).drop("text").collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    good, bad = ([r.predicted for r in held if truth[r.doc_id] == k] for k in (1, 0))
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.05


def test_edges(spark):
    rows = [(1, None, "a", 0.0), (2, "", "b", 1.0), (3, "word " * 100_000, "c", 2.0), (None, "plain words here", "d", 3.0), (1, None, "a", 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    labels = spark.createDataFrame([(1, 0), (3, 1), (3, None), (None, 1), (2, 7)], "doc_id long, quality int")
    out = Q.score_quality(df, labels)
    assert out.columns == ["doc_id", "text", "lang", "held_out", "score", "predicted"] and out.count() == 5
    none = Q.score_quality(df, labels.limit(0)).collect()
    assert len({r.score for r in none}) == 1
    assert Q.score_quality(df.limit(0), labels).count() == 0


def test_held_out_labels_teach_nothing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    from pyspark.sql import functions as F

    flipped = labels.withColumn("quality", F.when(Q.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = Q.fit(docs, labels), Q.fit(docs, flipped)
    assert np.array_equal(a.weights, b.weights) and a.cut == b.cut


def test_features_do_not_depend_on_the_batch():
    texts = ["One two, three!", None, "", "ÄÖ ü\n| a | b |", "x" * 5000, "SHOUT!! NOW!!"]
    whole = Q.features(pa.array(texts))
    assert np.allclose(whole, np.concatenate([Q.features(pa.array([t], pa.string())) for t in texts])) and np.isfinite(whole).all()


def plain_features(text):
    """The features of one text, counted character by character and word by word."""
    raw = (text or "").encode()
    groups = (range(97, 123), range(65, 91), range(48, 58), (32, 9), (10, 13), b".,;:?", b"!", b"#$%&*@^~<>{}[]\\/=+_", b"|", range(128, 256))
    n = len(raw)
    out = [sum(c in set(g) for c in raw) / n if n else 0.0 for g in groups]
    words = [w.translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")) for w in raw.split()]
    real, k = raw.split(), len(words)
    out.append(np.log1p(k))
    if not k:
        return out + [0.0] * 9
    counts = {w: words.count(w) for w in words}
    shouted = sum(sum(65 <= c <= 90 for c in w) >= 2 and not any(97 <= c <= 122 for c in w) for w in real)
    marked = sum(any(c in b"#$%&*@^~<>{}[]\\/=+_" for c in w) for w in real)
    pairs = list(zip(words, words[1:], strict=False))
    out += [
        sum(map(len, words)) / k, sum(len(w) > 12 for w in words) / k, sum(len(w) < 3 for w in words) / k, len(counts) / k, max(counts.values()) / k, shouted / k, marked / k,
        np.log1p(k / (sum(c in (10, 13) for c in raw) + 1)), 1 - len(set(pairs)) / len(pairs) if pairs else 0.0,
    ]
    return out


def test_features_by_brute_force(spark):
    texts = ["One two, three!", None, "", "ÄÖ ü\n| a | b |", "SHOUT!! NOW!! now", "a a a b a a", "x\r\ny\tz"]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40).collect()]
    assert np.allclose(Q.features(pa.array(texts)), [plain_features(t) for t in texts])


def test_the_fit_minimises_the_pairs_loss():
    """Weights have no better neighbour under the plain Bradley-Terry loss, and the cut no better quantile."""
    rng = np.random.default_rng(3)
    x = rng.random((300, len(Q.FEATURES)))
    y = (x[:, 0] + 0.3 * rng.normal(size=300) > 0.5).astype(int)
    m = Q.Model(x, y)
    z = np.clip((np.concatenate([x, np.sqrt(x)], axis=1) - m.mean) / m.scale, -8, 8)
    draw = np.random.default_rng(20)
    n = min(Q.MAX_PAIRS, 20 * len(x))
    pairs = z[draw.choice(np.flatnonzero(y == 1), n)] - z[draw.choice(np.flatnonzero(y == 0), n)]
    loss = lambda w: np.log1p(np.exp(-(pairs @ w))).mean() + Q.RIDGE / 2 * (w @ w)
    best = loss(m.weights)
    assert all(loss(m.weights + step * d) > best for d in rng.normal(size=(40, z.shape[1])) for step in (-0.05, 0.05))
    s = z @ m.weights
    wrong = lambda cut: ((s < cut) & (y == 1)).sum() + ((s >= cut) & (y == 0)).sum()
    assert wrong(m.cut) <= min(wrong(c) for c in np.quantile(s, np.linspace(0.01, 0.99, 99)))
    assert np.allclose(m.score(x), 1 / (1 + np.exp(-np.clip(s - m.cut, -30, 30))))


def test_rows_that_repeat_a_doc_id(spark):
    """They teach once, whatever their number and order."""
    rows = [(k, "good words in a plain line " * 3 if k % 2 else "BAD!! ### $$$") for k in range(40)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    a, b = Q.fit(df, labels), Q.fit(df.union(df).union(df).repartition(5), labels.union(labels))
    assert np.array_equal(a.weights, b.weights) and a.cut == b.cut
