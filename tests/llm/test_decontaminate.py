import hashlib
import random
import re

from voxelframe.llm.decontaminate import Patterns, decontaminate

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall((t or "").encode().lower())


def brute(text, items):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        if item is None or t is None:
            continue
        p = words(t)
        n = min(len(p), 10)
        windows = {tuple(p[i : i + n]) for i in range(max(1, len(p) - 9))} if p else set()
        for i in range(len(w) - n + 1) if n else ():
            if tuple(w[i : i + n]) in windows:
                hit.update(range(i, i + n))
                found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def check(spark, docs, items, **kw):
    d = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, spans int").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate(d, b, **kw).collect()}
    assert got == {i: brute(t, items) for i, t in docs}


def test_against_brute_force(spark):
    rng = random.Random(1)
    vocab = [f"w{k}" for k in range(12)] + ["É", "ñandú", "x1"]
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choices(vocab, k=n))
    items = [(k, text(rng.choice([1, 2, 3, 5, 9, 10, 11, 30]))) for k in range(40)]
    items += [(7, items[3][1]), (None, "w1 w2"), (99, None), (98, ""), (97, "..."), (96, "only here once and never again in any of these texts at all")]
    docs = [(k, text(rng.choice([0, 1, 5, 50, 400]))) for k in range(60)]
    docs += [(100, None), (101, ""), (102, "--- !!"), (103, "W1-W2_w3"), (104, "so ONLY here, once and never again in any of these texts. At all!"), (105, "w1 " * 60_000)]
    docs += [(106, "a" + items[8][1]), (107, items[8][1] + "a")]
    check(spark, docs, items)
    check(spark, docs, items, block_bytes=200)  # many blocks


def test_windows_do_not_cross_texts(spark):
    line = " ".join(f"k{i}" for i in range(10))
    half = line.split(" ")
    check(spark, [(1, " ".join(half[:5])), (2, " ".join(half[5:])), (3, line)], [(1, line)])


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate(d, b).first().n_hit == 0
    assert decontaminate(d.limit(0), b).count() == 0
    assert Patterns([]).groups == []


def test_blocks_keep_hits_and_no_text(spark, monkeypatch):
    """With many blocks only hits are written; equal and repeated rows, null ids and texts keep their own rows."""
    from voxelframe.llm import decontaminate as module

    written = []
    put = module.Stage.put
    monkeypatch.setattr(module.Stage, "put", lambda self, df, name: written.append(df.columns) or put(self, df, name))
    items = [(k, f"a{k} b{k} c{k}") for k in range(30)]
    texts = [(1, "x a1 b1 c1 y a2 b2 c2"), (1, "x a1 b1 c1 y a2 b2 c2"), (1, "a3 b3 c3"), (None, "a1 b1 c1 a1 b1 c1"), (None, None), (2, "nothing")]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    rows = lambda **kw: sorted((str(tuple(r[c] for c in ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items"))) + str(sorted(zip(r.spans[::2], r.spans[1::2], strict=True))) for r in decontaminate(df, spark.createDataFrame(items, "item_id long, text string"), **kw).collect()))
    one = rows()
    assert not written and len(one) == 6
    assert rows(block_bytes=30) == one
    assert len(written) > 5 and all(set(c) == {"doc_id", "digest", "spans", "items"} for c in written)
