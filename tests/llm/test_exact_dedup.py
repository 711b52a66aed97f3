import hashlib
import re

from voxelframe.llm.exact_dedup import CuckooIndex, exact_dedup


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_cuckoo_index_grows_and_deletes():
    index = CuckooIndex(4)
    keys = [hashlib.sha256(str(k).encode()).digest() for k in range(20_000)]
    for k, d in enumerate(keys):
        index.insert(d, k)
    assert index.resizes > 3 and index.size == 20_000
    assert all(index.get(d) == k for k, d in enumerate(keys))
    assert all(index.delete(d) for d in keys[::2]) and not index.delete(keys[0])
    assert all((index.get(d) is None) == (k % 2 == 0) for k, d in enumerate(keys))
    index.insert(keys[0], "again")
    assert index.get(keys[0]) == "again" and len(dict(index.items())) == 10_001


def test_false_filter_hits_are_verified():
    a = bytes(range(8)) + b"a" * 24
    b = bytes(range(8)) + b"b" * 24  # the same fingerprint and buckets
    index = CuckooIndex(2)
    index.insert(a, 1)
    assert index.get(b) is None
    index.insert(b, 2)
    assert index.get(a) == 1 and index.get(b) == 2 and index.delete(a) and index.get(b) == 2


def test_against_brute_force(spark):
    texts = ["a b", "a  b", "a\t\nb", " a b", "", None, " ", "x" * 200_000, "x" * 200_000, "é", "e", "a b"]
    rows = [(100 - i, t, True) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept boolean").repartition(4)
    got = {r.doc_id: r for r in exact_dedup(df).collect()}
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(norm(t), []).append(i)
    for i, t, _ in rows:
        g = groups[norm(t)]
        assert (got[i].keep_id, got[i].group_size, got[i].kept, got[i].text_sha256) == (min(g), len(g), i == min(g), hashlib.sha256(norm(t).encode()).hexdigest())
    assert exact_dedup(df.limit(0)).count() == 0


def test_nulls_repeats_and_removal(spark):
    df = spark.createDataFrame([(5, "t"), (5, "t"), (None, "t"), (None, "u"), (None, "u"), (7, "v"), (8, "v"), (9, "w")], "doc_id long, text string")
    rows = exact_dedup(df).collect()
    kept = sorted(((r.doc_id, r.keep_id, r.group_size) for r in rows if r.kept), key=str)
    assert kept == sorted([(5, 5, 3), (None, None, 2), (7, 7, 2), (9, 9, 1)], key=str) and len(rows) == 8
    gone = spark.createDataFrame([(7,), (9,)], "doc_id long")
    rows = {r.doc_id: r for r in exact_dedup(df, removed=gone).collect() if r.doc_id in (7, 8, 9)}
    assert not rows[7].kept and rows[8].kept and rows[8].group_size == 1 and not rows[9].kept and rows[9].group_size == 0
