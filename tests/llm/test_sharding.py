import zlib

from voxelframe.llm.sharding import shard


def check(rows, docs, n):
    assert sorted((r.doc_id for r in rows), key=str) == sorted((i for i, _ in docs), key=str)
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
        assert 0 <= r.shard < n and r.law == "bytes" and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    return {k: sum(r["size"] for r in rows if r.shard == k) for k in range(n)}


def test_sizes_and_slots(spark):
    docs = [(i, f"text {i} " * (1 + i % 40)) for i in range(6000)] + [(10_000 + i, "copy " * 30) for i in range(3000)]
    df = spark.createDataFrame([(i, t, 5) for i, t in docs], "doc_id long, text string, size int").repartition(5)
    rows = shard(df, 24).collect()
    sizes = check(rows, docs, 24)
    even = sum(sizes.values()) / 24
    assert all(0.95 * even < s < 1.05 * even for s in sizes.values()), sizes
    text = dict(docs)
    assert all(r["size"] == len(text[r.doc_id].encode()) + 8 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) for r in rows)


def test_small_groups_stay_together(spark):
    docs = [(i, f"group {i // 3} " * 20) for i in range(3000)]
    rows = shard(spark.createDataFrame(docs, "doc_id long, text string"), 8).collect()
    check(rows, docs, 8)
    where = {}
    for r in rows:
        where.setdefault(r.doc_id // 3, set()).add(r.shard)
    assert all(len(s) == 1 for s in where.values())


def test_edges(spark):
    docs = [(1, None), (1, None), (None, ""), (2, "é" * 50_000), (3, "a")]
    rows = shard(spark.createDataFrame(docs, "doc_id long, text string"), 24).collect()
    check(rows, docs, 24)
    assert {r["size"] for r in rows if r.doc_id == 1} == {8} and {r["size"] for r in rows if r.doc_id == 2} == {100_008}
    assert all(r.text_crc32 == 0 for r in rows if r.doc_id == 1)
    assert shard(spark.createDataFrame([], "doc_id long, text string"), 4).count() == 0


def test_shards_are_ranges_of_a_plain_sort(spark):
    """By brute force: ordered by text hash and doc_id, shard numbers never fall and slots count up from 0."""
    import xxhash

    docs = [(i, f"text {i % 700} " * (1 + i % 9)) for i in range(2500)] + [(9000 + i, "same text") for i in range(400)]
    rows = {r.doc_id: r for r in shard(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), 6).collect()}
    order = sorted(docs, key=lambda d: (xxhash.xxh64(d[1].encode(), seed=42).hexdigest(), d[0]))
    before, slot = 0, 0
    for i, _ in order:
        r = rows[i]
        assert r.shard >= before
        slot, before = (slot if r.shard == before else 0), r.shard
        assert r.slot == slot
        slot += 1
    sizes = {}
    for i, text in docs:
        sizes[rows[i].shard] = sizes.get(rows[i].shard, 0) + len(text) + 8
    assert len(sizes) == 6 and max(sizes.values()) < 1.1 * min(sizes.values())
