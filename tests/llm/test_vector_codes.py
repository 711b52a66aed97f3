import hashlib
import random
from fractions import Fraction
from math import floor, inf, nan

import duckdb
import numpy as np
import pytest
from support import same_rows

from voxelframe.llm import entry, sql, vector_codes
from voxelframe.llm.vector_codes import Codebook, compress_vectors, integers, total_by_label

SHAPE = "vec_id long, embedding array<double>, label int, code string"


def brute(rows, parts=16, entries=64, rounds=2):
    """The contract, with plain loops over Python integers."""
    kept = [(i, [floor(256 * Fraction(x)) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and x == x and abs(x) != inf for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    if not kept:
        return [], hashlib.sha256(b"").hexdigest()
    width = len(kept[0][1]) // parts
    cut = lambda v: [v[p * width : p * width + width] for p in range(parts)]
    books = [[cut(v)[p] for _, v, _ in kept[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for _, v, _ in kept:
                members.setdefault(near(cut(v)[p], books[p])[1], []).append(cut(v)[p])
            books[p] = [[sum(c) // len(members[k]) for c in zip(*members[k], strict=True)] if k in members else e for k, e in enumerate(books[p])]
    out = []
    for i, v, label in kept:
        found = [near(x, book) for x, book in zip(cut(v), books, strict=True)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), label))
    least = lambda x: min(x, 2**63 - 1)
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return [(i, code, least(e), least(sum(least(o[2]) for o in out if o[3] == label))) for i, code, e, label in out], digest


def check(spark, rows, **options):
    df = spark.createDataFrame([(*r, "clash") for r in rows], SHAPE)
    got = vector_codes.vector_codes(df, **options).collect()
    want, digest = brute(rows, **options)
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in got), key=key) == sorted(want, key=key)
    assert {r.codebooks_sha256 for r in got} <= {digest}


def test_query_matches_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{sf}/embeddings.parquet')")
    same_rows(entry.op12_vector_codes(spark, sf), con.execute(sql.VECTOR_CODES))


def test_random_vectors(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(32)], rng.choice([None, 1, 2])) for i in rng.sample(range(10**6), 300)]
    check(spark, rows)


def test_nulls_infinities_ties_and_repeated_rows(spark):
    v = [k / 256 for k in range(32)]
    rows = [(1, None, 1), (2, [*v[:-1], None], 1), (3, [*v[:-1], nan], 1), (4, [inf, *v[1:]], 1), (5, [-inf, *v[1:]], None), (7, v, None), (7, v, None), (7, v[::-1], 3), (None, v, 3), (6, [0.0] * 32, 3), (9, [-1 / 512] * 32, 3), (10, [1 / 512, -0.0] * 16, 4)]
    check(spark, rows)


def test_huge_components(spark):
    rng = random.Random(6)
    rows = [(i, [rng.choice([-1, 1]) * 10.0 ** rng.randint(-300, 300) if i % 3 == 0 else rng.gauss(0, 1e7) for _ in range(16)], i % 2) for i in range(40)]
    check(spark, rows, parts=4, entries=5)


def test_empty_tables_and_lengths(spark):
    df = spark.createDataFrame([], SHAPE)
    assert vector_codes.vector_codes(df).count() == 0
    assert vector_codes.vector_codes(spark.createDataFrame([(1, [], 1, ""), (2, None, 1, "")], SHAPE)).count() == 0
    mixed = spark.createDataFrame([(1, [1.0] * 16, 1, ""), (2, [2.0] * 16, 1, ""), (3, [3.0] * 32, 1, "")], SHAPE)
    assert [r.vec_id for r in vector_codes.vector_codes(mixed).orderBy("vec_id").collect()] == [1, 2]
    with pytest.raises(ValueError):
        vector_codes.vector_codes(mixed, parts=3)


def test_bitmasks_give_the_nearest_entry():
    rng = np.random.default_rng(1)
    for entries, spread in ((64, 40), (64, 3), (1, 5), (17, 1000)):
        book = Codebook(rng.integers(-spread, spread + 1, (entries, 4)))
        x = rng.integers(-2 * spread, 2 * spread, (500, 4))
        every = ((x[:, None] - book.entries[None]) ** 2).sum(axis=2)
        found, least = book.nearest(x)
        assert (found == every.argmin(axis=1)).all() and (least == every.min(axis=1)).all()
        within = (np.abs(x[:, None] - book.entries[None]) <= book.radius(x)[:, None, None]).all(axis=2)
        mask = book.candidates(x, book.radius(x))
        assert (((mask[:, None] >> np.arange(entries, dtype=np.uint64)) & np.uint64(1)).astype(bool) == within).all()


def test_integers_are_floors():
    assert integers(np.array([-0.001, 0.0, 1.999, -1e-320])).tolist() == [-1, 0, 511, -1]
    assert integers(np.array([1e300, -0.001])).tolist() == [int(1e300) * 256, -1]


def test_decoded_vectors_have_the_reported_error(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 8)).round(3)
    coded, books = compress_vectors(spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int"), parts=4, entries=16)
    rows = coded.orderBy("id").collect()
    near = books.decode(np.array([r.codes for r in rows]))
    assert (((np.floor(256 * x).astype(int) - near) ** 2).sum(axis=1) == [r.error for r in rows]).all()


def test_totals_of_many_labels_are_dealt(spark, monkeypatch):
    rows = [(i, None if i % 3 == 0 else i % 5, [i % 64], i) for i in range(300)]
    coded = spark.createDataFrame(rows, "id long, label int, codes array<int>, error long")
    want = sorted(map(tuple, total_by_label(coded).select("id", "label_error").collect()))
    monkeypatch.setattr(vector_codes, "BROADCAST_ROWS", 2)
    assert sorted(map(tuple, total_by_label(coded).select("id", "label_error").collect())) == want
    assert dict(want)[0] == sum(i for i in range(0, 300, 3))
