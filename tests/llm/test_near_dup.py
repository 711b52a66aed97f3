import random

import numpy as np
import pyarrow as pa
import pytest

from voxelframe.llm import near_dup, shingles
from voxelframe.llm.near_dup import near_duplicates


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(docs):
    """docs: list of (doc_id, text) -> {doc_id: (n, component)} for distinct ids."""
    sets = {i: shingle_set(t) for i, t in docs}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            inter = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * inter >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(sets[i]), root(i)) for i in ids}


def check(spark, docs):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, component_id string, sig int").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df).collect()}
    want = brute(docs)
    assert {i: v[:2] for i, v in got.items()} == want
    assert all(v[2] == (i == v[1]) for i, v in got.items())


def families(rng, n_families, size, words=60):
    vocab = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(3000)]
    out = []
    for f in range(n_families):
        base = rng.choices(vocab, k=words)
        for c in range(size):
            w = base.copy()
            for _ in range(rng.randint(0, 4) if c else 0):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            out.append(" ".join(w))
    return out


def test_families_and_edges(spark):
    rng = random.Random(7)
    texts = families(rng, 25, 8)
    passage = " ".join(f"p{k}" for k in range(55))
    texts += [passage + " " + t for t in families(rng, 30, 1, 120)]
    texts += [None, "", " \t\n", "one", "ONE", "one two three four", "One\ttwo  three\x0bfour", "one two three four five", "x " * 30_000, "x " * 20_000, "ÀÉ ñ b c d e", "àé ñ b c d e"]
    rng.shuffle(texts)
    check(spark, list(enumerate(texts)))


def test_one_large_family(spark, monkeypatch):
    """Star of copies and refined keys give the brute-force result."""
    monkeypatch.setattr(near_dup, "BLOCK", 20)
    monkeypatch.setattr(near_dup, "VERIFY", 16)
    monkeypatch.setattr(near_dup, "GROUPS", 7)
    rng = random.Random(8)
    check(spark, list(enumerate(families(rng, 2, 120, 50))))


def test_groups_over_three_blocks_after_refinement(spark, monkeypatch):
    """Texts that share whole signatures' parts in many components: refined groups are cut into parts, and no link is lost."""
    monkeypatch.setattr(near_dup, "BLOCK", 6)
    monkeypatch.setattr(near_dup, "GROUPS", 5)
    monkeypatch.setattr(near_dup, "VERIFY_SHINGLES", 400)
    rng = random.Random(9)
    passage = [f"p{k}" for k in range(60)]  # most shingles of every text: keys shared by all, similarity about the bound
    texts = [" ".join(passage + [f"t{c}x{k}" for k in range(rng.randint(3, 20))]) for c in range(40)]
    check(spark, list(enumerate(texts)))


def test_parts_meet_once(spark):
    """Every pair of a large group meets in one task, and small groups stay whole."""
    rows = [(1, 5, k, k, -1, 0, -1, b"") for k in range(20)] + [(2, 5, k, k, -1, 0, -1, b"") for k in range(4)]
    near_dup_block, near_dup.BLOCK = near_dup.BLOCK, 6
    try:
        df = spark.createDataFrame(rows, "key long, sub long, id long, component long, rank long, block long, part int, sig binary")
        dealt = near_dup._in_parts(df).collect()
    finally:
        near_dup.BLOCK = near_dup_block
    groups = {}
    for r in dealt:
        groups.setdefault((r.key, r.sub), []).append((r.id, r.part))
    for key, n in ((1, 20), (2, 4)):
        pairs = [frozenset((a, b)) for (k, _), g in groups.items() if k == key for i, (a, p) in enumerate(g) for b, q in g[i + 1 :] if a != b and (p == -1 or p != q)]
        assert sorted(map(sorted, pairs)) == sorted([a, b] for a in range(n) for b in range(a + 1, n))
    assert max(len(g) for (k, _), g in groups.items() if k == 1) < 20


def test_nulls_repeats_and_empty(spark):
    text = " ".join(map(str, range(30)))
    df = spark.createDataFrame([(1, text), (1, text), (2, text), (None, text), (None, None), (3, "a b")], "doc_id long, text string")
    rows = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df).collect()]
    assert sorted(rows, key=str) == sorted([(1, 26, 1, True), (1, 26, 1, True), (2, 26, 1, False), (None, 26, None, True), (None, 0, None, True), (3, 1, 3, True)], key=str)
    assert near_duplicates(df.limit(0)).count() == 0


def test_words_are_ascii_split():
    texts = ["A\u00a0b C\x0bd", "a\u00a0B c d", "a b c d"]
    sets = [list(s) for s in shingles.shingle_sets(pa.array(texts))]
    assert sets[0] == sets[1] != sets[2]  # U+00A0 splits nothing; case folds for A-Z


def test_pigeonhole_guarantee():
    """Signatures with up to MAX_ERRORS errors always share a key."""
    rng = np.random.default_rng(3)
    for _ in range(300):
        a = rng.integers(0, 1 << 16, 64).astype(np.uint16)
        b = a.copy()
        at = rng.choice(64, near_dup.MAX_ERRORS, replace=False)
        b[at] ^= 1
        keys = near_dup.index_keys(np.stack([a, b]))
        assert (keys[0] == keys[1]).any()


@pytest.mark.parametrize("j", [0.75, 0.8, 0.9])
def test_signature_bound_holds_at_the_threshold(j):
    rng = np.random.default_rng(4)
    for _ in range(200):
        n = 200
        shared = int(2 * n * j / (1 + j))
        pool = rng.integers(1, 1 << 63, 2 * n - shared).astype(np.uint64)
        a, b = np.unique(pool[:n]), np.unique(pool[n - shared :])
        x, y = (np.frombuffer(shingles.signature(s), np.uint16) for s in (a, b))
        assert (x != y).sum() <= near_dup.MAX_ERRORS
