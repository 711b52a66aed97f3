import random

import pytest
from pyspark.sql import functions as F

from voxelframe.llm import token_counts as T

ALPHABET = " \n\t'abcére2019.,!$ll  "


@pytest.fixture(scope="module")
def tokens():
    return T.counter(T.default_ranks())


def flat(tree):
    """Lengths and counts of all leaves."""
    return [x for b in tree.leaves() for x in b.lengths], [x for b in tree.leaves() for x in b.counts]


def well_formed(node):
    """Checks sums and widths of a subtree; gives its height."""
    if node.kids is None:
        assert (node.size, node.chars, node.tokens) == (len(node.lengths), sum(node.lengths), sum(node.counts)) and node.size <= T.MOST
        return 0
    assert 1 < len(node.kids) <= T.MOST and all(k.width() >= T.LEAST for k in node.kids)
    assert all(getattr(node, name) == sum(getattr(k, name) for k in node.kids) for name in ("size", "chars", "tokens"))
    heights = {well_formed(k) for k in node.kids}
    assert len(heights) == 1
    return heights.pop() + 1


def test_edits_equal_a_full_count(tokens):
    rng = random.Random(3)
    for _ in range(600):
        s = "".join(rng.choices(ALPHABET, k=rng.choice([0, 1, 5, 40, 300])))
        tree = T.TokenTree(s, tokens)
        for _ in range(4):
            a, b, x = rng.randint(0, len(s) + 2), rng.choice([0, 1, 3, 20]), "".join(rng.choices(ALPHABET, k=rng.choice([0, 1, 2, 6])))
            tree.edit(a, b, x)
            a = min(a, len(s))
            s = s[:a] + x + s[a + b :]
            fresh = T.TokenTree(s, tokens)
            assert tree.text == s and flat(tree) == flat(fresh)
            well_formed(tree.root)
            assert tree.total == len(tokens.encoding.encode_ordinary(s))
            i = rng.randint(0, tree.root.size)
            j = rng.randint(i, tree.root.size)
            assert tree.count(i, j) == sum(flat(tree)[1][i:j])


def test_only_the_touched_region_is_encoded(tokens):
    tree = T.TokenTree("word and more " * 20_000, tokens)
    assert tree.edit(100_000, 3, "other") < 8 and tree.edit(200_001, 0, "x") < 8
    assert tree.total == len(tokens.encoding.encode_ordinary(tree.text))


def test_trees_of_several_levels(tokens):
    """Large insertions and deletions split, merge and drop blocks on all levels."""
    rng = random.Random(4)
    tree = T.TokenTree("", tokens)
    for _ in range(60):
        n = len(tree.text)
        start, length = rng.randint(0, n), rng.choice([0, 0, 5, 2000, 60_000])
        new = "".join(rng.choices(ALPHABET, k=rng.choice([0, 3, 500, 40_000])))
        want = tree.text[:start] + new + tree.text[start + length :]
        tree.edit(start, length, new)
        fresh = T.TokenTree(want, tokens)
        assert tree.text == want and flat(tree) == flat(fresh)
        well_formed(tree.root)
    assert well_formed(T.TokenTree("a b " * 20_000, tokens).root) == 2


def test_kept_trees_are_edited_without_encoding_the_rest(spark, tokens, tmp_path):
    """A second batch of edits reads the stored trees of the first, and renews a few blocks and pre-tokens only."""
    texts = {1: "some words here and there " * 4000, 2: "short text", 3: "", 4: None}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    edit = lambda at, length, new: F.array(F.struct(F.lit(at).alias("start"), F.lit(length).alias("length"), F.lit(new).alias("text")))
    first = T.apply_edits(T.build_trees(docs), edit(50_000, 4, "other"))
    first.write.parquet(str(tmp_path / "first"))
    kept = spark.read.parquet(str(tmp_path / "first"))
    second = {r.doc_id: r for r in T.apply_edits(kept, edit(10, 3, " x")).collect()}
    assert second[1].n_reencoded < 8 and second[1].text.count("other") == 1 and second[1].n_tokens_before == len(tokens.encoding.encode_ordinary(kept.where("doc_id = 1").first().text))
    for r in second.values():
        fresh = T.TokenTree(r.text, tokens)
        assert r.n_tokens == fresh.total and (r.lengths, r.counts) == flat(fresh) and r.n_pretokens == len(r.lengths)
        assert sum(b.tokens for b in r.blocks) == r.n_tokens and sum(b.chars for b in r.blocks) == len(r.text)
    # a tree whose counts are wrong away from the edit keeps them: nothing else is encoded
    false = kept.where("doc_id = 1").withColumn("counts", F.transform("counts", lambda x: x * 0 + 7)).withColumn("blocks", F.transform("blocks", lambda b: F.struct(b["size"].alias("size"), b["chars"].alias("chars"), (b["size"] * 7).alias("tokens"))))
    r = T.apply_edits(false, edit(10, 3, " x")).first()
    assert sum(x != 7 for x in r.counts) <= 8 and r.n_tokens == sum(r.counts)


def test_operator(spark, tokens):
    rows = [(1, "some words here " * 30, 0), (2, None, 0), (3, "", 0), (None, "Ñandú", 0), (1, "some words here " * 30, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, edits int")
    got = T.count_with_edits(df, T.revision(F.col("text")), with_text=True).collect()
    assert len(got) == 5
    for r in got:
        assert r.n_tokens_after == len(tokens.encoding.encode_ordinary(r.text_after)) and r.n_edits == 3
    plain = {r.doc_id: r for r in T.count_with_edits(df).collect()}
    assert plain[1].n_tokens == len(tokens.encoding.encode_ordinary("some words here " * 30)) == plain[1].n_tokens_after and plain[2].n_tokens == 0
    odd = F.array(F.struct(F.lit(None).alias("start"), F.lit(None).alias("length"), F.lit(None).alias("text")), F.lit(None))
    assert {r.n_tokens == r.n_tokens_after for r in T.count_with_edits(df, odd).collect()} == {True}
    assert T.count_with_edits(df.limit(0)).count() == 0
