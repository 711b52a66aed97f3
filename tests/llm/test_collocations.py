import random
import re
from collections import Counter

import duckdb
from pyspark.sql import functions as F
from support import same_rows

from voxelframe.llm import collocations as module
from voxelframe.llm import entry, sql
from voxelframe.llm.collocations import collocations, frequent_phrases

SHAPE = "doc_id long, text string, lang string, a long, word string, id string"
COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, longest=3, least=10, share_percent=50, top=2000):
    f, n = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    candidates = {k: a for k, a in f.items() if a >= least and len(k[1]) > 1}
    out = []
    for (lang, p), a in candidates.items():
        inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))  # noqa: B023, E731
        if any(g == lang and len(q) > len(p) and 100 * b >= share_percent * a and inside(q) for (g, q), b in candidates.items()):
            continue
        score, _, left, right = min((1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out.append((lang, " ".join(p), a, left, right, n[lang], score))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    ranks, result = Counter(), []
    for lang, *rest in out:
        ranks[lang] += 1
        if ranks[lang] <= top:
            result.append((lang, ranks[lang], *rest))
    return result


def table(spark, docs):
    return spark.createDataFrame([(k, t, g, 1, "w", "x") for k, (t, g) in enumerate(docs)], SHAPE).repartition(3)


def check(spark, docs, **options):
    got = sorted(tuple(r[c] for c in COLUMNS) for r in collocations(table(spark, docs), **options).collect())
    assert got == sorted(brute(docs, **options))
    return got


def made(seed, n=120, vocabulary=9):
    rng = random.Random(seed)
    words = ["Al", "be", "CE", "Été", "été", "x y", "d'e", "中", "z\x00"][:vocabulary]
    blanks = [" ", "  ", "\t", " \t ", ", ", ". ", "\n", "\x0b", ";", " ?! "]
    return [("".join(rng.choice(words) + rng.choices(blanks, [9, 3, 1, 1, 1, 1, 1, 1, 1, 1])[0] for _ in range(rng.randint(0, 60))), rng.choice(["en", "de", None])) for _ in range(n)]


def test_query_matches_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    same_rows(entry.op13_collocations(spark, sf), con.execute(sql.COLLOCATIONS))


def test_random_texts_ties_and_repeated_rows(spark):
    docs = made(1)
    assert len(check(spark, docs + docs[:20])) > 50
    check(spark, docs, top=7)


def test_longer_phrases(spark):
    check(spark, made(2, n=40, vocabulary=4), longest=5, least=6)


def test_nulls_empty_and_blank_texts(spark):
    assert check(spark, [(None, "en"), ("", None), (" \t .,;\n", "fr"), ("one", "de")]) == []
    assert collocations(table(spark, [("a b", "en")]).limit(0)).count() == 0
    got = check(spark, [("a b " * 5, None), ("A B", "und")] * 3)
    assert got[0][:3] == ("und", 1, "a b a")


def test_very_long_text_and_piece(spark):
    check(spark, [("la le li " * 40_000, "en"), ("la. le, " * 10_000, "en")])


def test_large_dictionaries_are_split_by_frequency(spark, monkeypatch):
    monkeypatch.setattr(module, "BROADCAST_ROWS", 2)
    monkeypatch.setattr(module, "BROADCAST_PHRASES", 2)
    monkeypatch.setattr(module, "HOT", 5)
    check(spark, made(3))


def test_settings_are_put_back_and_tables_dropped(spark):
    before = {k: spark.conf.get(k, None) for k in module._IN_PLACE}
    phrases, sizes = frequent_phrases(table(spark, made(4)))
    assert {k: spark.conf.get(k, None) for k in module._IN_PLACE} == before
    assert phrases.where("a < 10").count() == 0 and sizes.count() == 3


def test_merge_join_needs_no_shuffle_and_no_sort(spark):
    from voxelframe.llm.store import Stage

    rows = spark.range(1000).selectExpr("id div 7 as piece", "cast(id % 7 as int) as pos", "cast(id % 7 + 1 as int) as next", "id % 3 as id")
    with module._settings(spark, module._IN_PLACE | {"spark.sql.adaptive.enabled": "false"}):
        relation = Stage(spark, "test").put_dealt(rows.repartition(4, "piece").sortWithinPartitions("piece", "pos"), "r", "piece", [["piece", "next"], ["piece", "pos"]], 4)
        pairs = module._adjacent(relation)
        plan = pairs._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
        want = [(k // 7, k % 7, k % 3, (k + 1) % 3) for k in range(999) if k % 7 < 6]
        assert sorted(map(tuple, pairs.collect())) == want


def test_relations_stay_in_order(spark):
    docs = table(spark, made(5))
    dealt = module.pieces(docs).repartition(3, "piece").sortWithinPartitions("piece")
    parts = module.occurrences(dealt).select(F.spark_partition_id().alias("p"), "piece", "pos").collect()
    for p in {r.p for r in parts}:
        here = [(r.piece, r.pos) for r in parts if r.p == p]
        assert here == sorted(here) and len(here) == len(set(here))


def test_one_row_a_text_is_dealt_and_separators_take_a_place(spark):
    docs = table(spark, [("Ab cd, ef .\n gh", "en"), (" \t.;", "en"), (None, "en"), ("!ij", None)])
    found = module.pieces(docs)
    assert found.count() == 2
    rows = [(r.lang, r.pos, r.word) for r in module.occurrences(found).orderBy("lang", "pos").collect()]
    assert rows == [("en", 0, "Ab"), ("en", 1, "cd"), ("en", 2, ","), ("en", 3, "ef"), ("en", 4, ".\n"), ("en", 5, "gh"), ("und", 0, "!"), ("und", 1, "ij")]
    check(spark, [("a b. c a b,c a b", "en"), ("b ; ;a b", "en")] * 10)


def test_words_that_share_a_code(spark, monkeypatch):
    """Codes name words exactly, or the words themselves are joined."""
    docs = made(6)
    rows = module.coded(module.pieces(table(spark, docs))).collect()
    texts, words = [r for r in rows if r.piece is not None], [r for r in rows if r.word is not None]
    assert len({(r.lang, r.word) for r in words}) == len({r.code for r in words}) and {r.word for r in words} == {r.word.translate(LOWER) for r in words}
    assert sum(r.a for r in words) == sum(sum(c != 0 for c in r.codes) for r in texts)
    assert not any(r.codes[0] == 0 or r.codes[-1] == 0 for r in texts)
    want = check(spark, docs)
    monkeypatch.setattr(module, "SLICE", 50)
    assert check(spark, docs) == want
    monkeypatch.setattr(module, "_codes", lambda words, groups: (words % 5 + 1).view("int64"))
    assert len({r.code for r in module.coded(module.pieces(table(spark, docs))).collect() if r.word is not None}) < 6
    assert check(spark, docs) == want


def test_texts_are_split_once(spark, monkeypatch):
    """Without a clash of codes no regular expression splits the texts a second time."""
    monkeypatch.setattr(module, "occurrences", lambda found: 1 / 0)
    check(spark, made(7))


def test_only_frequent_keys_are_copied(spark, monkeypatch):
    """A table joined by a shuffle is sent once, but for its large keys."""
    rows = spark.range(100).selectExpr("id", "cast(if(id < 60, 0, id % 7) as int) as k")
    keys = spark.range(7).selectExpr("cast(id as int) as k", "if(id = 0, 60L, 1L) as w")
    monkeypatch.setattr(module, "BROADCAST_PHRASES", 1)
    monkeypatch.setattr(module, "HOT", 5)
    found = module._looked_up(rows, keys, ["k"], "w", 100)
    want = [(k, 0 if k < 60 else k % 7) for k in range(100)]
    assert sorted((r.id, r.k) for r in found.collect()) == want
    dealt = {r.k: r.n for r in found.groupBy("k").agg(F.countDistinct(F.pmod(F.xxhash64("k", "id"), F.lit(8))).alias("n")).collect()}
    assert dealt[0] > 1 and found.columns == ["k", "id", "w"]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "(w#" in plan and "explode(CASE WHEN" in plan.replace("outer ", "")
