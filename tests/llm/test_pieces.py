import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from voxelframe.llm import entry
from voxelframe.llm import pieces as P

TEXTS = ["Hello world", None, "", " ", "a  b \n\t é\U0001f600中\x00", "x" * 3000, "  lead", "trail  ", "▁ mark", "é" * 200, "the the the", "Ñandú 123 ## foo_bar"]


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=P.default_model())


def test_encoding_is_the_librarys_and_round_trips(spark, model):
    rows = [(k, t, "x") for k, t in enumerate(TEXTS)] + [(r.doc_id + 1000, r.text, "x") for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string, samples string").repartition(3)
    got = {r.doc_id: r for r in P.sample_segmentations(df, k=3, with_ids=True).collect()}
    assert len(got) == len(rows)
    for k, t, _ in rows:
        r, t = got[k], t or ""
        assert r.ids == model.encode(t) and r.n_pieces == len(r.ids), t[:40]
        assert r.exact == True and P.decode(r.ids) == t.replace(P.SPACE, " ")  # noqa: E712
        segmentations = [tuple(s.ids) for s in r.samples]
        assert len(set(segmentations)) == len(segmentations) and len({s.digest for s in r.samples}) == len(segmentations)
        for s in r.samples:
            assert P.decode(s.ids) == t.replace(P.SPACE, " ") and s.n_pieces == len(s.ids) and 0 <= s.inclusion <= 1
        assert [s.perturbed for s in r.samples] == sorted((s.perturbed for s in r.samples), reverse=True)
        assert len(r.samples) == (0 if not t else 3) or len(set(t)) < 3


def test_query_has_digests_of_the_ids(spark, model):
    """The query makes the pieces of the encoding and of both samples, and its digests are theirs."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    known = {r.doc_id: r for r in P.sample_segmentations(docs, k=2, with_ids=True).collect()}
    hashed = lambda lists: [r.h for r in spark.createDataFrame([(n, x) for n, x in enumerate(lists)], "n int, ids array<int>").orderBy("n").selectExpr("xxhash64(ids) AS h").collect()]
    got = sorted(entry.op9_pieces(spark, sf).join(docs.select("doc_id"), "doc_id", "left_semi").collect(), key=lambda r: r.doc_id)
    assert [r.doc_id for r in got] == sorted(known)
    encoded = [model.encode(r.text or "") for r in sorted(docs.collect(), key=lambda r: r.doc_id)]
    assert [r.digest for r in got] == hashed(encoded) and [r.n_pieces for r in got] == list(map(len, encoded))
    for s in range(2):
        drawn = [known[r.doc_id].samples[s].ids for r in got]
        assert [r.sample_digests[s] for r in got] == hashed(drawn) and [r.sample_pieces[s] for r in got] == list(map(len, drawn))


def test_columns_are_cut_into_the_same_units():
    texts = [*TEXTS, "▁▁", "a▁b ▁ c", " ▁ "]
    unit, first, units = P.units_in(pa.array(texts).slice(1))
    got = [[units[u].decode().replace(" ", P.SPACE) for u in unit[a:b]] for a, b in zip(first[:-1], first[1:], strict=True)]
    assert got == [P.units_of(t or "") for t in texts[1:]] and len(set(units)) == len(units)


def test_draws_depend_on_the_row_key_alone(spark):
    df = spark.createDataFrame([(k % 3, "some words to be segmented here, again and again " * 8) for k in range(9)], "doc_id long, text string")
    got = {}
    for r in P.sample_segmentations(df.repartition(5)).collect():
        got.setdefault(r.doc_id, set()).add(tuple(s.digest for s in r.samples))
    assert all(len(v) == 1 for v in got.values()) and len(set.union(*got.values())) == 3
    assert P.sample_segmentations(df.limit(0)).count() == 0


def all_segmentations(vocab, unit):
    """Every segmentation of a unit with its probability, by plain recursion."""
    index = {vocab.bytes[k].decode(): k for k in range(vocab.model.vocab_size()) if vocab.bytes[k] and not vocab.model.is_byte(k) and not vocab.model.is_unused(k)}

    def walk(i):
        if i == len(unit):
            yield (), 1.0
        for x in range(1, min(P.LONGEST, len(unit) - i) + 1):
            k = index.get(unit[i : i + x])
            w = vocab.weight[k] if k is not None else vocab.unknown if x == 1 else None
            if w is not None:
                for rest, p in walk(i + x):
                    yield (x, *rest), w * p

    found = dict(walk(0))
    total = sum(found.values())
    return {s: p / total for s, p in found.items()}


def test_sampling_without_replacement_follows_the_lattice():
    """First and second draws over many keys agree with the exact distribution over two units."""
    vocab = P.vocabulary(P.default_model())
    units = ["▁thea", "▁edo"]
    exact = [all_segmentations(vocab, u) for u in units]
    whole = {(a, b): p * q for a, p in exact[0].items() for b, q in exact[1].items()}
    n = 40_000
    lat = P.Lattice(vocab, units)
    unit, first = np.tile([0, 1], n), np.arange(n + 1) * 2
    samples, threshold, lengths_of = P.sample_slice(lat, unit, first, P.mix(np.arange(n, dtype=np.uint64)), 2)
    draws = [[(tuple(lengths_of(s, 2 * t)), tuple(lengths_of(s, 2 * t + 1))) for t in range(n)] for s in range(2)]
    assert all(a != b for a, b in zip(*draws, strict=True))
    counts = Counter(draws[0])
    second = Counter(draws[1])
    for s, p in sorted(whole.items(), key=lambda x: -x[1])[:12]:
        want2 = sum(q * p / (1 - q) for r, q in whole.items() if r != s)
        assert abs(counts[s] / n - p) < 5 * math.sqrt(p / n) + 1e-3
        assert abs(second[s] / n - want2) < 5 * math.sqrt(want2 / n) + 1e-3
    # inclusion probabilities of the drawn are unbiased: the Horvitz-Thompson total is 1
    logp = [np.add.reduceat(s["logp"], first[:-1]) for s in samples]
    total = sum(np.exp(p) / -np.expm1(-np.exp(p - threshold)) for p in logp)
    assert abs(total.mean() - 1) < 0.02
    for s in range(2):
        assert all(abs(logp[s][t] - math.log(whole[draws[s][t]])) < 1e-3 for t in random.Random(0).sample(range(n), 200))


def test_every_segmentation_is_found(spark):
    """With k at least their number, all segmentations of a text are drawn, however unlikely, each once."""
    vocab = P.vocabulary(P.default_model())
    texts = ["a", "ab", "the", "é", "x y", "\U0001f600", "1 2 a", "\x01"]
    want = []
    for t in texts:
        found = [((), 1.0)]
        for u in P.units_of(t):
            found = [((*a, s), p * q) for a, p in found for s, q in all_segmentations(vocab, u).items()]
        want.append(dict(found))
    k = max(map(len, want)) + 2
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for copy in range(3):
        got = {r.doc_id: r for r in P.sample_segmentations(df.selectExpr(f"doc_id + {100 * copy} AS doc_id", "text"), k=k, with_ids=True).collect()}
        for i, segmentations in enumerate(want):
            samples = got[100 * copy + i].samples
            assert len(samples) == len(segmentations) == len({s.digest for s in samples}), (texts[i], len(samples))
            assert len({tuple(s.ids) for s in samples}) == len(samples)
            np.testing.assert_allclose(sorted(math.exp(s.log_p) for s in samples), sorted(segmentations.values()), rtol=1e-9)
            assert all(s.inclusion == 1.0 for s in samples)


def test_unlikely_segmentations_keep_their_share():
    """Where one segmentation has nearly all mass, the others still follow theirs, and inclusion stays below 1."""
    vocab = P.vocabulary(P.default_model())
    unit = P.units_of("the")[0]
    exact = all_segmentations(vocab, unit)
    n = 20_000
    lat = P.Lattice(vocab, [unit])
    samples, threshold, lengths_of = P.sample_slice(lat, np.zeros(n, np.int64), np.arange(n + 1), P.mix(np.arange(n, dtype=np.uint64)), 2)
    assert np.isfinite(threshold).all()
    draws = [[tuple(lengths_of(s, t)) for t in range(n)] for s in range(2)]
    assert all(a != b for a, b in zip(*draws, strict=True))
    second = Counter(draws[1])
    for s in sorted(exact, key=exact.get)[-6:]:
        want = sum(q * exact[s] / (1 - q) for r, q in exact.items() if r != s)
        assert abs(second[s] / n - want) < 5 * math.sqrt(want / n) + 1e-3


def test_very_long_texts(spark, model):
    """One unit of 40,000 characters, one text of 60,000 units, and ties: rows that repeat."""
    texts = ["x" * 20_000 + "é中" * 10_000, "some words " * 30_000, "some words " * 30_000]
    got = P.sample_segmentations(spark.createDataFrame([(min(k, 1), t) for k, t in enumerate(texts)], "doc_id long, text string"), k=2, with_ids=True).collect()
    assert len(got) == 3 and all(r.exact and len(r.samples) == 2 for r in got)
    for r in got:
        text = texts[r.doc_id]
        assert r.ids == model.encode(text) and all(P.decode(s.ids) == text and np.isfinite(s.log_p) for s in r.samples)
    assert len({s.digest for r in got if r.doc_id == 1 for s in r.samples}) == 2


def test_a_word_is_one_unit_whatever_follows_it(model):
    """Units part where no piece joins two characters; encodings stay the library's, also of units without a blank before them."""
    texts = ["word word, word. word\nword;\nword!", "(word) word's", "é.\n\x01中, 1a\t2", "a ,\n ,", "$$$ a$$$ éﬁ"]
    unit, first, units = P.units_in(pa.array(texts[:1]))
    assert first.tolist() == [0, len(unit)] and [units[u].decode() for u in unit] == [" word", " word", ",", " word", ".", " word", "\n", "word", ";\n", "word", "!"]
    known = P.Units(P.vocabulary(P.default_model()))
    unit, first, units = P.units_in(pa.array(texts))
    numbers = known.number(units)[unit]
    for t, a, b in zip(texts, first[:-1], first[1:], strict=True):
        assert known.whole[numbers[a:b]].all()
        assert [x for u in numbers[a:b] for x in known.ids[known.begin[u] : known.begin[u] + known.n_ids[u]].tolist()] == model.encode(t)


def test_forgetting_units_changes_no_result(monkeypatch):
    """Units met once are forgotten beyond HELD, others are kept from task to task, with the same pieces and draws."""
    rng = random.Random(3)
    texts = ["".join(rng.choice(["some", "words", "again", f"x{rng.random()}", "été"]) + rng.choice([" ", ", ", ".\n", "\n"]) for _ in range(60)) for _ in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array(texts), pa.array(range(40))], ["doc_id", "text", "seed"])
    monkeypatch.setattr(P, "SLICE", 2000)

    def results():
        return [b.to_pylist() for b in P._run(P.default_model(), 2)(iter([batch]))]

    monkeypatch.setattr(P, "_local", P.threading.local())
    want = results()
    everything = len(P._known(P.default_model()).numbers)
    assert results() == want and len(P._known(P.default_model()).numbers) == everything
    monkeypatch.setattr(P, "HELD", 1500)
    monkeypatch.setattr(P, "RESTING", 200)
    monkeypatch.setattr(P, "_local", P.threading.local())
    assert results() == want and results() == want
    known = P._known(P.default_model())
    assert len(known.numbers) < everything / 3 and len(known.lat.first) <= 200 and b" some" in known.numbers
