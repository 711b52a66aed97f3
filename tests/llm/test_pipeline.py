"""The pipeline's stages against their operators' plain results."""

import corpus_pipeline as C
from test_decontaminate import brute as hits
from test_exact_dedup import norm
from test_near_dup import brute as near

SF = "/root/testdata/sf0.001"


def test_each_stage_on_its_own_input(spark):
    from voxelframe.llm.quality import score_quality

    assert [name for name, _ in C.STAGES] == ["quality", "exact_dedup", "near_dup", "decontaminate", "pieces"]
    step = dict(C.STAGES)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, items = spark.read.parquet(f"{SF}/labels.parquet"), [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    good = step["quality"](spark, docs, SF).cache()
    want = {r.doc_id for r in score_quality(docs, labels).where("predicted = 1").collect()}
    assert {r.doc_id for r in good.collect()} == want and good.columns == docs.columns
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert sum(truth[i] for i in truth if i in want) >= 0.97 * sum(truth.values())
    extra = good.limit(3).union(good.limit(3))
    rows = extra.union(good).cache()
    exact = step["exact_dedup"](spark, rows, SF).cache()
    first = {}
    for r in sorted(rows.collect(), key=lambda r: r.doc_id):
        first.setdefault(norm(r.text), r.doc_id)
    assert sorted(r.doc_id for r in exact.collect()) == sorted(first.values())
    text = [(r.doc_id, r.text) for r in exact.collect()]
    one = step["near_dup"](spark, exact, SF).cache()
    assert sorted(r.doc_id for r in one.collect()) == sorted(i for i, (_, c) in near(text).items() if i == c)
    clean = step["decontaminate"](spark, one, SF).cache()
    assert sorted(r.doc_id for r in clean.collect()) == sorted(r.doc_id for r in one.collect() if not hits(r.text, items)[4])
    out = step["pieces"](spark, clean, SF)
    assert sorted(r.doc_id for r in out.collect()) == sorted(r.doc_id for r in clean.collect()) and out.where("not exact").count() == 0


def test_empty_and_null_rows(spark):
    docs = spark.createDataFrame([(None, None, None, None, None), (None, "some words", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, step in C.STAGES[:-1]:
        assert step(spark, docs.limit(0), SF).count() == 0, name
        if name != "quality":
            assert step(spark, docs, SF).count() == 2, name
