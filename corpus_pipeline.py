"""The corpus pipeline: stages over the documents table, each written and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelframe.llm.decontaminate import decontaminate
from voxelframe.llm.exact_dedup import exact_dedup, normal_digest
from voxelframe.llm.near_dup import near_duplicates
from voxelframe.llm.pieces import sample_segmentations
from voxelframe.llm.quality import score_quality
from voxelframe.llm.store import Stage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """Rows of docs whose doc_id is not in dropped(doc_id); rows without doc_id stay."""
    return docs.select(*COLUMNS).join(dropped.where("doc_id is not null").distinct(), "doc_id", "left_anti").select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model predicts as good; learnt from the labelled ones among them."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score_quality(docs.select(*COLUMNS), labels).where("predicted = 1").select(*COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, the one of least doc_id.

    doc_id tells rows apart; only rows that repeat one of which some row stays
    (and those without one) are told apart by their texts' digests as well.
    """
    docs, found = docs.select(*COLUMNS), exact_dedup(docs)
    ids = found.groupBy("doc_id").agg(F.max("kept").alias("stays"), F.count("*").alias("n"))
    decided = ids.where("not stays or n > 1").select(F.col("doc_id").alias("id"))
    out = docs.join(decided, F.col("doc_id").eqNullSafe(F.col("id")), "left_anti")
    repeated = ids.where("stays and n > 1").select(F.col("doc_id").alias("id"))
    if repeated.limit(1).count():
        stay = found.where("kept").select(F.col("doc_id").alias("id"), F.unhex("text_sha256").alias("digest")).distinct()
        rows = docs.join(repeated, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi").withColumn("__digest", normal_digest(F.col("text")))
        rows = rows.join(stay, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("__digest") == F.col("digest")), "left_semi")
        out = out.union(rows.dropDuplicates(["doc_id", "__digest"]).select(*COLUMNS))
    return out


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return _without(docs, near_duplicates(docs).where("not kept").select("doc_id"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, found.where("contaminated").select("doc_id"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each kept document's encoding and its sampled segmentations, as digests."""
    found = sample_segmentations(docs, k=2)
    field = lambda name: F.transform("samples", lambda s: s[name])
    return found.select("doc_id", "n_pieces", "digest", "exact", F.size("samples").cast("long").alias("n_samples"), field("n_pieces").alias("sample_pieces"), field("digest").alias("sample_digests"), field("inclusion").alias("inclusion"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("exact_dedup", exact),
    ("near_dup", near),
    ("decontaminate", decontaminated),
    ("pieces", pieces),
]
#: The model of the first stage is fitted, which SQL cannot express; tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each but the last written to the shared folder."""
    stage = Stage(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage.put(docs, name)
    return docs
