"""The thin queries of this subpackage, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sql
from .collocations import collocations
from .decontaminate import decontaminate
from .exact_dedup import exact_dedup
from .licenses import scan_licenses
from .near_dup import near_duplicates
from .pieces import sample_segmentations
from .pii import pseudonymise
from .quality import score_quality
from .secrets import scan_secrets
from .sharding import shard
from .token_counts import count_with_edits, revision
from .url_filter import judge_urls
from .vector_codes import vector_codes


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document under shingle similarity of at least 0.75."""
    return near_duplicates(_docs(spark, sf_dir))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score for every document, learnt from the labels that are not held out."""
    docs = _docs(spark, sf_dir).select("doc_id", "text")
    return score_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("text")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 24 shards of near equal bytes."""
    return shard(_docs(spark, sf_dir))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document before and after a fixed revision of its kept tree."""
    return count_with_edits(_docs(spark, sf_dir), revision(F.col("text")))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row that stays for every document, and whether it is that row."""
    return exact_dedup(_docs(spark, sf_dir))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside an occurrence of a benchmark window."""
    found = decontaminate(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with its personal data replaced; the key comes from the session's setting."""
    return pseudonymise(_docs(spark, sf_dir))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree: source, a directory of 64 ids, and the id."""
    return scan_licenses(_docs(spark, sf_dir), F.concat_ws("/", "source", F.floor(F.col("doc_id") / 64), "doc_id"))


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's encoding and two sampled segmentations, as digests of their ids."""
    found = sample_segmentations(_docs(spark, sf_dir), k=2, with_ids=True)
    of = lambda value: F.transform("samples", value)
    pieces, n_samples = F.size("ids").cast("long").alias("n_pieces"), F.size("samples").cast("long").alias("n_samples")
    sampled = of(lambda s: F.size(s["ids"]).cast("long")).alias("sample_pieces"), of(lambda s: s["digest"]).alias("sample_digests")
    return found.select("doc_id", pieces, "digest", "exact", n_samples, *sampled, of(lambda s: s["log_p"]).alias("sample_log_p"), of(lambda s: s["inclusion"]).alias("inclusion"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and added spans of secrets in every text."""
    return scan_secrets(_docs(spark, sf_dir))


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL; the trees learn from the URLs that a rule decides."""
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The product code of every usable vector, and the errors of its label."""
    return vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best-scoring phrases of two and three words of each language."""
    return collocations(_docs(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dup": op1_near_dup,
    "op2_quality": op2_quality,
    "op3_sharding": op3_sharding,
    "op4_token_counts": op4_token_counts,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_decontaminate": op6_decontaminate,
    "op7_pii": op7_pii,
    "op8_licenses": op8_licenses,
    "op9_pieces": op9_pieces,
    "op10_secrets": op10_secrets,
    "op11_url_filter": op11_url_filter,
    "op12_vector_codes": op12_vector_codes,
    "op13_collocations": op13_collocations,
}
ORACLE_SQL: dict[str, str] = {
    "op1_near_dup": sql.NEAR_DUP,
    "op5_exact_dedup": sql.EXACT_DEDUP,
    "op6_decontaminate": sql.DECONTAMINATE,
    "op12_vector_codes": sql.VECTOR_CODES,
    "op13_collocations": sql.COLLOCATIONS,
}
