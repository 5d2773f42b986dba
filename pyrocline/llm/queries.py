"""One query for each operator of this subpackage, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyrocline.llm import decontamination, hamming, mixing, pages, quality, secrets, sharding, simhash, tokens, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest sign codes of every vector whose id is divisible by 100, against all vectors."""
    codes = hamming.sign_codes(_table(spark, sf_dir, "embeddings"))
    codes = hamming.settle(codes, "signs")
    found = hamming.top_k(codes, codes.where(F.col("id") % hamming.QUERY_EVERY == 0))
    return found.withColumnRenamed("id", "vec_id")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    return secrets.digest(secrets.scan_secrets(_table(spark, sf_dir, "documents")))


def op3_kneser_ney_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_fourier_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    return quality.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_consensus_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    found = pages.extract(_table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, written and read back."""
    return tokens.encode_table(spark, _table(spark, sf_dir, "documents"))


def op7_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near equal bytes."""
    out = sharding.shard(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_seeded_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items."""
    return decontamination.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and group of near-duplicates of every document."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_water_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    plan = mixing.plan_mix(_table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


_TOP_K_SQL = """
WITH d AS (SELECT DISTINCT q.vec_id AS query_id, e.vec_id,
    cast(list_sum(list_transform(range(1, len(q.embedding) + 1), lambda i: CASE WHEN (q.embedding[i] > 0) <> (e.embedding[i] > 0) THEN 1 ELSE 0 END)) AS BIGINT) AS distance
  FROM embeddings q JOIN embeddings e ON q.vec_id % 100 = 0 AND q.vec_id <> e.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d)
SELECT query_id, rank, vec_id, distance FROM r WHERE rank <= 10"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name and function of each query."""
    return {f.__name__: f for f in (op1_hamming_topk, op2_secret_scan, op3_kneser_ney_toxicity, op4_fourier_quality, op5_consensus_paths, op6_token_files,
                                  op7_sampled_splitters, op8_seeded_alignment, op9_simhash_dedup, op10_water_filling)}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL where SQL can express a query."""
    return {"op1_hamming_topk": _TOP_K_SQL, "op2_secret_scan": secrets.digest_sql()}
