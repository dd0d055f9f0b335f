"""Registered queries of this folder: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from .decontam import leaks
from .fingerprints import fingerprints
from .importance import resample
from .kneser import score_held_out
from .langid import language_id
from .lines import drop_repeated_lines
from .near_dedup import near_duplicates
from .packing import pack
from .sharding import shard_documents
from .spans import repeated_spans
from .suffixes import repeated_bytes
from .target import target_resample
from .whitening import whiten


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, _table(spark, sf_dir, "documents"))


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(spark, _table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeated_spans(spark, _table(spark, sf_dir, "documents"))
    kept = F.sha2(F.coalesce("kept_text", F.lit("")), 256)
    removed = F.array_join(F.col("removed").cast("array<string>"), ",")
    return out.select("row.doc_id", "n_sentences", F.size("removed").alias("n_removed"), removed.alias("removed"), kept.alias("kept_sha256"))


def op4_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeated_bytes(spark, _table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_held_out(spark, _table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(spark, _table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeated_lines(spark, _table(spark, sf_dir, "documents"))
    kept = F.sha2(F.coalesce("kept_text", F.lit("")), 256)
    return out.select("row.doc_id", "n_lines", F.size("removed").alias("n_removed"), "removed", kept.alias("kept_sha256"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, _table(spark, sf_dir, "documents"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark, _table(spark, sf_dir, "embeddings"))


def op12_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return target_resample(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(spark, _table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_document_fingerprints": op2_document_fingerprints,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_importance_resampling": op4_importance_resampling,
    "op5_decontamination": op5_decontamination,
    "op6_language_id": op6_language_id,
    "op7_line_dedup": op7_line_dedup,
    "op8_suffix_array_dedup": op8_suffix_array_dedup,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_target_resampling": op12_target_resampling,
    "op13_sharding": op13_sharding,
}

ORACLES: dict[str, str] = {
    "op1_minhash_near_dedup": oracles.NEAR_DEDUP,
    "op3_substring_dedup": oracles.SUBSTRING_DEDUP,
    "op8_suffix_array_dedup": oracles.SUFFIX_ARRAY_DEDUP,
    "op12_target_resampling": oracles.TARGET_RESAMPLING,
}
