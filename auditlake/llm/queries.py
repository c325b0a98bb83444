"""The queries of this subpackage, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm import oracles
from auditlake.llm.binary import token_table
from auditlake.llm.caps import near_vectors
from auditlake.llm.centroids import cluster_vectors
from auditlake.llm.chaining import repeated_passages
from auditlake.llm.graph import nearest
from auditlake.llm.katz import katz_scores
from auditlake.llm.langid import language_id
from auditlake.llm.licences import licence_scan
from auditlake.llm.minhash import near_duplicates
from auditlake.llm.mixing import mix_sources
from auditlake.llm.packing import pack_documents
from auditlake.llm.phrases import collocations
from auditlake.llm.secrets import secret_scan


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(_table(spark, sf_dir, "documents"))


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_table(spark, _table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=1)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(_table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents"))


def op3_cap_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings"))


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter("vec_id % 50 = 0"))


def op8_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz_scores(_table(spark, sf_dir, "documents"))


def op5_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(_table(spark, sf_dir, "documents"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(_table(spark, sf_dir, "embeddings")).drop("candidates")


def op12_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licence_scan(_table(spark, sf_dir, "documents"))
    span = "concat_ws(':', s.label, s.first, s.last)"
    return found.withColumn("spans", F.expr(f"array_join(transform(spans, s -> {span}), ',')"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secret_scan": op1_secret_scan,
        "op2_minhash_dedup": op2_minhash_dedup,
        "op3_cap_dedup": op3_cap_dedup,
        "op4_nearest": op4_nearest,
        "op5_passages": op5_passages,
        "op6_language_id": op6_language_id,
        "op7_mixing": op7_mixing,
        "op8_katz_scores": op8_katz_scores,
        "op9_token_files": op9_token_files,
        "op10_packing": op10_packing,
        "op11_centroids": op11_centroids,
        "op12_licences": op12_licences,
        "op13_collocations": op13_collocations,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_secret_scan": oracles.OP1, "op2_minhash_dedup": oracles.OP2, "op3_cap_dedup": oracles.OP3, "op11_centroids": oracles.op11(), "op13_collocations": oracles.OP13}
