"""A pipeline over ``documents``: language, near-duplicates, secrets, mixing, packing.

Every stage takes ``(spark, docs, sf_dir)`` and returns the documents that the next one works on;
the last one returns packed pieces. ``run`` writes each stage's result as Parquet to the folder
that driver and executors share and reads it again, so a lost executor never costs more than one
stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm.common import Scratch
from auditlake.llm.langid import UNKNOWN, identify, train
from auditlake.llm.minhash import near_duplicates
from auditlake.llm.mixing import mix_sources
from auditlake.llm.packing import pack_documents
from auditlake.llm.secrets import redact, secret_scan

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
_ROW = ("row", "row2")


def _row_hashes() -> dict[str, Column]:
    """Two hashes of a whole row, by which results find their rows again."""
    return {"row": F.xxhash64(*COLUMNS), "row2": F.xxhash64(F.lit("again"), *COLUMNS)}


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language (null, empty or without a letter) go; a missing label gets the prediction.

    Every other row stays as it is, repeated rows and very long texts too; ties of two languages go
    to the first by name. An empty table gives no row.
    """
    model = train(docs.select(F.col("doc_id").alias("id"), "text", "lang"))
    told = identify(docs, model, COLUMNS)
    return told.filter(F.col("lang_pred") != UNKNOWN).select("doc_id", "text", F.coalesce("lang", "lang_pred").alias("lang"), "source", "n_chars")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies stays: the one with the smallest id, once.

    Rows that repeat id and text are one. Rows without an id, and texts without a word (which the
    stage before leaves none of), stay. Texts are compared whole, however long. An empty table gives
    no row.
    """
    # an id may have several texts, of which one is a copy and another isn't
    gone = near_duplicates(docs, text_hash="text_hash").filter(~F.col("kept")).select("doc_id", "text_hash").distinct()
    left = docs.withColumn("text_hash", F.xxhash64("text")).join(gone, ["doc_id", "text_hash"], "left_anti")
    # rows that repeat id and text are copies too; rows without an id stay
    named = left.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id", "text"])
    return named.unionByName(left.filter("doc_id IS NULL")).select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Credentials that look live are masked; widely copied examples and all other text stay.

    Every row stays, with ``n_chars`` counted anew where text was masked; repeated rows are masked
    alike, overlapping spans as one. Null and empty texts have nothing to mask. An empty table gives
    no row.
    """
    keyed = docs.select(*COLUMNS).withColumns(_row_hashes())
    live = secret_scan(keyed, carry=_ROW).filter("n_live > 0").select(*_ROW, "live_spans").dropDuplicates([*_ROW])
    some = F.col("live_spans").isNotNull()
    text = F.when(some, redact(F.col("text"), F.col("live_spans"))).otherwise(F.col("text"))
    masked = keyed.join(live, [*_ROW], "left").withColumn("text", text)
    return masked.withColumn("n_chars", F.when(some, F.length("text")).otherwise(F.col("n_chars")).cast("long")).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents appear as often as the mix takes them, which may be not at all.

    Equal rows appear as often as all of them together. A null source is one of its own. Texts
    without words, and sources that have none, are not taken. An empty table gives no row.
    """
    keyed = docs.select(*COLUMNS).withColumns(_row_hashes())
    # equal rows are one row that appears as often as all of them together
    copies = mix_sources(keyed, carry=_ROW).groupBy(*_ROW).agg(F.sum("copies").cast("int").alias("copies")).filter("copies > 0")
    mixed = keyed.dropDuplicates([*_ROW]).join(copies, [*_ROW])
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of several context sizes, of every row: repeated rows are packed each, null
    and empty texts as their end id, very long texts in many pieces. An empty table gives no row.
    """
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language ID", language),
    ("MinHash near-dedup", near_copies),
    ("secret scans", secrets),
    ("mixing sources to target weights", mixing),
    ("packing", packing),
]

#: Sketches, classifiers, balanced sampling and tokenizers can't be said in SQL; the tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    scratch = Scratch(spark)
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        docs = scratch.cut(stage(spark, docs, sf_dir))
        if before is not None:
            scratch.drop(before)
        before = docs
    return docs
