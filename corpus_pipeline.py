"""The corpus pipeline over ``documents``: language ID, near-duplicates, decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir), and its result is written and read again as the next one's docs. All but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytolith.llm import op1_language_id, op4_packing, op5_secret_scan, op7_simhash_golay, op10_decontamination
from cytolith.llm.common import WRITTEN, discard, materialise, table
from cytolith.llm.queries import PACKING_TOKENIZER, tokenizer_path
from cytolith.session import ship_package


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages; those without letters or unlike all of them go."""
    ship_package(spark)
    return op1_language_id.accepted(docs, op1_language_id.learn(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near-duplicates."""
    ship_package(spark)
    return op7_simhash_golay.representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item contaminates."""
    ship_package(spark)
    return op10_decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by its kind; n_chars is that of the new text."""
    ship_package(spark)
    done = op5_secret_scan.redact(docs)
    return done.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))) if "n_chars" in docs.columns else done


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed along the space-filling curve."""
    ship_package(spark)
    return op4_packing.pack(docs, tokenizer_path(PACKING_TOKENIZER))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("packing", packing),
]

#: Profiles, fingerprints over text, components and token ids are beyond SQL: stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, writing each but the last stage's result; what a stage no longer needs is deleted."""
    docs, before = table(spark, sf_dir, "documents"), len(WRITTEN)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
        discard(spark, WRITTEN[before:-1])
    pieces = STAGES[-1][1](spark, docs, sf_dir)
    discard(spark, WRITTEN[before:-1])
    return pieces
