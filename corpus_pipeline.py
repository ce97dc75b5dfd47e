"""The corpus pipeline: documents in; good, distinct, uncontaminated documents without secrets out, encoded.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; what it returns is written as
Parquet in the shared folder and read again for the next.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangekeep.llm import decontam, dedup, quality, secrets, spiece
from rangekeep.llm.common import passing, stage, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates, the document with the least id stays."""
    return dedup.keep_one(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by the benchmark go."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by their kinds; n_chars follows the text."""
    masked = secrets.redact(docs)
    if "n_chars" not in docs.columns:
        return masked
    changed = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("bigint"))
    return masked.withColumn("n_chars", changed)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of the pieces of each text, with digests of the round trip."""
    return spiece.encode(docs, with_ids=True)


STAGES = [
    ("quality classifier", good_quality),
    ("near-duplicates", one_of_each),
    ("benchmark decontamination", uncontaminated),
    ("secret scan", without_secrets),
    ("sentencepiece", encoded),
]

#: The classifier and the sketches have no equivalent in SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, step) in enumerate(STAGES):
        with passing(spark):  # what a stage writes for itself goes once its result is written
            docs = stage(spark, step(spark, docs, sf_dir), f"pipeline-{k}", keep=True)
    return docs
