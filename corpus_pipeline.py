"""Corpus preparation in five stages, each of which calls one operator of spindle.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and reread as the next one's
docs. All but the last return the columns of documents.

Defined results: the stages take nulls in any column, empty and very long texts, repeated rows, empty tables and extra
columns as their operators do; see those. A row without text, or without letters, goes in the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.llm import decontam, langid, mixing, neardup, secrets
from spindle.llm.common import discard, materialize

FOLDS = 5
#: Rows of a batch that Spark hands to Python. Ten thousand, its default, are 30 MB of texts and more, held several times on both sides.
BATCH_ROWS = 512
#: DuckDB cannot compress with dictionaries, so the first stage has no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def small_batches(spark: SparkSession) -> None:
    """No more than BATCH_ROWS rows to a batch from now on; what is set lower stays. The setting counts when a stage's result is written, so it is left as it is."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those that the operator rejects go."""
    small_batches(spark)
    return langid.recognised(docs, docs.where(~langid.held_out(F.col("doc_id"), FOLDS)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: that with the smallest id."""
    small_batches(spark)
    return neardup.distinct(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    small_batches(spark)
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret replaced by its kind in brackets; n_chars follows the text."""
    small_batches(spark)
    done = secrets.redact(docs)
    return done.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))) if "n_chars" in docs.columns else done


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to their source's target weight; copy counts from 1."""
    return mixing.mix(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("redact_secrets", redact_secrets),
    ("mix_sources", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        done = materialize(stage(spark, docs, sf_dir))
        discard(docs)  # of the stage before; the table that was read is none of ours
        docs = done
    return docs
