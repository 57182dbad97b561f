"""A corpus from raw documents to a training mix: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import fold_of, staged
from millrace.llm.decontamination import drop_leaks
from millrace.llm.language import learning_rows
from millrace.llm.mixing import mix_sources
from millrace.llm.near_duplicates import drop_near_duplicates
from millrace.llm.secret_scan import redact_secrets
from millrace.llm.toxicity import fit_toxicity, score_toxicity

#: A stage can not be expressed in SQL (a trained network); the operators behind the stages have tests of their own.
ORACLE_SQL: str | None = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half; the network learns from the labelled documents of the stage's input."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit_toxicity(docs, labels.filter(learning_rows(fold_of(F.col("doc_id")))))
    return score_toxicity(docs, model, into="_toxicity").filter("_toxicity < 0.5").drop("_toxicity")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity of 0.8 or more)."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts masked; ``n_chars`` follows the text."""
    redacted = redact_secrets(docs)
    return redacted.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else redacted


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document, of those it takes any."""
    return mix_sources(docs, [5, 2, 1]).filter("taken > 0")


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("mixing", mixing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"corpus-{name}")
    return docs
