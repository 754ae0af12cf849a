"""From raw documents to a training mix: language, near duplicates, benchmark leaks, secrets, source weights.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet in the cluster's
shared folder and reads it back as the next stage's docs, so a lost executor costs one stage at most. All stages but the
last return the columns of documents. Null and empty texts leave at the first stage, which knows no language for them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import bagminhash, budget_mix, decontam_cgk, lang_crf, secret_markov
from siltstone.llm.common import shared_dir, table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts whose language the field names with a score of 0.5 or more, and those whose words each fit one of its languages."""
    return lang_crf.keep_known(docs, lang_crf.train(docs))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, that of the smallest doc_id."""
    return bagminhash.keep_one(docs)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam_cgk.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked and n_chars counted anew."""
    return secret_markov.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with how often and how many words of each."""
    return budget_mix.mix(docs).filter("repeats > 0").withColumn("taken", F.col("size") * F.col("repeats"))


STAGES = [
    ("language ID", known_language),
    ("MinHash near-dedup", one_of_each),
    ("benchmark decontamination", without_leaks),
    ("secret scans", without_secrets),
    ("mixing sources to target weights", mixed),
]
#: No stage but the last two can be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = shared_dir(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
