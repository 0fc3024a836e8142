"""The corpus pipeline: documents to a training mix, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept,
and returns a DataFrame; run() writes each result as Parquet to the shared
folder and reads it again. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import decontaminate, minhash, mixing, quality, secrets
from palimpsest.llm.shared import discard, stored


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Each row is judged by its whole text, also rows of null or repeated ids; null and empty texts get what the bias says.
    An empty table stays empty, here and in all stages, and columns of any other names stay as they are."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the least id: five words, similarity 0.8.

    Null and empty texts link with nothing and stay, as do rows of a null id. Rows of a repeated id are one node, so all
    of them stay or go."""
    return minhash.drop_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a copy of a benchmark item, or a long passage of one, go.

    Null and empty texts hold nothing and stay, as do rows of a null id; of a repeated id all rows go with one of them."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), passage_words=decontaminate.PASSAGE_WORDS)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are masked; every document stays.

    Null texts stay null; rows of null and repeated ids are masked each for itself; n_chars follows a masked text."""
    return secrets.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with their number of copies.

    A null source is a source of its own; texts without words are never taken; rows of repeated and null ids are taken
    each for itself. Where documents have a column of a name that the mix adds, see mixing.mixed_documents."""
    return mixing.mixed_documents(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("near-duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secret scan", secret_stage),
    ("mixing", mixing_stage),
]

#: The classifiers, the forest and the cube method can't be said in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stored(stage(spark, docs, sf_dir), f"stage-{k + 1}")
        if k:
            discard(before)
    return docs
