"""The training-data pipeline: toxicity, near duplicates, benchmark passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the
next one's docs. All stages but the last return the columns of docs, in their order; further columns of any name pass
through as they are.

Defined results. Null and empty texts are clean of all that is looked for, are no near duplicates of anything, and are
packed as one piece of the end id. A null doc_id is an id like others; of a class of near duplicates the least id that is
not null stays, of rows with equal ids the one of the least text hash, of rows equal in both one. Rows without words all
stay. Null labels teach nothing; without labels of both kinds the score is the rate of label 1. Empty tables
give empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from escalade.llm import decontamination, jaccard_join, packing, pii, toxicity
from escalade.llm.common import saved, table


def clean_of_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled examples vote clean."""
    model = toxicity.fit_on(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_docs(docs, model, out="__toxicity").where(F.col("__toxicity.score") < 0.5).select(*docs.columns)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of the Jaccard join."""
    return jaccard_join.one_of_each_class(docs)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return decontamination.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def without_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows the text."""
    out = pii.redact(docs.withColumn("__before", F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text") != F.col("__before"), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def best_fit_packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=0)


STAGES = [
    ("toxicity", clean_of_toxicity),
    ("near_duplicates", one_of_near_duplicates),
    ("decontamination", clean_of_benchmark),
    ("pii", without_pii),
    ("packing", best_fit_packed),
]

#: Nearest-neighbour votes and byte-pair encoding have no SQL; tests compare run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
