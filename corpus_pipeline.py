"""Corpus pipeline over ``documents``: toxicity, near-duplicates, benchmark passages, personal data, mixing.

Every stage takes ``(spark, docs, sf_dir)``, works on all rows of ``docs`` and returns a DataFrame, which is written as
Parquet and read again as the next stage's ``docs``.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mergetide.llm.decontaminate import without_benchmark
from mergetide.llm.lsh_forest import near_duplicates
from mergetide.llm.mixing import mix_sources
from mergetide.llm.pseudonyms import pseudonymise
from mergetide.llm.registry import pseudonym_key
from mergetide.llm.toxicity import without_toxic
from mergetide.sources.shared import cut
from mergetide.sources.tables import table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored toxic by the machine of op9 go."""
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked at 0.8 on five-word shingles the one with the smallest id stays."""
    gone = near_duplicates(docs, k=5, threshold=80).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, edits included, go."""
    return without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes pseudonyms; ``n_chars`` follows the text where it changed."""
    count = "n_replaced"
    while count in docs.columns:
        count += "_"
    done = pseudonymise(docs, pseudonym_key(spark), count_col=count)
    done = done.withColumn("n_chars", F.when(F.col(count) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return done.select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: one row per document of which words are taken, with its words and those taken, repeats included."""
    return mix_sources(docs).where("taken > 0")


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
]

#: No SQL: the first three stages are a trained model, a randomised search and an edit distance.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
