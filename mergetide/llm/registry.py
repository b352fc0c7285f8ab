"""Registered queries of the llm operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mergetide.llm import sql
from mergetide.llm.decontaminate import benchmark_hits
from mergetide.llm.html_main import extract_main
from mergetide.llm.lexical import ranked_search
from mergetide.llm.lsh_forest import near_duplicates
from mergetide.llm.mixing import mix_sources
from mergetide.llm.phrases import phrase_fingerprints
from mergetide.llm.pseudonyms import pseudonymise
from mergetide.llm.quality import quality_rules
from mergetide.llm.recompress import dedup_substrings
from mergetide.llm.spelling import spelling_variants, word_counts
from mergetide.llm.suffixes import repeated_passages
from mergetide.llm.toxicity import toxicity
from mergetide.llm.warc import read_archives, write_archives
from mergetide.sources.shared import cut
from mergetide.sources.tables import table

#: Setting that holds the key of the pseudonyms.  The fallback is for tests and trial runs: it is public, so who knows it can
#: undo what was made with it.
KEY_SETTING, TRIAL_KEY = "spark.mergetide.pseudonymKey", "mergetide"


def pseudonym_key(spark: SparkSession) -> str:
    return spark.conf.get(KEY_SETTING, TRIAL_KEY)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", extract_main(F.col("html")).alias("text"))
    return pages.withColumn("n_chars", F.length("text").cast("long"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = cut(write_archives(table(spark, sf_dir, "pages")), "warc")
    return read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), key=pseudonym_key(spark))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op7_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_substrings(table(spark, sf_dir, "documents"), width=20)
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op8_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=4, threshold=80)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_passages(table(spark, sf_dir, "documents"), width=50)
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"], s["stop"])), ",")
    return found.select("doc_id", "n_repeated", "n_removable", text("spans").alias("spans"), text("removable").alias("removable"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(word_counts(table(spark, sf_dir, "documents")))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


def op13_phrase_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_fingerprints(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # it imports from here

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_quality_rules, op2_html_extraction, op3_decontamination, op4_warc, op5_pii, op6_mixing, op7_recompression, op8_minhash_forest, op9_toxicity,
        op10_suffix_array, op11_spelling_variants, op12_lexical_search, op13_phrase_fingerprints, pipeline,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": sql.OP1, "op4_warc": sql.OP4, "op6_mixing": sql.OP6, "op7_recompression": sql.OP7, "op8_minhash_forest": sql.OP8,
        "op10_suffix_array": sql.OP10, "op11_spelling_variants": sql.OP11, "op12_lexical_search": sql.OP12,
    }
