"""The operators over the driver tables: opN_<name>(spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from souq.llm import (alignment, automaton_dedup, class_lm, decontamination, html_wrappers, jaccard_join, license_scan,
                      line_dedup, mixing, quality_rules, spelling, suffix_dedup, token_rollup)
from souq.llm.common import work_folder
from souq.llm.oracles import MIXING, QUALITY_RULES


#: A public byte-level vocabulary; any tiktoken file does.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Folder of the vocabularies to align, read by the driver.
TOKENIZERS = "/opt/tokenizers"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hits.select(F.col("key").alias("doc_id"), "item_id", "score", "question_overlap", "answer_overlap")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.dedup(docs, removed_lines="n_removed_lines")
    return out.select("doc_id", "n_removed_lines", F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint")
                      .alias("n_bytes"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op3_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = html_wrappers.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return text.select("page_id", "url", "text", "n_chars")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("key").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeats(table(spark, sf_dir, "documents")).withColumnRenamed("key", "doc_id")


def op6_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after loading all documents, a replay of that batch (without effect) and a takedown of toxic ones."""
    docs = table(spark, sf_dir, "documents")
    rollup = token_rollup.TokenRollup(spark, work_folder(spark, "rollup"), TOKENIZER, "byte_bpe_50k")
    rollup.commit("load", docs)
    rollup.commit("load", docs)
    rollup.commit("takedown", token_rollup.takedown(docs, table(spark, sf_dir, "labels")), op="op")
    return rollup.totals()


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mixing.mix(table(spark, sf_dir, "documents"))
    return m.select(F.col("key").alias("doc_id"), "size", "source_size", "target", "taken")


def op8_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.score(table(spark, sf_dir, "documents")).withColumnRenamed("key", "doc_id")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    j = quality_rules.judge(d, prefix="")
    return j.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    "base_failed", "kept", "n_lines", "n_removed")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(table(spark, sf_dir, "documents"))
    return found.select(F.col("key").alias("doc_id"), "line", "license", "reduction", "n_missing", "n_added",
                        "exact", "missing", "added")


def op11_automaton_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = automaton_dedup.dedup(table(spark, sf_dir, "documents"))
    return out.select(F.col("key").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_token_alignment(spark: SparkSession, sf_dir: str, folder: str = TOKENIZERS) -> DataFrame:
    out = alignment.align(table(spark, sf_dir, "documents"), f"{folder}/byte_bpe_50k.json", f"{folder}/piece_bpe_32k.model")
    return out.withColumnsRenamed({"key": "doc_id", "groups": "groups_sha256"})


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_line_dedup": op2_line_dedup,
    "op3_html_wrappers": op3_html_wrappers,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_token_rollup": op6_token_rollup,
    "op7_source_mixing": op7_source_mixing,
    "op8_class_lm": op8_class_lm,
    "op9_quality_rules": op9_quality_rules,
    "op10_license_scan": op10_license_scan,
    "op11_automaton_dedup": op11_automaton_dedup,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_token_alignment": op13_token_alignment,
}

ORACLES = {
    "op7_source_mixing": MIXING,
    "op9_quality_rules": QUALITY_RULES,
}
