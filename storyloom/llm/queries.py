"""One query for each operator, over its whole table, with production parameters; and the pipeline as a query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.llm import decontaminate, html_text, licenses, line_dedup, lm_score, mixing, near_dedup, pii, quality_model, quality_rules, secrets, source_divergence, token_alignment
from storyloom.llm.common import load

#: Stands for a secret that a run takes from its own store.
PII_KEY = "surrogates-1"


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.copies(load(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark")).drop("text_hash")


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(load(spark, sf_dir, "documents"))


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(load(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(load(spark, sf_dir, "documents")).drop("text_hash")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(load(spark, sf_dir, "pages"))


def op7_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.scored(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")).drop("text_hash")


def op8_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.surrogates(load(spark, sf_dir, "documents"), PII_KEY).drop("text_hash")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have no paths: a source is a tree of folders of 1,000 and 100 ids."""
    docs = load(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.col("source"), F.floor(F.col("doc_id") / 1000).cast("string"), F.floor(F.col("doc_id") / 100).cast("string"), F.col("doc_id").cast("string"))
    return licenses.scan(docs.select("doc_id", path.alias("path"), "text"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.judged(load(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule_failed", "host_verdict")


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    found = line_dedup.deduped(line_dedup.build(docs), docs)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.alignment(load(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.audit(load(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_mixing,
        op2_decontamination,
        op3_lm_score,
        op4_simhash_dedup,
        op5_secrets,
        op6_html_text,
        op7_quality_model,
        op8_pii_surrogates,
        op9_licenses,
        op10_quality_rules,
        op11_line_dedup,
        op12_token_alignment,
        op13_source_divergence,
    )
}
