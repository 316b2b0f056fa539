"""The registered queries of the text operators, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallybook.llm import bpe, decontaminate, licences, merkle, mixing, near_join, paragraphs, quality, repeats, resampling, templates, token_files, toxicity
from tallybook.llm.common import table
from tallybook.llm.twins import ORACLES  # noqa: F401
from tallybook.session import scratch_path

VOCABULARY = "word_bpe_49k.json"


def op1_site_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.extract_main_text(table(spark, sf_dir, "pages"))


def op2_toxicity_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_signature_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_join.near_components(table(spark, sf_dir, "documents"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_path(spark, "token-files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), out, public_tokenizers.path(VOCABULARY))
    return token_files.read_token_files(spark, out).select("doc_id", "start", "n_tokens", "ids_crc32")


def op5_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


def op6_quality_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(table(spark, sf_dir, "documents"))


def op8_bpe_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoding_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op9_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op10_paragraph_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.paragraph_clusters(table(spark, sf_dir, "documents"))


def op11_hash_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed, where = merkle.tampered()
    proofs = merkle.verified(merkle.manifest(table(spark, sf_dir, "documents"), changed, where))
    return proofs.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_site_templates, op2_toxicity_trees, op3_signature_tree_join, op4_token_files, op5_positional_index,
        op6_quality_forest, op7_licence_scan, op8_bpe_prefix, op9_repeated_strings, op10_paragraph_bands,
        op11_hash_mixing, op12_merkle_manifest, op13_importance_resampling,
    )
}
