"""The operators' registered queries over the given tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import read_table
from . import divergence, html_paths, license_scan, mixing, packing, prefix_trie, prob_minhash, quality_risk, repair_tokens, rp_forest, simhash, suffix_dedup, toxicity
from .common import ready


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each document that stand in an earlier one as 50-byte strings."""
    docs = read_table(spark, sf_dir, "documents")
    return suffix_dedup.dedup_report(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels outside the held-out fold."""
    docs = read_table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", "held_out", "score", "predicted")


def op3_html_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_paths.extract(read_table(spark, sf_dir, "pages"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents packed into sequences of 2048 ids."""
    return packing.pack_documents(read_table(spark, sf_dir, "documents"))


def op5_repair_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, written and read back."""
    return repair_tokens.write_and_read(read_table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that the mix of all sources takes."""
    return mixing.report(read_table(spark, sf_dir, "documents"))


def op7_quality_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality counts and verdict of every document."""
    return quality_risk.judge(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License texts found in every document."""
    return license_scan.scan(read_table(spark, sf_dir, "documents"))


def op9_prob_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document (its smallest doc_id)."""
    classes, _links = prob_minhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return classes


def op10_rp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors found for every vector whose id is divisible by 20."""
    return rp_forest.nearest(read_table(spark, sf_dir, "embeddings"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of each language are apart, and by which terms."""
    return divergence.report(read_table(spark, sf_dir, "documents"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of all rebuilt conversations."""
    return prefix_trie.report(read_table(spark, sf_dir, "conversations"))


#: name -> (query, DuckDB SQL or None)
REGISTRY = {
    "op1_suffix_dedup": (op1_suffix_dedup, None),
    "op2_toxicity": (op2_toxicity, None),
    "op3_html_paths": (op3_html_paths, None),
    "op4_packing": (op4_packing, None),
    "op5_repair_tokens": (op5_repair_tokens, None),
    "op6_mixing": (op6_mixing, mixing.SQL),
    "op7_quality_risk": (op7_quality_risk, quality_risk.SQL),
    "op8_license_scan": (op8_license_scan, license_scan.SQL),
    "op9_prob_minhash": (op9_prob_minhash, None),
    "op10_rp_forest": (op10_rp_forest, None),
    "op11_divergence": (op11_divergence, divergence.SQL),
    "op12_simhash": (op12_simhash, None),
    "op13_prefix_trie": (op13_prefix_trie, prefix_trie.SQL),
}


def queries() -> dict:
    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ready(spark)
            return fn(spark, sf_dir)
        return run
    return {name: wrap(fn) for name, (fn, _sql) in REGISTRY.items()}


def oracle_sql() -> dict:
    return {name: sql for name, (_fn, sql) in REGISTRY.items() if sql is not None}
