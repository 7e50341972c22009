"""The registered corpus queries and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, exact_dedup, html_text, licenses, mixing, order_minhash, pii, quality, simhash, token_counts
from .common import table


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of all documents, and what they decode to, as digests."""
    return bpe.digests(table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash near-duplicates of all documents."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    return quality.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order MinHash fingerprints of all documents and of their edited texts."""
    return order_minhash.fingerprints(table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts of all documents."""
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The license that covers each document best."""
    return licenses.best(table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with surrogates for personal data, keyed by the session's setting."""
    return pii.replace(table(spark, sf_dir, "documents"), spark.conf.get(pii.KEY_SETTING, pii.KEY))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents by source."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_text": op1_html_text,
    "op2_bpe": op2_bpe,
    "op3_simhash": op3_simhash,
    "op4_quality": op4_quality,
    "op5_order_minhash": op5_order_minhash,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_licenses": op7_licenses,
    "op8_pii": op8_pii,
    "op9_token_counts": op9_token_counts,
    "op10_mixing": op10_mixing,
}
ORACLE: dict[str, str] = {"op6_exact_dedup": exact_dedup.ORACLE, "op10_mixing": mixing.ORACLE}
