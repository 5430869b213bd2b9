"""The registered queries of the subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pairforge.llm import (
    bpe, byte_dedup, decontaminate, filter_audit, fingerprint, html_extract, langid, license_scan, minhash_dedup, pii, prefix_trie,
    secret_scan, substring_dedup,
)
from pairforge.llm.inputs import VOCABULARY, documents, table
from pairforge.llm.oracles import ORACLES  # noqa: F401


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document."""
    coded = bpe.encode_decode(documents(spark, sf_dir), VOCABULARY)
    return coded.select("doc_id", *bpe.digests(coded))


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near-duplicate documents."""
    return minhash_dedup.near_duplicates(documents(spark, sf_dir))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return pii.find_personal_data(documents(spark, sf_dir)).select("doc_id", *pii.digests())


def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle fingerprints of every document and of its edited text."""
    return fingerprint.compare_edited(documents(spark, sf_dir))


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    found = html_extract.extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices in every document."""
    found = license_scan.scan(documents(spark, sf_dir))
    names = F.array_join(F.transform("found", lambda f: f.license), ",")
    return found.select("doc_id", "n_words", F.size("found").cast("long").alias("n_licenses"), names.alias("licenses"))


def op6_byte_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document in strings of 200 bytes that start twice."""
    cut = byte_dedup.remove_repeats(documents(spark, sf_dir))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", byte_dedup.kept_digest())


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    found = langid.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in every document."""
    found = decontaminate.find_benchmark(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", *decontaminate.summary())


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that a smaller document has in a window of 13."""
    cut = substring_dedup.remove_repeats(documents(spark, sf_dir))
    return cut.select("doc_id", "n_words", "n_removed", substring_dedup.kept_digest())


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return secret_scan.find_secrets(documents(spark, sf_dir)).select("doc_id", *secret_scan.digests())


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interaction of five filters over every document, by language."""
    return filter_audit.audit(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), table(spark, sf_dir, "labels"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix trie of every rebuilt conversation."""
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


QUERIES = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_pii": op2_pii,
    "op3_fingerprint": op3_fingerprint,
    "op4_html_extract": op4_html_extract,
    "op5_license_scan": op5_license_scan,
    "op6_byte_dedup": op6_byte_dedup,
    "op7_language_id": op7_language_id,
    "op9_decontaminate": op9_decontaminate,
    "op10_substring_dedup": op10_substring_dedup,
    "op8_bpe": op8_bpe,
    "op11_secret_scan": op11_secret_scan,
    "op12_filter_audit": op12_filter_audit,
    "op13_prefix_trie": op13_prefix_trie,
}
