"""One query for each operator: its production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import langid, licenses, media, merkle, mixing, neardup, pieces, quality, repeats, secrets, syncmers, toxicity, urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from those that aren't held out."""
    return langid.predict_documents(table(spark, sf_dir, "documents"))


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document, by a new ledger."""
    return secrets.scan_documents(table(spark, sf_dir, "documents"))


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, and their likeness."""
    return syncmers.fingerprint_documents(table(spark, sf_dir, "documents"))


def op4_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as telephony audio, read back and digested."""
    return media.store_texts(table(spark, sf_dir, "documents"))


def op5_mix_to_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixing.mix_documents(table(spark, sf_dir, "documents"))


def op6_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of every document."""
    return pieces.segment_documents(table(spark, sf_dir, "documents"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on the url of every page, by rules and the tree that rated documents teach."""
    return urls.judge_pages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op8_hyperminhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate component of every document."""
    return neardup.dedup_documents(table(spark, sf_dir, "documents"))


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence of every document, its own or its directory's."""
    return licenses.scan_documents(table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade of every document and whether it is kept."""
    return quality.rate_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from the labelled ones that aren't held out."""
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash, proof and check of every document in a tree for each language under one root."""
    return merkle.prove_documents(table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words of every document, and its text without their repetitions."""
    told = repeats.run_documents(table(spark, sf_dir, "documents"), listed=("start", "length", "period"))
    return told.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_secret_scans": op2_secret_scans,
    "op3_document_fingerprints": op3_document_fingerprints,
    "op4_telephony_audio": op4_telephony_audio,
    "op5_mix_to_weights": op5_mix_to_weights,
    "op6_sampled_pieces": op6_sampled_pieces,
    "op7_url_filters": op7_url_filters,
    "op8_hyperminhash_near_dedup": op8_hyperminhash_near_dedup,
    "op9_license_scans": op9_license_scans,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_toxicity": op11_toxicity,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_periodic_runs": op13_periodic_runs,
}
ORACLES: dict[str, str] = {"op7_url_filters": urls.oracle(), "op12_merkle_manifest": merkle.oracle()}
