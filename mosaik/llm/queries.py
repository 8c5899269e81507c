"""The queries of this subpackage, by the names under which __spark_entry__.py registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, html_text, lm_scoring, merkle, mixing, packing, quality, sharding, simhash, storage, substrings, token_files, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a passage of a benchmark item, with that item."""
    return decontaminate.overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen shards of documents, as even in bytes as whole groups of equal texts allow."""
    return sharding.laid_out(_table(spark, sf_dir, "documents"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much more every document looks like conversation than like documents at large."""
    import public_tokenizers

    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return lm_scoring.cross_entropy_difference(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "conversations"), tokenizer)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix of sources takes of every document."""
    return mixing.taken(_table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learned from the labels that are not held out."""
    docs = _table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.trained(docs, _table(spark, sf_dir, "labels")))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extracted(_table(spark, sf_dir, "pages"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, written to files and read back from them."""
    import public_tokenizers

    path = storage.new_path(spark, "tokens")
    token_files.write_tokens(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read_documents(spark, path)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of line-first cleaning for every document."""
    q = [f"q.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")]
    return quality.measured(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("row.doc_id", *q)


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the passages that a document before it has."""
    return substrings.removed(_table(spark, sf_dir, "documents"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, and whether the document as it is seen verifies."""
    return merkle.lower_cased(_table(spark, sf_dir, "documents"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2,048 tokens, read back from the sequences."""
    import public_tokenizers

    path = storage.new_path(spark, "packed")
    packing.write_packed(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return packing.read_pieces(spark, path)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_simhash": op2_simhash,
    "op3_sharding": op3_sharding,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_mixing": op5_mixing,
    "op6_toxicity": op6_toxicity,
    "op7_html_text": op7_html_text,
    "op8_token_files": op8_token_files,
    "op9_quality": op9_quality,
    "op10_substrings": op10_substrings,
    "op11_merkle": op11_merkle,
    "op12_packing": op12_packing,
}

ORACLE_SQL: dict[str, str] = {
    "op9_quality": quality.SQL,
    "op11_merkle": merkle.SQL,
}
