"""Registered queries of the corpus operators, with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidelog.llm import bpe, decontaminate, language_model, line_dedup, minhash, quality_classifier, quality_rules, token_counts, token_files, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file; never copied into the repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract columns of decontaminate.digest: windows of 8 words of every benchmark item against every whole document."""
    return decontaminate.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores and the sample's verdict (kept) of every document; models and k learn from labels."""
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pre-tokens, tokens and unigram log-score of every document, with the 32k piece vocabulary."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), keep=["doc_id"])


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text without its repeated lines (edit similarity 0.8), with the numbers of its lines and of those dropped."""
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), counts=("n_lines", "n_dropped"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract columns of bpe.encoding_digest: ids and decoded text of every whole document as SHA-256, with the 50k byte vocabulary."""
    return bpe.encoding_digest(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract columns of the rules, and the host's verdict (source is the host)."""
    return quality_rules.apply_rules(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_rejected")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract columns and the grammar's total of every document."""
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted", "total")


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract columns of minhash.near_duplicates with shingles of 4 words (the pipeline takes 5)."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=4)


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract columns and bits per byte of every document."""
    return language_model.score_documents(table(spark, sf_dir, "documents"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract columns read back from the token files of all documents, end id 2, written to the shared folder."""
    return token_files.token_file_digest(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": op1_decontamination,
        "op2_quality_classifier": op2_quality_classifier,
        "op3_token_counts": op3_token_counts,
        "op4_line_dedup": op4_line_dedup,
        "op5_bpe": op5_bpe,
        "op6_quality_rules": op6_quality_rules,
        "op7_toxicity": op7_toxicity,
        "op8_minhash": op8_minhash,
        "op9_language_model": op9_language_model,
        "op10_token_files": op10_token_files,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": decontaminate.ORACLE_SQL, "op6_quality_rules": quality_rules.ORACLE_SQL, "op8_minhash": minhash.ORACLE_SQL}
