"""A corpus pipeline: language ID, quality rules, near copies, secret scans, packing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from hyperloom.llm import jaccard, langid, packing, quality_rules, secret_scan


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or in no learned language, go."""
    return langid.keep_languages(docs, langid.learn(docs))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep_quality(docs, quality_rules.references(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the document with the least id stays."""
    return jaccard.one_of_each(docs)


def secrets_masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay, their secrets masked; `n_chars` follows the new text."""
    return secret_scan.mask_secrets(docs, "text", "n_chars")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packing.pack_documents(docs)


STAGES = [("language_id", language_id), ("quality_rules", quality), ("ngram_jaccard", near_copies), ("secret_scans", secrets_masked), ("best_fit_packing", packed)]

#: SQL has no n-gram filter, no tokenizer and no packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over `documents`, each written to the shared folder before the next."""
    from hyperloom.llm.columnar import settled

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = len(STAGES) - 1
    return reduce(lambda df, stage: stage[1][1](spark, df, sf_dir) if stage[0] == last else settled(stage[1][1](spark, df, sf_dir)), enumerate(STAGES), docs)
