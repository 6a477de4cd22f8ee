"""The registered queries of the operators: whole tables, production parameters."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flightperf.llm import (decontam, digests, hard_negatives, languages, licenses, line_dedup, neural_lm, phrases, pieces, quality,
                            simhash, token_files, toxicity)
from flightperf.llm.common import documents, fold_column
from flightperf.session import scratch_path

END_ID = 1
HELD_FOLD = 2     # of four, that toxicity and languages are not learned from


def tokenizer_path(name: str) -> str:
    return importlib.import_module("public_tokenizers").path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Co-trained quality scores of every document."""
    docs = documents(spark, sf_dir)
    return quality.scores(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op2_sentencepiece(spark: SparkSession, sf_dir: str, model_file: str | None = None) -> DataFrame:
    """ids, score and decoded text of every document."""
    return pieces.encode_and_decode(documents(spark, sf_dir), model_file or tokenizer_path("piece_bpe_32k.model"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the boilerplate lines of its source."""
    return line_dedup.drop_boilerplate(documents(spark, sf_dir), "source", counts=True).select(
        "doc_id", "text", "n_lines", "n_dropped")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License labels of every document."""
    return licenses.scan(documents(spark, sf_dir))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Improbable-feature digests of every document and its edited text."""
    return digests.digests(documents(spark, sf_dir))


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-bilinear and unigram scores of every document; learned from nine of ten folds."""
    docs = documents(spark, sf_dir)
    return neural_lm.scores(docs, neural_lm.learning_fold()).withColumn(
        "held_out", fold_column("doc_id", neural_lm.FOLDS) == 0)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (document, benchmark item) leak."""
    return decontam.leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(
        "doc_id", "item_id", "n_windows", "item_windows", "n_slots")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score and spans of every document; learned from three of four folds of the labels."""
    docs = documents(spark, sf_dir)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), fold_column("doc_id", 4) != HELD_FOLD)
    return toxicity.scores(docs, model).withColumn("held_out", fold_column("doc_id", 4) == HELD_FOLD)


def op9_token_files(spark: SparkSession, sf_dir: str, tokenizer_file: str | None = None) -> DataFrame:
    """Token files of all documents, written and read back."""
    path = scratch_path(spark, "token-files")
    token_files.write_token_files(documents(spark, sf_dir), path,
                                  tokenizer_file or tokenizer_path("word_bpe_49k.json"), END_ID)
    return token_files.read_digests(spark, path)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.components(documents(spark, sf_dir).select(F.col("doc_id").cast("long"), "text"))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; learned from three of four folds."""
    docs = documents(spark, sf_dir)
    known = languages.train(docs, fold_column("doc_id", 4) != HELD_FOLD)
    return languages.identify(docs, known).withColumn("held_out", fold_column("doc_id", 4) == HELD_FOLD)


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 collocations of every language."""
    return phrases.collocations(documents(spark, sf_dir))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector, a window of scores for each of its positives."""
    return hard_negatives.mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), label=hard_negatives.moved_label())


QUERIES = {
    "op1_quality": op1_quality,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_line_dedup": op3_line_dedup,
    "op4_license_scan": op4_license_scan,
    "op5_fingerprints": op5_fingerprints,
    "op6_language_model": op6_language_model,
    "op7_decontamination": op7_decontamination,
    "op8_toxicity": op8_toxicity,
    "op9_token_files": op9_token_files,
    "op10_simhash": op10_simhash,
    "op11_language_id": op11_language_id,
    "op12_phrases": op12_phrases,
    "op13_hard_negatives": op13_hard_negatives,
}

# Queries that SQL can express; the others are tested against brute force in tests/llm.
SQL = {"op3_line_dedup": line_dedup.sql(), "op7_decontamination": decontam.sql(),
       "op12_phrases": phrases.sql(), "op13_hard_negatives": hard_negatives.sql()}
