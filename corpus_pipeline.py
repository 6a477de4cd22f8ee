"""The training-data pipeline: quality classifier, line dedup, SimHash near-dedup, benchmark
decontamination, SentencePiece encoding and decoding.

Each stage takes (spark, docs, sf_dir) and is written as Parquet before the next one reads it.
All but the last return the columns of documents. Edge cases are those of the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flightperf.llm import decontam, line_dedup, pieces, quality, simhash
from flightperf.llm.common import documents, few_rows_a_batch, written
from flightperf.llm.queries import tokenizer_path

PIECES = "piece_bpe_32k.model"


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier keeps."""
    few_rows_a_batch(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.train(docs, labels))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the boilerplate lines of their source (n_chars stays that of the input)."""
    return line_dedup.drop_boilerplate(docs, "source")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the smallest doc_id."""
    few_rows_a_batch(spark)
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    return decontam.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids, score and decoded text of every document that is left."""
    few_rows_a_batch(spark)
    return pieces.encode_and_decode(docs, tokenizer_path(PIECES), ("doc_id", "lang", "source"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup_stage),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("sentencepiece", tokenize),
]

# The classifier and the piece search have no SQL; tests/llm checks the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each but the last written and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
