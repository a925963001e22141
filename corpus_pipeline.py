"""A corpus pipeline of five stages, each by one operator of ``codestrata.llm``.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept.  All but the last return the columns
of ``documents``; the last returns the tokens.  Stages keep their own memory of nothing: what passes between them is
written as Parquet to the folder that driver and executors share, and read again.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.llm import decontaminate, language_id, ngram_join, piece_codec, quality
from codestrata.session import own_folder, shared_dir, ship, table

#: A document stays with a language if the calibrated probability of that language is at least this.
LEAST_LANGUAGE_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter (null and empty texts too), and those whose language stays in doubt; without any
    labelled row that is all of them.  Repeated rows share their fate; a score of just the limit stays."""
    ship(spark)
    model = language_id.fit(docs, F.col("doc_id").isNotNull())
    return language_id.keep_sure(docs, model, LEAST_LANGUAGE_SCORE)


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects what the plain counts or the divergence of histograms fail: null, empty and very short texts too; a document of
    no language is compared to all.  Repeated rows share their fate; a distance of just the limit stays."""
    ship(spark)
    shared_dir(spark)
    return quality.keep_good(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of similar ones, that with the least id; texts without a word all stay, and of rows
    equal in id and text one does."""
    ship(spark)
    shared_dir(spark)
    return ngram_join.keep_one(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold a benchmark item, whole or edited; null and empty texts hold none, and null and empty items
    are in none.  Repeated rows share their fate."""
    ship(spark)
    shared_dir(spark)
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``n_tokens``, token ``ids``, and ``round_trip``: whether decoding them gives the text back."""
    ship(spark)
    return piece_codec.encode_checked(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", identify_language),
    ("quality rules", apply_quality_rules),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("SentencePiece encoding and decoding", encode_pieces),
]

#: The stages' models and alignments have no form in SQL; tests hold them against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``."""
    folder = own_folder(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
