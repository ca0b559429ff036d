"""The registered queries of this package, with their production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from corpuslens.llm import (
    collocations, embeddings, fingerprints, ngram_join, packing, privacy, quality, runs, token_counts, toxicity, vector_packing, warc,
    word_bpe,
)
from corpuslens.llm.common import tables
from corpuslens.llm.oracles import ORACLES  # noqa: F401

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(tables(spark, sf_dir, "documents"), WORDS)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_bpe.round_trip(tables(spark, sf_dir, "documents"), WORDS)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(tables(spark, sf_dir, "documents"), PIECES)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(tables(spark, sf_dir, "pages"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(tables(spark, sf_dir, "documents"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_documents(tables(spark, sf_dir, "documents"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(tables(spark, sf_dir, "embeddings"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(tables(spark, sf_dir, "documents"), tables(spark, sf_dir, "labels"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(tables(spark, sf_dir, "documents"), tables(spark, sf_dir, "labels"))


def op7_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.private_data(tables(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_digests(tables(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(tables(spark, sf_dir, "documents"))


def op13_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_packing.pack_examples(tables(spark, sf_dir, "documents"), WORDS)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_best_fit_packing, op2_bpe, op3_toxicity, op4_embedding_dedup, op5_quality, op6_token_counts, op7_private_data, op8_warc, op9_ngram_jaccard, op10_fingerprints,
        op11_periodic_runs, op12_collocations, op13_vector_packing)}
