"""A training-data pipeline over the documents table: filters, near duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and returns a table; the runner
writes it as Parquet to the shared folder and reads it back for the next one. All stages but the last return the
columns of documents. Models are fitted on the labelled documents of sf_dir outside the held-out fold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm import ngram_join, packing, privacy, quality, toxicity
from corpuslens.llm.common import stage, tables
from corpuslens.llm.queries import WORDS


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents that the random field calls toxic go."""
    model = toxicity.fit(tables(spark, sf_dir, "documents"), tables(spark, sf_dir, "labels"))
    return toxicity.keep(docs, model)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents that the compression classifier calls bad go."""
    model = quality.fit(tables(spark, sf_dir, "documents"), tables(spark, sf_dir, "labels"))
    return quality.keep(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: of each component the document with the smallest id stays."""
    return ngram_join.keep_first(docs)


def remove_private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: entities and disclosing terms are replaced; n_chars follows the new text."""
    clean = privacy.sanitise(docs)
    length = F.length("text").cast(clean.schema["n_chars"].dataType) if "n_chars" in clean.columns else None
    return clean.withColumn("n_chars", length) if length is not None else clean


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: the documents' token sequences, packed."""
    return packing.pack_documents(docs, WORDS)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("private_data", remove_private_data),
    ("packing", pack),
]

#: The classifiers and the tokenizer can't be written in SQL; tests hold each stage's operator against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables(spark, sf_dir, "documents")
    for i, (name, apply) in enumerate(STAGES):
        docs = apply(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stage(docs, name)
    return docs
