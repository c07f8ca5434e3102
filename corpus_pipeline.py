"""Corpus pipeline: quality, language, repeated passages, near duplicates, packing.

STAGES lists (name, function). A function takes (spark, docs, sf_dir) and returns the documents that its
stage keeps, in the columns of ``docs``; the last returns pieces of packed sequences. Each result is
written as Parquet and read again as the next stage's documents. The stages share one driver, which gives back
what a stage no longer needs (``released``).

Defined results: rows with a null text go with the language stage (no letter); rows with a null doc_id
are never taken for duplicates; extra columns pass through; an empty table stays empty.
"""

from __future__ import annotations

from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import language_id, line_dedup, packing, quality_ranker, simhash_similar
from corpusloom.llm._text import fresh, released, stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents below the cut of the pairwise ranking."""
    model = quality_ranker.fit(docs, table(spark, sf_dir, "labels"))
    released(spark)
    name = fresh(docs, "quality_score")
    scored = quality_ranker.score(docs, model, tuple(docs.columns), name=name)
    return scored.where(F.col(name) >= 0.5).drop(name)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those between two languages."""
    model = language_id.fit(docs)
    released(spark)
    if model is None:
        return docs
    prefix = fresh(docs, "lang_pred")[len("lang_pred") :]
    found = language_id.predict(docs, model, tuple(docs.columns), suffix=prefix)
    sure = (F.col(f"lang_pred{prefix}") != language_id.UNDETERMINED) & ~F.col(f"lang_ambiguous{prefix}")
    return found.where(sure).select(*docs.columns)


def line_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated passages out of the texts; n_chars follows the text."""
    released(spark)
    if "n_chars" not in docs.columns:
        return line_dedup.dedup(docs).select(*docs.columns)
    left = line_dedup.dedup(docs.drop("n_chars"))
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates (five-word shingles, similarity 0.8)."""
    return simhash_similar.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens, every sequence in the mixture of the sources."""
    released(spark)
    definition = Path(public_tokenizers.path("word_bpe_49k.json")).read_text()
    return packing.pack(docs, definition)


STAGES = [
    ("quality_ranker", quality),
    ("language_id", language),
    ("line_dedup", line_passages),
    ("simhash_near_dedup", near_duplicates),
    ("packing", pack),
]

#: Fitted models, rolling hashes and tokenizers have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
