"""One query for each operator, over its whole table, with production parameters."""

from __future__ import annotations

from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from corpusloom.llm import language_id, line_dedup, packing, quality_ranker, quality_rules, sentencepiece_wfst, simhash, topk_search, toxicity, url_filter
from corpusloom.llm._text import fold, table


def op1_quality_ranker(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality_ranker.fit(docs, labels.where(fold(F.col("doc_id"), 3) != 1))
    scored = quality_ranker.score(docs, model)
    return scored.select(
        "doc_id",
        (fold(F.col("doc_id"), 3) == 1).alias("held_out"),
        F.col("quality_score").alias("score"),
        (F.col("quality_score") >= 0.5).cast("int").alias("predicted"),
    )


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(fold(F.col("doc_id"), 4) != 2))
    scored = toxicity.score(docs, model)
    return scored.select(
        "doc_id",
        (fold(F.col("doc_id"), 4) == 2).alias("held_out"),
        F.col("toxic_score").alias("score"),
        (F.col("toxic_score") >= 0.3).cast("int").alias("predicted"),
    )


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_removed", "removed_chars", F.length("text").cast("long").alias("kept_chars"), F.md5("text").alias("text_md5"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP6_RULES = (
    url_filter.UrlRule("allow", "org", "/"),
    url_filter.UrlRule("block", "example.org", "/es/"),
    url_filter.UrlRule("block", "example.org", "/en/1"),
    url_filter.UrlRule("allow", "com", "/fr/"),
    url_filter.UrlRule("block", "com", "/de/"),
)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), OP6_RULES, url_filter.fit(spark)).select("page_id", "host", "path", "rule", "verdict")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    definition = Path(public_tokenizers.path("word_bpe_49k.json")).read_text()
    return packing.pack(table(spark, sf_dir, "documents"), definition).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op8_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topk_search.quantised(table(spark, sf_dir, "embeddings"))
    return topk_search.top_k(rows, rows.where(F.col("vec_id") % 50 == 0), 5)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(fold(F.col("doc_id"), 5) != 0))
    found = language_id.predict(docs, model)
    return found.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), "lang_ambiguous")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = Path(public_tokenizers.path("piece_bpe_32k.model")).read_bytes()
    return sentencepiece_wfst.encode(table(spark, sf_dir, "documents"), model, ids=False, digest=True)


QUERIES = {
    "op1_quality_ranker": op1_quality_ranker,
    "op2_toxicity": op2_toxicity,
    "op3_simhash": op3_simhash,
    "op4_line_dedup": op4_line_dedup,
    "op5_quality_rules": op5_quality_rules,
    "op6_url_filter": op6_url_filter,
    "op7_packing": op7_packing,
    "op8_topk_search": op8_topk_search,
    "op9_language_id": op9_language_id,
    "op10_sentencepiece": op10_sentencepiece,
}
