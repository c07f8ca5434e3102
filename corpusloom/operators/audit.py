"""One-pass profile of raw issue rows against two membership lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T


def prepare(rows: DataFrame, train: DataFrame, heldout: DataFrame) -> DataFrame:
    """``rows`` with t, d (squeezed title and description), n_words, text_hash, in_train, in_test and what the lists say."""
    side = lambda df, n: df.select("key", F.struct("source_id", "created").alias(n))
    joined = rows.join(side(train, "_a"), "key", "left").join(side(heldout, "_b"), "key", "left")
    cut = joined.withColumn("t", T.squeeze(F.col("title"))).withColumn("d", T.squeeze(F.col("description")))
    folded = cut.withColumn("_n", T.casefold(F.concat_ws("\n", "t", "d"))).withColumn("_ft", T.casefold("t")).withColumn("_fd", T.casefold("d"))
    return folded.select("*", T.word_count(F.concat_ws(" ", "t", "d")).alias("n_words"), F.sha2("_n", 256).alias("text_hash"), F.col("_a").isNotNull().alias("in_train"), F.col("_b").isNotNull().alias("in_test"))


def profile(prepared: DataFrame, cutoff_date: str) -> DataFrame:
    """One row of counts."""
    train, test, day = F.col("in_train"), F.col("in_test"), F.substring("created", 1, 10)
    off = lambda side: (F.col(f"{side}.source_id") != F.col("source_id")) | (F.col(f"{side}.created") != F.col("created"))
    count = {
        "malformed_timestamp_shape": ~F.rlike("created", F.lit(r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d$")),
        "train_rows": train,
        "test_rows": test,
        "unassigned_rows": ~train & ~test,
        "train_empty_title": train & (F.col("t") == ""),
        "train_empty_description": train & (F.col("d") == ""),
        "train_description_equals_title": train & (F.col("_ft") == F.col("_fd")),
        "train_description_placeholder": train & F.col("_fd").isin([p for p in T.PLACEHOLDERS if p]),
        "train_words_at_most_5": train & (F.col("n_words") <= 5),
        "train_issue_key_pattern": train & F.rlike("_n", F.lit(r"(?iU)\b[a-z][a-z0-9_]{1,20}-\d+\b")),
        "train_url_pattern": train & F.rlike("_n", F.lit(r"(?i)https?://|www\.")),
        "train_rows_after_cutoff": train & (day > cutoff_date),
        "train_id_or_date_mismatch": train & off("_a"),
        "test_rows_on_or_before_cutoff": test & (day <= cutoff_date),
        "test_id_or_date_mismatch": test & off("_b"),
    }
    return prepared.agg(
        F.count("*").alias("rows"),
        (F.count("*") - F.count_distinct("key")).alias("duplicate_issue_key_rows"),
        *(F.count_if(c).alias(n) for n, c in count.items()),
        F.min("created").alias("min_created"),
        F.max("created").alias("max_created"),
    )


def overlaps(prepared: DataFrame) -> DataFrame:
    """Unique train texts, repeats beyond the first, texts shared with test, and the train rows that share them."""
    per = prepared.groupBy("text_hash").agg(F.count_if("in_train").alias("a"), F.count_if("in_test").alias("b"))
    shared = (F.col("a") > 0) & (F.col("b") > 0)
    total = lambda c, v: F.coalesce(F.sum(F.when(c, v)), F.lit(0))
    return per.agg(
        F.count_if(F.col("a") > 0).alias("train_unique_exact_texts"),
        total(F.col("a") > 0, F.col("a") - 1).alias("train_duplicate_text_extra_rows"),
        F.count_if(shared).alias("exact_text_groups_shared_train_test"),
        total(shared, F.col("a")).alias("train_rows_matching_test_text"),
    )


def word_quantiles(prepared: DataFrame, shares: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """Total, maximum and the values at places int(n * share) of the ascending word counts of the train rows.

    Counts are grouped first; the ordered table has one row for each distinct length.
    """
    from pyspark.sql import Window as W

    per = prepared.where("in_train").groupBy("n_words").agg(F.count("*").alias("c"))
    run = per.withColumn("upto", F.sum("c").over(W.orderBy("n_words"))).crossJoin(F.broadcast(per.agg(F.sum("c").alias("n"))))
    at = [F.min(F.when(F.col("upto") > F.floor(F.col("n") * q), F.col("n_words"))).alias(f"p{round(q * 100)}") for q in shares]
    return run.agg(F.sum(F.col("n_words") * F.col("c")).alias("total"), *at, F.max("n_words").alias("max"))
