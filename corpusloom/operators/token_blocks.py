"""Token sequences: fixed blocks, masks, padding, and example encoding around a pluggable tokenizer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.operators.corpus import number_rows

IGNORED = -100

# The prompt budgets, in tokens.
COMPLETION_RESERVE = 128
FRAME_RESERVE = 768
LEAST_CONTENT = 256
LEAST_QUERY, MOST_QUERY, QUERY_SHARE = 128, 512, 5
LEAST_CANDIDATE = 24


def blocks(rows: DataFrame, length: int, order: list[str], batch_docs: int | None = None) -> DataFrame:
    """batch, block and tokens: concatenated ``tokens`` cut into blocks of ``length``; what is left over is dropped.

    With ``batch_docs`` documents are concatenated batch by batch and each batch drops its rest; without it
    all documents are one stream, whose offsets are sums over ranges of documents.
    """
    placed = number_rows(rows.withColumn("_all", F.lit(0)), ["_all"], order, "_doc").drop("_all")
    if batch_docs:
        cut = placed.withColumn("batch", F.expr(f"_doc div {batch_docs}")).withColumn("_range", F.lit(0))
    else:
        cut = placed.withColumn("batch", F.lit(0).cast("long")).withColumn("_range", F.expr("_doc div 4096"))
    size = F.size("tokens").cast("long")
    inside = F.sum(size).over(W.partitionBy("batch", "_range").orderBy("_doc").rowsBetween(W.unboundedPreceding, -1))
    sums = cut.groupBy("batch", "_range").agg(F.sum(size).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("batch").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("_n").over(W.partitionBy("batch"))
    offsets = sums.select("batch", "_range", before.alias("_b"), total.alias("_total"))
    at = cut.withColumn("_o", F.coalesce(inside, F.lit(0))).join(offsets, ["batch", "_range"]).withColumn("_o", F.col("_o") + F.col("_b"))
    # Whole slices of documents travel, not tokens.
    first, last = F.expr(f"_o div {length}"), F.expr(f"(_o + size(tokens) - 1) div {length}")
    pieces = at.where("size(tokens) > 0").select("batch", "_o", "_total", "tokens", F.explode(F.sequence(first, last)).alias("block"))
    start = F.greatest(F.lit(0), F.col("block") * length - F.col("_o")).cast("int")
    end = F.least(F.size("tokens").cast("long"), (F.col("block") + 1) * length - F.col("_o")).cast("int")
    whole = pieces.where((F.col("block") + 1) * length <= F.col("_total"))
    part = whole.select("batch", "block", F.struct(F.col("_o"), F.slice("tokens", start + 1, end - start).alias("t")).alias("p"))
    return part.groupBy("batch", "block").agg(F.flatten(F.transform(F.array_sort(F.collect_list("p")), lambda x: x["t"])).alias("tokens"))


def completion_ids(prompt: Column, full: Column, alone: Column) -> Column:
    """What follows the prompt in the full rendering, or the completion encoded alone if the prompt is no prefix."""
    rest = F.slice(full, F.size(prompt) + 1, F.greatest(F.lit(0), F.size(full) - F.size(prompt)))
    return F.when(F.slice(full, 1, F.size(prompt)) == prompt, rest).otherwise(alone)


def example(prompt: Column, completion: Column, max_length: int) -> Column:
    """struct of input_ids, attention_mask and labels; the prompt is cut so that the completion stays whole."""
    room = F.greatest(F.lit(0), F.lit(max_length) - F.size(completion))
    kept = F.slice(prompt, 1, room)
    ids = F.concat(kept, completion)
    return F.struct(
        ids.alias("input_ids"),
        F.array_repeat(F.lit(1), F.size(ids)).alias("attention_mask"),
        F.concat(F.array_repeat(F.lit(IGNORED), F.size(kept)), completion).alias("labels"),
    )


def pad(rows: DataFrame, pad_id: int, batch: str = "batch_id") -> DataFrame:
    """input_ids, attention_mask and labels filled to the longest of their batch."""
    longest = F.max(F.size("input_ids")).over(W.partitionBy(batch))
    fill = lambda c, v: F.concat(c, F.array_repeat(F.lit(v), F.col("_m") - F.size(c))).alias(c)
    rest = [c for c in rows.columns if c not in ("input_ids", "attention_mask", "labels")]
    return rows.withColumn("_m", longest).select(*rest, fill("input_ids", pad_id), fill("attention_mask", 0), fill("labels", IGNORED))


def prompt_budgets(candidates: Column, max_length: int) -> tuple[Column, Column]:
    """Token budgets of the query and of each candidate in a compact prompt, as ``encoding.budgets`` has them."""
    content = max(LEAST_CONTENT, max_length - COMPLETION_RESERVE - FRAME_RESERVE)
    query = min(MOST_QUERY, max(LEAST_QUERY, content // QUERY_SHARE))
    each = F.floor(F.lit(content - query) / F.greatest(F.lit(1), candidates)).cast("int")
    return F.lit(query), F.greatest(F.lit(LEAST_CANDIDATE), each)


def compact_prompt(words: Column, budget: Column) -> Column:
    """The first ``budget`` tokens of a tokenised text, joined again."""
    return F.array_join(F.slice(words, F.lit(1), budget), " ")
