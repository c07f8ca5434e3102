"""Deterministic sampling, mixtures, plan arithmetic and finite stream combinators."""

from __future__ import annotations

import hashlib
import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions.hashing import sha256, stable_fraction
from corpusloom.operators.corpus import number_rows


def keep_pointwise(label: Column, query_id: Column, candidate: Column, seed: int, share: float) -> Column:
    """Positives, and negatives by the stable fraction of their key."""
    return (label == 1) | (stable_fraction(F.concat_ws(":", F.lit(str(seed)), query_id, candidate)) < share)


def keep_set(gold: Column, query_id: Column, seed: int, share: float) -> Column:
    """Records with gold labels, and those without by the stable fraction of their key."""
    return (F.size(gold) > 0) | (stable_fraction(F.concat_ws(":", F.lit(str(seed)), query_id)) < share)


def balanced_selector(rows: DataFrame, order: list[str], share: float, seed: int, repository: str, total: int | None = None) -> DataFrame:
    """All positives (label 1) and exactly round(share * negatives) negatives, spread evenly in the given order.

    The running remainder of the i-th negative is a floor of a multiple, so rows need only their position.
    """
    negatives = rows.where("label = 0")
    n = negatives.count() if total is None else total
    target = round(share * n)
    if target >= n:
        return rows
    phase = int(hashlib.sha256(f"{seed}:{repository}:pointwise-negative-phase".encode()).hexdigest()[:16], 16) % n
    placed = number_rows(negatives.withColumn("_all", F.lit(0)), ["_all"], order, "_i").drop("_all")
    exact = lambda k: F.expr(f"({phase}L + (_i + {k}) * {target}L) div {n}L")
    return rows.where("label = 1").unionByName(placed.where(exact(1) > exact(0)).select(*rows.columns))


def mixture_weights(sizes: DataFrame, temperature: float) -> DataFrame:
    """repository, n and weight = n**t / sum(n**t)."""
    if not 0 <= temperature <= 1:
        raise ValueError("temperature must lie between 0 and 1")
    power = F.pow(F.col("n").cast("double"), F.lit(float(temperature)))
    total = sizes.agg(F.sum(power.cast("decimal(28,9)")).cast("double").alias("_t"))
    return sizes.crossJoin(F.broadcast(total)).select("repository", "n", (power / F.col("_t")).alias("weight"))


def step_plan(manifests: DataFrame, share: float, batch: int, accumulation: int) -> DataFrame:
    """records and max_steps of an exhaustive pass over (repository, total, positives), with its intervals."""
    retained = F.col("positives") + F.bround(F.lit(float(share)) * (F.col("total") - F.col("positives")), 0).cast("long")
    records = manifests.agg(F.sum(retained).alias("records"))
    steps = F.ceil(F.col("records") / (batch * accumulation)).cast("long")
    evals = F.greatest(F.lit(250), F.ceil(F.col("max_steps") / 20).cast("long"))
    return records.select("records", steps.alias("max_steps")).select(
        "*", F.greatest(F.lit(10), F.ceil(F.col("max_steps") / 1000).cast("long")).alias("logging_steps"), evals.alias("eval_steps"), F.least(F.lit(1000), evals).alias("save_steps")
    )


def shuffled(rows: DataFrame, key: Column, seed: int) -> DataFrame:
    """A deterministic global order by a seeded hash of the key (a range sort, no buffer)."""
    return rows.orderBy(sha256(F.concat_ws(":", F.lit(str(seed)), key)), key)


def concatenate(sources: list[DataFrame]) -> DataFrame:
    """Every row of every source once, with its source number."""
    return reduce(DataFrame.unionByName, (s.withColumn("source_no", F.lit(i)) for i, s in enumerate(sources)))


def round_robin(sources: list[DataFrame], order: list[str]) -> DataFrame:
    """One row of each source in turn, in each one's order, until the first is exhausted; position is 0-based."""
    numbered = concatenate([number_rows(s.withColumn("_all", F.lit(0)), ["_all"], order, "_turn").drop("_all") for s in sources])
    shortest = min((s.count() for s in sources), default=0)
    return numbered.where(F.col("_turn") < shortest).withColumn("position", F.col("_turn") * len(sources) + F.col("source_no")).drop("_turn")


def weighted_interleave(sources: list[DataFrame], weights: list[float], order: list[str], repeats: bool = True) -> DataFrame:
    """Sources mixed in the given proportions until all are exhausted.

    The k-th row of a source stands at (k + 1/2) / weight; sources that end early start again (``repeats``),
    as often as the slowest needs.
    """
    sizes = [s.count() for s in sources]
    if not all(sizes):
        raise ValueError("a source without rows cannot be repeated")
    length = max(n / w for n, w in zip(sizes, weights, strict=True))
    parts = []
    for i, (s, n, w) in enumerate(zip(sources, sizes, weights, strict=True)):
        turns = math.ceil(length * w / n - 1e-9) if repeats else 1
        placed = number_rows(s.withColumn("_all", F.lit(0)), ["_all"], order, "_k").drop("_all")
        again = placed.withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(max(1, turns) - 1))))
        at = (F.col("_k") + F.col("_r") * n + 0.5) / w
        parts.append(again.withColumn("at", at).where(F.col("at") <= length).withColumn("source_no", F.lit(i)).drop("_k", "_r"))
    return reduce(DataFrame.unionByName, parts).orderBy("at", "source_no")


def take(rows: DataFrame, n: int, order: list[str]) -> DataFrame:
    return rows.orderBy(*order).limit(n)


def runs(rows: DataFrame, key: str, partition: list[str], order: list[str]) -> DataFrame:
    """Adds run: the number of the stretch of equal ``key`` values, within a partition, in the given order."""
    w = W.partitionBy(*partition).orderBy(*order)
    new = F.when(F.lag(key).over(w).eqNullSafe(F.col(key)) & F.lag(F.lit(1)).over(w).isNotNull(), 0).otherwise(1)
    return rows.withColumn("_new", new).withColumn("run", F.sum("_new").over(w)).drop("_new")
