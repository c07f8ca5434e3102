"""Checks of an exported corpus. Each returns the rows that break it; an export is sound if all are empty.

``documents`` has split, shard, row_index and text; ``provenance`` beside it issue_uid, text_hash,
group_hash, split, shard, row_index and dedup_aliases; ``ledger`` issue_uid, representative_uid, text_hash and
group_hash (split too); ``canonical`` is :func:`corpus.build` with uid, membership, text, text_hash, desc_hash,
created, reason and split.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions.hashing import group_split, sha256

PLACE = ["split", "shard", "row_index"]


def violations(documents: DataFrame, provenance: DataFrame, ledger: DataFrame, canonical: DataFrame, heldout_texts: DataFrame, heldout_descriptions: DataFrame, cutoff: str, seed: str, buckets: int = 10000, validation: int = 100) -> dict[str, DataFrame]:
    """check name -> rows (item: string) that break it."""
    item = lambda df, c: df.select(F.col(c).cast("string").alias("item"))
    place = F.concat_ws("/", *PLACE).alias("place")
    many = lambda df, c: item(df.groupBy(c).agg(F.count("*").alias("n")).where("n > 1"), c)
    pair = documents.withColumn("_d", F.lit(1)).join(provenance.withColumn("_p", F.lit(1)), PLACE, "full")
    # Digests stand for texts, which are not shuffled.
    digest = sha256(T.casefold("text"))
    text = documents.select(*PLACE, digest.alias("_digest")).join(provenance, PLACE)
    uids = provenance.select("issue_uid", "group_hash", "split", "text_hash").unionByName(provenance.select(F.explode("dedup_aliases").alias("issue_uid"), "group_hash", "split", "text_hash"))
    known = uids.join(canonical.select(F.col("uid").alias("issue_uid"), "membership", "reason", "created", F.col("text_hash").alias("_h"), F.col("split").alias("_s"), "desc_hash"), "issue_uid", "left")
    shard = documents.groupBy("split", "shard").agg(F.min("row_index").alias("a"), F.max("row_index").alias("b"), F.count_distinct("row_index").alias("n"), F.count("*").alias("m"))
    first = text.join(canonical.select(F.col("uid").alias("issue_uid"), digest.alias("_t")), "issue_uid", "left")
    found = {
        "ledger_uid_unique": many(ledger, "issue_uid"),
        "rows_align": item(pair.where("_d is null or _p is null").select(place), "place"),
        "text_not_empty": item(documents.where("text is null or text = ''").select(place), "place"),
        "text_hash_right": item(text.where(F.col("_digest") != F.col("text_hash")).select(place), "place"),
        "text_hash_unique": many(provenance, "text_hash"),
        "row_index_dense": item(shard.where("a <> 0 or b <> n - 1 or n <> m").select(F.concat_ws("/", "split", "shard").alias("place")), "place"),
        "split_right": item(provenance.where(group_split(F.col("group_hash"), seed, buckets, validation) != F.col("split")), "issue_uid"),
        "group_in_one_split": item(provenance.groupBy("group_hash").agg(F.count_distinct("split").alias("n")).where("n > 1"), "group_hash"),
        "identity_once": many(uids, "issue_uid"),
        "canonical_train": item(known.where("membership is null or membership <> 'train' or reason is not null or _s <> split"), "issue_uid"),
        "before_cutoff": item(known.where(F.col("created") > cutoff), "issue_uid"),
        "canonical_hash": item(known.where("_h <> text_hash"), "issue_uid"),
        "canonical_text": item(first.where(F.col("_t") != F.col("_digest")), "issue_uid"),
        "description_in_one_split": item(known.where("desc_hash <> ''").groupBy("desc_hash").agg(F.count_distinct("split").alias("n")).where("n > 1"), "desc_hash"),
        "ledger_matches": item(uids.select("issue_uid", "text_hash", "group_hash").exceptAll(ledger.select("issue_uid", "text_hash", "group_hash")).union(ledger.select("issue_uid", "text_hash", "group_hash").exceptAll(uids.select("issue_uid", "text_hash", "group_hash"))), "issue_uid"),
        "no_heldout_text": item(provenance.join(heldout_texts, "text_hash", "left_semi"), "issue_uid"),
        "no_heldout_description": item(known.join(heldout_descriptions, "desc_hash", "left_semi"), "issue_uid"),
        "all_represented": item(canonical.where("reason is null").join(uids.select(F.col("issue_uid").alias("uid")), "uid", "left_anti"), "uid"),
    }
    return found


def membership_sets(train: DataFrame, heldout: DataFrame, heads: DataFrame, rows: DataFrame) -> dict[str, DataFrame]:
    """Set checks on keys: no overlap, heads are held out, every member has a row."""
    key = lambda df: df.select("key").distinct()
    return {
        "train_heldout_disjoint": key(train).intersect(key(heldout)),
        "heads_heldout": key(heads).subtract(key(heldout)),
        "heads_not_train": key(heads).intersect(key(train)),
        "members_have_rows": key(train).union(key(heldout)).subtract(key(rows)),
    }


def cutoff_checks(train: DataFrame, heldout: DataFrame, cutoff: str) -> dict[str, DataFrame]:
    """Train at the cutoff at the latest, held-out after it; timestamps of fixed width compare as text."""
    return {"train_late": train.where(F.col("created") > cutoff), "heldout_early": heldout.where(F.col("created") <= cutoff)}


def counts(checks: dict[str, DataFrame]) -> DataFrame:
    """check and violations, one row for each check."""
    marked = [df.select(F.lit(name).alias("check"), F.lit(1).alias("v")) for name, df in checks.items()]
    spark = next(iter(checks.values())).sparkSession
    names = spark.createDataFrame([(n, 0) for n in checks], "check string, v int")
    return reduce(DataFrame.union, [names, *marked]).groupBy("check").agg(F.sum("v").cast("long").alias("violations"))


def assert_sound(checks: dict[str, DataFrame]) -> None:
    broken = {r["check"]: r["violations"] for r in counts(checks).where("violations > 0").collect()}
    if broken:
        raise ValueError(f"violations: {broken}")


def reconcile(identities: DataFrame) -> DataFrame:
    """train, excluded, aliases and documents, and whether they add up."""
    train = F.col("membership") == "train"
    sums = identities.agg(
        F.count_if(train).alias("train"),
        F.count_if(train & F.col("reason").isNotNull()).alias("excluded"),
        F.count_if(F.col("reason").isNull() & ~F.col("is_representative")).alias("aliases"),
        F.count_if(F.col("reason").isNull() & F.col("is_representative")).alias("documents"),
    )
    return sums.withColumn("adds_up", F.expr("train = excluded + aliases + documents"))


def checksum_differences(manifest: DataFrame, files: DataFrame, by: str = "name") -> DataFrame:
    """Names of a manifest (name, sha256) that are missing or have another checksum among ``files`` (path, sha256); ``by`` path: whole paths."""
    named = F.col("path") if by == "path" else F.element_at(F.split("path", "/"), -1)
    actual = files.select(named.alias(by), F.col("sha256").alias("_s"))
    return manifest.join(actual, by, "left").where("_s is null or _s <> sha256").select(by)
