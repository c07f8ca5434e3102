"""Queries over the document corpus: sanitise, classify, decontaminate, deduplicate, split, check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions.hashing import in_shard, stable_fraction
from corpusloom.functions.numeric import lax_timestamp, strict_timestamp
from corpusloom.operators import audit, corpus, validate
from corpusloom.plans import binding as B
from corpusloom.plans.registry import query
from corpusloom.tables import stored, table


def built(spark: SparkSession, sf_dir: str, texts: bool = False) -> DataFrame:
    return corpus.build(B.rows(spark, sf_dir), *B.membership(spark, sf_dir), B.REPOSITORY, B.SEED, texts=texts)


def documents(spark: SparkSession, sf_dir: str, texts: bool = False) -> DataFrame:
    return built(spark, sf_dir, texts).where("is_representative")


@query(
    "doc_exact_dedup",
    """
    WITH folded AS (
        SELECT doc_id, sha256(replace(lower(text), 'ß', 'ss')) AS text_hash FROM documents
    )
    SELECT text_hash, min(doc_id) AS representative_id, count(*) AS members
    FROM folded GROUP BY text_hash
    """,
)
def doc_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.casefold("text"), 256).alias("text_hash"))
    return docs.groupBy("text_hash").agg(F.min("doc_id").alias("representative_id"), F.count("*").alias("members"))


@query("sanitised_text", "WITH" + B.SANE_SQL + " SELECT uid, md5(text) AS text_md5, text_hash, desc_hash, array_to_string(flags, ',') AS flags FROM sane")
def sanitised_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    sane = corpus.sanitise(B.rows(spark, sf_dir), ["DOC"])
    return sane.select(F.concat(F.lit("corpus:"), "key").alias("uid"), F.md5("text").alias("text_md5"), "text_hash", "desc_hash", F.array_join("flags", ",").alias("flags"))


@query("quality_flags", "WITH" + B.SANE_SQL + " SELECT flag, count(*) AS n FROM (SELECT unnest(flags) AS flag FROM sane WHERE membership = 'train') GROUP BY flag")
def quality_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.flag_histogram(built(spark, sf_dir))


@query("membership_classify", "WITH" + B.ISSUES_SQL + " SELECT membership, CASE WHEN membership = 'unassigned' THEN 'unassigned_identity' ELSE '' END AS row_reason, count(*) AS n FROM issues GROUP BY ALL")
def membership_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = corpus.classify(B.rows(spark, sf_dir), *B.membership(spark, sf_dir), B.REPOSITORY)
    return found.groupBy("membership", F.coalesce("row_reason", F.lit("")).alias("row_reason")).agg(F.count("*").alias("n"))


@query("heldout_exclusion", "WITH" + B.BUILT_SQL + " SELECT reason, count(*) AS n FROM judged WHERE reason IS NOT NULL GROUP BY reason")
def heldout_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.exclusion_histogram(built(spark, sf_dir))


@query(
    "doc_group_split",
    "WITH" + B.BUILT_SQL + " SELECT uid, representative_uid, is_representative, text_hash, group_hash, split FROM built",
)
def doc_group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built(spark, sf_dir).where("reason is null").select("uid", "representative_uid", "is_representative", "text_hash", "group_hash", "split")


@query(
    "doc_split_counts",
    "WITH" + B.BUILT_SQL + r" SELECT split, count(*) AS documents, CAST(sum(len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))) AS BIGINT) AS words, count(DISTINCT group_hash) AS groups FROM built WHERE is_representative GROUP BY split",
)
def doc_split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir, True).groupBy("split").agg(F.count("*").alias("documents"), F.sum(T.word_count(F.col("text")).cast("long")).alias("words"), F.count_distinct("group_hash").alias("groups"))


@query("doc_composition", "WITH" + B.BUILT_SQL + " SELECT split, project, count(*) AS n FROM built WHERE is_representative GROUP BY ALL")
def doc_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).groupBy("split", "project").agg(F.count("*").alias("n"))


SHARD = 100


@query(
    "doc_shards",
    "WITH" + B.BUILT_SQL + """ SELECT uid, split, CAST(i // 100 AS INTEGER) AS shard, CAST(i % 100 AS INTEGER) AS row_index
    FROM (SELECT uid, split, row_number() OVER (PARTITION BY split ORDER BY created, uid) - 1 AS i FROM built WHERE is_representative)""",
)
def doc_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.shards(documents(spark, sf_dir), SHARD).select("uid", "split", "shard", "row_index")


@query(
    "duplicate_groups",
    "WITH" + B.BUILT_SQL + """ SELECT text_hash, representative_uid, array_to_string(list_sort(list(uid) FILTER (NOT is_representative)), ',') AS alias_uids, min(split) AS split
    FROM built GROUP BY text_hash, representative_uid HAVING count(*) > 1""",
)
def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = built(spark, sf_dir).where("reason is null")
    aliases = F.array_sort(F.collect_list(F.when(~F.col("is_representative"), F.col("uid"))))
    return kept.groupBy("text_hash", "representative_uid").agg(F.array_join(aliases, ",").alias("alias_uids"), F.min("split").alias("split"), F.count("*").alias("_n")).where("_n > 1").drop("_n")


@query(
    "flag_samples",
    "WITH" + B.BUILT_SQL + """ SELECT flag, CAST(rank AS INTEGER) AS rank, uid FROM (
        SELECT flag, uid, row_number() OVER (PARTITION BY flag ORDER BY created, uid) AS rank
        FROM (SELECT uid, created, unnest(list_prepend('general', flags)) AS flag FROM built WHERE is_representative)) WHERE rank <= 5""",
)
def flag_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.flag_samples(documents(spark, sf_dir))


@query(
    "reconciliation",
    "WITH" + B.BUILT_SQL + """ SELECT (SELECT count(*) FROM judged WHERE membership = 'train') AS train,
        (SELECT count(*) FROM judged WHERE membership = 'train' AND reason IS NOT NULL) AS excluded,
        (SELECT count(*) FROM built WHERE NOT is_representative) AS aliases,
        (SELECT count(*) FROM built WHERE is_representative) AS documents, true AS adds_up""",
)
def reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.reconcile(built(spark, sf_dir))


CHECKS = (
    "ledger_uid_unique rows_align text_not_empty text_hash_right text_hash_unique row_index_dense split_right group_in_one_split identity_once "
    "canonical_train before_cutoff canonical_hash canonical_text description_in_one_split ledger_matches no_heldout_text no_heldout_description all_represented "
    "train_heldout_disjoint heads_heldout heads_not_train members_have_rows"
).split()


@query("corpus_violations", "SELECT unnest([" + ", ".join(f"'{c}'" for c in CHECKS) + "]) AS \"check\", CAST(0 AS BIGINT) AS violations")
def corpus_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All checks of an export built from the corpus itself; a sound export breaks none."""
    made = export(spark, sf_dir)
    train, heldout = B.membership(spark, sf_dir)
    checks = validate.violations(*made, B.CUTOFF, B.SEED)
    return validate.counts(checks | validate.membership_sets(train, heldout, heldout, B.rows(spark, sf_dir)))


def export(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    """Documents, provenance, ledger, canonical rows, and the held-out hashes of texts and descriptions."""
    identities = stored(built(spark, sf_dir, True).drop("title", "description"), "identities")  # a dozen checks read them
    placed = stored(corpus.shards(identities.where("is_representative"), SHARD), "placed")
    aliases = identities.where("reason is null and not is_representative").groupBy("representative_uid").agg(F.array_sort(F.collect_list("uid")).alias("_a"))
    full = placed.drop("representative_uid").join(aliases, placed["uid"] == aliases["representative_uid"], "left")
    provenance = full.select(F.col("uid").alias("issue_uid"), "text_hash", "group_hash", "split", "shard", "row_index", F.coalesce("_a", F.array().cast("array<string>")).alias("dedup_aliases"))
    ledger = identities.where("reason is null").select(F.col("uid").alias("issue_uid"), "representative_uid", "text_hash", "group_hash")
    return placed.select("split", "shard", "row_index", "text"), provenance, ledger, identities, *corpus.heldout_hashes(identities)


#: What the faults of :func:`planted_violations` break; ``a`` is the number of aliases of the fourth row.
PLANTED = {
    "ledger_uid_unique": "1", "rows_align": "1", "text_not_empty": "1", "text_hash_right": "2", "text_hash_unique": "1", "row_index_dense": "1", "identity_once": "1",
    "canonical_train": "1", "before_cutoff": "1", "canonical_hash": "a + 2", "canonical_text": "1", "ledger_matches": "2 * a + 4", "no_heldout_text": "1", "all_represented": "1",
}


@query(
    "planted_violations",
    "WITH" + B.BUILT_SQL + """, fourth AS (
        SELECT text_hash FROM built WHERE is_representative AND split = 'train' ORDER BY created, uid LIMIT 1 OFFSET 3
    ), extra AS (SELECT count(*) AS a FROM built WHERE NOT is_representative AND text_hash IN (SELECT text_hash FROM fourth))
    SELECT unnest(["""
    + ", ".join(f"'{c}'" for c in CHECKS if not c.startswith(("train_", "heads_", "members_")))
    + "]) AS \"check\", CAST(unnest(["
    + ", ".join(PLANTED.get(c, "0") for c in CHECKS if not c.startswith(("train_", "heads_", "members_")))
    + "]) AS BIGINT) AS violations FROM extra",
)
def planted_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checks on an export with one fault of each kind in the first shard of the training split."""
    documents, provenance, ledger, canonical, texts, descriptions = export(spark, sf_dir)
    rows = {r["row_index"]: r for r in provenance.where("split = 'train' and shard = 0 and row_index < 12").select("row_index", "issue_uid", "text_hash").collect()}
    uid = lambda k: rows[k]["issue_uid"]
    at = lambda k: (F.col("split") == "train") & (F.col("shard") == 0) & (F.col("row_index") == k)
    # Row 1 has lost its text, row 2 its document.
    documents = documents.withColumn("text", F.when(at(1), "").otherwise(F.col("text"))).where(~at(2))
    # Row 3 has the hash of row 4, row 8 claims row 9 as an alias.
    aliases = F.when(at(8), F.array_append("dedup_aliases", uid(9))).otherwise(F.col("dedup_aliases"))
    provenance = provenance.withColumn("text_hash", F.when(at(3), rows[4]["text_hash"]).otherwise(F.col("text_hash"))).withColumn("dedup_aliases", aliases)
    # Row 5 is twice in the ledger.
    ledger = ledger.unionByName(ledger.where(F.col("issue_uid") == uid(5)))
    # Row 6 is held out, row 7 too new, and one row is nowhere in the export.
    own = F.col("uid")
    ghost = canonical.where(own == uid(11)).withColumn("uid", F.lit("ghost"))
    membership = F.when(own == uid(6), "heldout").otherwise(F.col("membership"))
    created = F.when(own == uid(7), "2031-01-01 00:00:00").otherwise(F.col("created"))
    canonical = canonical.withColumn("membership", membership).withColumn("created", created).unionByName(ghost)
    # The text of row 10 is a held-out one.
    texts = texts.unionByName(spark.createDataFrame([(rows[10]["text_hash"],)], "text_hash string"))
    return validate.counts(validate.violations(documents, provenance, ledger, canonical, texts, descriptions, B.CUTOFF, B.SEED))


@query(
    "stable_sample",
    "SELECT doc_id, CAST('0x' || substr(sha256('42:' || doc_id), 1, 16) AS UBIGINT)::DOUBLE / 18446744073709551615::DOUBLE < 0.25 AS kept, CAST(CAST('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 16) AS UBIGINT) % 8 AS INTEGER) AS shard FROM documents",
)
def stable_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("doc_id").cast("string")
    shard = F.lit(None).cast("int")
    for k in range(8):
        shard = F.when(in_shard(key, 8, k), k).otherwise(shard)
    return table(spark, sf_dir, "documents").select("doc_id", (stable_fraction(F.concat_ws(":", F.lit("42"), key)) < 0.25).alias("kept"), shard.alias("shard"))



@query(
    "date_checks",
    "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS strict, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS lax, CAST(NULL AS VARCHAR) AS unpadded_strict, strftime(date_trunc('day', o_orderdate), '%Y-%m-%d %H:%M:%S') AS unpadded_lax FROM orders",
)
def date_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda ts: F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
    padded = text("o_orderdate")
    loose = F.concat(F.date_format("o_orderdate", "y-M-d"), F.lit(" 0:0:0"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", text(strict_timestamp(padded)).alias("strict"), text(lax_timestamp(padded)).alias("lax"), text(strict_timestamp(loose)).alias("unpadded_strict"), text(lax_timestamp(loose)).alias("unpadded_lax")
    )


AUDIT_SQL = (
    "WITH"
    + B.ISSUES_SQL
    + r""", prepared AS (
        SELECT *, trim(regexp_replace(title, '\s+', ' ', 'g')) AS t, trim(regexp_replace(description, '\s+', ' ', 'g')) AS d FROM issues
    ), p AS (
        SELECT *, replace(lower(t || chr(10) || d), 'ß', 'ss') AS n, sha256(replace(lower(t || chr(10) || d), 'ß', 'ss')) AS text_hash,
               len(list_filter(string_split(t || ' ' || d, ' '), lambda x: x <> '')) AS n_words, membership = 'train' AS a, membership = 'heldout' AS b
        FROM prepared
    )"""
)


def audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.prepare(B.rows(spark, sf_dir), *B.membership(spark, sf_dir))


@query(
    "audit_profile",
    AUDIT_SQL
    + r""" SELECT count(*) AS rows, count(*) - count(DISTINCT key) AS duplicate_issue_key_rows, CAST(0 AS BIGINT) AS malformed_timestamp_shape,
        count(*) FILTER (a) AS train_rows, count(*) FILTER (b) AS test_rows, count(*) FILTER (NOT a AND NOT b) AS unassigned_rows,
        count(*) FILTER (a AND t = '') AS train_empty_title, count(*) FILTER (a AND d = '') AS train_empty_description,
        count(*) FILTER (a AND replace(lower(t), 'ß', 'ss') = replace(lower(d), 'ß', 'ss')) AS train_description_equals_title,
        count(*) FILTER (a AND lower(d) IN ('none', 'null', 'nan', 'no name', 'no description')) AS train_description_placeholder,
        count(*) FILTER (a AND n_words <= 5) AS train_words_at_most_5,
        count(*) FILTER (a AND regexp_matches(n, '(?i)(^|[^\p{L}\p{N}_])[a-z][a-z0-9_]{1,20}-\d+($|[^\p{L}\p{N}_])')) AS train_issue_key_pattern,
        count(*) FILTER (a AND regexp_matches(n, '(?i)https?://|www\.')) AS train_url_pattern,
        count(*) FILTER (a AND substr(created, 1, 10) > '2020-01-01') AS train_rows_after_cutoff, CAST(0 AS BIGINT) AS train_id_or_date_mismatch,
        count(*) FILTER (b AND substr(created, 1, 10) <= '2020-01-01') AS test_rows_on_or_before_cutoff, CAST(0 AS BIGINT) AS test_id_or_date_mismatch,
        min(created) AS min_created, max(created) AS max_created FROM p""",
)
def audit_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.profile(audited(spark, sf_dir), "2020-01-01")


@query(
    "audit_overlaps",
    AUDIT_SQL
    + """, per AS (SELECT text_hash, count(*) FILTER (a) AS x, count(*) FILTER (b) AS y FROM p GROUP BY text_hash)
    SELECT count(*) FILTER (x > 0) AS train_unique_exact_texts, CAST(coalesce(sum(x - 1) FILTER (x > 0), 0) AS BIGINT) AS train_duplicate_text_extra_rows,
           count(*) FILTER (x > 0 AND y > 0) AS exact_text_groups_shared_train_test, CAST(coalesce(sum(x) FILTER (x > 0 AND y > 0), 0) AS BIGINT) AS train_rows_matching_test_text FROM per""",
)
def audit_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.overlaps(audited(spark, sf_dir))


@query(
    "audit_word_quantiles",
    AUDIT_SQL + """, l AS (SELECT list_sort(list(n_words)) AS x FROM p WHERE a)
    SELECT CAST(list_sum(x) AS BIGINT) AS total, CAST(x[CAST(floor(len(x) * 0.5) AS BIGINT) + 1] AS INTEGER) AS p50, CAST(x[CAST(floor(len(x) * 0.95) AS BIGINT) + 1] AS INTEGER) AS p95, CAST(list_max(x) AS INTEGER) AS max FROM l""",
)
def audit_word_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.word_quantiles(audited(spark, sf_dir))
