"""How the roles of the library's operators are played by the named tables, in Spark and in SQL.

Documents are issues: the first line is the title, the rest the description; two consecutive documents
share a minute of creation. Every fifth is held out, a few of the rest are unassigned, all others train.
Links go from a document to its two predecessors and its successor in the same source, and from a copy to
the first document with its text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.tables import table

REPOSITORY = "corpus"
SEED = "corpus-v1"
CUTOFF = "2030-01-01 00:00:00"
MAX_POSTING, POOL = 50_000, 32

ISSUES_SQL = """
    issues AS (
        SELECT doc_id, doc_id + 1 AS source_row, 'S' || doc_id AS source_id, 'DOC-' || doc_id AS key, 'corpus:DOC-' || doc_id AS uid,
               split_part(text, chr(10), 1) AS title,
               CASE WHEN contains(text, chr(10)) THEN substr(text, instr(text, chr(10)) + 1) ELSE '' END AS description,
               source AS project, lang AS issue_type, text AS body,
               strftime(TIMESTAMP '2020-01-01 00:00:00' + to_minutes(CAST(doc_id // 2 AS BIGINT)), '%Y-%m-%d %H:%M:%S') AS created,
               CASE WHEN doc_id % 5 = 0 THEN 'heldout' WHEN doc_id % 17 = 3 THEN 'unassigned' ELSE 'train' END AS membership
        FROM documents
    )"""

SANE_SQL = (
    ISSUES_SQL
    + r""",
    cleaned AS (
        SELECT *, trim(regexp_replace(title, '\s+', ' ', 'g')) AS t0, trim(regexp_replace(description, '\s+', ' ', 'g')) AS d0 FROM issues
    ), masked AS (
        SELECT *,
               regexp_replace(regexp_replace(t0, '(?i)https?://[^\s]*(?:/browse/|/issues/)[^\s]+', '[ISSUE_REF]', 'g'), '(?i)\bDOC-\d+\b', '[ISSUE_REF]', 'g') AS t1,
               regexp_replace(regexp_replace(d0, '(?i)https?://[^\s]*(?:/browse/|/issues/)[^\s]+', '[ISSUE_REF]', 'g'), '(?i)\bDOC-\d+\b', '[ISSUE_REF]', 'g') AS d1
        FROM cleaned
    ), compared AS (
        SELECT *, d1 <> '' AND replace(lower(d1), 'ß', 'ss') = replace(lower(t1), 'ß', 'ss') AS same FROM masked
    ), cut AS (
        SELECT *, t1 AS t, CASE WHEN same THEN '' ELSE d1 END AS d FROM compared
    ), counted AS (
        SELECT *, NOT regexp_matches(replace(t || ' ' || d, '[ISSUE_REF]', ''), '[\p{L}\p{N}]') AS empty,
               len(list_filter(string_split(t || ' ' || d, ' '), lambda x: x <> '')) AS n_words,
               len(list_filter(string_split(d, ' '), lambda x: x <> '')) AS d_words
        FROM cut
    ), flagged AS (
        SELECT *,
               CASE WHEN empty THEN '' ELSE concat_ws(chr(10), CASE WHEN t <> '' THEN 'Title: ' || t END, CASE WHEN d <> '' THEN 'Description: ' || d END) END AS text,
               list_sort(list_filter([
                   CASE WHEN t0 <> title OR d0 <> description THEN 'normalized_unicode_whitespace_controls' END,
                   CASE WHEN same THEN 'description_equals_title_removed' END,
                   CASE WHEN empty THEN 'empty_after_cleaning' END,
                   CASE WHEN NOT empty AND t = '' THEN 'description_only' END,
                   CASE WHEN NOT empty AND d = '' THEN 'title_only' END,
                   CASE WHEN NOT empty AND n_words <= 5 THEN 'short_text' END], lambda x: x IS NOT NULL)) AS flags
        FROM counted
    ), sane AS (
        SELECT *, CASE WHEN text <> '' THEN sha256(replace(lower(text), 'ß', 'ss')) ELSE '' END AS text_hash,
               CASE WHEN NOT empty AND d_words >= 50 THEN sha256(replace(lower(d), 'ß', 'ss')) ELSE '' END AS desc_hash
        FROM flagged
    )"""
)

HORNER = "list_reduce(list_prepend(0::BIGINT, list_transform(range(8), lambda k: CAST('0x' || substr({h}, 8 * k + 1, 8) AS BIGINT))), lambda a, b: (a * (4294967296 % {m}) + b) % {m})"

BUILT_SQL = (
    SANE_SQL
    + """,
    judged AS (
        SELECT *, CASE WHEN membership = 'unassigned' THEN 'unassigned_identity'
                       WHEN membership = 'heldout' THEN 'heldout_identity'
                       WHEN text = '' THEN 'empty_after_cleaning'
                       WHEN text_hash IN (SELECT text_hash FROM sane WHERE membership = 'heldout' AND text_hash <> '') THEN 'heldout_exact_text_overlap'
                       WHEN desc_hash IN (SELECT desc_hash FROM sane WHERE membership = 'heldout' AND desc_hash <> '') THEN 'heldout_substantive_description_overlap'
                  END AS reason
        FROM sane
    ), kept AS (
        SELECT *, first_value(uid) OVER (PARTITION BY text_hash ORDER BY created, uid) AS representative_uid,
               CASE WHEN desc_hash = '' THEN text_hash ELSE min(text_hash) OVER (PARTITION BY desc_hash) END AS group_hash
        FROM judged WHERE reason IS NULL
    ), hashed AS (
        SELECT *, sha256('corpus-v1:' || group_hash) AS gh FROM kept
    ), built AS (
        SELECT *, uid = representative_uid AS is_representative,
               CASE WHEN """
    + HORNER.format(h="gh", m=10000)
    + """ < 100 THEN 'validation' ELSE 'train' END AS split
        FROM hashed
    )"""
)

CAP_SQL = f" HAVING count(*) <= {MAX_POSTING}"

LINKS_SQL = (
    ISSUES_SQL
    + """,
    near AS (
        SELECT key AS head, 'precedes' AS relation, unnest([
                   lag(key, 1) OVER w, lag(key, 2) OVER w, lead(key, 1) OVER w]) AS tail
        FROM issues WINDOW w AS (PARTITION BY project ORDER BY doc_id)
    ), copies AS (
        SELECT key AS head, 'copies' AS relation, first_value(key) OVER (PARTITION BY replace(lower(body), 'ß', 'ss') ORDER BY doc_id) AS tail FROM issues
    ), links AS (
        SELECT CASE WHEN CAST(substr(head, 5) AS BIGINT) % 50 = 0 THEN 'test' ELSE 'train' END AS source, head, relation, tail FROM near WHERE tail IS NOT NULL
        UNION ALL
        SELECT CASE WHEN CAST(substr(head, 5) AS BIGINT) % 50 = 0 THEN 'test' ELSE 'train' END, head, relation, tail FROM copies WHERE head <> tail
    ), groups AS (
        SELECT source, head, relation, list_sort(list_distinct(list(tail))) AS tails FROM links GROUP BY ALL
    ), queries AS (
        SELECT 'corpus:' || head || ':' || relation AS query_id, g.*, i.created, i.uid, i.body, i.body || ' ' || relation AS qtext,
               CASE WHEN source = 'test' THEN 'test'
                    WHEN """
    + HORNER.format(h="sha256('sft-v1:' || head || ':' || relation)", m=100)
    + """ < 10 THEN 'validation' ELSE 'train' END AS split
        FROM groups g JOIN issues i ON i.key = g.head
    ), gold AS (
        SELECT query_id, i.key FROM (SELECT query_id, created AS qc, unnest(tails) AS tail FROM queries) q JOIN issues i ON i.key = q.tail AND i.created < q.qc
    ), post AS (
        SELECT key, created, unnest(list_distinct(regexp_extract_all(replace(lower(body), 'ß', 'ss'), '[a-z0-9ı][a-z0-9ı_.+-]{1,}'))) AS term FROM issues
    ), stats AS (
        SELECT term, count(*) AS df, CAST(ln((SELECT count(*) + 1 FROM issues) / (count(*) + 1)) + 1.0 AS DECIMAL(18, 9)) AS idf
        FROM post GROUP BY term"""
    + CAP_SQL
    + """
    ), qterms AS (
        SELECT query_id, head, created AS qc, unnest(list_distinct(regexp_extract_all(replace(lower(qtext), 'ß', 'ss'), '[a-z0-9ı][a-z0-9ı_.+-]{1,}'))) AS term FROM queries
    ), best AS (
        SELECT * FROM (
            SELECT query_id, key, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank FROM (
                SELECT q.query_id, p.key, sum(s.idf) AS score FROM qterms q JOIN stats s USING (term) JOIN post p USING (term)
                WHERE p.created < q.qc AND p.key <> q.head GROUP BY q.query_id, p.key)) WHERE rank <= 32
    ), fresh AS (
        SELECT query_id, key, 0 AS score, row_number() OVER (PARTITION BY query_id ORDER BY icreated DESC, key DESC) + have AS rank FROM (
            SELECT q.query_id, i.key, i.created AS icreated, coalesce(h.have, 0) AS have
            FROM queries q JOIN issues i ON i.created < q.created AND i.key <> q.head
            LEFT JOIN (SELECT query_id, max(rank) AS have FROM best GROUP BY query_id) h ON h.query_id = q.query_id
            LEFT JOIN best b ON b.query_id = q.query_id AND b.key = i.key
            WHERE b.key IS NULL AND coalesce(h.have, 0) < 32)
    ), ranked AS (
        SELECT query_id, key, CAST(score AS DECIMAL(28, 9)) AS score, CAST(rank AS INTEGER) AS rank FROM best
        UNION ALL SELECT query_id, key, CAST(score AS DECIMAL(28, 9)), CAST(rank AS INTEGER) FROM fresh WHERE rank <= 32
    )"""
)


#: The same with all terms, however many issues have them.
ALL_TERMS_SQL = LINKS_SQL.replace(CAP_SQL, "")


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_row, source_id, key, title, project, issue_type, description, created (text), doc_id and body."""
    docs = table(spark, sf_dir, "documents")
    at = F.instr("text", "\n")
    minute = F.expr("timestamp_ntz'2020-01-01 00:00:00' + make_dt_interval(0, 0, cast(doc_id div 2 as int))")
    return docs.select(
        (F.col("doc_id") + 1).alias("source_row"),
        F.concat(F.lit("S"), "doc_id").alias("source_id"),
        F.concat(F.lit("DOC-"), "doc_id").alias("key"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("source").alias("project"),
        F.col("lang").alias("issue_type"),
        F.when(at > 0, F.substr("text", at + 1)).otherwise("").alias("description"),
        F.date_format(minute, "yyyy-MM-dd HH:mm:ss").alias("created"),
        "doc_id",
        F.col("text").alias("body"),
    )


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return issues(spark, sf_dir).drop("doc_id", "body")


def membership(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Train and held-out lists (key, source_id, created)."""
    all_ = issues(spark, sf_dir)
    part = F.when(F.col("doc_id") % 5 == 0, "heldout").when(F.col("doc_id") % 17 == 3, "unassigned").otherwise("train")
    listed = all_.select("key", "source_id", "created", part.alias("part"))
    return tuple(listed.where(F.col("part") == p).drop("part") for p in ("train", "heldout"))


def dated_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, uid, created and text, as retrieval takes them."""
    return issues(spark, sf_dir).select("key", F.concat(F.lit(f"{REPOSITORY}:"), "key").alias("uid"), "created", F.col("body").alias("text"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, head, relation and tail."""
    all_ = issues(spark, sf_dir)
    w = W.partitionBy("project").orderBy("doc_id")
    tails = F.array(F.lag("key", 1).over(w), F.lag("key", 2).over(w), F.lead("key", 1).over(w))
    near = all_.select("doc_id", "key", tails.alias("t")).select("doc_id", F.col("key").alias("head"), F.lit("precedes").alias("relation"), F.explode("t").alias("tail")).where("tail is not null")
    hashed = all_.select("doc_id", "key", F.sha2(T.casefold("body"), 256).alias("h"))
    first = hashed.groupBy("h").agg(F.min(F.struct("doc_id", "key")).alias("f"))
    copies = hashed.join(first, "h").select("doc_id", F.col("key").alias("head"), F.lit("copies").alias("relation"), F.col("f.key").alias("tail")).where("head <> tail")
    source = F.when(F.col("doc_id") % 50 == 0, "test").otherwise("train")
    return near.union(copies).select(source.alias("source"), "head", "relation", "tail")


def relations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("copies", "The tail has the same text.")], "name string, definition string")
