"""Headerless tab-separated files with fixed widths, counted headers, quarantine and checksums."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions.numeric import lax_timestamp, strict_timestamp

ISSUE_FIELDS = ("source_id", "key", "title", "project", "issue_type", "status", "description", "created")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no (from 1) and value of every line of the files at ``path``, in the order of their names.

    Lines are numbered within each part of a file; the counts of the parts, which are few, give the rest.
    """
    parts = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("m"))
    inside = F.row_number().over(W.partitionBy("f", "b").orderBy("m"))
    counts = parts.groupBy("f", "b").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("f", "b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("f", "b", before.alias("o"))
    return parts.withColumn("i", inside).join(offsets, ["f", "b"]).select((F.col("i") + F.col("o")).alias("line_no"), "value")


def scan_issues(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows (source_row and the fields) and quarantined ones (source_row, reason, raw_line_hash) of numbered lines."""
    cut = rows.withColumn("p", F.split("value", "\t", -1))
    width = F.size("p")
    good = cut.where(width == len(ISSUE_FIELDS)).select(F.col("line_no").alias("source_row"), *(F.get("p", F.lit(i)).alias(n) for i, n in enumerate(ISSUE_FIELDS)))
    bad = cut.where(width != len(ISSUE_FIELDS)).select(F.col("line_no").alias("source_row"), F.lit("malformed_field_count").alias("reason"), F.sha2(F.concat("value", F.lit("\n")), 256).alias("raw_line_hash"))
    return good, bad


def scan_issues_strict(rows: DataFrame, repository: str) -> DataFrame:
    """key, uid, created and text of every issue; a wrong width is an error; of rows with one key the least (created, source_id, text) stays."""
    cut = rows.withColumn("p", F.split("value", "\t", -1))
    checked = cut.withColumn("p", F.when(F.size("p") == len(ISSUE_FIELDS), F.col("p")).otherwise(F.raise_error(F.concat(F.lit("wrong field count in line "), F.col("line_no").cast("string")))))
    named = checked.select(*(F.get("p", F.lit(i)).alias(n) for i, n in enumerate(ISSUE_FIELDS)))
    parts = F.concat_ws("\n", F.when(F.col("title") != "", F.concat(F.lit("Title: "), "title")), F.when(F.col("description") != "", F.concat(F.lit("Description: "), "description")))
    typed = named.select("key", "source_id", lax_timestamp(F.col("created")).alias("created"), parts.alias("text"))
    least = typed.groupBy("key").agg(F.min(F.struct("created", "source_id", "text")).alias("x"))
    return least.select("key", F.concat(F.lit(repository + ":"), "key").alias("uid"), F.col("x.created"), F.col("x.text"))


def _counted(rows: DataFrame, width: int, what: str) -> DataFrame:
    """line_no and the fields p of the lines after the header, which must hold their number."""
    header = F.max(F.when(F.col("line_no") == 1, F.trim("value").cast("long")))
    declared, found = rows.agg(header, F.count("*") - 1).first()
    if declared != found:
        raise ValueError(f"{what}: the header says {declared}, there are {found} rows")
    cut = rows.where("line_no > 1").withColumn("p", F.split("value", "\t", -1))
    wrong = cut.where(F.size("p") != width).select(F.min("line_no")).first()[0]
    if wrong is not None:
        raise ValueError(f"{what}: line {wrong} has not {width} fields")
    return cut


def scan_membership(rows: DataFrame) -> DataFrame:
    """key, source_id and created; dates are strict, equal repeats are one row, unequal ones an error."""
    named = _counted(rows, 3, "membership").select(F.get("p", F.lit(0)).alias("key"), F.get("p", F.lit(1)).alias("source_id"), F.get("p", F.lit(2)).alias("created"))
    bad = named.where((F.col("key") == "") | (F.col("source_id") == "") | strict_timestamp(F.col("created")).isNull()).limit(1).collect()
    if bad:
        raise ValueError(f"membership: invalid row {tuple(bad[0])}")
    same = named.groupBy("key").agg(F.min(F.struct("source_id", "created")).alias("a"), F.max(F.struct("source_id", "created")).alias("b"))
    torn = same.where("a <> b").limit(1).collect()
    if torn:
        raise ValueError(f"membership: conflicting identity {torn[0]['key']}")
    return same.select("key", "a.source_id", "a.created")


def scan_query_heads(rows: DataFrame) -> DataFrame:
    return scan_links(rows).select(F.col("head").alias("key")).distinct()


def scan_links(rows: DataFrame) -> DataFrame:
    """line_no, head, relation, tail and created of a counted link file; dates are strict."""
    named = _counted(rows, 4, "links").select("line_no", *(F.get("p", F.lit(i)).alias(n) for i, n in enumerate(("head", "relation", "tail", "created"))))
    bad = named.where(strict_timestamp(F.col("created")).isNull()).limit(1).collect()
    if bad:
        raise ValueError(f"links: invalid date in line {bad[0]['line_no']}")
    return named


def adjacency(links: DataFrame) -> DataFrame:
    """head, relation, tails (distinct, sorted) and first_line of each group."""
    return links.groupBy("head", "relation").agg(F.array_sort(F.collect_set("tail")).alias("tails"), F.min("line_no").alias("first_line"))


def scan_relations(rows: DataFrame) -> DataFrame:
    """name, definition and relation_id after one skipped line; of repeats the last stands."""
    cut = rows.where("line_no > 1").withColumn("p", F.split("value", "\t", -1))
    named = cut.select("line_no", F.when(F.size("p") == 3, F.get("p", F.lit(0))).when(F.col("line_no") == 1, "").otherwise(F.raise_error(F.lit("a relation row has not three fields"))).alias("name"), F.get("p", F.lit(1)).alias("definition"), F.get("p", F.lit(2)).alias("relation_id"))
    last = named.groupBy("name").agg(F.max_by(F.struct("definition", "relation_id"), "line_no").alias("x"))
    return last.select("name", "x.definition", "x.relation_id")


def width_histogram(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.size(F.split("value", "\t", -1)).alias("width")).agg(F.count("*").alias("n"))


def check_cutoff(rows: DataFrame, repository: str, cutoff: str) -> None:
    """The document must have a line of the repository that contains the cutoff's date."""
    named = rows.where(F.startswith("value", F.lit(repository + "\t")) & F.contains("value", F.lit(cutoff[:10])))
    if not named.limit(1).count():
        raise ValueError(f"no cutoff {cutoff[:10]} for {repository}")


def checksums(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, length and sha256 of whole files, in all folders below; a file has to be smaller than two gigabytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


