"""End-to-end jobs over raw files: the corpus, the retrieval records, and their evaluation."""

from __future__ import annotations

import platform
import re
from dataclasses import asdict, dataclass

import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.numeric import repository_of, safe_div, softmax_pair
from corpusloom.operators import corpus, metrics, outputs, records, retrieval, sinks, validate
from corpusloom.sources import delimited
from corpusloom.tables import cut

# The policies that a configuration may name.
SANITISATION = "conservative-v1"
NEAR_DUPLICATES = "disabled_pending_review"
TIMESTAMP = re.compile(r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}")


@dataclass(frozen=True)
class CorpusConfig:
    repository: str
    version: str
    cutoff: str
    seed: str
    buckets: int = 10_000
    validation_buckets: int = 100
    shard_size: int = 10_000
    substantive_words: int = 50
    sanitisation: str = SANITISATION
    near_duplicates: str = NEAR_DUPLICATES

    def __post_init__(self) -> None:
        if not re.fullmatch("[a-z0-9_]+", self.version):
            raise ValueError("versions are lower-case letters, digits and underscores")
        if not TIMESTAMP.fullmatch(self.cutoff):
            raise ValueError("the cutoff is no timestamp")
        if (self.sanitisation, self.near_duplicates) != (SANITISATION, NEAR_DUPLICATES):
            raise ValueError("this build knows one way of sanitising and none of near duplicates")
        if not 0 < self.validation_buckets < self.buckets or self.shard_size < 1 or self.substantive_words < 1:
            raise ValueError("buckets, shard size and words must be positive, and validation a part of the buckets")


def build_corpus(spark: SparkSession, raw: dict[str, str], target: str, config: CorpusConfig) -> DataFrame:
    """Raw issues to published shards, ledgers and manifest; returns the manifest's row.

    ``raw`` has the paths of issues, train, heldout and links, and may have that of the cutoff document. Nothing is
    published unless every check holds and the sources have the checksums that they had at the start. The manifest has
    the configuration, counters, sources and, by name and checksum, every file that is published before it.
    """
    read = lambda name: delimited.lines(spark, raw[name])
    sources = _checksums(spark, list(raw.values()))
    if "cutoff" in raw:
        delimited.check_cutoff(read("cutoff"), config.repository, config.cutoff)
    rows, quarantine = delimited.scan_issues(read("issues"))
    train, heldout = (cut(delimited.scan_membership(read(n))) for n in ("train", "heldout"))
    heads = delimited.scan_query_heads(read("links"))
    rows = cut(rows)
    validate.assert_sound(validate.membership_sets(train, heldout, heads, rows) | validate.cutoff_checks(train, heldout, config.cutoff))
    identities = cut(corpus.build(rows, train, heldout, config.repository, config.seed, config.buckets, config.validation_buckets, config.substantive_words))
    kept = identities.where("reason is null")
    placed = cut(corpus.shards(kept.where("is_representative"), config.shard_size))
    aliases = kept.where("not is_representative").groupBy(F.col("representative_uid").alias("_r")).agg(F.array_sort(F.collect_list("uid")).alias("_a"))
    provenance = placed.join(aliases, F.col("uid") == F.col("_r"), "left").select(
        F.col("uid").alias("issue_uid"), "source_rows", F.col("created").alias("created_at"), "text_hash", "group_hash", "split", "shard", "row_index", F.col("flags").alias("quality_flags"), F.coalesce("_a", F.array().cast("array<string>")).alias("dedup_aliases")
    )
    ledger = kept.select(F.col("uid").alias("issue_uid"), "representative_uid", "text_hash", "group_hash", "split")
    sums = validate.reconcile(identities)
    if not sums.first()["adds_up"]:
        raise ValueError("train identities are not the sum of exclusions, aliases and documents")
    held = corpus.heldout_hashes(identities)
    validate.assert_sound(validate.violations(placed.select("split", "shard", "row_index", "text"), provenance, ledger, identities, *held, config.cutoff, config.seed, config.buckets, config.validation_buckets))
    conflicts = identities.where("reason = 'identity_conflict'").select(F.element_at("source_rows", 1).alias("source_row"), F.col("reason"), F.col("raw_hash").alias("raw_line_hash"), F.col("uid").alias("issue_uid"))
    per_split = placed.agg(F.count_if(F.col("split") == "train").alias("train_documents"), F.count_if(F.col("split") == "validation").alias("validation_documents"))
    counters = rows_seen(rows, quarantine, identities)
    named = {"repository": F.lit(config.repository), "version": F.lit(config.version), "seed": F.lit(config.seed), "cutoff": F.lit(config.cutoff)}
    named["config"] = F.struct(*(F.lit(v).alias(k) for k, v in asdict(config).items()))
    named["environment"] = F.struct(F.lit(platform.python_version()).alias("python"), F.lit(pyspark.__version__).alias("spark"))
    manifest = cut(sums.crossJoin(per_split).crossJoin(counters).withColumns(named))
    report = manifest.crossJoin(corpus.exclusion_histogram(identities).agg(F.collect_list(F.struct("*")).alias("exclusions"))).crossJoin(corpus.flag_histogram(identities).agg(F.collect_list(F.struct("*")).alias("quality_flags")))
    parts = {
        "canonical": identities,
        "quarantine": quarantine.withColumn("issue_uid", F.lit(None).cast("string")).unionByName(conflicts),
        "exclusions": identities.where("reason is not null").select(F.col("uid").alias("issue_uid"), "source_rows", "reason", "membership"),
        "split_ids": ledger,
        "provenance": lambda path: sinks.write_provenance(provenance, [c for c in provenance.columns if c not in ("split", "shard", "row_index")], path),
        "documents": lambda path: sinks.write_shards(placed, path),
        "quality_report": lambda path: report.coalesce(1).write.json(path),
        "card": lambda path: spark.createDataFrame([(card(manifest, config),)], "value string").coalesce(1).write.text(path),
    }
    # Written last: it names the files of all other parts as they lie in the staging folder.
    names = list(parts)
    parts["manifest"] = lambda path: _with_files(manifest, sources, [f"{path.rpartition('/')[0]}/{n}" for n in names]).coalesce(1).write.json(path)
    root = f"{target}/{config.version}"

    def unchanged(_spark: SparkSession, _staged: dict[str, str]) -> None:
        if validate.checksum_differences(sources, _checksums(spark, list(raw.values())), by="path").limit(1).count():
            raise ValueError("a source changed during the build")

    sinks.publish(spark, parts, f"{target}/.staging", {name: f"{root}/{name}" for name in parts}, unchanged)
    return manifest


def _checksums(spark: SparkSession, paths: list[str]) -> DataFrame:
    return cut(delimited.checksums(spark, paths))


def _with_files(manifest: DataFrame, sources: DataFrame, folders: list[str]) -> DataFrame:
    """The manifest's row with ``sources`` and ``artifacts`` (name within the version, bytes, sha256)."""
    root = folders[0].rpartition("/")[0]
    files = delimited.checksums(manifest.sparkSession, folders)
    listed = files.select(F.substring_index("path", root + "/", -1).alias("name"), F.col("length").alias("bytes"), "sha256").where("name not like '%/.%' and name not like '%/\\_%'")
    one = lambda df, name: df.agg(F.array_sort(F.collect_list(F.struct("*"))).alias(name))
    return manifest.crossJoin(one(sources.select(F.col("path").alias("name"), F.col("length").alias("bytes"), "sha256"), "sources")).crossJoin(one(listed, "artifacts"))


def rows_seen(rows: DataFrame, quarantine: DataFrame, identities: DataFrame) -> DataFrame:
    """One row of counters: source rows, malformed ones, identities by membership, repeated and conflicting ones."""
    read = rows.agg(F.count("*").alias("well_formed_rows")).crossJoin(quarantine.agg(F.count("*").alias("malformed_rows")))
    member = lambda m: F.count_if(F.col("membership") == m)
    seen = identities.agg(
        member("train").alias("train_identities"), member("heldout").alias("heldout_identities"), member("unassigned").alias("unassigned_identities"),
        F.sum(F.size("source_rows") - 1).alias("duplicate_identity_rows"), F.count_if(F.col("reason") == "identity_conflict").alias("conflicting_identities"),
    )
    return read.select((F.col("well_formed_rows") + F.col("malformed_rows")).alias("source_rows"), "malformed_rows").crossJoin(seen)


def card(manifest: DataFrame, config: CorpusConfig) -> str:
    """What a reader of the corpus should know, as Markdown."""
    row = manifest.first()
    return "\n".join([
        f"# {config.repository}, version {config.version}", "",
        f"Titles and descriptions of records created up to {config.cutoff}.", "",
        sinks.markdown(manifest.select("train_documents", "validation_documents", "excluded", "aliases")),
        f"- {config.validation_buckets} of {config.buckets} hash buckets of text groups are for validation; a group is never in both.",
        f"- {row['aliases']} exact copies were left out; near duplicates were not looked for.",
        "- No held-out identity, text or long description is in it.",
        "- A line of a shard has the text alone; its origin is in the line of the same place in provenance.",
    ])


def validate_corpus(spark: SparkSession, root: str, raw: dict[str, str]) -> dict[str, int]:
    """Checks a published version on its own: checksums, memberships, every document, and the manifest's counts.

    Returns the numbers of documents by split; anything wrong is a ValueError.
    """
    manifest = spark.read.json(f"{root}/manifest")
    config = manifest.select("config.*").first()
    parts = ("canonical", "quarantine", "exclusions", "split_ids", "provenance", "documents", "quality_report", "card")
    listed = lambda name: manifest.select(F.explode(name).alias("f")).select("f.*")
    files = delimited.checksums(spark, [f"{root}/{p}" for p in parts]).withColumn("path", F.substring_index("path", root.rstrip("/") + "/", -1))
    for wanted, found in ((listed("artifacts"), files), (listed("sources"), delimited.checksums(spark, list(raw.values())))):
        wrong = [r["path"] for r in validate.checksum_differences(wanted.withColumnRenamed("name", "path"), found, by="path").limit(10).collect()]
        if wrong:
            raise ValueError(f"missing or with another checksum: {wrong}")
    train, heldout = (cut(delimited.scan_membership(delimited.lines(spark, raw[n]))) for n in ("train", "heldout"))
    ledger = spark.read.parquet(f"{root}/split_ids")
    keys = ledger.select(F.col("issue_uid").alias("uid"))
    uids = lambda df: df.select(F.concat(F.lit(config["repository"] + ":"), "key").alias("uid"))
    identities = spark.read.parquet(f"{root}/canonical")
    docs = published_shards(spark, f"{root}/documents").select("split", "shard", "at", F.from_json("value", "text string")["text"].alias("text"))
    beside = published_shards(spark, f"{root}/provenance")
    fields = "issue_uid string, source_rows array<long>, created_at string, text_hash string, group_hash string, row_index long, quality_flags array<string>, dedup_aliases array<string>"
    sidecars = beside.select("split", "shard", F.from_json("value", fields).alias("x")).select("split", "shard", "x.*")
    held = corpus.heldout_hashes(identities)
    validate.assert_sound(
        {"ledger_not_train": keys.subtract(uids(train)), "ledger_heldout": keys.intersect(uids(heldout))}
        | validate.violations(docs.withColumnRenamed("at", "row_index"), sidecars, ledger, identities, *held, config["cutoff"], config["seed"], config["buckets"], config["validation_buckets"])
    )
    counts = {r["split"]: r["count"] for r in docs.groupBy("split").count().collect()}
    row = manifest.first()
    if any(counts.get(s, 0) != row[f"{s}_documents"] for s in ("train", "validation")):
        raise ValueError(f"the manifest has other counts than {counts}")
    return counts


def published_shards(spark: SparkSession, folder: str) -> DataFrame:
    """split, shard, at (place in the shard, from 0) and value of the lines that ``sinks`` wrote, one file a shard."""
    lines = spark.read.text(folder, wholetext=True)
    return lines.select("split", "shard", F.posexplode(F.split(F.regexp_replace("value", "\n$", ""), "\n")).alias("at", "value"))


def build_records(spark: SparkSession, raw: dict[str, str], target: str, repository: str, limit: int = 32, max_posting: int = 50_000) -> DataFrame:
    """Raw issues, relations and links (train, test) to set and pointwise records by split.

    Returns coverage and counters per split, which are the manifest too.
    """
    read = lambda name: delimited.lines(spark, raw[name])
    issues = cut(delimited.scan_issues_strict(read("issues"), repository))
    links = delimited.scan_links(read("train")).withColumn("source", F.lit("train")).unionByName(delimited.scan_links(read("test")).withColumn("source", F.lit("test")))
    groups = records.query_groups(links)
    resolved = records.resolve_queries(groups, issues, delimited.scan_relations(read("relations")).drop("relation_id"), repository)
    # A (head, relation) may be in both files; the source keeps its two groups apart.
    queries = cut(resolved.withColumn("query_id", F.concat_ws("\x1f", "query_id", "source")))
    ranked = cut(retrieval.retrieve(issues, queries, limit, max_posting))
    gold = cut(records.valid_gold(queries, issues))
    plain = lambda df: df.withColumn("query_id", F.substring_index("query_id", "\x1f", 1))
    sets = plain(records.set_records(queries, ranked, gold, issues, repository))
    points = plain(records.pointwise_records(queries, ranked, gold, issues))
    # The records are counted by what they are made of, without their texts.
    pairs = ranked.join(issues.select("key"), "key", "left_semi").join(queries.select("query_id", "split"), "query_id")
    coverage = cut(records.coverage(queries, ranked, gold).join(records.made(groups, issues, queries, pairs), "split", "full").na.fill(0))
    parts = {
        "set_retrieval": lambda path: sets.write.partitionBy("split").json(path),
        "pointwise": lambda path: points.write.partitionBy("split").json(path),
        "manifest": lambda path: coverage.coalesce(1).write.json(path),
    }
    sinks.publish(spark, parts, f"{target}/.staging", {name: f"{target}/{name}" for name in parts})
    return coverage


def evaluate_sets(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Predictions and metrics of set records with raw_output and latency_seconds.

    ``answers`` has query_id, query_uid, candidate_records, gold_tail_uids, gold_candidate_labels, raw_output,
    latency_seconds and, if known, generated_tokens.
    """
    parsed = answers.withColumn("_o", outputs.parse_output("raw_output"))
    named = parsed.select("*", F.col("_o.labels").alias("labels"), F.col("candidate_records").alias("candidates"))
    mapped = named.join(metrics.map_labels(named.select("query_id", "labels", "candidates")), "query_id")
    pool = F.transform("candidate_records", lambda c: c["issue_uid"])
    gold_pool = F.transform(F.filter("candidate_records", lambda c: F.array_contains("gold_candidate_labels", c["label"])), lambda c: c["issue_uid"])
    ready = mapped.select(
        "query_id", repository_of(F.col("query_uid")).alias("repository"), F.col("predicted_uids").alias("ranked"), F.col("predicted_uids").alias("predicted"),
        F.col("gold_tail_uids").alias("full_gold"), gold_pool.alias("pool_gold"), pool.alias("candidates"), "invalid_labels", "duplicate_labels",
        F.col("_o.parse_ok").alias("parse_ok"), F.col("_o.parse_error").alias("parse_error"), "latency_seconds",
        F.col("generated_tokens") if "generated_tokens" in answers.columns else F.lit(None).cast("int").alias("generated_tokens"),
    )
    found = metrics.retrieval_metrics(metrics.query_metrics(ready))
    extra = ready.rollup("repository").agg(
        F.grouping("repository").alias("_all"),
        safe_div(F.count_if(~F.col("parse_ok")), F.count("*")).alias("parse_error_rate"),
        F.sum(F.size("invalid_labels")).alias("invalid_labels"),
        F.sum(F.size("duplicate_labels")).alias("duplicate_labels"),
        F.coalesce(F.avg("latency_seconds"), F.lit(0.0)).alias("mean_latency_seconds"),
        F.coalesce(F.avg("generated_tokens"), F.lit(0.0)).alias("mean_generated_tokens"),
    )
    named_extra = extra.withColumn("scope", F.when(F.col("_all") == 1, "overall").otherwise(F.col("repository"))).drop("_all", "repository")
    return ready, found.join(named_extra, "scope")


def evaluate_pointwise(scores: DataFrame, threshold: float | None = None, gold: DataFrame | None = None) -> tuple[float, DataFrame, DataFrame]:
    """Threshold, binary metrics and per-repository retrieval metrics of scored candidates.

    ``scores`` has query_id, query_uid, candidate_uid, retriever_rank, gold_label, gold_tail_uids, and the two
    completions' log-likelihoods; without a threshold the best F1 of these rows is taken. gold_tail_uids may be in
    ``gold`` (query_id, gold_tail_uids) instead, where queries without a row have none.
    """
    if gold is not None:
        scores = scores.drop("gold_tail_uids").join(gold.select("query_id", "gold_tail_uids").dropDuplicates(["query_id"]), "query_id", "left")
    rated = scores.withColumn("probability", softmax_pair(F.col("valid_log_likelihood"), F.col("invalid_log_likelihood")))
    pairs = rated.select(F.col("probability").alias("score"), F.col("gold_label").alias("label"))
    curve = metrics.score_curve(pairs)
    at = metrics.best_f1_threshold(curve).first()["threshold"] if threshold is None else threshold
    binary = metrics.confusion(pairs, at).crossJoin(metrics.roc_auc(curve)).crossJoin(metrics.binary_average_precision(curve))
    order = F.array_sort(F.collect_list(F.struct((-F.col("probability")).alias("p"), "retriever_rank", F.col("candidate_uid").alias("uid"), F.col("gold_label").alias("y"))))
    per = rated.groupBy("query_id").agg(F.first("query_uid").alias("query_uid"), F.first("gold_tail_uids").alias("full_gold"), order.alias("x"))
    uid = lambda xs: F.transform(xs, lambda s: s["uid"])
    ready = per.select(
        "query_id", repository_of(F.col("query_uid")).alias("repository"), uid("x").alias("ranked"), uid(F.filter("x", lambda s: -s["p"] >= at)).alias("predicted"),
        F.coalesce("full_gold", F.array().cast("array<string>")).alias("full_gold"), uid(F.filter("x", lambda s: s["y"] == 1)).alias("pool_gold"), uid("x").alias("candidates"),
    )
    return at, binary, metrics.retrieval_metrics(metrics.query_metrics(ready))
