from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from corpusloom.plans.build import CorpusConfig, build_corpus, build_records, evaluate_pointwise, evaluate_sets, validate_corpus

DAY = "2020-01-{:02d} 00:00:00"


def raw_files(folder):
    n = 12
    issues = [f"S{i}\tAB-{i}\ttitle number {i} word\tp\tbug\topen\tshared text {i % 4} of it\t{DAY.format(i + 1)}" for i in range(n)]
    (folder / "issues.txt").write_text("\n".join(issues) + "\nbroken line\n")
    member = lambda ids: f"{len(ids)}\n" + "".join(f"AB-{i}\tS{i}\t{DAY.format(i + 1)}\n" for i in ids)
    (folder / "train.txt").write_text(member(range(9)))
    (folder / "heldout.txt").write_text(member(range(9, n)))
    (folder / "links.txt").write_text(f"1\nAB-9\tblocks\tAB-1\t{DAY.format(1)}\n")
    (folder / "train_links.txt").write_text(f"3\nAB-77\tblocks\tAB-1\t{DAY.format(1)}\nAB-5\tblocks\tAB-1\t{DAY.format(1)}\nAB-5\tblocks\tAB-8\t{DAY.format(1)}\n")
    (folder / "relations.txt").write_text("1\nblocks\tStops it.\t0\n")
    (folder / "good.txt").write_text("\n".join(issues) + "\n")
    return {k: str(folder / f"{k}.txt") for k in ("issues", "train", "heldout", "links", "train_links", "relations", "good")}


def test_corpus_and_records(spark, tmp_path):
    raw = raw_files(tmp_path)
    config = CorpusConfig("R", "r_v1", DAY.format(9), "seed", shard_size=4)
    manifest = build_corpus(spark, {k: raw[k] for k in ("issues", "train", "heldout", "links")}, str(tmp_path / "out"), config).first()
    assert (manifest["train"], manifest["excluded"], manifest["aliases"], manifest["train_documents"] + manifest["validation_documents"]) == (9, 0, 0, 9)
    shards = spark.read.text(str(tmp_path / "out/r_v1/documents")).count()
    assert shards == 9 and spark.read.parquet(str(tmp_path / "out/r_v1/quarantine")).count() == 1
    with pytest.raises(FileExistsError):
        build_corpus(spark, {k: raw[k] for k in ("issues", "train", "heldout", "links")}, str(tmp_path / "out"), config)

    coverage = build_records(spark, {"issues": raw["good"], "train": raw["train_links"], "test": raw["links"], "relations": raw["relations"]}, str(tmp_path / "sft"), "R", limit=4)
    assert sum(r["gold"] for r in coverage.collect()) == 2  # the link to a later issue does not count
    assert [sum(r[c] for r in coverage.collect()) for c in ("query_issue_missing", "set_records", "pointwise_records")] == [1, 2, 8]
    sets = spark.read.json(str(tmp_path / "sft/set_retrieval"))
    assert sets.count() == 2 and {r["query_id"] for r in sets.collect()} == {"R:AB-5:blocks", "R:AB-9:blocks"}
    answers = sets.select("query_id", "query_uid", "candidate_records", "gold_tail_uids", "gold_candidate_labels", F.col("completion")[0]["content"].alias("raw_output"), F.lit(0.5).alias("latency_seconds"), F.lit(7).alias("generated_tokens"))
    _, found = evaluate_sets(answers)
    over = {r["scope"]: r for r in found.collect()}["overall"]
    assert over["pool_exact"] == 1.0 and over["parse_error_rate"] == 0.0 and over["mean_latency_seconds"] == 0.5 and over["mean_generated_tokens"] == 7.0


def test_pointwise_evaluation(spark):
    rows = [("R:q", "R:q", "R:a", 1, 1, ["R:a"], -0.1, -3.0), ("R:q", "R:q", "R:b", 2, 0, ["R:a"], -3.0, -0.1)]
    df = spark.createDataFrame(rows, "query_id string, query_uid string, candidate_uid string, retriever_rank int, gold_label int, gold_tail_uids array<string>, valid_log_likelihood double, invalid_log_likelihood double")
    at, binary, found = evaluate_pointwise(df)
    row = json.loads(binary.toJSON().first())
    assert 0.5 < at < 1 and row["auroc"] == 1.0 and row["average_precision"] == 1.0 and row["f1"] == 1.0
    assert {r["scope"]: r["full_exact"] for r in found.collect()} == {"overall": 1.0, "r": 1.0}
    # Gold in a table of its own; a query that it lacks has none.
    gold = spark.createDataFrame([("R:other", ["R:a"])], "query_id string, gold_tail_uids array<string>")
    _, _, found = evaluate_pointwise(df.drop("gold_tail_uids"), gold=gold)
    assert {r["scope"]: r["full_exact"] for r in found.collect()} == {"overall": 0.0, "r": 0.0}


def test_a_published_version_is_validated_on_its_own(spark, tmp_path):
    raw = {k: v for k, v in raw_files(tmp_path).items() if k in ("issues", "train", "heldout", "links")}
    (tmp_path / "cutoff.txt").write_text("Q\t2020-01-09\nR\tuntil 2020-01-09\n")
    raw["cutoff"] = str(tmp_path / "cutoff.txt")
    # Five buckets of ten, so that both splits have documents.
    config = CorpusConfig("R", "r_v1", DAY.format(9), "seed", buckets=10, validation_buckets=5, shard_size=2)
    build_corpus(spark, raw, str(tmp_path / "out"), config)
    root = str(tmp_path / "out/r_v1")
    manifest = json.loads(spark.read.text(f"{root}/manifest").first()[0])
    assert (manifest["source_rows"], manifest["malformed_rows"], manifest["duplicate_identity_rows"]) == (13, 1, 0)
    assert manifest["config"]["near_duplicates"] == "disabled_pending_review" and len(manifest["sources"]) == 5
    assert {a["name"].split("/")[0] for a in manifest["artifacts"]} == {"canonical", "quarantine", "exclusions", "split_ids", "provenance", "documents", "quality_report", "card"}
    report = json.loads(spark.read.text(f"{root}/quality_report").first()[0])
    assert sum(x["n"] for x in report["exclusions"]) == 3 and report["quality_flags"] == []
    assert "near duplicates were not looked for" in "\n".join(r[0] for r in spark.read.text(f"{root}/card").collect())

    counts = validate_corpus(spark, root, raw)
    assert sum(counts.values()) == 9 and counts["train"] == manifest["train_documents"]
    # The local file system has checksums of its own, which would be the first to speak.
    for crc in (tmp_path / "out").rglob(".*.crc"):
        crc.unlink()
    shard = next((tmp_path / "out/r_v1/documents").rglob("*.txt"))
    whole = shard.read_text()
    shard.write_text(whole.replace("title", "little"))
    with pytest.raises(ValueError, match=f"checksum.*{shard.name}"):
        validate_corpus(spark, root, raw)
    shard.write_text(whole)
    (tmp_path / "links.txt").write_text("0\n")
    with pytest.raises(ValueError, match="checksum.*links"):
        validate_corpus(spark, root, raw)


def test_wrong_documents_are_found_behind_right_checksums(spark, tmp_path):
    raw = {k: v for k, v in raw_files(tmp_path).items() if k in ("issues", "train", "heldout", "links")}
    build_corpus(spark, raw, str(tmp_path / "out"), CorpusConfig("R", "r_v1", DAY.format(9), "seed"))
    root = tmp_path / "out/r_v1"
    shard = next((root / "documents").rglob("*.txt"))
    before = hashlib.sha256(shard.read_bytes()).hexdigest()
    shard.write_text(shard.read_text().replace("title", "little"))
    part = next((root / "manifest").glob("*.json"))
    made = json.loads(part.read_text().replace(before, hashlib.sha256(shard.read_bytes()).hexdigest()))
    part.write_text(json.dumps(made))
    for crc in root.rglob(".*.crc"):
        crc.unlink()
    with pytest.raises(ValueError, match="text_hash_right"):
        validate_corpus(spark, str(root), raw)


def test_configurations_and_cutoffs_that_are_refused(spark, tmp_path):
    good = {"repository": "R", "version": "r_v1", "cutoff": DAY.format(9), "seed": "s"}
    for wrong in ({"version": "R-1"}, {"cutoff": "2020"}, {"near_duplicates": "minhash"}, {"sanitisation": "v2"}, {"validation_buckets": 0}, {"shard_size": 0}):
        with pytest.raises(ValueError, match="."):
            CorpusConfig(**(good | wrong))
    raw = {k: v for k, v in raw_files(tmp_path).items() if k in ("issues", "train", "heldout", "links")}
    (tmp_path / "cutoff.txt").write_text("R\t2021-01-09\n")
    with pytest.raises(ValueError, match="no cutoff"):
        build_corpus(spark, raw | {"cutoff": str(tmp_path / "cutoff.txt")}, str(tmp_path / "out"), CorpusConfig(**good))
    assert not (tmp_path / "out/r_v1").exists()
