"""The thin queries of the contract: folds, thresholds, columns and ranges, on the smallest given table."""

from __future__ import annotations

import zlib

import pytest

from corpusloom.llm import queries

TABLES = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("name", "folds", "held", "label"), [("op1_quality_ranker", 3, 1, 0.5), ("op2_toxicity", 4, 2, 0.3)])
def test_scores_of_every_document(spark, name, folds, held, label):
    got = queries.QUERIES[name](spark, TABLES).select("doc_id", "held_out", "score", "predicted").collect()
    ids = [r["doc_id"] for r in spark.read.parquet(f"{TABLES}/documents.parquet").select("doc_id").collect()]
    assert sorted(r["doc_id"] for r in got) == sorted(ids)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % folds == held)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= label)


@pytest.mark.parametrize(("name", "table", "column", "folds", "held"), [("op1_quality_ranker", "labels", "quality", 3, 1), ("op2_toxicity", "labels", "toxic", 4, 2), ("op9_language_id", "documents", "lang", 5, 0)])
def test_held_out_labels_change_nothing(spark, tmp_path, name, table, column, folds, held):
    """The labels of the held-out fold, all changed, leave every score as it was."""
    for t in ("documents", "labels"):
        rows = spark.read.parquet(f"{TABLES}/{t}.parquet").coalesce(1)
        if t == table:
            out = f"crc32(cast(cast(doc_id AS string) AS binary)) % {folds} = {held}"
            other = f"1 - {column}" if table == "labels" else "'zz'"
            rows = rows.selectExpr(*(f"CASE WHEN {out} THEN {other} ELSE {c} END AS {c}" if c == column else c for c in rows.columns))
        rows.write.parquet(f"{tmp_path}/{t}.parquet")
    value = "score" if name != "op9_language_id" else "concat(lang_pred, ' ', round(score, 6))"
    of = lambda folder: {r[0]: r[1] for r in queries.QUERIES[name](spark, str(folder)).selectExpr("doc_id", value).collect()}
    before, after = of(TABLES), of(tmp_path)
    assert before.keys() == after.keys()
    assert all(before[k] == pytest.approx(after[k], abs=1e-6) if isinstance(before[k], float) else before[k] == after[k] for k in before)


def test_languages_of_every_document(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{TABLES}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in queries.QUERIES["op9_language_id"](spark, TABLES).collect()}
    assert got.keys() == docs.keys()
    learned = {d["lang"] for d in docs.values() if d["lang"] is not None and zlib.crc32(str(d["doc_id"]).encode()) % 5}
    for k, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0) and 0 <= r["score"] <= 1
        letters = any(c.isalpha() for c in docs[k]["text"] or "")
        assert (r["lang_pred"] in learned) if letters else r["lang_pred"] == "und"
    sure = [k for k in got if got[k]["held_out"] and docs[k]["lang"] is not None]
    assert sum(got[k]["lang_pred"] == docs[k]["lang"] for k in sure) >= 0.9 * len(sure)
