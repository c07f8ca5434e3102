from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions.hashing import digest_mod, in_shard, sha256, stable_fraction
from corpusloom.functions.numeric import lax_timestamp, repository_of, softmax_pair, strict_timestamp
from corpusloom.operators import corpus, metrics, outputs, records, retrieval, sampling, sinks, token_blocks, validate
from corpusloom.sources import delimited, json_lines


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_dates(spark):
    texts = ["2020-02-29 10:00:00", "2019-02-30 10:00:00", "2020-1-2 3:4:5", "2020-01-02 03:04:05 ", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", strict_timestamp(F.col("t")).isNotNull().alias("s"), lax_timestamp(F.col("t")).isNotNull().alias("l"))
    got = {r["t"]: (r["s"], r["l"]) for r in df.collect()}
    assert got[texts[0]] == (True, True)
    assert got[texts[1]] == (False, False)
    assert got[texts[2]] == (False, True)
    assert not got[texts[3]][0] and got[""] == (False, False)


def test_hashes_against_python(spark):
    import hashlib

    keys = [f"key {i}é" for i in range(50)]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    for r in df.select("k", digest_mod(sha256(F.col("k")), 10007).alias("m"), stable_fraction(F.col("k")).alias("f"), in_shard(F.col("k"), 5, 2).alias("s")).collect():
        h = hashlib.sha256(r["k"].encode()).hexdigest()
        assert r["m"] == int(h, 16) % 10007
        assert r["f"] == int(h[:16], 16) / (16**16 - 1)
        assert r["s"] == (int(h[:16], 16) % 5 == 2)


def issue(n, title, description, key=None, source=None, created="2020-01-01 00:00:00"):
    return (n, source or f"S{n}", key or f"AB-{n}", title, "p", "bug", description, created)


ISSUE = "source_row long, source_id string, key string, title string, project string, issue_type string, description string, created string"


def test_sanitise(spark):
    data = [
        issue(1, "ﬁx  this​ now", "No Description"),
        issue(2, "see AB-12 and https://x.y/browse/AB-1", "is a duplicate of ab-7, the AB-X stays"),
        issue(3, "Same", "sAME"),
        issue(4, "AB-1", ""),
        issue(5, "", "one two three four five six"),
    ]
    got = {r["source_row"]: r for r in corpus.sanitise(spark.createDataFrame(data, ISSUE), ["AB"], 5).collect()}
    assert got[1]["text"] == "Title: fix this now"
    assert set(got[1]["flags"]) == {"normalized_unicode_whitespace_controls", "placeholder_removed", "title_only", "short_text"}
    assert got[2]["text"] == "Title: see [ISSUE_REF] and [ISSUE_REF]\nDescription: , the AB-X stays"
    assert {"issue_url_masked", "issue_id_masked", "explicit_link_reference_removed"} <= set(got[2]["flags"])
    assert "description_equals_title_removed" in got[3]["flags"] and got[3]["text"] == "Title: Same"
    assert got[4]["text"] == "" and "empty_after_cleaning" in got[4]["flags"]
    assert got[5]["flags"] == ["description_only"] and got[5]["desc_hash"] != ""


def test_text_functions_against_python(spark):
    """All characters, common ones without any others beside them, and random mixtures with combining marks."""
    chars = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c <= 0xDFFF]
    common = [chr(c) for a, b in T.COMMON for c in range(a, b)]
    texts = ["A" + "x ".join(chars[i : i + 128]) + "Σ" for i in range(0, len(chars), 128)]
    texts += ["Bß".join(common[i : i + 8]) for i in range(0, len(common), 8)] + [f" {c}Q" for c in common if c < "\u3000"]
    rng, pool = random.Random(1), [*common[:300], *"abcXYZ \t\n\x00\u0301\u1161\u11a8\u3099"]
    texts += ["".join(rng.choice(pool) for _ in range(rng.randrange(30))) for _ in range(2000)] + [None, "", " ", "\n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", T.casefold("t").alias("f"), T.clean_whitespace("t").alias("c"), T.has_alphanumeric("t").alias("a")).collect():
        assert r["f"] == (None if r["t"] is None else r["t"].casefold())
        assert r["c"] == T._clean(r["t"])
        assert r["a"] == any(c.isalnum() for c in r["t"] or "")


def test_folding_needs_no_python(spark):
    """Python workers, each with batches of whole texts, were most of an executor's memory."""
    plan = spark.createDataFrame([("Straße",)], "t string").select(T.casefold("t"), T.has_alphanumeric("t"))._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan
    both = spark.createDataFrame([issue(1, "a", "b")], ISSUE)
    assert corpus.sanitise(both, [])._jdf.queryExecution().executedPlan().toString().count("EvalPython") == 1  # cleans both fields


def test_build_reasons_and_conflicts(spark):
    long = " ".join(f"w{i}" for i in range(60))
    data = [
        issue(1, "a first title here", long),
        issue(2, "another title here", long),
        issue(3, "held out title here", "x " + long),
        issue(4, "HELD out title here", "x " + long),
        issue(5, "nobody knows this one", "d"),
        issue(6, "twice the same text", "text text"),
        issue(7, "twice the SAME text", "text text"),
        issue(8, "conflict", "one", key="AB-6"),
        issue(9, "bad date here", "one", created="2020-1-1 00:00:00"),
    ]
    df = spark.createDataFrame(data, ISSUE)
    member = lambda ns: df.where(F.col("source_row").isin(ns)).select("key", "source_id", "created")
    got = {r["uid"]: r for r in corpus.build(df, member([1, 2, 4, 6, 7, 9]), member([3]), "R", "seed").collect()}
    reason = {k: r["reason"] for k, r in got.items()}
    assert reason["R:AB-1"] is None and reason["R:AB-2"] is None
    assert got["R:AB-1"]["group_hash"] == got["R:AB-2"]["group_hash"]
    assert reason["R:AB-3"] == "heldout_identity" and reason["R:AB-4"] == "heldout_exact_text_overlap"
    assert reason["R:AB-5"] == "unassigned_identity" and reason["R:AB-6"] == "identity_conflict"
    assert reason["R:AB-9"] == "invalid_date"
    assert got["R:AB-6"]["source_rows"] == [6, 8]


def test_build_decides_without_texts(spark):
    """Joins and aggregations over identities carry no texts; with them the result is the same."""
    rng = random.Random(3)
    data = [issue(i, f"title {rng.randrange(15)} of some words", " ".join(f"w{rng.randrange(3)}" for _ in range(55)), created=f"2020-01-01 00:{i:02d}:00") for i in range(50)]
    data += [issue(60, "title 1 of some words", "one", key="AB-7"), issue(61, None, None)]
    df = spark.createDataFrame(data, ISSUE)
    member = lambda rest: df.where(F.col("source_row") % 5 == rest).select("key", "source_id", "created")
    made = [corpus.build(df, member(1).union(member(2)).union(member(3)), member(0), "R", "seed", 10, 3, texts=t) for t in (True, False)]
    assert not {"title", "description", "text"} & set(made[1].columns)
    assert rows(made[0], *made[1].columns) == rows(made[1], *made[1].columns) and made[0].count() == 51
    plan = made[0]._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not [x for x in plan if "Aggregate [" in x and "title#" in x]
    for r in made[0].where("text_hash <> ''").select(T.casefold("text").alias("f"), "text_hash", "title", "source_rows").collect():
        import hashlib

        assert hashlib.sha256(r["f"].encode()).hexdigest() == r["text_hash"]
        assert r["title"] == next(d[3] for d in data if d[0] == r["source_rows"][0])


def test_number_rows_is_dense(spark):
    df = spark.createDataFrame([(i % 3, random.Random(i).random(), i) for i in range(500)], "g int, x double, i int")
    got = corpus.number_rows(df, ["g"], ["x", "i"], "n", 7).collect()
    for g in range(3):
        own = sorted((r["x"], r["i"], r["n"]) for r in got if r["g"] == g)
        assert [r[2] for r in own] == list(range(len(own)))


def test_retrieval_against_loop(spark):
    rng = random.Random(5)
    issues = [(f"K{i:02d}", f"2020-01-{1 + rng.randrange(9):02d} 00:00:00", " ".join(rng.choice("red green blue rare one two".split()) for _ in range(3))) for i in range(30)]
    idf_of = {}
    for k, _, t in issues:
        for w in set(t.split()):
            idf_of[w] = idf_of.get(w, 0) + 1
    cap, limit = 12, 8
    idf = {w: round(math.log(31 / (n + 1)) + 1, 9) for w, n in idf_of.items() if n <= cap}
    frame = spark.createDataFrame(issues, "key string, created string, text string")
    queries = frame.select(F.concat(F.lit("q"), "key").alias("query_id"), "key", "created", "text")
    got = {}
    for r in retrieval.retrieve(frame, queries, limit, cap).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["key"], float(r["score"])))
    for k, d, t in issues:
        terms = set(t.split()) & idf.keys()
        scores = {x: sum(idf[w] for w in terms & set(y.split())) for x, e, y in issues if e < d and x != k}
        best = sorted(((-s, x) for x, s in scores.items() if s > 0))[:limit]
        order = [x for _, x in best]
        order += [x for e, x in sorted(((e, x) for x, e, _ in issues if e < d and x != k and x not in order), reverse=True)][: limit - len(order)]
        assert [x for _, x, _ in sorted(got.get(f"q{k}", []))] == order


def shared_words(n=60):
    """Issues in few words, so that scores tie, and queries of two kinds for each."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(12)] + ["every"]
    return [(f"K{rng.randrange(10**6):06d}", f"2020-01-{1 + i // 5:02d} 00:00:00", " ".join({"every", *(rng.choice(words) for _ in range(rng.randrange(6)))})) for i in range(n)]


@pytest.mark.parametrize("cap", [None, 20])
def test_scores_in_many_blocks_against_loop(spark, cap):
    """With no cap the word that all issues have counts too; blocks of a few issues and queries give what one block gives."""
    issues, limit = shared_words(), 7
    of = {k: set(t.split()) for k, _, t in issues}
    df = {w: sum(w in x for x in of.values()) for x in of.values() for w in x}
    idf = {w: round(math.log((len(issues) + 1) / (n + 1)) + 1, 9) for w, n in df.items() if cap is None or n <= cap}
    frame = spark.createDataFrame(issues, "key string, created string, text string").repartition(3)
    queries = frame.select(F.concat(F.lit("q"), "key").alias("query_id"), "key", "created", F.concat_ws(" ", "text", F.lit("unheard-of")).alias("text"))
    got = {}
    for r in retrieval.scored(frame, queries, limit, cap, block_postings=20, block_terms=15).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["key"], float(r["score"])))
    for k, d, _ in issues:
        scores = {x: round(sum(idf[w] for w in of[k] & of[x] & idf.keys()), 9) for x, e, _ in issues if e < d and x != k}
        best = sorted((-s, x) for x, s in scores.items() if s > 0)[:limit]
        assert sorted(got.get(f"q{k}", [])) == [(i, x, -s) for i, (s, x) in enumerate(best, 1)]


def test_blocks_of_retrieval_are_not_shuffled(spark):
    """Shuffling a copy of each block of issues for each block of queries grows with the square of the input."""
    frame = spark.createDataFrame(shared_words(), "key string, created string, text string")
    queries = frame.select(F.concat(F.lit("q"), "key").alias("query_id"), "key", "created", "text")
    plan = retrieval.scored(frame, queries, 7, 50)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_pools_in_many_blocks(spark):
    """Texts go to the records of all blocks; of the plan's exchanges none carries them."""
    rng = random.Random(2)
    issues = {f"K{i}": None if i == 7 else f"text {i} é" * rng.randrange(1, 4) for i in range(12)}
    frame = spark.createDataFrame([(k, f"u:{k}", t) for k, t in issues.items()], "key string, uid string, text string")
    queries = spark.createDataFrame([(f"q{i}", f"K{i % 12}", "train") for i in range(30)], "query_id string, key string, split string")
    lists = {f"q{i}": rng.sample([*issues, "gone"], rng.randrange(5)) for i in range(30)}
    ranked = spark.createDataFrame([(q, k, 1.5, r) for q, ks in lists.items() for r, k in enumerate(ks, 1)], "query_id string, key string, score double, rank int")
    right = {(q, k) for q, ks in lists.items() for k in ks[:1]}
    gold = spark.createDataFrame([*right, ("q1", "K11")], "query_id string, key string")
    made = records.pools(queries, ranked, gold, frame, block_rows=4)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        got = {r["query_id"]: r for r in made.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got.keys() == lists.keys()
    for i, (q, ks) in enumerate(lists.items()):
        want = [(f"C{r:03d}", f"u:{k}", k, issues[k], r, (q, k) in right) for r, k in enumerate(ks, 1) if k in issues]
        c = [(*(p["candidate"][n] for n in ("label", "issue_uid", "issue_key", "text", "rank")), p["is_gold"]) for p in got[q]["_p"]]
        assert [x[:5] for x in c] == [x[:5] for x in want] and got[q]["body"] == issues[f"K{i % 12}"]
        assert [x[5] for x in c] == [x[5] or (q, x[2]) == ("q1", "K11") for x in want]


def test_set_and_ranking_metrics(spark):
    data = [("q1", "r", ["a", "b", "c"], ["a", "x"], ["a", "c", "z"], ["a", "c"], ["a", "b", "c"]), ("q2", "r", [], [], [], [], ["a"])]
    df = spark.createDataFrame(data, "query_id string, repository string, ranked array<string>, predicted array<string>, full_gold array<string>, pool_gold array<string>, candidates array<string>")
    per = {r["query_id"]: r for r in metrics.query_metrics(df).collect()}
    assert per["q1"]["map"] == pytest.approx((1 + 2 / 3) / 3) and per["q1"]["mrr"] == 1.0
    assert per["q1"]["ndcg_5"] == pytest.approx((1 + 1 / 2) / (1 + 1 / math.log2(3) + 1 / 2))
    assert per["q1"]["full_f1"] == pytest.approx(2 / 5) and per["q2"]["map"] == 0 and per["q2"]["exact_full"] == 1
    over = {r["scope"]: r for r in metrics.retrieval_metrics(metrics.query_metrics(df)).collect()}["overall"]
    assert over["queries"] == 2 and over["empty_prediction_accuracy"] == 1.0 and over["macro_mrr"] == 0.5


@pytest.mark.parametrize("data", [[(0.5, 1), (0.5, 0), (0.9, 1), (0.1, 0), (0.9, 0)], [(0.3, 1)], [], [(0.2, 0), (0.1, 0)]])
def test_binary_metrics(spark, data):
    curve = metrics.score_curve(spark.createDataFrame(data, "score double, label int"))
    pos, neg = [s for s, y in data if y], [s for s, y in data if not y]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg)) if pos and neg else 0.0
    assert metrics.roc_auc(curve).first()[0] == pytest.approx(auc)
    best, at = 0.0, max((s for s, _ in data), default=0.5)
    ap = tp = seen = 0
    for s in sorted({s for s, _ in data}, reverse=True):
        new = sum(y for x, y in data if x == s)
        tp, seen = tp + new, seen + sum(x == s for x, _ in data)
        ap += new / len(pos) * tp / seen if pos else 0
        f = 2 * tp / (seen + len(pos)) if seen + len(pos) else 0
        if f > best:
            best, at = f, s
    assert tuple(metrics.best_f1_threshold(curve).first()) == pytest.approx((at, best))
    assert metrics.binary_average_precision(curve).first()[0] == pytest.approx(ap)


def test_selector_is_exact(spark):
    df = spark.createDataFrame([(i, int(i % 7 == 0)) for i in range(100)], "i int, label int")
    for share in (0.0, 0.1, 0.37, 1.0):
        got = sampling.balanced_selector(df, ["i"], share, 42, "r").collect()
        negatives = [r["i"] for r in got if r["label"] == 0]
        assert len(got) - len(negatives) == 15 and len(negatives) == round(share * 85)


def test_blocks(spark):
    docs = [(0, [1, 2, 3]), (1, []), (2, list(range(4, 12))), (3, [12])]
    df = spark.createDataFrame(docs, "d int, tokens array<int>")
    got = [r["tokens"] for r in token_blocks.blocks(df, 4, ["d"]).orderBy("block").collect()]
    assert got == [[1, 2, 3, 4], [5, 6, 7, 8], [9, 10, 11, 12]]
    per = token_blocks.blocks(df, 4, ["d"], 3).orderBy("batch", "block").collect()
    assert [r["tokens"] for r in per] == [[1, 2, 3, 4], [5, 6, 7, 8]]


def test_parse_output():
    cases = {
        '{"tails": ["a", " b ", ""]} rest': (["a", "b"], True, None),
        "```json\n{\"tails\": []}\n```": ([], True, None),
        "none": ([], False, "no_json_object"),
        '{"tails": [1]}': ([], False, "tails_must_be_a_string_list"),
        '{"tails": "a"}': ([], False, "tails_must_be_a_string_list"),
        '{"tails": ["a"], "tails": ["b"]}': (["b"], True, None),
    }
    for text, want in cases.items():
        assert outputs.parse_tails(text) == want
    assert outputs.parse_tails('{"tails"')[2].startswith("invalid_json")
    assert outputs.parse_tails(None)[2] == "no_json_object"


def test_scans(spark, tmp_path):
    good = "\t".join(["1", "AB-1", "t", "p", "b", "s", "d", "2020-01-01 00:00:00"])
    (tmp_path / "issues.txt").write_text(good + "\nbroken\tline\n" + good.replace("AB-1", "AB-2") + "\n")
    numbered = delimited.lines(spark, str(tmp_path / "issues.txt"))
    ok, bad = delimited.scan_issues(numbered)
    assert rows(ok, "source_row", "key") == [(1, "AB-1"), (3, "AB-2")] and rows(bad, "source_row") == [(2,)]
    with pytest.raises(Exception, match="wrong field count"):
        delimited.scan_issues_strict(numbered, "R").collect()
    (tmp_path / "members.txt").write_text("2\nAB-1\tS1\t2020-01-01 00:00:00\nAB-1\tS1\t2020-01-01 00:00:00\n")
    assert rows(delimited.scan_membership(delimited.lines(spark, str(tmp_path / "members.txt"))), "key") == [("AB-1",)]
    (tmp_path / "wrong.txt").write_text("3\nAB-1\tS1\t2020-01-01 00:00:00\n")
    with pytest.raises(ValueError, match="header"):
        delimited.scan_membership(delimited.lines(spark, str(tmp_path / "wrong.txt")))
    (tmp_path / "links.txt").write_text("1\na\tr\tb\t2020-01-01 00:00:00\n")
    assert rows(delimited.adjacency(delimited.scan_links(delimited.lines(spark, str(tmp_path / "links.txt")))), "head", "relation") == [("a", "r")]
    assert delimited.checksums(spark, str(tmp_path / "links.txt")).count() == 1


def test_publish_and_checkpoints(spark, tmp_path):
    df = spark.range(3)
    sinks.publish(spark, {"a": df}, str(tmp_path / "staging"), {"a": str(tmp_path / "out" / "a")})
    assert spark.read.parquet(str(tmp_path / "out" / "a")).count() == 3
    with pytest.raises(FileExistsError):
        sinks.publish(spark, {"a": df}, str(tmp_path / "staging"), {"a": str(tmp_path / "out" / "a")})
    for n in (2, 10):
        (tmp_path / f"checkpoint-{n}").mkdir()
    assert json_lines.newest_checkpoint(spark, str(tmp_path)).endswith("checkpoint-10")
    assert json_lines.missing_paths(spark, [str(tmp_path), str(tmp_path / "no")]) == [str(tmp_path / "no")]


def test_checks_find_what_is_wrong(spark):
    train = spark.createDataFrame([("a", "1", "x"), ("b", "2", "x")], "key string, source_id string, created string")
    held = spark.createDataFrame([("b", "2", "x")], "key string, source_id string, created string")
    checks = validate.membership_sets(train, held, held, train.where("key = 'a'"))
    got = {r["check"]: r["violations"] for r in validate.counts(checks).collect()}
    assert got == {"train_heldout_disjoint": 1, "heads_heldout": 0, "heads_not_train": 1, "members_have_rows": 1}
    with pytest.raises(ValueError, match="train_heldout_disjoint"):
        validate.assert_sound(checks)


def test_small_functions(spark):
    df = spark.createDataFrame([("Apache:A-1", 1.0, 3.0), ("none", 0.0, 0.0)], "u string, a double, b double")
    got = df.select(repository_of(F.col("u")), softmax_pair(F.col("a"), F.col("b"))).collect()
    assert got[0][0] == "apache" and got[1][0] == "unknown" and got[1][1] == 0.5
    assert got[0][1] == pytest.approx(math.exp(1) / (math.exp(1) + math.exp(3)))
    assert spark.createDataFrame([("Straße", )], "t string").select(T.casefold("t")).first()[0] == "strasse"
