from __future__ import annotations

import gzip
import json

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import encoding, outputs, records, sampling, sinks, token_blocks, validate
from corpusloom.sources import delimited, json_lines


def words_tokenizer():
    """Words as tokens, by a table that grows; roles are words of their own."""
    ids, names = {}, []

    def encode(text):
        for w in text.split():
            if w not in ids:
                ids[w] = len(names)
                names.append(w)
        return [ids[w] for w in text.split()]

    def chat(messages, cue):
        return encode(" ".join(f"<{m['role']}> {m['content']}" for m in messages) + (" <assistant>" if cue else ""))

    return encoding.Tokenizer(encode, lambda t: " ".join(names[i] for i in t), chat)


def record(candidates, words):
    return {
        "query_id": "q", "query_uid": "R:q", "query_text": "ask " * words, "relation": "blocks", "relation_definition": "d",
        "prompt": [{"role": "system", "content": "s"}, {"role": "user", "content": "full " * 5000}],
        "completion": [{"role": "assistant", "content": '{"tails": ["C01"]}'}],
        "candidate_records": [{"label": f"C{i:02}", "text": f"t{i} " * words} for i in range(candidates)],
    }


def test_set_examples_keep_every_candidate():
    t = words_tokenizer()
    made = encoding.encode_record(record(20, 400), t, True, 2048)
    assert len(made["input_ids"]) <= 2048 and made["attention_mask"] == [1] * len(made["input_ids"])
    text = t.decode(made["input_ids"])
    assert all(f"C{i:02}: t{i}" in text for i in range(20)) and text.endswith('{"tails": ["C01"]}')
    answer = [x for x in made["labels"] if x != token_blocks.IGNORED]
    assert made["input_ids"][-len(answer) :] == answer and t.decode(answer) == '{"tails": ["C01"]}'
    with pytest.raises(ValueError, match="do not all fit"):
        encoding.encode_record(record(60, 400), t, True, 1024)


def test_pointwise_prompts_are_cut():
    t = words_tokenizer()
    made = encoding.encode_record(record(1, 1), t, False, 64)
    assert len(made["input_ids"]) == 64 and t.decode(made["input_ids"]).endswith('{"tails": ["C01"]}')
    long = record(1, 1) | {"completion": [{"role": "assistant", "content": "x " * 64}]}
    with pytest.raises(ValueError, match="alone"):
        encoding.encode_record(long, t, False, 64)


def test_an_answer_whose_prompt_is_no_prefix():
    t = words_tokenizer()
    other = encoding.Tokenizer(t.encode, t.decode, lambda m, cue: t.encode("a") if cue else t.encode("b c"), " <end>")
    assert encoding.split_ids(other, [], [{"role": "assistant", "content": "yes"}]) == (t.encode("a"), t.encode("yes <end>"))


def test_encoding_of_a_table(spark):
    rows = spark.read.json(spark.sparkContext.parallelize([json.dumps(record(3, 5)), json.dumps(record(2, 5) | {"query_id": "p"})]))
    got = {r["query_id"]: r for r in encoding.encode(rows, words_tokenizer, "set_retrieval", 2048).collect()}
    assert sorted(got) == ["p", "q"] and all(len(r["input_ids"]) == len(r["labels"]) for r in got.values())
    with pytest.raises(ValueError, match="unknown task"):
        encoding.encode(rows, words_tokenizer, "other", 64)


@pytest.mark.parametrize(("candidates", "limit"), [(0, 512), (1, 1024), (7, 2048), (32, 4096), (500, 8192)])
def test_budgets_agree(spark, candidates, limit):
    columns = token_blocks.prompt_budgets(F.lit(candidates), limit)
    assert tuple(spark.range(1).select(*columns).first()) == encoding.budgets(candidates, limit)


def test_completion_ids(spark):
    df = spark.createDataFrame([([1, 2], [1, 2, 3], [9]), ([1, 2], [1, 3, 3], [9])], "p array<int>, f array<int>, a array<int>")
    assert [r[0] for r in df.select(token_blocks.completion_ids(F.col("p"), F.col("f"), F.col("a"))).collect()] == [[3], [9]]


def test_diagnostics_name_the_place():
    assert outputs.parse_tails('so: {"tails": [1,}')[2].startswith("invalid_json: ") and "(char " in outputs.parse_tails('so: {"tails": [1,}')[2]


def test_roles(spark):
    df = spark.createDataFrame([([("system", "a"), ("tool_call", "b"), ("it's", "c"), ("assistant", "d")],)], "m array<struct<role:string,content:string>>")
    text = df.select(records.fallback_chat(F.col("m"), False, "<e>")).first()[0]
    assert text == "System:\na\nTool_Call:\nb\nIt'S:\nc\nAssistant:\nd\n<e>"


def test_json_sources(spark, tmp_path):
    folder = tmp_path / "shards"
    folder.mkdir()
    (folder / "train-00000.jsonl").write_text('{"text": "a"}\n\n{"text": "b"}\n')
    (folder / "train-00001.jsonl").write_text('{"text": "c"}\n')
    (folder / "validation-00000.jsonl").write_text('{"text": "v"}\n')
    assert json_lines.read_jsonl(spark, str(folder / "train-00000.jsonl"), "text string").count() == 2
    assert sorted(r["text"] for r in json_lines.read_shards(spark, [str(folder)], "train").collect()) == ["a", "b", "c"]
    (folder / "train-00002.jsonl").write_text('{"text": "c", "id": 1}\n')
    with pytest.raises(ValueError, match="exactly one field"):
        json_lines.read_shards(spark, [str(folder)], "train")
    (tmp_path / "bad.jsonl").write_text("not json\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        json_lines.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "text string").collect()
    stream = json_lines.stream_jsonl(spark, str(folder), "text string")
    query = stream.writeStream.format("memory").queryName("shards").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.table("shards").count() == 5


def test_config_and_manifests(spark, tmp_path):
    assert json_lines.read_config('version = "r_v1"\nn = 3', {"version": str, "n": int})["n"] == 3
    for text in ('version = "R-1"', "n = 3"):
        with pytest.raises(ValueError, match="version"):
            json_lines.read_config(text, {"version": str})
    (tmp_path / "m.json").write_text(json.dumps({"counts": {"a": 1, "b": 2}}))
    assert json_lines.read_manifests(spark, {"R": str(tmp_path / "m.json")}, ["b"]).collect()[0].asDict() == {"repository": "R", "b": 2}
    with pytest.raises(ValueError, match="lacks"):
        json_lines.read_manifests(spark, {"R": str(tmp_path / "m.json")}, ["c"])


def test_cutoff_and_widths(spark, tmp_path):
    (tmp_path / "c.txt").write_text("R\tuntil 2020-01-05\nS\t2021-01-01\n")
    rows = delimited.lines(spark, str(tmp_path / "c.txt"))
    delimited.check_cutoff(rows, "R", "2020-01-05 00:00:00")
    with pytest.raises(ValueError, match="no cutoff"):
        delimited.check_cutoff(rows, "S", "2020-01-05 00:00:00")
    assert [tuple(r) for r in delimited.width_histogram(rows).collect()] == [(2, 2)]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("pointwise", "train", 1), ("set", "test", 2)], "task string, split string, n int")
    sinks.write_split_tasks(rows, str(tmp_path / "tasks"))
    assert (tmp_path / "tasks/task=set/split=test").is_dir()
    sinks.write_predictions(rows.coalesce(1), str(tmp_path / "predictions"))
    part = next((tmp_path / "predictions").glob("*.json.gz"))
    assert len(gzip.open(part, "rt").read().splitlines()) == 2
    with pytest.raises(ValueError, match="not a number"):
        sinks.write_metrics(spark.sql("SELECT double('NaN') AS f1"), str(tmp_path / "metrics"))
    sinks.write_metrics(spark.sql("SELECT 0.5D AS f1"), str(tmp_path / "metrics"))
    assert spark.read.json(str(tmp_path / "metrics")).first()["f1"] == 0.5
    assert sinks.markdown(rows.where("n = 1")) == "| task | split | n |\n|---|---|---|\n| pointwise | train | 1 |\n"
    assert json.loads(sinks.report(rows.where("n = 2"))) == {"n": 2, "split": "test", "task": "set"}
    manifest = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "name string, sha256 string")
    files = spark.createDataFrame([("x/a", "1"), ("x/b", "9")], "path string, sha256 string")
    assert sorted(r[0] for r in validate.checksum_differences(manifest, files).collect()) == ["b", "c"]


def test_take_and_interleave(spark):
    one, two = spark.range(40).withColumn("s", F.lit(1)), spark.range(10).withColumn("s", F.lit(2))
    assert [r["id"] for r in sampling.take(one, 3, ["id"]).collect()] == [0, 1, 2]
    got = sampling.weighted_interleave([one, two], [0.5, 0.5], ["id"])
    found = {(r["s"], r["id"]) for r in got.collect()}
    assert found == {(1, k) for k in range(40)} | {(2, k) for k in range(10)}
    times = {r["s"]: r["n"] for r in got.groupBy("s").agg(F.count("*").alias("n")).collect()}
    assert times[1] >= 40 and times[2] > 10  # an exhausted source begins again
