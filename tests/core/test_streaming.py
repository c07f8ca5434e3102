from __future__ import annotations

from corpusloom.streaming import events


def test_exact_negative_selection_and_restart(spark, tmp_path):
    rows = [(s, int(i % 5 == 0), i) for s in ("a", "b") for i in range(50)]
    schema = "source string, label int, i int"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / "one"))
    stream = events.file_stream(spark, str(tmp_path / "in" / "*"), schema)
    for _ in range(2):  # the second pass has nothing new
        events.run_once(events.select_negatives(stream, 1, 4), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    for s in ("a", "b"):
        assert sum(r["label"] for r in got if r["source"] == s) == 10
        assert sum(1 - r["label"] for r in got if r["source"] == s) == 10


def test_windows(spark):
    df = spark.createDataFrame([("2024-01-01 00:10:00", "x", 1.0), ("2024-01-01 00:50:00", "x", 2.0), ("2024-01-01 01:10:00", "x", 4.0)], "ts string, event_type string, value double")
    got = events.windowed_counts(df).collect()
    assert sorted((r["n"], float(r["total"])) for r in got) == [(1, 4.0), (2, 3.0)]
