from __future__ import annotations

import hashlib
import random

import numpy as np

import corpus_pipeline
from corpusloom.llm import language_id, registry
from tests.llm.test_operators import DOCS, prose


def test_stages_keep_clean_documents_and_columns(spark, tmp_path):
    rng = random.Random(20)
    kinds = {"xx": "ka lo mi".split(), "yy": "über schön groß".split()}
    rows = [(i, "\n".join(prose(rng, 30, kinds[lang]) for _ in range(3)), lang, f"s{i % 3}", 0) for i, lang in enumerate(["xx", "yy"] * 40)]
    copies = [(200, rows[0][1], "xx", "s0", 0), (201, rows[1][1] + " " + prose(rng, 1, kinds["yy"]), "yy", "s0", 0)]
    junk = [(300 + i, " ".join(w.upper() + "!!" for w in prose(rng, 60).split()), "xx", "s1", 0) for i in range(20)]
    odd = [(400, None, None, None, 0), (401, "", None, "s", 0), (402, "123 456", None, "s", 0)]
    labels = [(r[0], int(r[0] < 300), 0) for r in rows + junk]
    spark.createDataFrame(rows + copies + junk + odd, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    folder = str(tmp_path)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality_ranker"](spark, docs, folder)
    assert good.columns == docs.columns and ids(good) >= {r[0] for r in rows} and not ids(good) & {r[0] for r in junk}
    known = stages["language_id"](spark, docs, folder)
    assert known.columns == docs.columns and ids(known) >= {r[0] for r in rows + copies} and not ids(known) & {400, 401, 402}
    lines = stages["line_dedup"](spark, docs, folder)
    assert lines.columns == docs.columns and lines.count() == docs.count()
    one = stages["simhash_near_dedup"](spark, docs, folder)
    assert one.columns == docs.columns and ids(one) >= {r[0] for r in rows} and not ids(one) & {200, 201}
    pieces = corpus_pipeline.run(spark, folder)
    assert pieces.count() > 0 and ids(pieces) <= {r[0] for r in rows + copies}


def test_registry_names_every_operator():
    assert sorted({int(n[2:].split("_")[0]) for n in registry.QUERIES}) == list(range(1, 11))


def test_near_duplicates_give_back_what_the_driver_no_longer_needs(spark):
    docs = spark.createDataFrame([(i, prose(random.Random(i % 3), 40), "xx", "s", 0) for i in range(6)], DOCS)
    jvm = spark._jvm
    place = jvm.javax.management.ObjectName("java.lang:type=GarbageCollector,name=G1 Old Generation")
    attribute = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "getAttribute")
    args = spark.sparkContext._gateway.new_array(jvm.Object, 2)
    args[0], args[1] = place, "CollectionCount"
    whole = lambda: attribute.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    before = whole()
    assert dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, "").count() == 3
    assert whole() - before >= 5  # of sketches, representatives, balls, buckets, ids: after each


def test_language_sample_reaches_the_driver_small_and_whole(spark, monkeypatch):
    rng = random.Random(7)
    kinds = {"xx": "ka lo mi ne".split(), "yy": "über schön groß".split()}
    rows = [(i, prose(rng, 300, kinds[lang]), lang, "s", 0) for i, lang in enumerate(["xx", "yy"] * 60)]
    docs = spark.createDataFrame(rows, DOCS)
    sent = []

    def counted(df, to_arrow=type(docs).toArrow):
        sent.append(to_arrow(df))
        return sent[-1]

    monkeypatch.setattr(type(docs), "toArrow", counted)
    model = language_id.fit(docs)
    dense = [(lang, language_id.gram_vector(t).astype(np.float32)) for _, t, lang, _, _ in rows]
    dense.sort(key=lambda r: (r[0], hashlib.blake2b(r[1], digest_size=16).digest()))
    want = language_id.fit_codes(np.stack([x for _, x in dense]), np.array([int(lang == "yy") for lang, _ in dense]), ("xx", "yy"))
    assert [t.num_rows for t in sent] == [len(rows)] and sent[0].nbytes < len(rows) * language_id.DIM
    assert model.languages == want.languages and np.allclose(model.weights, want.weights, 1e-5, 1e-6) and np.allclose(model.trust, want.trust)
