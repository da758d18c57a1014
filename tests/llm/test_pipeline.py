"""The pipeline against stages worked out one by one on a small corpus."""

import random
from collections import Counter

import corpus_pipeline
from stratalex.llm import near_dedup


def corpus(words):
    rng = random.Random(3)
    docs, labels, n = [], [], 0
    bench = [" ".join(words(900 + i, 30, 50_000)) for i in range(3)]
    kinds = {}

    def add(text, kind, toxic=0):
        nonlocal n
        docs.append((n, text))
        labels.append((n, 1, toxic))
        kinds[n] = kind
        n += 1

    for i in range(150):
        add(" ".join(words(i, 60 + i % 50, 50_000)), "clean")
        if i % 4 == 0:
            w = words(5000 + i, 60, 50_000)
            w[3:3] = ["scum", "moron", "idiotic"]
            add(" ".join(w), "toxic", 1)
    for i in range(0, 20):
        add(docs[[k for k in kinds if kinds[k] == "clean"][i]][1], "copy")
    for i in range(12):
        base = words(7000 + i, 150, 50_000)
        add(" ".join(base), "near")
        base[rng.randrange(150)] = "changed"
        add(" ".join(base), "near copy")
    for i in range(6):
        w = words(8000 + i, 50, 50_000)
        add(" ".join(w[:20]) + " " + bench[i % 3] + " " + " ".join(w[20:]), "leak")
    add(None, "empty")
    return docs, labels, bench, kinds


def test_pipeline(spark, make_docs, words, tmp_path):
    docs, labels, bench, kinds = corpus(words)
    make_docs(docs).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    d = str(tmp_path)
    frame = spark.read.parquet(f"{d}/documents.parquet")
    columns, kept = frame.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, d)
        if name != "pack":
            assert frame.columns == columns
        frame.write.parquet(f"{d}/{name}")
        frame = spark.read.parquet(f"{d}/{name}")
        kept[name] = {r.doc_id for r in frame.select("doc_id").collect()}
    gone = lambda a, b: Counter(kinds[i] for i in a - b)
    assert gone(set(kinds), kept["toxicity"]) == {"toxic": 38}
    assert sum(gone(kept["toxicity"], kept["exact_dedup"]).values()) == 20
    # of two near copies the smaller id stays
    assert gone(kept["exact_dedup"], kept["near_dedup"]) == {"near copy": 12}
    assert gone(kept["near_dedup"], kept["decontaminate"]) == {"leak": 6}
    assert kept["pack"] == kept["decontaminate"]
    assert Counter(r.doc_id for r in corpus_pipeline.run(spark, d).collect()) == Counter(r.doc_id for r in frame.collect())
    assert near_dedup.SIMILARITY == 0.8 and near_dedup.SHINGLE == 5


def test_empty_tables(spark, make_docs, tmp_path):
    make_docs([]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
