"""Columns of the caller's whose names the operators use inside."""

import pytest
from pyspark.sql import functions as F

from stratalex.llm import conversation_repair, decontaminate, exact_dedup, license_scan, near_dedup, sharding, spelling_variants

NAMES = ["_gone_h", "_gone_id", "_bad_k", "_bad_id", "_k", "_h", "_id", "_w", "_b", "_shard", "_slot", "_text", "_row", "_p", "label", "base", "share", "d", "w", "word", "n"]


@pytest.fixture(scope="module")
def docs(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = spark.createDataFrame([(1, text), (2, text), (3, f"{text} all rights reserved"), (4, None), (5, "abcdefg " * 6)], "doc_id long, text string")
    return rows.select("*", *[F.lit("mine").alias(n) for n in NAMES])


def kept(rows, docs):
    assert set(docs.columns) <= set(rows.columns)
    out = rows.collect()
    assert all(r[n] == "mine" for r in out for n in NAMES)
    return sorted(r["doc_id"] for r in out)


def test_filters_keep_the_callers_columns(spark, docs):
    benchmark = spark.createDataFrame([(1, "abcdefg abcdefg abcdefg")], "item_id long, text string")
    assert kept(near_dedup.drop_near_duplicates(docs), docs) == [1, 4, 5]
    assert kept(decontaminate.drop_contaminated(docs, benchmark), docs) == [1, 2, 3, 4]
    assert kept(exact_dedup.drop_exact_copies(docs), docs) == [2, 3, 4, 5]
    for rows in (near_dedup.drop_near_duplicates(docs.limit(0)), decontaminate.drop_contaminated(docs.limit(0), benchmark)):
        assert rows.count() == 0 and rows.columns == docs.columns


def test_shards_keep_the_callers_columns(spark, docs, tmp_path):
    placed = sharding.assign_shards(docs)
    assert kept(placed, docs) == [1, 2, 3, 4, 5] and {"__slot", "__shard"} <= set(placed.columns)
    sharding.write_shards(docs, str(tmp_path / "out"))
    assert kept(spark.read.parquet(str(tmp_path / "out")), docs) == [1, 2, 3, 4, 5]
    sharding.write_shards(docs.limit(0), str(tmp_path / "none"))


def test_reports_ignore_them(spark, docs):
    assert sorted((r["doc_id"], r["n_base"]) for r in license_scan.scan(docs).collect()) == [(1, 0), (2, 0), (3, 1), (4, 0), (5, 0)]
    words = spelling_variants.counted(spelling_variants.damaged_words(docs), 5)
    assert [(r["word"], r["n"]) for r in words.collect()] == [("abcdefg", 6)]
    talk = spark.createDataFrame([(1, 0, "user", "a."), (1, 1, "assistant", "b.")], "conv_id long, turn long, role string, text string")
    talk = talk.select("*", *[F.lit("mine").alias(n) for n in ("c", "t", "h", "seq", "block", "copies", "kind", "edit")])
    assert conversation_repair.report(talk).first()["audit"] == "KK"
