"""The corpus pipeline: toxicity, exact copies, near-duplicates, benchmark passages, packing.

Every stage takes (spark, docs, sf_dir) and returns the rows it keeps with the columns of
``documents``; the last returns the packed pieces.  ``run`` applies them to ``documents``
one after another, each on the whole table that its predecessor wrote; these tables go at the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratalex.llm import decontaminate, exact_dedup, near_dedup, packing, toxicity
from stratalex.llm.common import Scratch, table, written

VOCABULARY, END_ID = "byte_bpe_50k.json", 0

#: Packing depends on a tokenizer and the first stage on a fitted classifier.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_copies(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.best_fit(docs, VOCABULARY, END_ID)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("pack", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with Scratch(spark, "pipeline") as scratch:
        for name, stage in STAGES[:-1]:
            docs = scratch.written(stage(spark, docs, sf_dir), name)
        return written(STAGES[-1][1](spark, docs, sf_dir), "packed")
