"""From a question to the context of its answer: enhance, cut, embed, search, weigh, expand, print."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalex.functions import embedding, enrich
from stratalex.functions.segment import tokens
from stratalex.operators import block_index, context, retrieval
from stratalex.sources.scratch import Scratch, written

FIELDS = {"content": 1.0, "chapter_title": 2.0}
DEFAULT_STAGE = "junior"


def write_store(chunks: DataFrame, path: str) -> None:
    """What questions read beside the chunks: the text index with the grades, and the vectors by chunk id."""
    block_index.write(chunks, "chunk_id", list(FIELDS), f"{path}/text", ["grade"])
    vectors = chunks.select(F.col("chunk_id").alias("vec_id"), embedding.embed_local("content").alias("embedding"))
    vectors.write.option("compression", "zstd").parquet(f"{path}/vectors")


def asked(spark: SparkSession, question: str, stage: str) -> tuple[list[str], list[float]]:
    """The terms and the vector of a question with the words of its stage; made as the store's are."""
    enhanced = spark.range(1).select(enrich.enhance_query(F.lit(question), F.lit(stage)).alias("q"))
    row = enhanced.select(tokens(F.col("q")).alias("terms"), embedding.embed_local("q").alias("vector")).first()
    return list(row["terms"]), [float(x) for x in row["vector"]]


def results(chunks: DataFrame, store: str, question: str, stage: str | None = None, extend: bool = False, k: int = 5) -> DataFrame:
    """The k best chunks for a question, as ``retrieval.search`` gives them; a blank stage is junior."""
    spark, stage = chunks.sparkSession, stage or DEFAULT_STAGE
    terms, vector = asked(spark, question, stage)
    by_text = block_index.search(spark, f"{store}/text", terms, FIELDS, retrieval.BM25_TOP, enrich.in_stage(F.col("grade"), stage, extend))
    return retrieval.search(chunks, spark.read.parquet(f"{store}/vectors"), terms, vector, stage, extend, k, by_text=by_text)


def expanded(chunks: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """``found`` by score and weight, with neighbours, and with the columns of the chunks."""
    few = ["chunk_id", "source_file", "start_char", "weight"]
    with Scratch(chunks.sparkSession, "expand") as scratch:
        ordered = context.by_weight(found.select("chunk_id", "score", "position").join(chunks.select(*few), "chunk_id"))
        ordered = scratch.written(ordered, "results")  # at most 20 rows
        anchors = ordered.select(F.col("chunk_id").alias("anchor_id"), "source_file", "start_char")
        picked = context.expand(ordered.select("chunk_id", "score", "position"), context.neighbours(chunks, anchors), k)
        return written(chunks.join(F.broadcast(picked), "chunk_id"), "expanded")  # at most 24 rows


def question_context(chunks: DataFrame, store: str, question: str, stage: str | None = None, extend: bool = False, k: int = 5) -> DataFrame:
    """context, n: what a model is told of the store for a question; empty where nothing is found."""
    return context.prompt_text(expanded(chunks, results(chunks, store, question, stage, extend, k), k))
