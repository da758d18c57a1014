"""The chunk store: upsert, deletes, statistics, incremental files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from stratalex.functions import text as T
from stratalex.functions.embedding import embed_local
from stratalex.operators.order import with_sum_before
from stratalex.sources.scratch import Scratch


def keep_first(rows: DataFrame, content: str, order: str) -> DataFrame:
    """One row for each distinct content, that of the smallest order value.

    A minimum for each hash instead of a window: copies meet as partial results, so a
    content that a third of all rows have doesn't gather in one task.
    """
    hashed = rows.withColumn("content_hash", T.content_hash(F.col(content)))
    first = hashed.groupBy("content_hash").agg(F.min(order).alias(order))
    return hashed.join(first, ["content_hash", order], "left_semi")


def upsert(old: DataFrame, new: DataFrame, content: str, order: str) -> DataFrame:
    """``old`` and ``new`` by content hash; the row of the largest order value wins."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1))).withColumn("content_hash", T.content_hash(F.col(content)))
    best = both.groupBy("content_hash").agg(F.max(F.struct("_new", order)).alias("_best"))
    best = best.select("content_hash", F.col("_best._new").alias("_new"), F.col(f"_best.{order}").alias(order))
    return both.join(best, ["content_hash", "_new", order], "left_semi").drop("_new")


def _by_prefix(rows: DataFrame, digits: int) -> DataFrame:
    """In order of the hash, so that a partition of any size is written by as many tasks as it needs."""
    return rows.withColumn("prefix", F.substring("content_hash", 1, digits)).repartitionByRange("prefix", "content_hash")


def write_store(rows: DataFrame, content: str, path: str, digits: int = 2) -> None:
    """Stores rows, of which each content is there once, by the first hexadecimal digits of their content's hash."""
    _by_prefix(rows.withColumn("content_hash", T.content_hash(F.col(content))), digits).write.partitionBy("prefix").parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", path).schema(_store_schema(spark, path)).parquet(path)


def _store_schema(spark: SparkSession, path: str) -> StructType:
    """The prefix is text, though it may look like a number."""
    fields = [f for f in spark.read.parquet(path).schema if f.name != "prefix"]
    return StructType([*fields, StructField("prefix", StringType())])


def merge_into(path: str, new: DataFrame, content: str, order: str) -> list[str]:
    """Upserts into a written store and returns the prefixes it wrote; the others' files are neither read nor written.

    The same result as ``upsert`` of the whole store.  Running it again with the same rows
    changes nothing, so a run that broke off is repeated.
    """
    spark = new.sparkSession
    old = read_store(spark, path)
    digits = len(old.select("prefix").first()["prefix"] if not old.isEmpty() else "00")
    with Scratch(spark, "merge") as scratch:
        new = scratch.written(new.select(*[c for c in old.columns if c not in ("content_hash", "prefix")]), "new")
        met = new.select(F.substring(T.content_hash(F.col(content)), 1, digits).alias("prefix")).distinct()
        touched = sorted(r["prefix"] for r in met.collect())  # 16 ** digits at most
        if touched:
            kept = old.where(F.col("prefix").isin(touched)).drop("content_hash", "prefix")
            merged = scratch.written(_by_prefix(upsert(kept, new, content, order), digits), "merged")
            merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("prefix").parquet(path)
    return touched


def char_delta(old: DataFrame, new: DataFrame, content: str) -> DataFrame:
    """Characters that new distinct contents add to the store: one row."""
    h = lambda d: d.select(T.content_hash(F.col(content)).alias("h"), F.length(content).alias("n")).dropDuplicates(["h"])
    return h(new).join(h(old), "h", "left_anti").agg(F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("added_chars"), F.count("*").alias("added_chunks"))


def content_length_of(rows: DataFrame, hashes: DataFrame, content: str) -> DataFrame:
    """Stored length for each of the given hashes, 0 where it isn't stored."""
    known = rows.select(T.content_hash(F.col(content)).alias("content_hash"), F.length(content).alias("n")).dropDuplicates(["content_hash"])
    return hashes.join(known, "content_hash", "left").select("content_hash", F.coalesce("n", F.lit(0)).alias("stored_length"))


def delete_by_source(rows: DataFrame, source: str) -> DataFrame:
    return rows.where(~F.col("source_file").eqNullSafe(F.lit(source)))


def forget_path(processed: DataFrame, name: str) -> DataFrame:
    return processed.where(~F.endswith("path", F.lit(name)))


def stats(rows: DataFrame) -> DataFrame:
    one = lambda g: F.count_if(F.col("grade") == g)
    return rows.agg(
        F.count_distinct("source_file").alias("total_documents"), F.count("*").alias("total_chunks"), F.coalesce(F.sum(F.length("content")), F.lit(0)).cast("long").alias("total_chars"),
        one("junior").alias("junior_count"), one("senior").alias("senior_count"),
    )


def count_by_grade(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.coalesce("grade", F.lit("")).alias("grade")).agg(F.count("*").alias("n"))


def formula_stats(rows: DataFrame) -> DataFrame:
    seen = rows.select(T.has_formula(F.col("content")).alias("has"), T.formula_blocks(F.col("content")).alias("n"))
    total = seen.agg(F.count("*").alias("total"), F.count_if("has").alias("with_formula"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("blocks"))
    return total.withColumn("ratio_pct", T.percent(F.col("with_formula"), F.col("total")))


def restandardise(rows: DataFrame) -> DataFrame:
    """Rewrites formulas; what depends on the content, a vector too, is made anew from it."""
    new = rows.withColumn("_old", F.col("content")).withColumn("content", T.wrap_latex("content"))
    new = new.withColumns({"changed": ~F.col("content").eqNullSafe(F.col("_old")), "content_hash": T.content_hash(F.col("content")), "formula_count": T.formula_blocks(F.col("content"))}).drop("_old")
    return new.withColumn("embedding", embed_local("content")) if "embedding" in rows.columns else new


def restandardise_report(rows: DataFrame) -> DataFrame:
    before = rows.withColumn("_had", T.has_formula(F.col("content")))
    done = restandardise(before)
    return done.agg(F.count("*").alias("total"), F.count_if("changed").alias("modified"), F.count_if("_had").alias("with_formulas"), F.coalesce(F.sum("formula_count"), F.lit(0)).cast("long").alias("blocks_after"))


def files_to_process(files: DataFrame, processed: DataFrame, failed: DataFrame) -> DataFrame:
    """Files not yet processed, or that failed before; ``retry`` tells which."""
    fresh = files.join(processed, "path", "left_anti").withColumn("retry", F.lit(False))
    again = files.join(processed, "path", "left_semi").join(failed.select("name"), "name", "left_semi").withColumn("retry", F.lit(True))
    return fresh.unionByName(again)


def duplicate_uploads(files: DataFrame) -> DataFrame:
    """Files named ``base_<13 digits>.pdf`` beside ``base.pdf`` of the same size."""
    stamped = files.where(F.rlike("name", F.lit(r"_\d{13}\.pdf$"))).withColumn("base", F.regexp_replace("name", r"_\d{13}\.pdf$", ".pdf"))
    return stamped.join(files.select(F.col("name").alias("base"), "size"), ["base", "size"], "left_semi").drop("base")


def result_counts(results: DataFrame, n: str = "chunks") -> DataFrame:
    c: Column = F.col(n)
    return results.agg(F.count_if(c > 0).alias("indexed"), F.count_if(c == 0).alias("skipped"), F.count_if(c < 0).alias("failed"))


def scanned_files(pages: DataFrame, first: int = 3, least: int = 20) -> DataFrame:
    """For each file whether its first pages all have too little text: a scan."""
    low = F.length(F.trim(F.coalesce("content", F.lit("")))) < least
    return pages.where(F.col("page_num") <= first).groupBy("file_name").agg((F.count_if(low) == F.count("*")).alias("is_scanned"), F.count("*").alias("pages_checked"))


def full_text(pages: DataFrame) -> DataFrame:
    """The parts of each file's whole text: file_name, page_num, start_char, n_chars, part.

    A part is a page and the blank line after it; in order of pages they are the text.  A
    file of any length stays in rows of one page, as ``start_char`` tells each one's place.
    """
    part = F.concat(F.coalesce("content", F.lit("")), F.lit("\n\n"))
    parts = pages.select("file_name", "page_num", part.alias("part"), F.length(part).cast("long").alias("n_chars"))
    return with_sum_before(parts, "file_name", ["page_num"], F.col("n_chars"), "start_char")


def write_full_text(pages: DataFrame, path: str) -> None:
    """Writes the parts, a folder for each file, in order of pages inside and between files' parts."""
    parts = full_text(pages).repartitionByRange("file_name", "start_char").sortWithinPartitions("file_name", "start_char")
    parts.write.partitionBy("file_name").parquet(path)
