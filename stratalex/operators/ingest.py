"""Pages into the store: gate, stage, source name, chunks, vectors, upsert; redirects, manifests, uploads."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalex.functions import embedding, enrich, urls
from stratalex.functions import text as T
from stratalex.operators import chunking, kb, web
from stratalex.sources.scratch import written

#: Characters that the text of a crawled page, and of one that is rendered, must have.
LEAST_CRAWLED, LEAST_RENDERED = 200, 100
MOST_HOPS = 20


def long_enough(pages: DataFrame, text: str = "text", least: int = LEAST_CRAWLED) -> DataFrame:
    """Pages whose text has ``least`` characters; null has none."""
    return pages.where(F.length(F.coalesce(text, F.lit(""))) >= least)


def page_chunks(pages: DataFrame, least: int = LEAST_CRAWLED, stage: str | None = None) -> DataFrame:
    """Chunks with vectors of the pages (page_id, url, html) that have enough text.

    A blank stage is told from the page's text; the source is ``crawl:`` and a name made
    of the URL.  Of pages with equal texts the first is taken, so a page is in the store once.
    """
    found = kb.keep_first(long_enough(web.extract(pages, columns=["text"]), least=least), "text", "page_id").drop("content_hash")
    told = F.lit(stage) if stage else enrich.page_stage(F.col("text"))
    named = found.select("page_id", "url", F.concat(F.lit("crawl:"), urls.source_name(F.col("url"))).alias("source_name"), told.alias("grade"), "text")
    chunks = chunking.chunk(named, "source_name", "text", keep=["page_id", "url", "source_name", "grade"])
    return written(chunks, "page-chunks").withColumn("embedding", embedding.embed_local("content"))


def ingest_pages(store: DataFrame, pages: DataFrame, least: int = LEAST_CRAWLED) -> DataFrame:
    """The store after the pages' chunks came in; of equal contents the last of the last page stays."""
    made = page_chunks(pages, least).withColumn("content_hash", T.content_hash(F.col("content")))
    place = F.struct("page_id", "ordinal")
    last = made.groupBy("content_hash").agg(F.max(place).alias("_last"))
    new = made.join(last, (made["content_hash"] == last["content_hash"]) & (place == F.col("_last")), "left_semi").dropDuplicates(["content_hash"])
    return kb.upsert(store, new.select(*store.columns), "content", "chunk_id")


def follow(starts: DataFrame, redirects: DataFrame, hops: int = MOST_HOPS) -> DataFrame:
    """url, final, hops, reason: where each URL leads, one join for each hop.

    ``redirects``: src, status, location (null and relative locations too; of several
    locations of a URL the smallest counts).  Every target is checked again: one that must
    not be fetched ends the chain with its reason, and so does a chain of more hops (``hops``).
    """

    @F.pandas_udf("string")
    def resolved(url: pd.Series, location: pd.Series) -> pd.Series:
        return pd.Series([web.resolve_redirect(u, x) for u, x in zip(url, location, strict=True)])

    links = redirects.where(urls.is_redirect(F.col("status")) & F.col("location").isNotNull()).groupBy(F.col("src").alias("final")).agg(F.min("location").alias("location"))
    at = starts.select("url", F.col("url").alias("final"), F.lit(0).alias("hops"), urls.unsafe_reason(F.col("url")).alias("reason"))
    done = []
    for n in range(1, hops + 2):
        ahead = written(at.where("reason IS NULL").join(links, "final", "left").select("url", "final", "hops", "location"), "hops")
        done.append(at.where("reason IS NOT NULL"))
        done.append(ahead.where("location IS NULL").select("url", "final", "hops", F.lit(None).cast("string").alias("reason")))
        moving = ahead.where("location IS NOT NULL")
        if moving.isEmpty():
            break
        if n > hops:
            done.append(moving.select("url", "final", "hops", F.lit("hops").alias("reason")))
            break
        moved = moving.select("url", resolved("final", "location").alias("final"), (F.col("hops") + 1).alias("hops"))
        at = moved.withColumn("reason", urls.unsafe_reason(F.col("final")))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def crawl_stats(pages: DataFrame) -> DataFrame:
    """One row: pages seen, indexed, skipped, failed, and chunks, from (status, chunks)."""
    one = lambda s: F.count_if(F.col("status") == s).alias(s)
    return pages.agg(F.count("*").alias("pages"), one("indexed"), one("skipped"), one("failed"), F.coalesce(F.sum("chunks"), F.lit(0)).cast("long").alias("chunks"))


# -- manifests: small tables kept as JSON -----------------------------------------------------


def save_manifest(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def load_manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def reset_manifest(spark: SparkSession, path: str, schema: str) -> None:
    """An empty manifest in the place of the old one."""
    save_manifest(spark.createDataFrame([], schema), path)


def without_failed(failed: DataFrame, name: str) -> DataFrame:
    return failed.where(~F.col("name").eqNullSafe(F.lit(name)))


def upload_names(uploads: DataFrame, there: DataFrame) -> DataFrame:
    """name and stored name of PDF uploads (name, ms): illegal characters replaced, clashes stamped.

    A name clashes if the store (name) has it or an earlier upload took it; it then gets
    ``_<ms>`` before its extension.  Other files are refused.
    """
    from pyspark.sql import Window

    from stratalex.sources.tables import safe_upload_name

    safe = uploads.where(F.endswith(F.lower("name"), F.lit(".pdf"))).withColumn("safe", safe_upload_name(F.col("name")))
    nth = F.row_number().over(Window.partitionBy("safe").orderBy("ms", "name"))
    known = there.select(F.col("name").alias("safe"), F.lit(True).alias("_there")).distinct()
    marked = safe.withColumn("_n", nth).join(known, "safe", "left")
    stamped = F.concat(F.regexp_replace("safe", r"\.[^.]*$", ""), F.lit("_"), F.col("ms").cast("string"), F.regexp_extract("safe", r"(\.[^.]*)$", 1))
    return marked.select("name", F.when((F.col("_n") > 1) | F.col("_there"), stamped).otherwise(F.col("safe")).alias("stored"))
