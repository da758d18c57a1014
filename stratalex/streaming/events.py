"""Token streams of server-sent events, and incremental ingestion."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalex.functions import text as T
from stratalex.operators import kb


def payload(line: Column) -> Column:
    return F.when(F.startswith(line, F.lit("data: ")), F.trim(F.substring(line, 7, 1_000_000_000)))


def delta(data: Column, field: str) -> Column:
    """A non-empty text of the first choice's delta, else null; bad JSON gives null."""
    return F.nullif(F.get_json_object(data, f"$.choices[0].delta.{field}"), F.lit(""))


def pieces(lines: DataFrame) -> DataFrame:
    """stream_id, seq, k, type, piece: the events of each stream up to [DONE]; reasoning comes before content of a line."""
    data = lines.select("stream_id", "seq", payload(F.col("line")).alias("d")).where("d IS NOT NULL")
    ended = data.where("d = '[DONE]'").groupBy("stream_id").agg(F.min("seq").alias("end"))
    live = data.join(ended, "stream_id", "left").where("end IS NULL OR seq < end")
    parts = live.select("stream_id", "seq", F.posexplode(F.array(delta(F.col("d"), "reasoning_content"), delta(F.col("d"), "content"))).alias("k", "piece")).where("piece IS NOT NULL")
    return parts.withColumn("type", F.when(F.col("k") == 0, "reasoning").otherwise("chunk"))


def final_texts(lines: DataFrame) -> DataFrame:
    """stream_id, type, full: the whole text of each kind, once for a stream; its size is the input's."""
    told = pieces(lines).groupBy("stream_id", "type").agg(F.array_sort(F.collect_list(F.struct("seq", "piece"))).alias("p"))
    return told.select("stream_id", "type", F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("full"))


def assemble(lines: DataFrame) -> DataFrame:
    """stream_id, seq, type, piece, full: each event with the text so far of its own kind.

    That is what a client is sent; its size grows with the square of a stream.  For the
    text alone take :func:`final_texts`.
    """
    so_far = Window.partitionBy("stream_id", "type").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return pieces(lines).select("stream_id", "seq", "type", "piece", F.array_join(F.collect_list("piece").over(so_far), "").alias("full"))


def distinct_stream(rows: DataFrame, content: str) -> DataFrame:
    """Each content once over the life of a stream; the state never expires."""
    return rows.withColumn("content_hash", T.content_hash(F.col(content))).dropDuplicates(["content_hash"])


def distinct_within(rows: DataFrame, content: str, time: str, delay: str) -> DataFrame:
    """Each content once within ``delay`` of its first time; older state is dropped, so it stays bounded.

    A content that comes again later passes: the store it goes into must know it, as with ``ingest_into``.
    """
    hashed = rows.withColumn("content_hash", T.content_hash(F.col(content))).withWatermark(time, delay)
    return hashed.dropDuplicatesWithinWatermark(["content_hash"])


def ingest_into(stream: DataFrame, path: str, checkpoint: str, content: str, order: str):
    """Merges what is new since the checkpoint into a store by hash (``kb.merge_into``), then stops.

    A batch that is run again after a failure changes nothing.
    """
    return ingest(stream, checkpoint, lambda batch, _: kb.merge_into(path, batch, content, order))


def ingest(stream: DataFrame, checkpoint: str, merge: Callable[[DataFrame, int], None]):
    """Runs ``merge(batch, id)`` for what is new since the checkpoint, then stops."""
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
