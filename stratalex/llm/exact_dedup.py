"""Exact deduplication by 128-bit content hash with a byte comparison inside groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row the group of equal texts: id, keep_id, group_size, kept, text_sha256.

    Rows are grouped by the MD5 of the text and, inside a hash, by the text's bytes, so
    that texts whose hashes collide stay apart.  Each task first sums up its own rows;
    a text with any number of copies crosses the shuffle once for each task.  Only the
    narrow rows (id, hashes) meet the groups again, and only groups of two or more.

    Null text counts as empty; an empty text is a text like any other.  The largest id of
    a group stays; a null id is smaller than any other.  Rows that repeat id and text are
    one document given twice and carry the same decision.  Other columns are ignored.
    """
    base = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    groups = (
        base.groupBy(F.unhex(F.md5("_text")).alias("_h"), "_text")
        .agg(F.max("_id").alias("keep_id"), F.count("*").alias("group_size"))
        .where("group_size > 1")
        .select("_h", F.unhex(F.sha2("_text", 256)).alias("_s"), "keep_id", "group_size")
    )
    rows = base.select("_id", F.unhex(F.md5("_text")).alias("_h"), F.unhex(F.sha2("_text", 256)).alias("_s"))
    return rows.join(groups, ["_h", "_s"], "left").select(
        F.col("_id").alias(id_col),
        F.when(F.col("group_size").isNull(), F.col("_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (F.col("group_size").isNull() | F.col("_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.lower(F.hex("_s")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row for each text, that of the largest id; all columns stay.

    Null and empty texts are equal, and the row keeps what it had.  Of rows that repeat
    the id as well one stays.
    """
    names = docs.columns
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    text = F.coalesce(F.col(text_col), F.lit(""))
    best = docs.groupBy(F.md5(text).alias("_h"), text.alias("_text")).agg(F.max_by(row, F.struct(F.col(id_col).isNotNull(), F.col(id_col))).alias("_row"))
    return best.select(*[F.col(f"_row.c{i}").alias(c) for i, c in enumerate(names)])
