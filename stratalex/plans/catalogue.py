"""All queries of the engine's own operators, each with its SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def load() -> None:
    from stratalex.plans import chat, store, texts, web  # noqa: F401
    from stratalex.plans import ingest, search  # noqa: F401


#: The chunk view in SQL.
CHUNKS = """chunks AS (
  SELECT doc_id AS chunk_id, source AS source_file, text AS content,
         CASE doc_id % 4 WHEN 0 THEN 'primary' WHEN 1 THEN 'junior' WHEN 2 THEN 'senior' ELSE 'university' END AS grade,
         substr(split_part(text, chr(10), 1), 1, 49) AS chapter_title,
         CASE doc_id % 5 WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN 0.85::DOUBLE WHEN 2 THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END AS weight,
         CAST(doc_id // 2 * 500 AS INTEGER) AS start_char
  FROM documents)"""
