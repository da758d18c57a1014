"""Splitting documents into chunks that keep formulas whole, with their metadata."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalex.functions import enrich
from stratalex.functions import text as T

SIZE, OVERLAP, LEAST, TITLE = 600, 100, 20, 50
# Fixed value: the start of a line that opens a chapter.
CHAPTER = re.compile(r"^(?:第[一二三四五六七八九十\d]+章|第[一二三四五六七八九十\d]+节|Chapter\s*\d+|§\d+)\s*.*$", re.M | re.A)
FORMULA = re.compile(r"\$\$[\s\S]*?\$\$")
_TRIM = "".join(map(chr, range(33)))


def sections(text: str) -> list[str]:
    """Chapters, the short ones joined until a section has twice the chunk size."""
    titles, parts = CHAPTER.findall(text), CHAPTER.split(text)
    while len(parts) > 1 and not parts[-1]:
        parts.pop()
    out, current = [], ""
    for i, part in enumerate(parts):
        if i and titles:
            current += titles[min(i, len(titles)) - 1] + "\n"
        current += part
        if len(current) >= 2 * SIZE or i == len(parts) - 1:
            out.append(current.strip(_TRIM))
            current = ""
    return out or [text]


def pack(section: str) -> list[str]:
    """Paragraphs joined up to the chunk size; a longer one stays whole.

    A formula counts as a short mark, so it is never cut and blank lines inside it don't
    separate paragraphs.
    """
    formulas = FORMULA.findall(section)
    numbers = iter(range(len(formulas)))
    marked = FORMULA.sub(lambda _: f"%%FORMULA_{next(numbers)}%%", section)
    out: list[str] = []
    current = ""
    for para in (p.strip(_TRIM) for p in marked.split("\n\n")):
        if not para:
            continue
        if current and len(current) + len(para) > SIZE:
            out.append(current)
            current = ""
        current += ("\n\n" if current else "") + para
    if current:
        out.append(current)
    back = lambda c: re.sub(r"%%FORMULA_(\d+)%%", lambda m: formulas[int(m[1])] if int(m[1]) < len(formulas) else m[0], c)
    return [back(c) for c in out] or [section]


def chapter_title(section: str) -> str:
    if m := CHAPTER.search(section):
        return m[0].strip(_TRIM)
    first = section.split("\n")[0].strip(_TRIM)
    return first if len(first) < TITLE else ""


def pieces(text: str | None) -> Iterator[tuple[int, str, str, int, int]]:
    """ordinal, chapter title, content, start, end of each chunk.

    Starts grow by the length less an overlap and are held back to the last chunk's
    length, so they have plateaus; chunks that are too short count for nothing.
    """
    base, n = 0, 0
    for section in sections(text or ""):
        title, offset, parts = chapter_title(section), 0, pack(section)
        for i, part in enumerate(parts):
            content = part.strip(_TRIM)
            if len(content) < LEAST:
                continue
            yield n, title, content, base + offset, base + offset + len(content)
            n += 1
            offset += max(0, len(content) - OVERLAP)
            if i < len(parts) - 1:
                offset = min(offset, len(content))
        base += len(section) + 2


def chunk(docs: DataFrame, source: str, text: str, stage: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Chunks of each document with ids, offsets and metadata, and its columns ``keep``; stage null is detected."""
    made = ["source_file", "ordinal", "chapter_title", "content", "start_char", "end_char"]
    types = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, s, *p) for i, (s, t) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)) for p in pieces(t)]
            of, *columns = zip(*rows, strict=True) if rows else [[]] * 7
            kept = [b.column(2 + i).take(pa.array(of, pa.int64())) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, types, strict=True)), *kept], [*made, *keep])

    rows = docs.select(F.col(source).cast("string"), F.col(text), *[F.col(c).alias(f"_keep_{c}") for c in keep])
    more = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    rows = rows.mapInArrow(cut, f"source_file string, ordinal int, chapter_title string, content string, start_char int, end_char int{more}")
    c = F.col("content")
    rows = rows.withColumns({
        "chunk_id": F.substring(F.sha2(F.concat_ws("|", "source_file", F.col("ordinal").cast("string"), "content"), 256), 1, 16),
        "stage": F.lit(stage) if stage else enrich.page_stage(c), "knowledge_point": enrich.knowledge_point(c), "question_type": enrich.question_type(c),
        "source_type": enrich.source_type(F.col("source_file"), c), "has_formula": T.has_formula(c), "formula_count": T.formula_blocks(c),
    })
    return rows.withColumn("weight", enrich.default_weight(F.col("source_type"), F.col("stage")))
