"""Metadata of texts: stage, question type, source type, topic, weight."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratalex.functions import lexicons as L


def keyword_hits(text: Column, words: Sequence[str]) -> Column:
    """How many of the words are in the text, each counted once."""
    return reduce(lambda a, b: a + b, [F.contains(text, F.lit(w)).cast("int") for w in words], F.lit(0))


def has_any(text: Column, words: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words], F.lit(False))


def detect_stage(primary: Column, junior: Column, senior: Column, university: Column) -> Column:
    """Stage of a page by its scores; a tie goes to the lower stage, none at all to junior."""
    return (
        F.when((university > senior) & (university > junior) & (university > primary), "university")
        .when((senior > junior) & (senior > primary), "senior")
        .when(junior > primary, "junior")
        .when(primary > 0, "primary")
        .otherwise("junior")
    )


def page_stage(text: Column, lists: Sequence[Sequence[str]] = (L.PAGE_PRIMARY, L.PAGE_JUNIOR, L.PAGE_SENIOR, L.PAGE_UNIVERSITY)) -> Column:
    return detect_stage(*[keyword_hits(text, words) for words in lists])


def stage_of_name(name: Column) -> Column:
    lower = F.lower(name)
    return F.when(has_any(lower, L.NAME_UNIVERSITY), "university").when(has_any(lower, L.NAME_SENIOR), "senior").when(has_any(lower, L.NAME_PRIMARY), "primary").when(has_any(lower, L.NAME_JUNIOR), "junior").otherwise("senior")


def stage_of_path(path: Column) -> Column:
    lower = F.lower(path)
    return (
        F.when(has_any(lower, L.PATH_UNIVERSITY), "university").when(has_any(lower, L.NAME_SENIOR), "senior").when(has_any(lower, L.NAME_PRIMARY), "primary")
        .when(has_any(lower, L.NAME_JUNIOR), "junior").when(F.contains(lower, F.lit("数学")), "senior").otherwise("junior")
    )


def question_type(text: Column, proof=L.PROOF, geometry=L.GEOMETRY, function=L.FUNCTION, calculation=L.CALCULATION, ask: str = "求") -> Column:
    lower = F.lower(text)
    return (
        F.when(has_any(lower, proof), "proof").when(has_any(lower, geometry), "geometry").when(F.contains(lower, F.lit(ask)) & has_any(lower, function), "function")
        .when(has_any(lower, calculation), "calculation").otherwise("general")
    )


def source_type(name: Column, text: Column, textbook=L.TEXTBOOK, exam=L.EXAM, lecture=L.LECTURE) -> Column:
    lower = F.lower(F.concat(F.coalesce(name, F.lit("")), F.lit(" "), F.coalesce(text, F.lit(""))))
    return F.when(has_any(lower, textbook), "textbook").when(has_any(lower, exam), "exam").when(has_any(lower, lecture), "lecture").otherwise("textbook")


def default_weight(kind: Column, stage: Column) -> Column:
    return F.when(kind == "textbook", 1.0).when(kind == "exam", 0.85).when(kind == "lecture", 0.7).when(stage == "university", 0.4).otherwise(0.6)


def knowledge_point(text: Column, words: Sequence[str] = (*L.CHUNK_JUNIOR, *L.CHUNK_SENIOR), default: str = "综合") -> Column:
    """The first word of the list that the text has."""
    return F.coalesce(*[F.when(F.contains(text, F.lit(w)), F.lit(w)) for w in words], F.lit(default))


def enhance_query(query: Column, stage: Column) -> Column:
    return (
        F.when(stage == "primary", F.concat(F.lit("小学 "), query)).when(stage == "junior", F.concat(F.lit("初中 课内 "), query, F.lit(" 中考考点")))
        .when(stage == "senior", F.concat(F.lit("高中 "), query, F.lit(" 高考考点"))).otherwise(query)
    )


def allowed_stages(stage: str | None, extend: bool = False) -> list[str] | None:
    """Grades a search at a stage may return; None for no filter."""
    order = ["primary", "junior", "senior", "university"]
    if stage not in order:
        return None
    kept = order[: order.index(stage) + 1]
    return kept + ["university"] if extend and "university" not in kept else kept


def in_stage(grade: Column, stage: str | None, extend: bool = False) -> Column:
    kept = allowed_stages(stage, extend)
    return F.lit(True) if kept is None else grade.isin(kept)


def result_weight(grade: Column, weight: Column) -> Column:
    return F.when(grade == "university", 0.6).otherwise(1.0) * F.when(weight > 0, weight).otherwise(1.0)
