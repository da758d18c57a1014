"""License notices by an exact set-similarity join, with DataFrame functions only.

A template is a set of words and the share of them, its containment threshold, that a block
of text must hold.  Blocks are runs of twice ``stride`` words that start at every
``stride``-th word, where no template has more than ``stride`` words; so each run that could
be a notice lies whole in the block in whose first half it starts.  Words that stand in no
template can't count, so a block is the set of its template words.

All template words are ordered by their number in the whole corpus, the rarest first.  With
``need`` words in common demanded, a template of n words and a block of m meet in the first
n - need + 1 words of the one and the first m - need + 1 of the other (prefix filter), if
m >= need (length filter) and enough words stand behind the first common one on both sides
(positional filter).  Blocks that meet a template there are compared as sets, which drops
what only passed the filters; nothing that reaches the threshold is lost.  A phrase is a
template with threshold 1 whose words must also stand consecutively; its places are listed.

Texts are read twice, for the counts and for the join.  No row that meets no template leaves
its task but for a count of words.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalex.llm.common import Scratch, written
from stratalex.llm.decontaminate import words_of


class Template(NamedTuple):
    """``words`` separated by spaces; ``share`` 1.0 with ``phrase`` means consecutive words."""

    label: str
    words: str
    share: float = 0.8
    phrase: bool = False
    base: bool = False


# Base phrases, names of licenses, and the first words of license notices.
TEMPLATES = (
    Template("cc-by", "cc by", 1.0, True, True),
    Template("gpl", "general public license", 1.0, True, True),
    Template("reserved", "all rights reserved", 1.0, True, True),
    Template("agpl", "affero general public license", 1.0, True),
    Template("apache", "apache license", 1.0, True),
    Template("bsd", "bsd license", 1.0, True),
    Template("cc-by-nc", "cc by nc", 1.0, True),
    Template("cc-by-nd", "cc by nd", 1.0, True),
    Template("cc-by-sa", "cc by sa", 1.0, True),
    Template("lgpl", "lesser general public license", 1.0, True),
    Template("mit", "mit license", 1.0, True),
    Template("mpl", "mozilla public license", 1.0, True),
    Template("apache", "licensed under the apache license version you may not use this file except in compliance with the license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("cc", "this work is licensed under a creative commons attribution international license"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license"),
    Template("reserved", "no part of this publication may be reproduced or transmitted in any form without the prior written permission of the publisher"),
)

#: Words of all templates together, as they are part of the plan; more are refused.
MOST_WORDS = 20_000


def _need(size: int, share: float) -> int:
    return max(math.ceil(size * share - 1e-9), 1)


def _counts(words: DataFrame, known: Sequence[str]) -> dict[str, int]:
    """How often each template word stands in the whole corpus; a row for each, no more."""
    found = words.select(F.explode(F.filter("_w", lambda x: x.isin(*known))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return {r["word"]: r["n"] for r in found.collect()}


def _places(words: Column, phrase: Column, stride: int) -> Column:
    """Where the phrase stands in the first half of a block, from 0."""
    last = F.least(F.lit(stride), F.size(words) - F.size(phrase) + 1) - 1
    starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.filter(starts, lambda o: F.slice(words, o + 1, F.size(phrase)) == phrase)


def matches(docs: DataFrame, templates: Sequence[Template] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_id, _k, n_words for each row of ``docs`` with a null ``label``, and a row for each block that meets a template.

    Those have label, base, share (of the template's words that the block has), start (the
    block's first word, from 0) and places (the starts of a phrase, from 0; null for a notice).
    ``_k`` is a hash of the text that tells rows apart which repeat an id.  Null texts have no
    words; a template without words is refused.
    """
    sets = [sorted(set(t.words.split(" "))) for t in templates]
    if not templates or not all(t.words.split() for t in templates) or sum(map(len, sets)) > MOST_WORDS:
        raise ValueError(f"give templates with words, and at most {MOST_WORDS} of them")
    known = sorted({w for s in sets for w in s})
    stride = max((len(t.words.split()) for t in templates), default=1)
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_k"), words_of(F.col(text_col)).alias("_w"))
    counts = _counts(words, known)
    order = sorted(known, key=lambda w: (counts.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}

    index, first = [], set()
    for t, s in zip(templates, sets, strict=True):
        ranks, need = sorted(rank[w] for w in s), _need(len(s), t.share)
        for i, r in enumerate(ranks[: len(ranks) - need + 1]):
            index.append((r, i, need, ranks, t.label, t.base, t.words.split() if t.phrase else None))
            first.add(order[r])
    lookup = docs.sparkSession.createDataFrame(index, "_r int, _i int, _need int, _ranks array<int>, label string, base boolean, _phrase array<string>")

    one = F.struct(F.lit(None).cast("int").alias("at"), F.lit(None).cast("array<string>").alias("words"))
    is_first = lambda x: x.isin(*sorted(first))
    blocks = F.transform(F.sequence(F.lit(0), F.size("_w") - 1, F.lit(stride)), lambda s: F.struct(s.alias("at"), F.slice("_w", s + 1, 2 * stride).alias("words")))
    blocks = F.filter(blocks, lambda b: F.exists(b["words"], is_first))
    rows = words.select("_id", "_k", F.size("_w").cast("long").alias("n_words"), F.explode(F.when(F.exists("_w", is_first), F.concat(F.array(one), blocks)).otherwise(F.array(one))).alias("_b"))

    ranks_of = F.create_map(*[x for w in order for x in (F.lit(w), F.lit(rank[w]))])
    own = F.array_sort(F.array_distinct(F.transform(F.filter("_b.words", lambda x: x.isin(*known)), lambda x: F.element_at(ranks_of, x))))
    met = rows.select("_id", "_k", "n_words", "_b", F.when(F.col("_b.at").isNotNull(), own).alias("_own"))
    met = met.select("*", F.posexplode_outer("_own").alias("_j", "_r")).where(F.col("_r").isNull() | F.col("_r").isin(*[rank[w] for w in sorted(first)]))
    met = met.join(F.broadcast(lookup), "_r", "left")  # at most MOST_WORDS rows
    behind = F.least(F.size("_ranks") - F.col("_i"), F.size("_own") - F.col("_j"))
    passed = (F.size("_own") >= F.col("_need")) & (F.col("_j") <= F.size("_own") - F.col("_need")) & (behind >= F.col("_need"))
    both = F.array_intersect("_own", "_ranks")
    # of the words that a block and a template share, the first speaks for them
    equal = (F.size(both) >= F.col("_need")) & (F.array_min(both) == F.col("_r"))
    met = met.where(F.col("_b.at").isNull() | (passed & equal))
    places = F.when(F.col("_phrase").isNotNull(), F.transform(_places(F.col("_b.words"), F.col("_phrase"), stride), lambda o: o + F.col("_b.at")))
    met = met.select("_id", "_k", "n_words", "label", "base", (F.size(both) / F.size("_ranks")).alias("share"), F.col("_b.at").alias("start"), places.alias("places"))
    return met.where("places IS NULL OR size(places) > 0")


def scan(docs: DataFrame, templates: Sequence[Template] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row of ``docs``: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``score`` is the largest share of a template that one block holds, 0 where no block
    meets its threshold.  Repeated rows get equal results, an empty table none.
    """
    with Scratch(docs.sparkSession, "licenses") as scratch:
        rows = scratch.written(matches(docs, templates, id_col, text_col), "matches")
        found = rows.where("label IS NOT NULL").drop("n_words").distinct()
        place = F.when(F.col("base"), F.col("places"))
        found = found.groupBy("_id", "_k").agg(
            F.sum(F.coalesce(F.size(place), F.lit(0)) * F.col("base").cast("int")).alias("n_base"),
            F.min(F.array_min(place)).alias("first_word"),
            F.max(F.array_max(place)).alias("last_word"),
            F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))).alias("base_labels"),
            F.array_sort(F.collect_set("label")).alias("labels"),  # no more than there are templates
            F.max("share").alias("score"),
        )
        each = rows.where("label IS NULL").select("_id", "_k", "n_words").alias("e")
        out = each.join(found.alias("f"), (F.col("e._k") == F.col("f._k")) & F.col("e._id").eqNullSafe(F.col("f._id")), "left")
        out = out.select(
            F.col("e._id").alias(id_col),
            "n_words",
            F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
            F.col("first_word").cast("long"),
            F.col("last_word").cast("long"),
            F.coalesce(F.concat_ws(",", "base_labels"), F.lit("")).alias("base_labels"),
            F.coalesce(F.concat_ws(",", "labels"), F.lit("")).alias("labels"),
            F.coalesce("score", F.lit(0.0)).alias("score"),
        )
        return written(out, "licenses")
