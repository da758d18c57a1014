"""Neighbours of found chunks, and the prompt text made of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalex.functions import text as T
from stratalex.operators.order import with_sum_before
from stratalex.sources.scratch import written

DAMPING = 0.9
#: Anchors up to which they are broadcast.
MOST_ANCHORS = 1000


def neighbours(chunks: DataFrame, anchors: DataFrame, before: int = 1, after: int = 1) -> DataFrame:
    """anchor_id, chunk_id, side, distance: the chunks next to each anchor in its source.

    ``anchors`` (anchor_id, source_file, start_char) are few.  The place of an anchor is
    that of the first chunk whose offset isn't smaller, as offsets have plateaus.  Each next
    neighbour is a minimum or maximum over the source, so a source of any size is summed up
    in the tasks that read it; many anchors are looked up among the neighbours of all.
    """
    if anchors.count() > MOST_ANCHORS:
        return all_neighbours(chunks, before, after).join(anchors.select("anchor_id"), "anchor_id", "left_semi")
    rows = chunks.select("source_file", F.struct("start_char", "chunk_id").alias("p"))
    met = rows.join(F.broadcast(anchors), "source_file").where(F.col("p.start_char") >= F.col("start_char"))
    at = met.groupBy("anchor_id", "source_file").agg(F.min("p").alias("low")).withColumn("high", F.col("low"))
    out = []
    for d in range(1, max(before, after) + 1):
        at = rows.join(F.broadcast(at), "source_file").groupBy("anchor_id", "source_file").agg(F.max(F.when(F.col("p") < F.col("low"), F.col("p"))).alias("low"), F.min(F.when(F.col("p") > F.col("high"), F.col("p"))).alias("high"))
        for side, n, end, sign in (("before", before, "low", -1), ("after", after, "high", 1)):
            if d <= n:
                out.append(at.where(F.col(end).isNotNull()).select("anchor_id", F.col(f"{end}.chunk_id").alias("chunk_id"), F.lit(side).alias("side"), F.lit(sign * d).alias("distance")))
    return reduce(DataFrame.unionByName, out)


def all_neighbours(chunks: DataFrame, before: int = 1, after: int = 1) -> DataFrame:
    """anchor_id, chunk_id, side, distance for every chunk, by places and equal joins.

    The same neighbours that :func:`neighbours` finds for a few anchors.
    """
    placed = written(with_sum_before(chunks.select("source_file", "chunk_id", "start_char"), "source_file", ["start_char", "chunk_id"], F.lit(1), "place"), "places")
    first = placed.groupBy("source_file", "start_char").agg(F.min("place").alias("at"))
    steps = F.array(*[F.lit(d) for d in (*range(-before, 0), *range(1, after + 1))])
    anchors = placed.join(first, ["source_file", "start_char"]).select(F.col("chunk_id").alias("anchor_id"), "source_file", "at", F.explode(steps).alias("distance"))
    return (
        anchors.withColumn("place", F.col("at") + F.col("distance"))
        .join(placed.select("source_file", "chunk_id", "place"), ["source_file", "place"])
        .select("anchor_id", "chunk_id", F.when(F.col("distance") < 0, "before").otherwise("after").alias("side"), "distance")
    )


def by_weight(results: DataFrame) -> DataFrame:
    """At most 20 results with their places by score times weight (a weight of 0 counts as 1), as they were where equal."""
    weighed = F.col("score") * F.when(F.col("weight") > 0, F.col("weight")).otherwise(1.0)
    return results.withColumn("position", F.row_number().over(Window.orderBy(F.desc(weighed), "position")))


def expand(results: DataFrame, around: DataFrame, k: int) -> DataFrame:
    """chunk_id, score, position: results with their neighbours, max(k, 4) + 4 rows at most.

    ``results`` (chunk_id, score, position) are at most 20, so they are folded in one row.
    After each result come its neighbours, in page order, with the result's score damped.
    A chunk stays where it is seen first; a result that was seen as a neighbour brings no
    neighbours of its own.
    """
    near = around.groupBy("anchor_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("distance", "chunk_id"))), lambda x: x["chunk_id"]).alias("near"))
    kind = results.schema["chunk_id"].dataType.simpleString()
    none = F.array().cast(f"array<{kind}>")
    rows = results.join(near.withColumnRenamed("anchor_id", "chunk_id"), "chunk_id", "left").select("position", "chunk_id", F.col("score").cast("double").alias("score"), F.coalesce("near", none).alias("near"))
    ordered = rows.agg(F.array_sort(F.collect_list(F.struct("position", "chunk_id", "score", "near"))).alias("r"))

    def step(seen: Column, r: Column) -> Column:
        known = lambda c: F.exists(seen, lambda x: x["chunk_id"] == c)
        new = F.filter(r["near"], lambda c: (c != r["chunk_id"]) & ~known(c))
        mine = F.array(F.struct(r["chunk_id"].alias("chunk_id"), r["score"].alias("score")))
        damped = F.transform(new, lambda c: F.struct(c.alias("chunk_id"), (r["score"] * DAMPING).alias("score")))
        return F.when(known(r["chunk_id"]), seen).otherwise(F.concat(seen, mine, damped))

    start = F.array().cast(f"array<struct<chunk_id:{kind},score:double>>")
    kept = ordered.select(F.slice(F.aggregate("r", start, step), 1, max(k, 4) + 4).alias("kept"))
    return kept.select(F.posexplode("kept").alias("i", "x")).select("x.chunk_id", "x.score", (F.col("i") + 1).alias("position"))


# What stands around the contents, and the labels of stages and kinds of sources.
BEFORE = "\n\n---\n【以下为对应学段官方教材、教辅参考资料】\n解题必须严格依据下面内容，禁止编造定理、公式、解题步骤。\n\n"
AFTER = "请基于以上教材内容，结合数学知识回答。用到的定理/公式标注出处。若无相关知识库内容，如实告知「暂无此知识点资料」。\n---\n"
LABELS = {"primary": "小学", "junior": "初中", "senior": "高中", "university": "大学拓展"}
KINDS = {"textbook": "教材 ", "exam": "真题 ", "crawl": "网络 "}


def prompt_text(expanded: DataFrame) -> DataFrame:
    """context, n: one row with the contents in order, numbered, and how many there are.

    ``expanded``: position, score, content, grade, source_file and, where the store has
    them, chapter_title, source_type, source_name, page_num.  Bare LaTeX is wrapped, tags
    are stripped.  Without rows the context is empty.
    """
    of = lambda c: F.col(c) if c in expanded.columns else F.lit(None).cast("string")
    filled = lambda c: F.nullif(of(c).cast("string"), F.lit(""))
    named = lambda c, names: reduce(lambda a, kv: F.when(of(c) == kv[0], kv[1]).otherwise(a), names.items(), F.lit(""))
    head = F.concat(
        F.lit("参考"), F.col("position").cast("string"), F.lit(" "), named("grade", LABELS), F.lit(" "), named("source_type", KINDS),
        F.coalesce(F.concat(F.lit("（"), filled("chapter_title"), F.lit("）")), F.lit("")),
        F.lit("["), F.coalesce(filled("source_name"), filled("source_file"), F.lit("")), F.coalesce(F.concat(F.lit(" P"), of("page_num").cast("string")), F.lit("")), F.lit("]"),
        F.format_string(" [得分: %.0f%%]\n", F.col("score") * 100),
    )
    content = F.coalesce("content", F.lit(""))
    wrapped = expanded.withColumn("_wrapped", T.wrap_latex(F.when(T.has_latex(content), content)))
    line = F.concat(head, T.strip_tags(F.coalesce("_wrapped", content)), F.lit("\n\n"))
    rows = wrapped.select("position", line.alias("line")).agg(F.array_sort(F.collect_list(F.struct("position", "line"))).alias("l"))
    lines = F.array_join(F.transform("l", lambda x: x["line"]), "")
    return rows.select(F.when(F.size("l") > 0, F.concat(F.lit(BEFORE), lines, F.lit(AFTER))).otherwise("").alias("context"), F.size("l").cast("long").alias("n"))
