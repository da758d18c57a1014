"""Expansion and the text of a context, on small hand-made results."""

from pyspark.sql import functions as F

from stratalex.operators import context


def test_a_result_seen_as_a_neighbour_brings_none(spark):
    results = spark.createDataFrame([(1, 0.9, 1), (2, 0.8, 2), (9, 0.5, 3)], "chunk_id long, score double, position int")
    around = spark.createDataFrame([(1, 2, "after", 1), (2, 1, "before", -1), (2, 3, "after", 1), (9, 9, "before", -1), (9, 8, "before", -2)], "anchor_id long, chunk_id long, side string, distance int")
    got = [(r["chunk_id"], round(r["score"], 6), r["position"]) for r in context.expand(results, around, 5).orderBy("position").collect()]
    assert got == [(1, 0.9, 1), (2, 0.81, 2), (9, 0.5, 3), (8, 0.45, 4)]
    assert [r["chunk_id"] for r in context.expand(results, around.limit(0), 1).orderBy("position").collect()] == [1, 2, 9]
    assert context.expand(results.limit(0), around, 5).count() == 0


def test_results_go_by_score_and_weight(spark):
    rows = spark.createDataFrame([(1, 0.9, 0.5, 1), (2, 0.5, 0.0, 2), (3, 0.5, 1.0, 3), (4, 0.4, None, 4)], "chunk_id long, score double, weight double, position int")
    assert [r["chunk_id"] for r in context.by_weight(rows).orderBy("position").collect()] == [2, 3, 1, 4]


def test_text_of_a_context(spark):
    schema = "position int, score double, content string, grade string, source_file string, chapter_title string, source_type string, source_name string, page_num int"
    rows = [
        (2, 0.456, "plain <b>bold</b> &lt;p&gt;", "university", "b.pdf", "", "exam", "", None),
        (1, 1.0, "see \\frac{1}{2}", "junior", "a.pdf", "One", "textbook", "Book", 7),
        (3, 0.1, None, None, None, None, "other", None, None),
    ]
    got = context.prompt_text(spark.createDataFrame(rows, schema)).first()
    body = "参考1 初中 教材 （One）[Book P7] [得分: 100%]\nsee $$\\frac{1}{2}$$\n\n参考2 大学拓展 真题 [b.pdf] [得分: 46%]\nplain bold\n\n参考3  [] [得分: 10%]\n\n\n"
    assert (got["context"], got["n"]) == (context.BEFORE + body + context.AFTER, 3)
    none = context.prompt_text(spark.createDataFrame([], schema).withColumn("position", F.col("position"))).first()
    assert (none["context"], none["n"]) == ("", 0)
