import pytest
from pyspark.sql import functions as F

from stratalex.operators import context, history, kb, retrieval, web

CHUNK = "chunk_id long, source_file string, content string, grade string, chapter_title string, weight double, start_char int"


def lists(spark, a, b):
    make = lambda ids: spark.createDataFrame([(i, r + 1) for r, i in enumerate(ids)], "id long, rank int")
    return {r.id: round(r.rrf, 6) for r in retrieval.fuse(make(a), make(b)).collect()}


def test_rrf(spark):
    assert lists(spark, [1], [1]) == {1: 1.0}
    assert lists(spark, [1], [2]) == {1: 0.5, 2: 0.5}
    assert lists(spark, [1], []) == {1: 1.0}
    assert lists(spark, [], [2]) == {2: 0.5}


def test_store(spark):
    old = spark.createDataFrame([(1, "a", "x", "junior"), (2, "a", "y", "senior")], "id long, source_file string, content string, grade string")
    new = spark.createDataFrame([(3, "b", "x", "junior"), (4, "b", "z", None)], old.schema)
    merged = kb.upsert(old, new, "content", "id")
    assert sorted((r.content, r.source_file) for r in merged.collect()) == [("x", "b"), ("y", "a"), ("z", "b")]
    again = kb.upsert(merged.drop("content_hash"), new, "content", "id")
    assert sorted(r.content for r in again.collect()) == ["x", "y", "z"]
    assert kb.char_delta(old, new, "content").first()[:] == (1, 1)
    assert {r.grade: r.n for r in kb.count_by_grade(merged).collect()} == {"junior": 1, "senior": 1, "": 1}
    assert [r.content for r in kb.keep_first(old.unionByName(new), "content", "id").orderBy("id").collect()] == ["x", "y", "z"]
    assert kb.stats(old.limit(0)).first().total_chars == 0
    assert kb.delete_by_source(old, "a").count() == 0


def test_scans_and_files(spark):
    pages = [("s", n, "x" * k) for n, k in enumerate((0, 5, 19), 1)] + [("t", n, "x" * k) for n, k in enumerate((0, 5, 20), 1)]
    got = {r.file_name: r.is_scanned for r in kb.scanned_files(spark.createDataFrame(pages, "file_name string, page_num int, content string")).collect()}
    assert got == {"s": True, "t": False}
    files = spark.createDataFrame([("a_1700000000000.pdf", 5), ("a.pdf", 5), ("b_1700000000000.pdf", 5), ("b.pdf", 6), ("c_1.pdf", 1)], "name string, size long")
    assert [r.name for r in kb.duplicate_uploads(files).collect()] == ["a_1700000000000.pdf"]


def test_neighbours(spark):
    c = spark.createDataFrame([(0, "s", "", "", "", 1.0, 0), (1, "s", "", "", "", 1.0, 500), (2, "s", "", "", "", 1.0, 500)], CHUNK)
    for anchor in (1, 2):
        a = c.where(F.col("chunk_id") == anchor).select(F.col("chunk_id").alias("anchor_id"), "source_file", "start_char")
        assert [r.chunk_id for r in context.neighbours(c, a).orderBy("chunk_id").collect()] == [0, 2]


def test_search_edges(spark):
    c = spark.createDataFrame([(i, "s", f"alpha beta {'gamma ' * i}", "junior", "t", 1.0, 0) for i in range(5)], CHUNK)
    v = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(5)], "vec_id long, embedding array<float>")
    got = retrieval.search(c, v, ["gamma"], [0.0, 1.0], "junior", k=3).orderBy("position").collect()
    assert len(got) == 3 and got[0].score >= got[1].score >= got[2].score
    assert retrieval.search(c, v, [], [0.0, 1.0], None, k=3).count() == 3
    assert retrieval.search(c, v.limit(0), ["nothing"], [0.0, 1.0], None).count() == 0
    post = retrieval.search(c.withColumn("grade", F.lit("university")), v, ["gamma"], [0.0, 1.0], "junior")
    assert post.count() == 0


@pytest.mark.parametrize("prefilter", [False, True])
def test_post_filter_can_be_short(spark, prefilter):
    c = spark.createDataFrame([(i, "s", "x", "junior" if i >= 200 else "university", "", 1.0, 0) for i in range(205)], CHUNK)
    v = spark.createDataFrame([(i, [float(300 - i), 1.0]) for i in range(205)], "vec_id long, embedding array<float>")
    assert retrieval.search(c, v, [], [1.0, 0.0], "junior", prefilter=prefilter).count() == (5 if prefilter else 0)


def test_history(spark):
    m = spark.createDataFrame([(1, t, "user", " " if t == 20 else f"m{t}") for t in range(25)] + [(2, 0, "assistant", "a"), (2, 1, "user", "line one\nand a long second line")], "conv_id long, turn long, role string, text string")
    assert [r.turn for r in history.last_messages(m).where("conv_id = 1").orderBy("turn").collect()] == [t for t in range(6, 25) if t != 20]
    assert {r.conv_id: r.title for r in history.sessions(m).collect()} == {1: "m0", 2: "line one and a lon"}
    s = spark.createDataFrame([(1, "A", False, 1), (2, "B", False, 3), (3, "B", False, 2)], "conv_id long, owner_sid string, deleted boolean, updated int")
    assert history.session_page(s, "A", 0, 2, [F.desc("updated")]).count() == 0
    assert history.session_page(s, "A", 1, 2, [F.desc("updated")]).count() == 1


def test_bfs(spark):
    e = spark.createDataFrame([("http://a/", "http://b/"), ("http://b/", "http://c/"), ("http://c/", "http://a/"), ("http://b/", "http://d/skip")], "src string, dst string")
    got = {r.url: r.depth for r in web.bfs(e, ["http://a", "http://A/", "bad"], 2).collect()}
    assert got == {"http://a/": 0, "http://b/": 1, "http://c/": 2, "http://d/skip": 2}
    assert web.bfs(e, ["http://a/"], 0).count() == 1
    assert {r.url for r in web.bfs(e, ["http://a/"], 3, domains=["a"]).collect()} == {"http://a/", "http://b/"}
