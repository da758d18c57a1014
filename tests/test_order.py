from collections import Counter, defaultdict

from pyspark.sql import functions as F

from stratalex.functions import text as T
from stratalex.functions import urls
from stratalex.operators import context, kb
from stratalex.operators.order import with_sum_before


def test_sums_over_a_hot_group(spark):
    rows = [("hot", i, i % 7) for i in range(3000)] + [(f"g{i % 40}", i, 3) for i in range(400)] + [(None, 1, 5), (None, 2, 6)]
    got = with_sum_before(spark.createDataFrame(rows, "g string, at int, v int"), "g", ["at"], F.col("v"), "before").collect()
    groups = defaultdict(list)
    for g, at, v in rows:
        groups[g].append((at, v))
    want = {(g, at): sum(v for a, v in own if a < at) for g, own in groups.items() for at, _ in own}
    assert len(got) == len(rows) and {(r.g, r.at): r.before for r in got} == want


def test_neighbours_of_all_equal_those_of_few(spark):
    rows = [("a", i, 500 * (i // 2)) for i in range(40)] + [("b", 100 + i, 7 * i) for i in range(9)] + [("c", 200, 0)]
    chunks = spark.createDataFrame(rows, "source_file string, chunk_id int, start_char int")
    few = context.neighbours(chunks, chunks.select(F.col("chunk_id").alias("anchor_id"), "source_file", "start_char"), 2, 1)
    key = lambda r: (r.anchor_id, r.chunk_id, r.side, r.distance)
    assert Counter(map(key, context.all_neighbours(chunks, 2, 1).collect())) == Counter(map(key, few.collect()))


def test_parts_of_whole_texts(spark, tmp_path):
    pages = [("f", 2, "second"), ("f", 1, "first"), ("f", 3, None), ("g", 1, "é")]
    frame = spark.createDataFrame(pages, "file_name string, page_num int, content string")
    got = {(r.file_name, r.page_num): (r.start_char, r.part) for r in kb.full_text(frame).collect()}
    assert got == {("f", 1): (0, "first\n\n"), ("f", 2): (7, "second\n\n"), ("f", 3): (15, "\n\n"), ("g", 1): (0, "é\n\n")}
    kb.write_full_text(frame, str(tmp_path / "texts"))
    assert spark.read.parquet(str(tmp_path / "texts")).count() == 4


def test_page_lines(spark):
    body = [f"Line {i} of the body, which is long enough to stay." for i in range(20)]
    cases = {
        "\n".join(["Short head", *body, "foot"]): "\n".join(body),
        "\n".join(["第3章", *body, "12. 证"]): "\n".join(["第3章", *body, "12. 证"]),
        "\n".join(["读后章", *body]): "\n".join(body),  # no 第
        "\n".join(["v1.2", *body]): "\n".join(["v1.2", *body]),
        "\n".join([*body[:9], "12", "侵权必究 all", "翻印", "see http://x.y www.z", *body[9:]]): "\n".join([*body[:9], "see http://x.y www.z", *body[9:]]),
        "\n".join([*body, "\tISBN 1\r", "\n\n\n"]): "\n".join(body),
        "": "",
    }
    frame = spark.createDataFrame([*cases.items(), (None, "")], "raw string, want string")
    for r in frame.select("raw", "want", T.clean_page(F.col("raw")).alias("got")).collect():
        assert r.got == r.want, r.raw


def test_source_names(spark):
    cases = {
        "http://ex.com/a/b.html": "ex_com_b", "http://ex.com/a/b/": "ex_com_b", "http://ex.com/": "ex.com_index", "http://ex.com": "ex.com_index", "http://ex.com/.env": "ex_com__env",
        "http://ex.com/a-b.c.d?q=1": "ex_com_a-b_c", "http://ex.com/数学.html": "ex_com_数学", "http://ex.com//": "crawled_page", "http://ex.com/" + "x" * 100: "ex_com_" + "x" * 73,
    }
    frame = spark.createDataFrame(list(cases.items()), "url string, want string")
    for r in frame.select("url", "want", urls.source_name(F.col("url")).alias("got")).collect():
        assert r.got == r.want, r.url
