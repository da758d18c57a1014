from pyspark.sql import functions as F

from stratalex.operators import history, ingest, web
from stratalex.sources import tables


def test_pages_of_any_depth():
    n = 100_000
    for html in ("<div>" * n + "deep", "<div>" * n + "</b>" * n + "deep", "<b>" * n + "deep"):
        got = web.page("http://h/", f"<body><p><a href='/x'>l</a></p>{html}", ["text", "tables", "links"])
        assert "deep" in got["text"] and got["links"] == ["http://h/x"] and got["tables"] == []


def test_only_what_is_asked_for(spark):
    rows = spark.createDataFrame([(1, "http://h/", "<p>a</p><table><tr><td>x</table>"), (None, None, None)], "page_id long, url string, html string")
    assert web.extract(rows, columns=["tables"]).columns == ["page_id", "url", "tables"]
    assert web.extract(rows.limit(0)).count() == 0


def test_redirect_chains(spark):
    links = [(f"http://a/{i}", 301, f"/{i + 1}") for i in range(30)] + [("http://b/", 302, "http://b/"), ("http://c/", 302, "http://127.0.0.1/"), ("http://d/", 200, "http://a/0"), ("http://e/", 302, None)]
    starts = ["http://a/25", "http://a/9", "http://a/8", "http://b/", "http://c/", "http://d/", "http://e/", "ftp://x/", None]
    got = {r.url: (r.final, r.hops, r.reason) for r in ingest.follow(spark.createDataFrame([(s,) for s in starts], "url string"), spark.createDataFrame(links, "src string, status int, location string")).collect()}
    assert got["http://a/25"] == ("http://a/30", 5, None) and got["http://a/9"][:2] == ("http://a/29", 20) and got["http://a/8"] == ("http://a/28", 20, "hops")
    assert got["http://b/"] == ("http://b/", 20, "hops") and got["http://c/"] == ("http://127.0.0.1/", 1, "address")
    assert got["http://d/"] == ("http://d/", 0, None) and got["http://e/"] == ("http://e/", 0, None) and got["ftp://x/"][2] == "scheme"


def test_ingest_replaces_equal_contents(spark):
    text = "".join(f"<p>Line {i} of a page about algebra and the like, long enough.</p>" for i in range(20))
    pages = spark.createDataFrame([(1, "http://h/a/b.html", f"<article>{text}</article>"), (2, "http://h/", "<p>short</p>"), (3, "http://h/n", None)], "page_id long, url string, html string")
    made = ingest.page_chunks(pages)
    assert {(r.page_id, r.source_name) for r in made.collect()} == {(1, "crawl:h_b")} and len(made.first().embedding) == 256
    store = made.select("chunk_id", "content", "source_file", "grade").limit(0)
    once = ingest.ingest_pages(store, pages)
    assert once.count() == made.count()
    again = ingest.ingest_pages(once.select(*store.columns), pages)
    assert again.count() == once.count()


def test_manifests(spark, tmp_path):
    path, schema = str(tmp_path / "m"), "name string, reason string"
    ingest.save_manifest(spark.createDataFrame([("a", "x"), ("b", None)], schema), path)
    assert ingest.without_failed(ingest.load_manifest(spark, path, schema), "a").collect()[0].name == "b"
    ingest.reset_manifest(spark, path, schema)
    assert ingest.load_manifest(spark, path, schema).count() == 0


def test_files_of_a_folder(spark, tmp_path):
    for name, body in (("b.PDF", "12"), ("a.pdf", "123"), ("c.txt", "1")):
        (tmp_path / name).write_text(body)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "d.pdf").write_text("1")
    found = tables.files(spark, str(tmp_path))
    assert [(r["name"], r["size"]) for r in found.collect()] == [("a.pdf", 3), ("b.PDF", 2)]
    assert found.agg(F.sum("size")).first()[0] == 5
    stored = ingest.upload_names(spark.createDataFrame([("x?.pdf", 5), ("x*.pdf", 4), ("a.pdf", 6), ("n.txt", 1)], "name string, ms long"), found)
    assert {r["name"]: r["stored"] for r in stored.collect()} == {"x*.pdf": "x_.pdf", "x?.pdf": "x__5.pdf", "a.pdf": "a_6.pdf"}


def test_session_writes(spark):
    columns = "conv_id long, title string, stage string, model string, owner_sid string, deleted boolean, created long, updated long"
    empty = spark.createDataFrame([], columns)
    one = history.insert_session(empty, "me", 7)
    assert tuple(one.first()) == (1, "新对话", "junior", "", "me", False, 7, 7)
    new = spark.createDataFrame([(1, 9, "assistant", "hello"), (1, 10, "user", "A question\nof more than eighteen")], "conv_id long, turn long, role string, text string")
    after, every = history.append_messages(one, new.limit(0), new)
    assert (after.first().title, after.first().updated, every.count()) == ("A question of more", 10, 2)
    assert history.update_meta(one, 1, model="m").first().model == "m" and history.update_meta(one, 1).first().model == ""
    assert history.hard_delete(every, 1).count() == 0 and history.live_sessions(one).first().live == 1
    asked = spark.createDataFrame([(1, None, None, None), (2, "senior", 0.9, "ctx")], "conv_id long, stage string, temperature double, context string")
    got = {r.conv_id: (r.temperature, r.messages) for r in history.request_messages(every, asked, "Base", {"junior": "J", "senior": "S"}).collect()}
    assert got[2] == (0.9, '[{"role":"system","content":"Base\\nSctx"}]')
    assert got[1][0] == 0.15 and got[1][1].startswith('[{"role":"system","content":"Base\\nJ"},{"role":"assistant","content":"hello"},{"role":"user"')
