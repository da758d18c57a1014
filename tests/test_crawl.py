"""The crawl against a queue that one worker handles, merges, addresses and page ingestion."""

import hashlib
import os
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from stratalex.functions import urls
from stratalex.operators import ingest, kb, web


def in_turn(pages, seeds, most, depth, words, least):
    """One page after another: url, depth, status."""
    hosts = {s.split("/")[2] for s in seeds}
    queue, seen, hashes, indexed, out = deque(), set(), set(), 0, []
    for s in seeds:
        if s not in seen:
            seen.add(s)
            queue.append((s, 0))
    while queue and indexed < most:
        url, d = queue.popleft()
        host = url.split("/")[2]
        if not any(host == h or host.endswith("." + h) for h in hosts):
            out.append((url, d, "outside"))
            continue
        if url not in pages:
            out.append((url, d, "failed"))
            continue
        text, links = pages[url]
        h = hashlib.sha256((text or "").encode()).hexdigest()
        status = "short" if len(text or "") < least else "duplicate" if h in hashes else "indexed"
        if status == "indexed":
            hashes.add(h)
            indexed += 1
        out.append((url, d, status))
        if d < depth and indexed < most:
            for link in links:
                if all(w in link for w in words) and link not in seen:
                    seen.add(link)
                    queue.append((link, d + 1))
    return out


@pytest.mark.parametrize(("most", "depth"), [(1000, 3), (25, 3), (7, 2), (0, 2), (1, 0)])
def test_crawl_equals_a_queue(spark, most, depth):
    r = random.Random(5)
    name = lambda i: f"http://{['a.com', 'b.a.com', 'c.org'][i % 3]}/p{i}"
    pages = {name(i): (r.choice(["x" * 5, "y" * 300, f"page {i} " * 60, None, "z" * 250]), [name(r.randrange(180)) for _ in range(r.randrange(7))]) for i in range(150)}
    seeds = [name(0), name(3), name(0), name(4)]
    rows = spark.createDataFrame([(u, t, ls) for u, (t, ls) in pages.items()], "url string, text string, links array<string>")
    got = sorted(web.crawl(rows, seeds, most, depth).collect(), key=lambda x: (x["depth"], x["place"]))
    assert [(x["url"], x["depth"], x["status"]) for x in got] == in_turn(pages, seeds, most, depth, (), 200)


def test_one_page_for_a_url(spark):
    rows = spark.createDataFrame([(2, "http://A.com/x/", "b", ["/l"]), (1, "http://a.com/x", "a", []), (3, "ftp://x", "c", [])], "page_id long, url string, text string, links array<string>")
    assert [(r["url"], r["text"]) for r in web.first_pages(rows).collect()] == [("http://a.com/x", "a")]


def test_merge_touches_only_what_it_must(spark, tmp_path):
    path = str(tmp_path / "store")
    old = spark.createDataFrame([(i, f"text {i}", "old") for i in range(400)], "id long, content string, source string")
    new = spark.createDataFrame([(1000, "text 7", "new"), (1001, "text 7", "newer"), (1002, "fresh", "new")], "id long, content string, source string")
    kb.write_store(old, "content", path)
    files = lambda: {os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f.startswith("part-")}
    before = files()
    touched = kb.merge_into(path, new, "content", "id")
    assert touched == sorted({hashlib.sha256(t.encode()).hexdigest()[:2] for t in ("text 7", "fresh")})
    kept = {f for f in before if not any(f"prefix={p}/" in f for p in touched)}
    assert kept <= files() and len(kept) > len(before) / 2
    want = kb.upsert(old, new, "content", "id").select("id", "content", "source")
    read = lambda: sorted(map(tuple, kb.read_store(spark, path).select("id", "content", "source").collect()))
    assert read() == sorted(map(tuple, want.collect())) and (1001, "text 7", "newer") in read()
    kb.merge_into(path, new, "content", "id")
    assert read() == sorted(map(tuple, want.collect()))
    assert kb.merge_into(path, new.limit(0), "content", "id") == []


def test_addresses(spark):
    refused = ["http://[::1]/", "http://2130706433/", "http://0x7f.1/", "http://0x7F000001", "http://017700000001/", "http://10.1/", "http://[::ffff:10.0.0.1]:8/x", "http://a@[FE80::1]/", "http://localhost./", "http://x.localhost/"]
    allowed = ["https://fdic.gov", "https://fcbayern.com", "http://fe80.com/", "http://134744072/", "http://[2001:db8::7f00:1]/", "http://1.2.3.4.5/", "http://256.1.1.1/", "http://4294967296/"]
    rows = spark.createDataFrame([(u,) for u in [*refused, *allowed, None, "", "http://", "http://[1::2::3/", "gopher://x"]], "u string")
    got = {r["u"]: r["why"] for r in rows.select("u", urls.unsafe_reason(F.col("u")).alias("why")).collect()}
    assert {got[u] for u in refused} == {"address"} and {got[u] for u in allowed} == {None}
    assert [got[u] for u in (None, "", "http://", "gopher://x")] == ["scheme", "scheme", "host", "scheme"]


def test_pages_of_one_text_are_taken_once(spark):
    text = "".join(f"<p>Line {i} of a page about algebra, \\(x_{i}\\) and \\[y\\] at length.</p>" for i in range(20))
    pages = spark.createDataFrame([(2, "http://h/b", f"<article>{text}</article>"), (1, "http://h/a.html", f"<article>{text}</article>")], "page_id long, url string, html string")
    made = ingest.page_chunks(pages)
    rows = made.collect()
    assert {(r["page_id"], r["source_file"]) for r in rows} == {(1, "crawl:h_a")}
    assert all("$x_" in r["content"] and "$$y$$" in r["content"] and "\\(" not in r["content"] for r in rows)
    store = made.select("chunk_id", "content", "source_file").limit(0)
    assert {r["source_file"] for r in ingest.ingest_pages(store, pages).collect()} == {"crawl:h_a"}
