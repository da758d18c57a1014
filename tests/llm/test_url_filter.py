import re
import string

import pytest

from stratalex.llm import url_filter
from stratalex.llm.queries import RULES

FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
SCHEMA = "page_id long, url string, html string, _host string, host string, rule string"
URLS = [
    None, "", "no scheme", "http://", "http://com/en/x", "https://A.Example.COM/en/7?x#y", "https://example.com/en/70/..", "https://notexample.com/en/7",
    "http://sub.example.net/de/8", "http://example.net/de/80#f", "http://net/de/", "http://x.net/de", "ftp://é.ORG/es/É?q", "http://org/es/://", "http://h?/en/", "http://a.com#/en/", "x" * 200_000 + "://b.com/en/" + "y" * 100_000,
    "https://ÀÉ.com/en/", "http://user@host.com:80/en/",
]


def brute(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate(FOLD)
    best = None
    for r in RULES:
        h, _, p = r.pattern.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(r.pattern) > len(best.pattern)):
            best = r
    return host, path, best


@pytest.fixture(scope="module")
def model(spark):
    good = [(f"https://{w}.{t}.example.com/en/{n}", 0.0) for n, w in enumerate(["blog", "www", "m", "news"]) for t in ["thther", "river", "ththon", "market", "garden"]]
    bad = [(f"http://{a}-{b}.example.com/{n}", 1.0) for n, a in enumerate(["cheap", "free", "best", "win"]) for b in ["pills", "casino", "bets", "spam", "cash"]]
    return url_filter.fit(spark.createDataFrame((good + bad) * 3 + [(None, 1.0), ("http://x", None)], "url string, label double"))


def test_rules_against_brute_force(spark, model):
    rows = [(i, u, "", "a", "b", "c") for i, u in enumerate(URLS)] + [(3, URLS[4], "", "", "", "")] * 2
    got = url_filter.judge(spark.createDataFrame(rows, SCHEMA), RULES, model).collect()
    assert len(got) == len(rows)
    by_id = {r[0]: r[1] for r in rows[: len(URLS)]}
    for r in got:
        if r.page_id == 3:
            continue
        host, path, rule = brute(by_id[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule and rule.pattern)
        assert r.verdict in ("block", "allow") and (rule is None or r.verdict == rule.verdict)


def test_trees_on_unseen_urls(spark, model):
    urls = [("https://blog.meadow.example.com/en/9", "allow"), ("http://quick-loans.example.com/7", "block"), ("http://hot-deals.example.com/5", "block"), ("https://www.harbor.example.com/en/2", "allow")]
    rows = [(i, u, "", "", "", "") for i, (u, _) in enumerate(urls)]
    got = {r.page_id: r.verdict for r in url_filter.judge(spark.createDataFrame(rows, SCHEMA), [], model).collect()}
    assert [got[i] for i in range(4)] == [v for _, v in urls]


def test_held_out_accuracy(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    labels = url_filter.weak_labels(pages)
    from pyspark.sql import functions as F

    held = F.crc32("url") % 5 == 0
    m = url_filter.fit(labels.where(~held))
    got = url_filter.judge(pages.where(held), [], m).join(url_filter.weak_labels(pages.where(held)).withColumnRenamed("url", "u").distinct().join(pages.select("page_id", F.col("url").alias("u")), "u"), "page_id")
    n, right = got.select(F.count("*"), F.count_if((F.col("verdict") == "block") == (F.col("label") == 1))).first()
    assert n > 300 and right >= 0.98 * n


def test_no_rows_or_one_class(spark):
    empty = spark.createDataFrame([], SCHEMA)
    m = url_filter.fit(spark.createDataFrame([], "url string, label double"))
    assert url_filter.judge(empty, RULES, m).count() == 0
    one = url_filter.fit(spark.createDataFrame([("http://a", 1.0)], "url string, label double"))
    assert url_filter.judge(spark.createDataFrame([(1, "http://b", "", "", "", "")], SCHEMA), [], one).first().verdict == "block"


def test_plan_has_no_python(spark, model):
    rows = spark.createDataFrame([(1, "http://b", "", "", "", "")], SCHEMA).select("page_id", "url")
    plan = url_filter.judge(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"), RULES, model)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and rows.count() == 1


def test_suffixes_of_all_urls(spark, monkeypatch):
    rows = [(f"http://a{i}.s{i % 50}.com/{i}", float(i % 50 < 10)) for i in range(2000)]
    labelled = spark.createDataFrame(rows * 2, "url string, label double")
    m = url_filter.fit(labelled, rows=200)
    seen = {(r._labels, r._suffix): (r._n, r._y, len(r._folds)) for r in m.suffixes.collect()}
    assert m.rate == 0.2 and seen == {(1, "com"): (2000.0, 400.0, 5)} | {(2, f"s{k}.com"): (40.0, 40.0 * (k < 10), 5) for k in range(50)}
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows)] + [(None, None)], "page_id long, url string")
    want = sorted(map(str, url_filter.judge(pages, [], m).collect()))
    monkeypatch.setattr(url_filter, "MOST_BROADCAST", 10)
    shuffled = url_filter.fit(labelled, rows=200)
    assert m.small and not shuffled.small and sorted(map(str, url_filter.judge(pages, [], shuffled).collect())) == want


def test_suffix_statistics_out_of_fold(spark):
    """A suffix of one host tells a row to fit on nothing about its own label."""
    rows = [(f"http://a.only{i}.com/{i}", float(i < 10)) for i in range(40)]
    m = url_filter.fit(spark.createDataFrame(rows, "url string, label double"))
    hosts = spark.createDataFrame([("a.only3.com",), ("a.only30.com",)], "_host string")
    out = [r.f_suffix_rate_2 for r in url_filter._with_suffix(hosts, "_host", m.suffixes, m.rate, m.small, out_of_fold=True).collect()]
    full = [r.f_suffix_rate_2 for r in url_filter._with_suffix(hosts, "_host", m.suffixes, m.rate, m.small).orderBy("_host").collect()]
    assert out == [m.rate, m.rate] and full[0] > m.rate > full[1]


def test_hosts_of_unseen_words(spark):
    """Blocks are told by shape: precision and recall on hosts whose words the fitting never saw, against the majority."""
    import random

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("bcdfghjklmnprstv") + rng.choice("aeiou") for _ in range(rng.randrange(2, 4)))
    good = lambda: f"https://www.{word()}.org/{word()}/{word()}.html"
    bad = lambda: f"http://{word()}-{word()}{rng.randrange(100, 9999)}.{word()}.info/p?id={rng.randrange(10**6)}&ref={rng.randrange(99)}&s={word()}"
    near = lambda: f"http://{word()}.info/{word()}?id={rng.randrange(99)}"
    made = [(f(), y) for _ in range(400) for f, y in ((good, 0.0), (good, 0.0), (near, 0.0), (bad, 1.0))]
    m = url_filter.fit(spark.createDataFrame(made[:1000], "url string, label double"))
    held = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(made[1000:])], "page_id long, url string")
    got = {r.page_id: r.verdict == "block" for r in url_filter.judge(held, [], m).collect()}
    pairs = [(got[i], y == 1.0) for i, (_, y) in enumerate(made[1000:])]
    hit = sum(g and y for g, y in pairs)
    assert hit / sum(g for g, _ in pairs) > 0.9 and hit / sum(y for _, y in pairs) > 0.9
    assert sum(g == y for g, y in pairs) > sum(not y for _, y in pairs) + 0.15 * len(pairs)  # the majority allows all
