"""Queries over pages and URLs."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalex.functions import urls
from stratalex.operators import web
from stratalex.plans.catalogue import query
from stratalex.sources.tables import table

_HOST = "lower(regexp_extract(url, '^[A-Za-z]+://(?:[^/?#@]*@)?([^/?#:]*)', 1))"
_PATH = "regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1)"


@query("html_extract")
def html_extract(spark, sf):
    return web.extract(table(spark, sf, "pages"), columns=["text"]).select("page_id", "url", "text")


# the pages have no tables, and a page without one is a row with null
@query("html_tables", "SELECT page_id, CASE WHEN contains(lower(html), '<table') THEN html END AS table_text FROM pages")
def html_tables(spark, sf):
    return web.extract(table(spark, sf, "pages"), columns=["tables"]).select("page_id", F.explode_outer("tables").alias("table_text"))


# the pages' links all start at the host's root
_LINKS = r"""SELECT page_id, url, regexp_extract(url, '^[A-Za-z]+://[^/?#]*') || unnest(regexp_extract_all(regexp_replace(html, '<script.*?</script>|<!--.*?-->', '', 'gs'), '<a[^>]* href="([^"]*)"', 1)) AS link FROM pages"""


@query("html_links", f"SELECT page_id, link FROM ({_LINKS})")
def html_links(spark, sf):
    return web.extract(table(spark, sf, "pages"), kept_links_only=False, columns=["links"]).select("page_id", F.explode("links").alias("link"))


_NORMAL = rf"""CASE WHEN lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) IN ('http', 'https') THEN
  CASE WHEN w <> b AND suffix(w, '/') THEN substr(w, 1, length(w) - 1) ELSE w END END"""
_PARTS = rf"""(SELECT page_id, url, regexp_extract(url, '^([A-Za-z]+)://', 1) || '://' || {_HOST} || regexp_extract(url, '^[A-Za-z]+://[^/?#:]*(:\d+)', 1) AS o,
  CASE WHEN {_PATH} = '' THEN '/' ELSE {_PATH} END || regexp_extract(url, '^[^?#]*(\?[^#]*)', 1) AS r FROM pages)"""


@query("url_normalize", f"SELECT page_id, {_NORMAL} AS url_normal FROM (SELECT page_id, url, o || r AS w, o || '/' AS b FROM {_PARTS})")
def url_normalize(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.normalise(F.col("url")).alias("url_normal"))


@query("url_source_name", rf"""SELECT page_id, CASE WHEN p IN ('', '/') THEN h || '_index' WHEN last = '' THEN 'crawled_page'
  ELSE regexp_replace(substr(h || '_' || CASE WHEN strpos(substr(last, 2), '.') > 0 THEN array_to_string(string_split(last, '.')[:-2], '.') ELSE last END, 1, 80), '[^A-Za-z0-9_\-\x{{4e00}}-\x{{9fff}}]', '_', 'g') END AS name
FROM (SELECT *, string_split(rtrim(p, '/'), '/')[-1] AS last FROM (SELECT page_id, regexp_extract(url, '^[A-Za-z]+://(?:[^/?#@]*@)?([^/?#:]*)', 1) AS h, {_PATH} AS p FROM pages))""")
def url_source_name(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.source_name(F.col("url")).alias("name"))


@query("domain_filter", f"SELECT page_id FROM pages WHERE {_HOST} = 'example.com' OR suffix({_HOST}, '.example.com') OR suffix({_HOST}, '.tionsh.example.net') OR {_HOST} = 'tionsh.example.net'")
def domain_filter(spark, sf):
    return table(spark, sf, "pages").where(urls.in_domains(F.col("url"), ["example.com", "tionsh.example.net"])).select("page_id")


@query("path_filter", "SELECT page_id FROM pages WHERE contains(lower(url), '/en/') OR contains(lower(url), 'utm_')")
def path_filter(spark, sf):
    return table(spark, sf, "pages").where(urls.in_paths(F.col("url"), ["/EN/", "utm_"])).select("page_id")


# hosts by page and what must come of them: of literal addresses those of networks inside
_HOSTS = [
    ("example.com", None), ("fdic.gov", None), ("fcbayern.com", None), ("127.0.0.1", "address"), ("127.1", "address"), ("2130706433", "address"), ("0x7f.1", "address"), ("0177.0.0.1", "address"),
    ("172.20.1.1:80", "address"), ("172.32.0.1", None), ("192.168.1.256", None), ("10.0.0.0", "address"), ("0.0.0.0", "address"), ("0.0.0.1", None), ("u:p@10.1.2.3:8080", "address"),
    ("", "host"), (":80", "host"), ("[::1]", "address"), ("[::1]:8080", "address"), ("[::]", "address"), ("[fd12:3456::1]", "address"), ("[fe80::1%25eth0]", "address"), ("[fec0::7]", "address"),
    ("[2001:db8::1]", None), ("[::ffff:192.168.0.1]", "address"), ("[::ffff:8.8.8.8]", None), ("[1:2:3]", "host"), ("LOCALHOST", "address"), ("169.254.169.254", "address"), ("8.8.8.8", None),
]
_CHOSEN = "CASE page_id % 31 " + " ".join(f"WHEN {i} THEN 'http://{h}/a'" for i, (h, _) in enumerate(_HOSTS)) + " ELSE 'ftp://x.com/' END"
_REASONS = "CASE page_id % 31 " + " ".join(f"WHEN {i} THEN '{r}'" for i, (_, r) in enumerate(_HOSTS) if r) + " WHEN 30 THEN 'scheme' END"


@query("url_safety", f"SELECT page_id, NULL AS own, {_REASONS} AS reason FROM pages")
def url_safety(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.unsafe_reason(F.col("url")).alias("own"), urls.unsafe_reason(F.expr(_CHOSEN)).alias("reason"))


@query("redirect_status", "SELECT page_id, page_id % 20 + 295 AS status FROM pages WHERE page_id % 20 + 295 IN (301, 302, 303, 307, 308)")
def redirect_status(spark, sf):
    p = table(spark, sf, "pages").selectExpr("page_id", "page_id % 20 + 295 AS status")
    return p.where(urls.is_redirect(F.col("status")))


@query("completions_url", "SELECT page_id, regexp_replace(url, '/+$', '') || '/chat/completions' AS endpoint FROM pages")
def completions_url(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.completions_url(F.col("url")).alias("endpoint"))


_EDGES = """e AS (SELECT DISTINCT 'http://p/' || page_id AS src, 'http://p/' || (page_id * 3 + k) % (SELECT count(*) FROM pages) AS dst FROM pages, (SELECT unnest([1, 2, 7]) AS k))"""


@query("bfs_crawl", f"""WITH RECURSIVE {_EDGES}, r(url, depth) AS (SELECT 'http://p/0', 0 UNION SELECT e.dst, depth + 1 FROM r JOIN e ON e.src = r.url WHERE depth < 3)
SELECT url, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY url""")
def bfs_crawl(spark, sf):
    return web.bfs(_edges(table(spark, sf, "pages")), ["http://p/0"], 3)


def _edges(p):
    n = p.count()
    return p.select("page_id", F.explode(F.array(F.lit(1), F.lit(2), F.lit(7))).alias("k")).select(F.concat(F.lit("http://p/"), "page_id").alias("src"), F.concat(F.lit("http://p/"), (F.col("page_id") * 3 + F.col("k")) % n).alias("dst")).distinct()


def _normal_sql(of: str) -> str:
    """The normal form of a URL column without a port, as SQL."""
    origin = f"regexp_extract({of}, '^([A-Za-z]+)://', 1) || '://' || lower(regexp_extract({of}, '^[A-Za-z]+://([^/?#]*)', 1))"
    rest = f"CASE WHEN regexp_extract({of}, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract({of}, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) END || regexp_extract({of}, '^[^?#]*(\\?[^#]*)', 1)"
    return f"{origin} || CASE WHEN length({rest}) > 1 AND suffix({rest}, '/') THEN substr({rest}, 1, length({rest}) - 1) ELSE {rest} END"


@query("page_graph", f"SELECT DISTINCT {_normal_sql('url')} AS src, {_normal_sql('link')} AS dst FROM ({_LINKS})")
def page_graph(spark, sf):
    return web.edges_of(web.extract(table(spark, sf, "pages"), kept_links_only=False, columns=["links"]))


@query("crawl_queue")
def crawl_queue(spark, sf):
    pages = web.first_pages(web.extract(table(spark, sf, "pages"), columns=["text", "links"]))
    seeds = [r["url"] for r in table(spark, sf, "pages").orderBy("page_id").select("url").limit(20).collect()]
    return web.crawl(pages, seeds, 500, 3)
