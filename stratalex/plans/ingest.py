"""Queries that bring pages, files and messages in, and those over the tables that keep track."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalex.functions import text as T
from stratalex.functions import urls
from stratalex.operators import history, ingest, web
from stratalex.plans.catalogue import query
from stratalex.plans.search import _TOP, _search
from stratalex.plans.web import _EDGES, _edges
from stratalex.sources import archive
from stratalex.sources.scratch import scratch_path
from stratalex.sources.tables import PRESETS, files, table

_STRIPPED = "trim(regexp_replace(regexp_replace(html, '<[^>]*>', '', 'g'), '&lt;/?[a-zA-Z][^&]*&gt;', '', 'g'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


@query("page_gate", f"SELECT page_id, length({_STRIPPED}) AS n FROM pages WHERE length({_STRIPPED}) >= 1500")
def page_gate(spark, sf):
    texts = table(spark, sf, "pages").select("page_id", T.strip_tags(F.col("html")).alias("text"))
    return ingest.long_enough(texts, least=1500).select("page_id", F.length("text").cast("long").alias("n"))


@query("ingest_pages")
def ingest_pages(spark, sf):
    made = ingest.page_chunks(table(spark, sf, "pages"))
    return made.groupBy("page_id", "source_name", "grade").agg(F.count("*").alias("chunks"), F.sum(F.length("content")).alias("n_chars"))


@query("response_rows", _TOP + " SELECT position, chunk_id, coalesce(chapter_title, '') AS chapter_title, printf('%.1f%%', res.score * 100) AS score FROM res")
def response_rows(spark, sf):
    return _search(spark, sf).select("position", "chunk_id", F.coalesce("chapter_title", F.lit("")).alias("chapter_title"), F.format_string("%.1f%%", F.col("score") * 100).alias("score"))


@query("crawl_page_limit", f"""WITH RECURSIVE {_EDGES}, r(url, depth) AS (SELECT 'http://p/0', 0 UNION SELECT e.dst, depth + 1 FROM r JOIN e ON e.src = r.url WHERE depth < 4)
SELECT url, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY url ORDER BY min(depth), url LIMIT 25""")
def crawl_page_limit(spark, sf):
    return web.bfs(_edges(table(spark, sf, "pages")), ["http://p/0"], 4, most=25)


_STATUS = "CASE page_id % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'skipped' ELSE 'indexed' END"


@query("crawl_stats", f"""SELECT count(*) AS pages, count(*) FILTER (s = 'indexed') AS indexed, count(*) FILTER (s = 'skipped') AS skipped, count(*) FILTER (s = 'failed') AS failed,
CAST(coalesce(sum(c), 0) AS BIGINT) AS chunks FROM (SELECT {_STATUS} AS s, CASE WHEN page_id % 5 > 1 THEN page_id % 9 ELSE 0 END AS c FROM pages)""")
def crawl_stats(spark, sf):
    return ingest.crawl_stats(table(spark, sf, "pages").selectExpr(f"{_STATUS} AS status", "CASE WHEN page_id % 5 > 1 THEN page_id % 9 ELSE 0 END AS chunks"))


_HOPS = "CASE WHEN page_id % 4 = 3 THEN 'http://10.0.0.1/x' ELSE 'http://p.example/' || (page_id + 1) END"


@query("redirect_chain", f"""WITH RECURSIVE d AS (SELECT 'http://p.example/' || page_id AS src, {_HOPS} AS dst FROM pages WHERE page_id % 7 > 1),
r AS (SELECT 'http://p.example/' || page_id AS url, 'http://p.example/' || page_id AS final, 0 AS hops FROM pages
  UNION ALL SELECT r.url, d.dst, hops + 1 FROM r JOIN d ON d.src = r.final WHERE hops < 20)
SELECT url, arg_max(final, hops) AS final, CAST(max(hops) AS INTEGER) AS hops, CASE WHEN arg_max(final, hops) LIKE 'http://10.%' THEN 'address' END AS reason FROM r GROUP BY url""")
def redirect_chain(spark, sf):
    p = table(spark, sf, "pages")
    moved = p.where("page_id % 7 > 1").selectExpr("concat('http://p.example/', page_id) AS src", "302 AS status", "CASE WHEN page_id % 4 = 3 THEN 'http://10.0.0.1/x' ELSE concat('/', page_id + 1) END AS location")
    return ingest.follow(p.selectExpr("concat('http://p.example/', page_id) AS url"), moved)


@query("manifest_round_trip", "SELECT source AS name, 'reason ' || min(doc_id) AS reason FROM documents WHERE source <> (SELECT min(source) FROM documents) GROUP BY source")
def manifest_round_trip(spark, sf):
    path, schema = scratch_path(spark, "manifest"), "name string, reason string"
    failed = table(spark, sf, "documents").groupBy("source").agg(F.concat(F.lit("reason "), F.min("doc_id")).alias("reason")).withColumnRenamed("source", "name")
    ingest.save_manifest(failed, path)
    first = failed.agg(F.min("name")).first()[0]
    return ingest.without_failed(ingest.load_manifest(spark, path, schema), first)


_FAILED = "SELECT source AS name, count(*) AS files, min(doc_id) AS first_id FROM documents WHERE suffix(source, '1') GROUP BY source"


@query("failed_file_list", _FAILED)
def failed_file_list(spark, sf):
    d = table(spark, sf, "documents")
    return d.where(F.endswith("source", F.lit("1"))).groupBy(F.col("source").alias("name")).agg(F.count("*").alias("files"), F.min("doc_id").alias("first_id"))


_NAMES = "SELECT CASE WHEN doc_id % 5 = 0 THEN 'notes.txt' ELSE 'a/b:' || doc_id % 9 || '?.PDF' END AS name, doc_id + 1700000000000 AS ms FROM documents"


@query("upload_names", rf"""WITH u AS ({_NAMES}), s AS (SELECT *, regexp_replace(name, '[\\/:*?"<>|]', '_', 'g') AS safe FROM u WHERE suffix(lower(name), '.pdf')),
n AS (SELECT *, row_number() OVER (PARTITION BY safe ORDER BY ms, name) AS k FROM s)
SELECT name, CASE WHEN k > 1 OR safe = 'a_b_3_.PDF' THEN replace(safe, '.PDF', '') || '_' || ms || '.PDF' ELSE safe END AS stored FROM n""")
def upload_names(spark, sf):
    u = table(spark, sf, "documents").selectExpr("CASE WHEN doc_id % 5 = 0 THEN 'notes.txt' ELSE concat('a/b:', doc_id % 9, '?.PDF') END AS name", "doc_id + 1700000000000 AS ms")
    return ingest.upload_names(u, spark.createDataFrame([("a_b_3_.PDF",)], "name string"))


@query("file_listing")
def file_listing(spark, sf):
    return files(spark, sf, ".parquet").select("name", "size", F.date_format("modified", "yyyy-MM-dd HH:mm:ss").alias("modified"))


@query("disk_usage")
def disk_usage(spark, sf):
    return files(spark, sf, ".parquet").agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("bytes"))


@query("preset_pages", """SELECT page_id, s.name FROM pages, (VALUES ('初中数学（通用）', 'math'), ('高中数学（通用）', 'math'), ('K12 全面爬取', 'math')) s(name, word) WHERE contains(lower(url || '/math' || page_id % 3), word || '1')""")
def preset_pages(spark, sf):
    url = F.concat("url", F.lit("/math"), (F.col("page_id") % 3).cast("string"))
    fits = F.array(*[F.when(urls.in_paths(url, [f"{w}1" for w in words]), name) for name, _, _, words in PRESETS])
    return table(spark, sf, "pages").select("page_id", F.explode(F.array_compact(fits)).alias("name"))


@query("timestamp_format", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM events")
def timestamp_format(spark, sf):
    return table(spark, sf, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"))


def _sessions(spark, sf):
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.max("turn").alias("updated"))
    return c.selectExpr("conv_id", "CASE WHEN conv_id % 2 = 0 THEN '新对话' WHEN conv_id % 5 > 0 THEN 'kept' END AS title", "'junior' AS stage", "'m' AS model", "concat('u', conv_id % 3) AS owner_sid", "conv_id % 4 = 0 AS deleted", "CAST(0 AS BIGINT) AS created", "updated")


_TABLE = "s AS (SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN '新对话' WHEN conv_id % 5 > 0 THEN 'kept' END AS title, 'junior' AS stage, 'm' AS model, 'u' || conv_id % 3 AS owner_sid, conv_id % 4 = 0 AS deleted, CAST(0 AS BIGINT) AS created, max(turn) AS updated FROM conversations GROUP BY conv_id)"


@query("session_insert", f"WITH {_TABLE} SELECT * FROM s UNION ALL SELECT (SELECT max(conv_id) + 1 FROM s), '新对话', 'junior', '', 'me', false, 99, 99")
def session_insert(spark, sf):
    return history.insert_session(_sessions(spark, sf), "me", 99)


_ADDED = "SELECT conv_id, max(turn) + 1 AS turn, 'user' AS role, 'Question ' || conv_id AS text FROM conversations WHERE conv_id % 3 = 0 GROUP BY conv_id"


@query("message_append", f"""WITH {_TABLE}, n AS ({_ADDED}), c AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT * FROM n),
f AS (SELECT conv_id, coalesce(trim(replace(substr(arg_min(text, turn) FILTER (role = 'user'), 1, 18), chr(10), ' ')), '新对话') AS first, max(turn) AS last FROM c WHERE conv_id IN (SELECT conv_id FROM n) GROUP BY conv_id)
SELECT conv_id, CASE WHEN first IS NOT NULL AND (title IS NULL OR title = '新对话') THEN first ELSE title END AS title, greatest(updated, coalesce(last, updated)) AS updated FROM s LEFT JOIN f USING (conv_id)""")
def message_append(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    new = c.where("conv_id % 3 = 0").groupBy("conv_id").agg((F.max("turn") + 1).alias("turn")).selectExpr("conv_id", "turn", "'user' AS role", "concat('Question ', conv_id) AS text")
    return history.append_messages(_sessions(spark, sf), c, new)[0].select("conv_id", "title", "updated")


@query("session_meta", f"WITH {_TABLE} SELECT conv_id, CASE WHEN conv_id = 5 THEN 'senior' ELSE stage END AS stage, model FROM s")
def session_meta(spark, sf):
    return history.update_meta(_sessions(spark, sf), 5, stage="senior").select("conv_id", "stage", "model")


@query("hard_delete", "SELECT conv_id, turn FROM conversations WHERE conv_id <> 5")
def hard_delete(spark, sf):
    return history.hard_delete(table(spark, sf, "conversations"), 5).select("conv_id", "turn")


@query("live_sessions", f"WITH {_TABLE} SELECT count(*) FILTER (NOT deleted) AS live FROM s")
def live_sessions(spark, sf):
    return history.live_sessions(_sessions(spark, sf))


DIRECTIVES = {"primary": "Use everyday words.\n", "junior": "Stay within the school's book.\n", "senior": "Proofs may be asked for.\n", "university": "Anything goes.\n"}
_SAID = """l AS (SELECT conv_id, list(struct_pack(role := CASE WHEN lower(role) = 'user' THEN 'user' ELSE 'assistant' END, content := text) ORDER BY turn) AS l
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 19 AND trim(text) <> '' GROUP BY conv_id)"""


@query("request_messages", f"""WITH {_SAID}, q AS (SELECT DISTINCT conv_id, CASE conv_id % 3 WHEN 0 THEN 'senior' WHEN 1 THEN 'primary' END AS stage, CASE WHEN conv_id % 4 = 0 THEN 0.7 END AS t FROM conversations)
SELECT conv_id, CAST(coalesce(t, CASE stage WHEN 'senior' THEN 0.2 WHEN 'primary' THEN 0.1 ELSE 0.15 END) AS DOUBLE) AS temperature,
CAST(to_json(list_concat([struct_pack(role := 'system', content := 'You are a tutor.' || chr(10) || CASE stage WHEN 'senior' THEN 'Proofs may be asked for.' WHEN 'primary' THEN 'Use everyday words.' ELSE 'Stay within the school''s book.' END || chr(10) || 'Source ' || conv_id)], coalesce(l, []))) AS VARCHAR) AS messages
FROM q LEFT JOIN l USING (conv_id)""")
def request_messages(spark, sf):
    c = table(spark, sf, "conversations")
    asked = c.select("conv_id").distinct().selectExpr("conv_id", "CASE conv_id % 3 WHEN 0 THEN 'senior' WHEN 1 THEN 'primary' END AS stage", "CASE WHEN conv_id % 4 = 0 THEN 0.7D END AS temperature", "concat('Source ', conv_id) AS context")
    return history.request_messages(c, asked, "You are a tutor.", DIRECTIVES)


@query("archive_pages", "SELECT page_id, url, sha256(html) AS html_hash FROM pages")
def archive_pages(spark, sf):
    path = scratch_path(spark, "archive")
    table(spark, sf, "pages").write.json(path)
    archive.register(spark)
    lines = spark.read.format("line_archive").load(path)
    page = F.from_json("record", "page_id long, url string, html string")
    return lines.where("record != ''").select(page.alias("p")).select("p.page_id", "p.url", F.sha2("p.html", 256).alias("html_hash"))
