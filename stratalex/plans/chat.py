"""Queries over conversations and event streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalex.operators import history
from stratalex.plans.catalogue import query
from stratalex.sources.tables import table
from stratalex.streaming import events, rate_limit


@query("session_title", "SELECT conv_id, coalesce(trim(replace(substr(arg_min(text, turn) FILTER (role = 'user'), 1, 18), chr(10), ' ')), '新对话') AS title, count(*) AS messages, max(turn) AS updated FROM conversations GROUP BY conv_id")
def session_title(spark, sf):
    return history.sessions(table(spark, sf, "conversations"))


_OWNED = "SELECT conv_id, max(turn) AS updated, 'u' || conv_id % 3 AS owner_sid FROM conversations GROUP BY conv_id"


@query("session_list", f"SELECT conv_id, updated FROM (SELECT * FROM ({_OWNED}) ORDER BY updated DESC, conv_id LIMIT 20 OFFSET 20) WHERE owner_sid = 'u1'")
def session_list(spark, sf):
    s = table(spark, sf, "conversations").groupBy("conv_id").agg(F.max("turn").alias("updated")).withColumns({"owner_sid": F.concat(F.lit("u"), F.col("conv_id") % 3), "deleted": F.lit(False)})
    return history.session_page(s, "u1", 1, 20, [F.desc("updated"), F.col("conv_id")]).select("conv_id", "updated")


@query("session_messages", "SELECT conv_id, turn, role, text FROM conversations WHERE conv_id % 3 = 1")
def session_messages(spark, sf):
    c = table(spark, sf, "conversations")
    return history.messages_of(c, c.where("conv_id % 3 = 1").select("conv_id").distinct()).select("conv_id", "turn", "role", "text")


@query("last_n_history", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 2 AND trim(text) <> ''")
def last_n_history(spark, sf):
    return history.last_messages(table(spark, sf, "conversations"), 2).select("conv_id", "turn", "role")


@query("prompt_messages", """SELECT conv_id, CAST(to_json(list_concat([struct_pack(role := 'system', content := 'You are a tutor.')], list(struct_pack(role := lower(role), content := text) ORDER BY turn))) AS VARCHAR) AS messages
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 19 AND trim(text) <> '' GROUP BY conv_id""")
def prompt_messages(spark, sf):
    return history.prompt_messages(table(spark, sf, "conversations"), "You are a tutor.")


@query("last_user_content", "SELECT conv_id, arg_max(text, turn) AS content FROM conversations GROUP BY conv_id")
def last_user_content(spark, sf):
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.max_by("text", "turn").alias("content"))


@query("running_concat", "SELECT conv_id, turn, sha256(string_agg(text, '') OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)) AS full_hash FROM conversations")
def running_concat(spark, sf):
    return history.running_text(table(spark, sf, "conversations"), "conv_id", "turn", "text").select("conv_id", "turn", F.sha2("full_content", 256).alias("full_hash"))


_LINE = """CASE WHEN event_id % 17 = 0 THEN ': ping' WHEN event_id % 19 = 0 THEN 'data: bad' WHEN event_id % 301 = 0 THEN 'data: [DONE]'
 WHEN event_id % 5 = 0 THEN concat('data: {"choices":[{"delta":{"reasoning_content":"r', event_id, '","content":"c', event_id, '"}}]}')
 ELSE concat('data: {"choices":[{"delta":{"content":"', event_type, '"}}]}') END"""


@query("sse_final", f"""WITH l AS (SELECT user_id AS stream_id, event_id AS seq, {_LINE} AS line FROM events),
d AS (SELECT stream_id, seq, trim(substr(line, 7)) AS d FROM l WHERE line LIKE 'data: %'),
live AS (SELECT d.* FROM d LEFT JOIN (SELECT stream_id, min(seq) AS e FROM d WHERE d = '[DONE]' GROUP BY 1) x USING (stream_id) WHERE e IS NULL OR seq < e),
p AS (SELECT stream_id, seq, 'reasoning' AS type, CASE WHEN json_valid(d) THEN json_extract_string(d, '$.choices[0].delta.reasoning_content') END AS piece FROM live
  UNION ALL SELECT stream_id, seq, 'chunk', CASE WHEN json_valid(d) THEN json_extract_string(d, '$.choices[0].delta.content') END FROM live)
SELECT stream_id, type, string_agg(piece, '' ORDER BY seq) AS "full" FROM p WHERE piece <> '' GROUP BY stream_id, type""")
def sse_final(spark, sf):
    return events.final_texts(table(spark, sf, "events").selectExpr("user_id AS stream_id", "event_id AS seq", f"{_LINE} AS line"))


@query("sse_parse", f"""WITH l AS (SELECT user_id AS stream_id, event_id AS seq, {_LINE} AS line FROM events),
d AS (SELECT stream_id, seq, trim(substr(line, 7)) AS d FROM l WHERE line LIKE 'data: %'),
live AS (SELECT d.* FROM d LEFT JOIN (SELECT stream_id, min(seq) AS e FROM d WHERE d = '[DONE]' GROUP BY 1) x USING (stream_id) WHERE e IS NULL OR seq < e),
p AS (SELECT stream_id, seq, 'reasoning' AS type, CASE WHEN json_valid(d) THEN json_extract_string(d, '$.choices[0].delta.reasoning_content') END AS piece FROM live
  UNION ALL SELECT stream_id, seq, 'chunk', CASE WHEN json_valid(d) THEN json_extract_string(d, '$.choices[0].delta.content') END FROM live)
SELECT stream_id, seq, type, piece, string_agg(piece, '') OVER (PARTITION BY stream_id, type ORDER BY seq ROWS UNBOUNDED PRECEDING) AS "full" FROM p WHERE piece <> ''""")
def sse_parse(spark, sf):
    lines = table(spark, sf, "events").selectExpr("user_id AS stream_id", "event_id AS seq", f"{_LINE} AS line")
    return events.assemble(lines)


@query("event_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def event_json(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


_REQ = "SELECT event_id AS request_id, 'ip' || user_id % 5 AS ip, CASE event_id % 3 WHEN 0 THEN '/api/chat' WHEN 1 THEN '/api/knowledge/stats' ELSE '/index.html' END AS path, epoch_us(ts) // 1000 AS ms FROM events"


@query("rate_limit", f"""WITH RECURSIVE q AS ({_REQ}),
k AS (SELECT request_id, ms, ip || '|' || CASE WHEN path = '/api/chat' THEN 'chat' ELSE 'api' END AS key FROM q WHERE path LIKE '/api/%'),
o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ms, request_id) AS i FROM k),
r AS (SELECT key, i, request_id, ms, ms AS start, CAST(1 AS BIGINT) AS n FROM o WHERE i = 1
  UNION ALL SELECT o.key, o.i, o.request_id, o.ms, CASE WHEN r.start < o.ms - 3600000 THEN o.ms ELSE r.start END, CASE WHEN r.start < o.ms - 3600000 THEN 1 ELSE r.n + 1 END
  FROM r JOIN o ON o.key = r.key AND o.i = r.i + 1)
SELECT request_id, key, start AS window_start, n AS n_in_window, n <= CASE WHEN suffix(key, 'chat') THEN 2 ELSE 3 END AS allowed FROM r""")
def rate_limit_query(spark, sf):
    r = table(spark, sf, "events").selectExpr("event_id AS request_id", "concat('ip', user_id % 5) AS ip", "CASE event_id % 3 WHEN 0 THEN '/api/chat' WHEN 1 THEN '/api/knowledge/stats' ELSE '/index.html' END AS path", "unix_millis(CAST(ts AS TIMESTAMP)) AS ms")
    return rate_limit.limit_batch(r, 2, 3, 3_600_000)
