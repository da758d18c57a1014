"""The queries of this folder and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalex.llm import (
    conversation_repair, decontaminate, exact_dedup, html_content, license_scan, near_dedup, packing, sharding, spelling_variants, substring_dedup, token_store, toxicity, url_filter,
)
from stratalex.llm.common import table

VOCABULARY = "byte_bpe_50k.json"
RULES = tuple(
    url_filter.Rule(*r.split())
    for r in ("block com/en/", "allow example.com/en/7", "allow net/de/", "block example.net/de/8", "block org/es/")
)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.judge(pages, RULES, url_filter.fit(url_filter.weak_labels(pages)))


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.store_digest(spark, table(spark, sf_dir, "documents"), VOCABULARY, end_id=2)


def op3_html_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_content.extract(table(spark, sf_dir, "pages"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("_k")


OP5 = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, k, array_to_string(list_slice(w, s, s + k - 1), ' ') AS g
  FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM i WHERE len(w) > 0)),
dw AS (
  SELECT r, s, k, array_to_string(list_slice(w, s, s + k - 1), ' ') AS g
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, (SELECT DISTINCT k FROM iw) WHERE len(w) >= k)),
hit AS (SELECT dw.r, dw.s, dw.k, iw.item_id FROM dw JOIN iw ON dw.k = iw.k AND dw.g = iw.g),
n AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + k)) AS p FROM (SELECT DISTINCT r, s, k FROM hit)) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items,
       sha256(coalesce(t.ids, '')) AS items_sha256, n.n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN n ON n.r = d.r LEFT JOIN t ON t.r = d.r
"""


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


OP6 = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("kept_text")


OP7 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT r, doc_id, s, md5(array_to_string(list_slice(w, s, s + 19), ' ')) AS g
  FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d WHERE len(w) >= 20)),
f AS (SELECT g, min(doc_id) AS first_doc FROM win GROUP BY g),
l AS (SELECT g, r, min(s) AS first_start FROM win GROUP BY g, r),
gone AS (
  SELECT DISTINCT r, unnest(range(s, s + 20)) AS p
  FROM win JOIN f USING (g) JOIN l USING (g, r) WHERE first_doc < doc_id OR first_start < s),
kept AS (
  SELECT w.r, string_agg(w.x, ' ' ORDER BY w.p) AS t
  FROM (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d) w ANTI JOIN gone ON gone.r = w.r AND gone.p = w.p GROUP BY w.r),
n AS (SELECT r, count(*) AS n FROM gone GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n.n, 0) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN n ON n.r = d.r LEFT JOIN kept ON kept.r = d.r
"""


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents")).drop("_h")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(table(spark, sf_dir, "documents"), VOCABULARY, end_id=0)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign_shards(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", F.col("_slot").alias("slot"), F.col("_shard").alias("shard_id"))


def _op10() -> str:
    owners = ", ".join(map(str, sharding.lookup_table()))
    return f"""
WITH placed AS (
  SELECT doc_id, CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) % {sharding.SLOTS} AS INTEGER) AS slot
  FROM documents),
owners AS (SELECT unnest(range({sharding.SLOTS})) AS slot, unnest([{owners}]) AS shard_id)
SELECT p.doc_id, p.slot, CAST(o.shard_id AS INTEGER) AS shard_id FROM placed p JOIN owners o ON o.slot = p.slot
"""


LOWERED = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _crc32(text: str) -> str:
    """SQL for the unsigned CRC-32 of a text's bytes, bit by bit."""
    bits = f"flatten(list_transform(range(strlen({text})), lambda i: [CAST('0x' || substr(hex({text}), 2 * i + 1, 2) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))"
    step = "lambda c, x: xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1))"
    return f"xor(list_reduce({bits}, {step}, 4294967295), 4294967295)"


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.report_damaged(table(spark, sf_dir, "conversations"))


# from the last row to the first, for each of the states before a row (nothing, s, u, a) the
# cheapest rest: cost, audit and lines
OP11 = f"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32("(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS h
  FROM conversations),
d AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN h = 1 THEN '' WHEN h = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN h = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM c WHERE h <> 0),
o AS (
  SELECT conv_id, turn, role, text, count(*) OVER (PARTITION BY conv_id) AS n, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS seen,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth
  FROM d),
f AS (
  SELECT *, CASE WHEN seen = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(seen, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    left(role, 1) AS k, left(role, 1) || left(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1) AS back
  FROM o),
walk AS (
  SELECT conv_id, n AS i, [{{'cost': 0, 'audit': '', 'lines': CAST([] AS VARCHAR[])}}, {{'cost': 10, 'audit': 'II', 'lines': ['user:', 'assistant:']}},
    {{'cost': 5, 'audit': 'I', 'lines': ['assistant:']}}, {{'cost': 0, 'audit': '', 'lines': CAST([] AS VARCHAR[])}}] AS s
  FROM (SELECT DISTINCT conv_id, n FROM f)
  UNION ALL
  SELECT conv_id, i - 1, list_transform([1, 2, 3, 4], lambda q: list_min([b[q],
    {{'cost': 5 + b[CASE q WHEN 3 THEN 4 ELSE 3 END].cost, 'audit': 'I' || b[CASE q WHEN 3 THEN 4 ELSE 3 END].audit, 'lines': list_prepend(CASE q WHEN 3 THEN 'assistant:' ELSE 'user:' END, b[CASE q WHEN 3 THEN 4 ELSE 3 END].lines)}},
    {{'cost': 10 + b[CASE q WHEN 3 THEN 3 ELSE 4 END].cost, 'audit': 'II' || b[CASE q WHEN 3 THEN 3 ELSE 4 END].audit,
      'lines': list_concat(CASE q WHEN 3 THEN ['assistant:', 'user:'] ELSE ['user:', 'assistant:'] END, b[CASE q WHEN 3 THEN 3 ELSE 4 END].lines)}}]))
  FROM (
    SELECT w.conv_id, w.i, list_transform([1, 2, 3, 4], lambda q: list_min(list_filter([
      {{'cost': 2 + s[q].cost, 'audit': 'D' || s[q].audit, 'lines': s[q].lines}},
      CASE WHEN fault NOT IN ('blank', 'duplicate') AND (k = 's' AND q = 1 OR k = 'u' AND q <> 3 OR k = 'a' AND q = 3) THEN
        {{'cost': CASE fault WHEN 'truncated' THEN 5 ELSE 0 END + s[CASE k WHEN 's' THEN 2 WHEN 'u' THEN 3 ELSE 4 END].cost, 'audit': 'K' || s[CASE k WHEN 's' THEN 2 WHEN 'u' THEN 3 ELSE 4 END].audit,
          'lines': list_prepend(role || ':' || text, s[CASE k WHEN 's' THEN 2 WHEN 'u' THEN 3 ELSE 4 END].lines)}} END,
      CASE WHEN fault NOT IN ('blank', 'duplicate') THEN
        {{'cost': 1 + CASE fault WHEN 'truncated' THEN 5 ELSE 0 END + s[CASE q WHEN 3 THEN 4 ELSE 3 END].cost, 'audit': 'R' || s[CASE q WHEN 3 THEN 4 ELSE 3 END].audit,
          'lines': list_prepend(CASE q WHEN 3 THEN 'assistant:' ELSE 'user:' END || text, s[CASE q WHEN 3 THEN 4 ELSE 3 END].lines)}} END], lambda x: x IS NOT NULL))) AS b
    FROM walk w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i)),
t AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (i > 1 AND back NOT IN ('us', 'au', 'ua')) AS illegal
  FROM f GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(s[1].cost, 0) AS BIGINT) AS cost, coalesce(s[1].audit, '') AS audit, sha256(coalesce(array_to_string(s[1].lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) e LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN walk w ON w.conv_id IS NOT DISTINCT FROM e.conv_id AND w.i = 0
"""


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling_variants.counted(spelling_variants.damaged_words(table(spark, sf_dir, "documents")))
    return spelling_variants.variants(words)


OP12 = f"""
WITH RECURSIVE x AS (SELECT doc_id, {LOWERED.format("r")} AS w, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) AS r FROM documents) GROUP BY ALL),
h AS (SELECT w, c, {_crc32("(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w)")} AS h FROM x),
v AS (
  SELECT word, CAST(sum(c) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 199 = 0 THEN left(w, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, c FROM h)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
e AS (SELECT word, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)),
p AS (
  SELECT a.word AS a, b.word AS b FROM e a JOIN e b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT e.word, v.word FROM e JOIN v ON v.word = e.rest UNION SELECT v.word, e.word FROM e JOIN v ON v.word = e.rest),
q AS (SELECT a, v.word AS b, v.n AS n, row_number() OVER (PARTITION BY a ORDER BY v.n DESC, v.word) AS k, count(*) OVER (PARTITION BY a) AS n_near FROM p JOIN v ON v.word = p.b),
m AS (SELECT v.word, v.n, coalesce(q.n_near, 0) AS n_near, CASE WHEN q.n >= 5 * v.n THEN q.b END AS form, CASE WHEN q.n >= 5 * v.n THEN q.n END AS form_n FROM v LEFT JOIN q ON q.a = v.word AND q.k = 1),
g AS (SELECT word, word AS root FROM m UNION ALL SELECT g.word, m.form FROM g JOIN m ON m.word = g.root WHERE m.form IS NOT NULL)
SELECT m.word, m.form, g.root, m.n, CAST(m.n_near AS BIGINT) AS n_near, m.form_n FROM m JOIN g USING (word) JOIN m z ON z.word = g.root WHERE z.form IS NULL
"""


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def _op13() -> str:
    stride = max(len(t.words.split()) for t in license_scan.TEMPLATES)
    rows = ", ".join(f"('{t.label}', '{t.words}', {t.share}, {t.phrase}, {t.base})" for t in license_scan.TEMPLATES)
    return rf"""
WITH t AS (SELECT label, string_split(words, ' ') AS x, list_distinct(string_split(words, ' ')) AS u, share, phrase, base FROM (VALUES {rows}) v(label, words, share, phrase, base)),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWERED.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
y AS (SELECT r, s, x, label, base FROM (SELECT r, unnest(w) AS first, unnest(range(len(w))) AS s FROM d) JOIN t ON phrase AND first = x[1]),
p AS (SELECT r, label, base, s FROM y JOIN d USING (r) WHERE list_slice(w, s + 1, s + len(x)) = x),
b AS (SELECT r, list_distinct(list_slice(w, s + 1, s + {2 * stride})) AS u FROM (SELECT r, w, unnest(range(0, len(w), {stride})) AS s FROM d)),
o AS (SELECT r, label, len(list_intersect(b.u, t.u)) AS k, len(t.u) AS n, share FROM b, t WHERE NOT phrase),
f AS (
  SELECT r, label, base, s, 1.0::DOUBLE AS share FROM p
  UNION ALL SELECT r, label, false, NULL, k::DOUBLE / n FROM o WHERE k >= ceil(n * share - 1e-9)),
g AS (
  SELECT r, count(*) FILTER (base) AS n_base, min(s) FILTER (base) AS first_word, max(s) FILTER (base) AS last_word, max(share) AS score,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM f GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0::DOUBLE) AS score
FROM d LEFT JOIN g USING (r)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_filter": op1_url_filter,
        "op2_token_store": op2_token_store,
        "op3_html_content": op3_html_content,
        "op4_toxicity": op4_toxicity,
        "op5_decontaminate": op5_decontaminate,
        "op6_exact_dedup": op6_exact_dedup,
        "op7_substring_dedup": op7_substring_dedup,
        "op8_near_dedup": op8_near_dedup,
        "op9_best_fit_packing": op9_best_fit_packing,
        "op10_sharding": op10_sharding,
        "op11_conversation_repair": op11_conversation_repair,
        "op12_spelling_variants": op12_spelling_variants,
        "op13_license_scan": op13_license_scan,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_decontaminate": OP5, "op6_exact_dedup": OP6, "op7_substring_dedup": OP7, "op10_sharding": _op10(), "op11_conversation_repair": OP11, "op12_spelling_variants": OP12, "op13_license_scan": _op13()}
