"""Queries over texts: enrichment, pages, formulas, chunks, embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalex.functions import embedding, enrich
from stratalex.functions import lexicons as L
from stratalex.functions import text as T
from stratalex.operators import chunking, kb
from stratalex.plans.catalogue import CHUNKS, query
from stratalex.sources.tables import chunks, table

W = f"WITH {CHUNKS} "
# Stand-in lexicons: the supplied texts have no Chinese.
LISTS = (["le ", "des"], ["the", "and"], ["der", "und", "sch"], ["ción", "para"])


def _hits(words, column="content"):
    return "(" + " + ".join(f"CAST(contains({column}, '{w}') AS INTEGER)" for w in words) + ")"


def _any(words, column):
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


_SCORES = f", s AS (SELECT chunk_id, {_hits(LISTS[0])} AS p, {_hits(LISTS[1])} AS j, {_hits(LISTS[2])} AS s, {_hits(LISTS[3])} AS u FROM chunks)"


@query("keyword_hits", W + f"SELECT chunk_id, {_hits(LISTS[1])} AS hits FROM chunks")
def keyword_hits(spark, sf):
    return chunks(spark, sf).select("chunk_id", enrich.keyword_hits(F.col("content"), LISTS[1]).alias("hits"))


@query("stage_detect", W + _SCORES + " SELECT chunk_id, CASE WHEN u > s AND u > j AND u > p THEN 'university' WHEN s > j AND s > p THEN 'senior' WHEN j > p THEN 'junior' WHEN p > 0 THEN 'primary' ELSE 'junior' END AS stage FROM s")
def stage_detect(spark, sf):
    return chunks(spark, sf).select("chunk_id", enrich.page_stage(F.col("content"), LISTS).alias("stage"))


@query("stage_detect_v2", W + ", s AS (SELECT chunk_id, " + ", ".join(f"{_hits(w)} AS {c}" for w, c in zip((L.PAGE_PRIMARY, L.PAGE_JUNIOR, L.PAGE_SENIOR, L.PAGE_UNIVERSITY), "pjsu", strict=True)) + " FROM chunks) SELECT chunk_id, CASE WHEN u > s AND u > j AND u > p THEN 'university' WHEN s > j AND s > p THEN 'senior' WHEN j > p THEN 'junior' WHEN p > 0 THEN 'primary' ELSE 'junior' END AS stage FROM s")
def stage_detect_v2(spark, sf):
    return chunks(spark, sf).select("chunk_id", enrich.page_stage(F.col("content")).alias("stage"))


_ASK = dict(proof=["thre"], geometry=["éa"], function=["ing"], calculation=["="], ask="who")


@query("question_type", W + f"SELECT chunk_id, CASE WHEN {_any(_ASK['proof'], 'l')} THEN 'proof' WHEN {_any(_ASK['geometry'], 'l')} THEN 'geometry' WHEN contains(l, 'who') AND {_any(_ASK['function'], 'l')} THEN 'function' WHEN {_any(_ASK['calculation'], 'l')} THEN 'calculation' ELSE 'general' END AS question_type FROM (SELECT chunk_id, lower(content) AS l FROM chunks)")
def question_type(spark, sf):
    return chunks(spark, sf).select("chunk_id", enrich.question_type(F.col("content"), **_ASK).alias("question_type"))


_KINDS = dict(textbook=["src1"], exam=["trash", "src2"], lecture=["schen"])
_KIND = f"CASE WHEN {_any(_KINDS['textbook'], 'l')} THEN 'textbook' WHEN {_any(_KINDS['exam'], 'l')} THEN 'exam' WHEN {_any(_KINDS['lecture'], 'l')} THEN 'lecture' ELSE 'textbook' END"


@query("source_type", W + f"SELECT chunk_id, {_KIND} AS source_type FROM (SELECT chunk_id, lower(source_file || ' ' || content) AS l FROM chunks)")
def source_type(spark, sf):
    return chunks(spark, sf).select("chunk_id", enrich.source_type(F.col("source_file"), F.col("content"), **_KINDS).alias("source_type"))


@query("chunk_weight", W + f"SELECT chunk_id, CASE {_KIND} WHEN 'textbook' THEN 1.0::DOUBLE WHEN 'exam' THEN 0.85::DOUBLE WHEN 'lecture' THEN 0.7::DOUBLE END AS weight FROM (SELECT chunk_id, lower(source_file || ' ' || content) AS l FROM chunks)")
def chunk_weight(spark, sf):
    kind = enrich.source_type(F.col("source_file"), F.col("content"), **_KINDS)
    return chunks(spark, sf).select("chunk_id", enrich.default_weight(kind, F.col("grade")).alias("weight"))


@query("knowledge_point", W + "SELECT chunk_id, CASE WHEN contains(content, 'ananre') THEN 'ananre' WHEN contains(content, 'thre') THEN 'thre' WHEN contains(content, 'eux') THEN 'eux' ELSE '综合' END AS knowledge_point FROM chunks")
def knowledge_point(spark, sf):
    return chunks(spark, sf).select("chunk_id", enrich.knowledge_point(F.col("content"), ["ananre", "thre", "eux"]).alias("knowledge_point"))


@query("file_stage", f"SELECT doc_id, CASE WHEN {_any(L.NAME_UNIVERSITY, 'n')} THEN 'university' WHEN {_any(L.NAME_SENIOR, 'n')} THEN 'senior' WHEN {_any(L.NAME_PRIMARY, 'n')} THEN 'primary' WHEN {_any(L.NAME_JUNIOR, 'n')} THEN 'junior' ELSE 'senior' END AS by_name, CASE WHEN {_any(L.PATH_UNIVERSITY, 'n')} THEN 'university' WHEN {_any(L.NAME_SENIOR, 'n')} THEN 'senior' WHEN {_any(L.NAME_PRIMARY, 'n')} THEN 'primary' WHEN {_any(L.NAME_JUNIOR, 'n')} THEN 'junior' WHEN contains(n, '数学') THEN 'senior' ELSE 'junior' END AS by_path FROM (SELECT doc_id, lower(source || CASE doc_id % 6 WHEN 0 THEN '高中' WHEN 1 THEN 'Primary' WHEN 2 THEN '图论' WHEN 3 THEN '中考' WHEN 4 THEN '数学' ELSE '' END) AS n FROM documents)")
def file_stage(spark, sf):
    name = F.concat("source", F.expr("CASE doc_id % 6 WHEN 0 THEN '高中' WHEN 1 THEN 'Primary' WHEN 2 THEN '图论' WHEN 3 THEN '中考' WHEN 4 THEN '数学' ELSE '' END"))
    return table(spark, sf, "documents").select("doc_id", enrich.stage_of_name(name).alias("by_name"), enrich.stage_of_path(name).alias("by_path"))


@query("min_length_filter", W + "SELECT chunk_id, length(trim(content)) AS n FROM chunks WHERE length(trim(content)) >= 200")
def min_length_filter(spark, sf):
    n = F.length(F.trim("content"))
    return chunks(spark, sf).where(n >= 200).select("chunk_id", n.cast("long").alias("n"))


@query("snippet", W + "SELECT chunk_id, CASE WHEN length(content) > 150 THEN substr(content, 1, 150) || '...' ELSE content END AS snippet FROM chunks")
def snippet(spark, sf):
    return chunks(spark, sf).select("chunk_id", T.snippet(F.col("content")).alias("snippet"))


@query("truncate_text", W + "SELECT chunk_id, CASE WHEN length(content) > 5000 THEN substr(content, 1, 5000) || chr(10) || '...[truncated]' ELSE content END AS t FROM chunks")
def truncate_text(spark, sf):
    return chunks(spark, sf).select("chunk_id", T.truncated(F.col("content"), 5000).alias("t"))


_FORMULA = r"replace(content, ' the ', ' \frac{1}{2} and $x$ <i>b</i> ')"


def _with_formulas(spark, sf):
    return chunks(spark, sf).withColumn("content", F.replace("content", F.lit(" the "), F.lit(r" \frac{1}{2} and $x$ <i>b</i> ")))


@query("latex_detect", W + r"SELECT chunk_id, regexp_matches(" + _FORMULA + r", '(?i)(^|[^$])\\(" + T.LATEX + r")\b') AS has_latex FROM chunks")
def latex_detect(spark, sf):
    return _with_formulas(spark, sf).select("chunk_id", T.has_latex(F.col("content")).alias("has_latex"))


@query("latex_wrap")
def latex_wrap(spark, sf):
    return _with_formulas(spark, sf).select("chunk_id", T.wrap_latex("content").alias("content"))


@query("strip_html", r"SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', '', 'g'), '&lt;/?[a-zA-Z][^&]*&gt;', '', 'g'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS text FROM pages")
def strip_html(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.strip_tags(F.col("html")).alias("text"))


@query("whitespace_normalise", W + r"SELECT chunk_id, regexp_replace(regexp_replace(replace(content, '. ', chr(10) || chr(10) || chr(10) || chr(10) || chr(10) || '  '), '\n{4,}', chr(10) || chr(10) || chr(10), 'g'), '[ \t]+', ' ', 'g') AS t FROM chunks")
def whitespace_normalise(spark, sf):
    return chunks(spark, sf).select("chunk_id", T.squeeze(F.replace("content", F.lit(". "), F.lit("\n\n\n\n\n  "))).alias("t"))


_LINES = r"""
, l AS (SELECT chunk_id, i, len(a) AS n, regexp_replace(a[i], '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g') AS x
  FROM (SELECT chunk_id, a, unnest(range(1, len(a) + 1)) AS i FROM (SELECT chunk_id, string_split(regexp_replace(coalesce(content, ''), '\n+$', ''), chr(10)) AS a FROM chunks))),
k AS (SELECT * FROM l WHERE x <> '' AND NOT regexp_matches(x, '^\d{1,4}$')
  AND NOT (i - 1 < n * 0.08 AND length(x) < 30 AND NOT contains(x, '.') AND NOT regexp_matches(x, '第.*[章节]$'))
  AND NOT (i - 1 > n * 0.92 AND length(x) < 30 AND NOT regexp_matches(x, '\d.*[解证明答]$'))
  AND NOT regexp_matches(x, 'ISBN|版权所有|翻印|侵权必究'))
SELECT c.chunk_id, coalesce(string_agg(k.x, chr(10) ORDER BY k.i), '') AS t FROM chunks c LEFT JOIN k ON k.chunk_id = c.chunk_id GROUP BY c.chunk_id"""


@query("page_line_clean", W + _LINES)
def page_line_clean(spark, sf):
    return chunks(spark, sf).select("chunk_id", T.clean_page(F.col("content")).alias("t"))


def _pages(spark, sf):
    return table(spark, sf, "documents").select(F.col("source").alias("file_name"), F.expr("CAST(doc_id AS INT)").alias("page_num"), F.col("text").alias("content"))


@query("scan_detect", "SELECT file_name, count(*) FILTER (length(trim(content)) < 200) = count(*) AS is_scanned, count(*) AS pages_checked FROM (SELECT source AS file_name, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS p, text AS content FROM documents) WHERE p <= 3 GROUP BY file_name")
def scan_detect(spark, sf):
    from pyspark.sql import Window

    pages = _pages(spark, sf).withColumn("page_num", F.row_number().over(Window.partitionBy("file_name").orderBy("page_num")))
    return kb.scanned_files(pages, 3, 200)


@query("full_text_join", """SELECT file_name, page_num, CAST(coalesce(sum(length(content) + 2) OVER (PARTITION BY file_name ORDER BY page_num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_char,
CAST(length(content) + 2 AS BIGINT) AS n_chars, sha256(content || chr(10) || chr(10)) AS text_hash
FROM (SELECT source AS file_name, CAST(doc_id AS INTEGER) AS page_num, coalesce(text, '') AS content FROM documents)""")
def full_text_join(spark, sf):
    return kb.full_text(_pages(spark, sf)).select("file_name", "page_num", "start_char", "n_chars", F.sha2("part", 256).alias("text_hash"))


def _chunked(spark, sf):
    d = table(spark, sf, "documents")
    # a blank line after each line, and chapter openings, as the texts have neither
    t = F.regexp_replace(F.replace("text", F.lit("\n"), F.lit("\n\n")), r"(?m)^([A-Z]\w{4}\b)", r"Chapter 3 $1")
    return chunking.chunk(d.select(F.col("doc_id").cast("string").alias("source"), t.alias("text")), "source", "text")


# sections and chunks as folds over the parts of a text
_CHUNKED = r"""
WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS source_file, regexp_replace(replace(text, chr(10), chr(10) || chr(10)), '(?m)^([A-Z][A-Za-z0-9_]{4})([^\p{L}\p{N}\p{Mn}_]|$)', 'Chapter 3 \1\2', 'g') AS t FROM documents),
p AS (SELECT source_file, string_split(regexp_replace(coalesce(t, ''), '(?m)^((?:第[一二三四五六七八九十\d]+[章节]|Chapter\s*\d+|§\d+)\s*.*)$', chr(1) || '\1' || chr(1), 'g'), chr(1)) AS p FROM d),
e AS (SELECT source_file, list_prepend(p[1], list_transform(range(1, greatest(1, list_max(list_prepend(1, list_transform(range(1, (len(p) + 1) // 2 + 1), lambda i: CASE WHEN p[2 * i - 1] <> '' THEN i ELSE 1 END))))), lambda i: p[2 * i] || chr(10) || p[2 * i + 1])) AS e FROM p),
f AS (SELECT source_file, list_reduce(list_prepend({'done': CAST([] AS VARCHAR[]), 'cur': ''}, list_transform(e, lambda x: {'done': CAST([] AS VARCHAR[]), 'cur': x})),
  lambda a, x: CASE WHEN length(a.cur || x.cur) >= 1200 THEN {'done': list_append(a.done, a.cur || x.cur), 'cur': ''} ELSE {'done': a.done, 'cur': a.cur || x.cur} END) AS f FROM e),
s AS (SELECT source_file, i, regexp_replace(x, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g') AS section FROM (
  SELECT source_file, unnest(l) AS x, unnest(range(1, len(l) + 1)) AS i FROM (SELECT source_file, CASE WHEN f.cur <> '' OR len(f.done) = 0 THEN list_append(f.done, f.cur) ELSE f.done END AS l FROM f))),
m AS (SELECT source_file, i, section, regexp_extract_all(section, '\$\$[\s\S]*?\$\$') AS formulas, string_split(regexp_replace(section, '\$\$[\s\S]*?\$\$', chr(2), 'g'), chr(2)) AS b FROM s),
q AS (SELECT source_file, i, section, formulas, list_filter(list_transform(string_split(list_reduce(list_transform(range(1, len(b) + 1), lambda k: CASE WHEN k = 1 THEN b[k] ELSE '%%FORMULA_' || (k - 2) || '%%' || b[k] END), lambda x, y: x || y), chr(10) || chr(10)),
  lambda x: regexp_replace(x, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')), lambda x: x <> '') AS paras FROM m),
k AS (SELECT source_file, i, section, formulas, list_reduce(list_prepend({'done': CAST([] AS VARCHAR[]), 'cur': ''}, list_transform(paras, lambda x: {'done': CAST([] AS VARCHAR[]), 'cur': x})),
  lambda a, x: CASE WHEN a.cur <> '' AND length(a.cur) + length(x.cur) > 600 THEN {'done': list_append(a.done, a.cur), 'cur': x.cur}
    ELSE {'done': a.done, 'cur': CASE WHEN a.cur <> '' THEN a.cur || chr(10) || chr(10) || x.cur ELSE x.cur END} END) AS k FROM q),
c AS (SELECT source_file, i, section, unnest(l) AS c, unnest(range(1, len(l) + 1)) AS j, len(l) AS n, formulas FROM (
  SELECT source_file, i, section, formulas, CASE WHEN k.cur <> '' THEN list_append(k.done, k.cur) ELSE CASE WHEN len(k.done) > 0 THEN k.done ELSE [section] END END AS l FROM k)),
w AS (SELECT source_file, i, j, n, section, regexp_replace(list_reduce(list_prepend(c, list_transform(range(1, len(formulas) + 1), lambda z: '%%FORMULA_' || (z - 1) || '%%' || chr(3) || formulas[z])), lambda a, x: replace(a, string_split(x, chr(3))[1], string_split(x, chr(3))[2])), '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g') AS content FROM c),
kept AS (SELECT *, CAST(row_number() OVER (PARTITION BY source_file ORDER BY i, j) - 1 AS INTEGER) AS ordinal FROM w WHERE length(content) >= 20)"""
_OFFSETS = r""",
base AS (SELECT source_file, i, CAST(coalesce(sum(length(section) + 2) OVER (PARTITION BY source_file ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS base FROM s),
o AS (SELECT source_file, i, list(ordinal ORDER BY j) AS ordinals, list_reduce(list_prepend({'off': [CAST(0 AS BIGINT)], 'len': CAST(0 AS BIGINT), 'last': false}, list({'off': CAST([] AS BIGINT[]), 'len': CAST(length(content) AS BIGINT), 'last': j = n} ORDER BY j)),
  lambda a, x: {'off': list_append(a.off, CASE WHEN x.last THEN a.off[-1] + greatest(0, x.len - 100) ELSE least(a.off[-1] + greatest(0, x.len - 100), x.len) END), 'len': x.len, 'last': x.last}) AS o FROM kept GROUP BY source_file, i),
x AS (SELECT source_file, i, unnest(ordinals) AS ordinal, unnest(o.off[:-2]) AS off FROM o)
SELECT x.source_file, x.ordinal, CAST(base + off AS INTEGER) AS start_char, CAST(base + off + length(content) AS INTEGER) AS end_char
FROM x JOIN base USING (source_file, i) JOIN kept ON kept.source_file = x.source_file AND kept.ordinal = x.ordinal"""


@query("chunk_pack", _CHUNKED + " SELECT source_file, ordinal, content, substr(sha256(source_file || '|' || ordinal || '|' || content), 1, 16) AS chunk_id FROM kept")
def chunk_pack(spark, sf):
    return _chunked(spark, sf).select("source_file", "ordinal", "content", "chunk_id")


@query("chunk_offsets", _CHUNKED + _OFFSETS)
def chunk_offsets(spark, sf):
    return _chunked(spark, sf).select("source_file", "ordinal", "start_char", "end_char")


def _hits(words, text: str = "content") -> str:
    return f"len(list_filter({list(words)!r}, lambda w: contains({text}, w)))"


# metadata of the chunks by the word lists
_DESCRIBED = rf""",
n AS (SELECT source_file, ordinal, content, lower(content) AS low, lower(source_file || ' ' || content) AS named,
  regexp_replace(regexp_extract(section, '(?m)^(?:第[一二三四五六七八九十\d]+[章节]|Chapter\s*\d+|§\d+)\s*.*$'), '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g') AS chapter,
  regexp_replace(string_split(section, chr(10))[1], '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g') AS line,
  {_hits(L.PAGE_PRIMARY)} AS a, {_hits(L.PAGE_JUNIOR)} AS b, {_hits(L.PAGE_SENIOR)} AS c, {_hits(L.PAGE_UNIVERSITY)} AS d,
  list_filter({[*L.CHUNK_JUNIOR, *L.CHUNK_SENIOR]!r}, lambda w: contains(content, w)) AS topics, len(regexp_extract_all(content, '\$\$[\s\S]*?\$\$')) AS blocks FROM kept),
k2 AS (SELECT *, CASE WHEN d > c AND d > b AND d > a THEN 'university' WHEN c > b AND c > a THEN 'senior' WHEN b > a THEN 'junior' WHEN a > 0 THEN 'primary' ELSE 'junior' END AS stage,
  CASE WHEN {_hits(L.TEXTBOOK, 'named')} > 0 THEN 'textbook' WHEN {_hits(L.EXAM, 'named')} > 0 THEN 'exam' WHEN {_hits(L.LECTURE, 'named')} > 0 THEN 'lecture' ELSE 'textbook' END AS source_type FROM n)
SELECT source_file, ordinal, CASE WHEN chapter <> '' THEN chapter WHEN length(line) < 50 THEN line ELSE '' END AS chapter_title, stage, coalesce(topics[1], '综合') AS knowledge_point,
  CASE WHEN {_hits(L.PROOF, 'low')} > 0 THEN 'proof' WHEN {_hits(L.GEOMETRY, 'low')} > 0 THEN 'geometry' WHEN contains(low, '求') AND {_hits(L.FUNCTION, 'low')} > 0 THEN 'function'
    WHEN {_hits(L.CALCULATION, 'low')} > 0 THEN 'calculation' ELSE 'general' END AS question_type,
  source_type, CASE source_type WHEN 'textbook' THEN 1.0::DOUBLE WHEN 'exam' THEN 0.85::DOUBLE WHEN 'lecture' THEN 0.7::DOUBLE END AS weight,
  blocks > 0 OR regexp_matches(content, '(?i)(^|[^$])\\({T.LATEX})\b') AS has_formula, CAST(blocks AS INTEGER) AS formula_count
FROM k2"""


@query("chapter_split", _CHUNKED + _DESCRIBED)
def chapter_split(spark, sf):
    return _chunked(spark, sf).select("source_file", "ordinal", "chapter_title", "stage", "knowledge_point", "question_type", "source_type", "weight", "has_formula", "formula_count")


EMBED = r"""
WITH d AS (SELECT doc_id, regexp_replace(lower(text), '[ \t\n\x0b\f\r]+', ' ', 'g') AS t FROM documents),
c AS (SELECT doc_id, list_transform(string_split(t, ''), lambda x: CAST(unicode(x) AS BIGINT)) AS c, t FROM d),
g AS (
  SELECT doc_id, (c[i] * 31 + c[i + 1]) % 256 AS s, 1.0 AS w FROM (SELECT doc_id, c, unnest(range(1, len(c))) AS i FROM c)
  UNION ALL SELECT doc_id, (c[i] * 961 + c[i + 1] * 31 + c[i + 2]) % 256, 1.0 FROM (SELECT doc_id, c, unnest(range(1, len(c) - 1)) AS i FROM c)
  UNION ALL SELECT doc_id, abs(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END % 256), 2.0 FROM (
    SELECT doc_id, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(w, ''), lambda x: CAST(unicode(x) AS BIGINT))), lambda a, x: (a * 31 + x) & 4294967295) AS h
    FROM (SELECT doc_id, unnest(regexp_split_to_array(t, '[\s，。；：！？、()\[\]{}]+')) AS w FROM d) WHERE length(w) >= 2)),
v AS (SELECT doc_id, s, sum(w) AS w FROM g GROUP BY doc_id, s)
SELECT doc_id, CAST(s AS INTEGER) AS dim, round(CAST(CAST(CAST(w AS DOUBLE) / sqrt(CAST(sum(w * w) OVER (PARTITION BY doc_id) AS DOUBLE)) AS FLOAT) AS DOUBLE), 5) AS weight FROM v"""


@query("local_embedding", EMBED)
def local_embedding(spark, sf):
    v = table(spark, sf, "documents").select("doc_id", F.posexplode(embedding.embed_local("text")).alias("dim", "w")).where("w != 0")
    return v.select("doc_id", "dim", F.round(F.col("w").cast("double"), 5).alias("weight"))
