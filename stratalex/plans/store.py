"""Queries over the chunk store."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalex.functions import enrich, urls
from stratalex.functions import text as T
from stratalex.operators import kb
from stratalex.plans.catalogue import CHUNKS, query
from stratalex.sources.scratch import scratch_path
from stratalex.sources.tables import PROVIDERS, STAGES, chunks, providers, stages, table

W = f"WITH {CHUNKS} "


@query("kb_size", W + "SELECT count(*) AS n FROM chunks")
def kb_size(spark, sf):
    return chunks(spark, sf).agg(F.count("*").alias("n"))


@query("kb_distinct_sources", W + "SELECT count(DISTINCT source_file) AS n FROM chunks")
def kb_distinct_sources(spark, sf):
    return chunks(spark, sf).agg(F.count_distinct("source_file").alias("n"))


@query("kb_sources", W + "SELECT DISTINCT source_file FROM chunks ORDER BY 1")
def kb_sources(spark, sf):
    return chunks(spark, sf).select("source_file").distinct().orderBy("source_file")


@query("kb_count_by_grade", W + "SELECT grade, count(*) AS n FROM chunks GROUP BY grade")
def kb_count_by_grade(spark, sf):
    return kb.count_by_grade(chunks(spark, sf))


@query("kb_total_chars", W + "SELECT CAST(sum(length(content)) AS BIGINT) AS total_chars FROM chunks")
def kb_total_chars(spark, sf):
    return chunks(spark, sf).agg(F.sum(F.length("content")).cast("long").alias("total_chars"))


@query("kb_stats", W + "SELECT count(DISTINCT source_file) AS total_documents, count(*) AS total_chunks, CAST(sum(length(content)) AS BIGINT) AS total_chars, count(*) FILTER (grade = 'junior') AS junior_count, count(*) FILTER (grade = 'senior') AS senior_count FROM chunks")
def kb_stats(spark, sf):
    return kb.stats(chunks(spark, sf))


_BLOCKS = r"len(regexp_extract_all(content, '\$\$[\s\S]*?\$\$'))"


@query("formula_blocks", W + f"SELECT chunk_id, CAST({_BLOCKS} AS INTEGER) AS n_blocks FROM chunks")
def formula_blocks(spark, sf):
    return chunks(spark, sf).select("chunk_id", T.formula_blocks(F.col("content")).alias("n_blocks"))


_LATEX = r"regexp_matches(content, '(?i)(^|[^$])\\(" + T.LATEX + r")\b')"


@query("formula_stats", W + f", s AS (SELECT {_BLOCKS} AS n, {_LATEX} AS l FROM chunks) SELECT count(*) AS total, count(*) FILTER (n > 0 OR l) AS with_formula, CAST(sum(n) AS BIGINT) AS blocks, round(count(*) FILTER (n > 0 OR l) / count(*) * 100, 1) AS ratio_pct FROM s")
def formula_stats(spark, sf):
    return kb.formula_stats(chunks(spark, sf))


# the texts have no LaTeX commands, so nothing is rewritten
@query("restandardise_report", W + r"SELECT count(*) AS total, CAST(0 AS BIGINT) AS modified, count(*) FILTER (regexp_matches(content, '\$\$[\s\S]*?\$\$')) AS with_formulas, CAST(sum(len(regexp_extract_all(content, '\$\$[\s\S]*?\$\$'))) AS BIGINT) AS blocks_after FROM chunks")
def restandardise_report(spark, sf):
    return kb.restandardise_report(chunks(spark, sf))


@query("content_hash", W + "SELECT chunk_id, sha256(content) AS content_hash FROM chunks")
def content_hash(spark, sf):
    return chunks(spark, sf).select("chunk_id", T.content_hash(F.col("content")).alias("content_hash"))


@query("dedup_keep_first", W + "SELECT min(chunk_id) AS chunk_id, sha256(content) AS content_hash FROM chunks GROUP BY sha256(content)")
def dedup_keep_first(spark, sf):
    return kb.keep_first(chunks(spark, sf), "content", "chunk_id").select("chunk_id", "content_hash")


@query("upsert_last_wins", W + ", r AS (SELECT *, CASE WHEN chunk_id % 3 = 0 THEN 1 ELSE 0 END AS n FROM chunks) SELECT chunk_id, source_file, sha256(content) AS content_hash FROM (SELECT *, row_number() OVER (PARTITION BY sha256(content) ORDER BY n DESC, chunk_id DESC) AS k FROM r) WHERE k = 1")
def upsert_last_wins(spark, sf):
    c = chunks(spark, sf)
    return kb.upsert(c.where("chunk_id % 3 != 0"), c.where("chunk_id % 3 = 0"), "content", "chunk_id").select("chunk_id", "source_file", "content_hash")


@query("merge_store", W + ", r AS (SELECT *, CASE WHEN chunk_id % 50 = 0 THEN 1 ELSE 0 END AS n FROM chunks) SELECT chunk_id, source_file, content_hash, substr(content_hash, 1, 2) AS prefix FROM (SELECT *, sha256(content) AS content_hash, row_number() OVER (PARTITION BY sha256(content) ORDER BY n DESC, chunk_id DESC) AS k FROM r) WHERE k = 1")
def merge_store(spark, sf):
    c, path = chunks(spark, sf), scratch_path(spark, "store")
    old = c.where("chunk_id % 50 != 0")
    kb.write_store(kb.upsert(old.limit(0), old, "content", "chunk_id").drop("content_hash"), "content", path)
    kb.merge_into(path, c.where("chunk_id % 50 = 0"), "content", "chunk_id")
    return kb.read_store(spark, path).select("chunk_id", "source_file", "content_hash", "prefix")


@query("char_delta", W + "SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS added_chars, count(*) AS added_chunks FROM (SELECT DISTINCT content, length(content) AS n FROM chunks WHERE chunk_id % 3 = 0 AND content NOT IN (SELECT content FROM chunks WHERE chunk_id % 3 <> 0))")
def char_delta(spark, sf):
    c = chunks(spark, sf)
    return kb.char_delta(c.where("chunk_id % 3 != 0"), c.where("chunk_id % 3 = 0"), "content")


@query("content_length_of", W + ", h AS (SELECT DISTINCT sha256(content) AS content_hash FROM chunks), k AS (SELECT DISTINCT sha256(content) AS content_hash, length(content) AS n FROM chunks WHERE grade = 'junior') SELECT h.content_hash, CAST(coalesce(k.n, 0) AS INTEGER) AS stored_length FROM h LEFT JOIN k USING (content_hash)")
def content_length_of(spark, sf):
    c = chunks(spark, sf)
    return kb.content_length_of(c.where("grade = 'junior'"), c.select(T.content_hash(F.col("content")).alias("content_hash")).distinct(), "content")


@query("delete_by_source", W + "SELECT chunk_id, source_file FROM chunks WHERE source_file <> 'src3'")
def delete_by_source(spark, sf):
    return kb.delete_by_source(chunks(spark, sf), "src3").select("chunk_id", "source_file")


@query("remove_document", W + "SELECT chunk_id, source_file AS path FROM chunks WHERE NOT suffix(source_file, '7')")
def remove_document(spark, sf):
    return kb.forget_path(chunks(spark, sf).select("chunk_id", F.col("source_file").alias("path")), "7")


@query("point_lookup", W + "SELECT chunk_id, source_file, grade FROM chunks WHERE chunk_id = 17")
def point_lookup(spark, sf):
    return chunks(spark, sf).where("chunk_id = 17").select("chunk_id", "source_file", "grade")


@query("stage_filter", W + "SELECT chunk_id, grade FROM chunks WHERE grade IN ('primary', 'junior', 'senior')")
def stage_filter(spark, sf):
    return chunks(spark, sf).where(enrich.in_stage(F.col("grade"), "senior")).select("chunk_id", "grade")


@query("stage_filter_extend", W + "SELECT chunk_id, grade FROM chunks WHERE grade IN ('primary', 'junior', 'university')")
def stage_filter_extend(spark, sf):
    return chunks(spark, sf).where(enrich.in_stage(F.col("grade"), "junior", True)).select("chunk_id", "grade")


@query("enhance_query", W + "SELECT chunk_id, CASE grade WHEN 'primary' THEN '小学 ' || chapter_title WHEN 'junior' THEN '初中 课内 ' || chapter_title || ' 中考考点' WHEN 'senior' THEN '高中 ' || chapter_title || ' 高考考点' ELSE chapter_title END AS query FROM chunks")
def enhance_query(spark, sf):
    return chunks(spark, sf).select("chunk_id", enrich.enhance_query(F.col("chapter_title"), F.col("grade")).alias("query"))


_VALUES = ", ".join(f"('{s}', {o}, {t}::DOUBLE, '{label}')" for s, o, t, label in STAGES)


@query("stage_lookup", W + f", s(stage, o, temperature, label) AS (VALUES {_VALUES}) SELECT chunk_id, label, temperature, CAST(o AS INTEGER) AS stage_order FROM chunks JOIN s ON s.stage = chunks.grade")
def stage_lookup(spark, sf):
    return chunks(spark, sf).join(F.broadcast(stages(spark)), F.col("grade") == F.col("stage")).select("chunk_id", "label", "temperature", "stage_order")


_MODELS = ", ".join(f"({i}, '{code}', '{name}', '{url}', {models.split()!r})" for i, (code, name, url, models) in enumerate(PROVIDERS))


# every session has one of the models, told by its number
@query("provider_dimension", f"""WITH p AS (SELECT * FROM (VALUES {_MODELS}) v(position, provider, provider_name, base_url, models)),
m AS (SELECT *, unnest(models) AS model FROM p), n AS (SELECT model, row_number() OVER (ORDER BY position, list_position(models, model)) - 1 AS i FROM m),
s AS (SELECT model, count(*) AS sessions FROM (SELECT DISTINCT conv_id FROM conversations) c JOIN n ON n.i = c.conv_id % (SELECT count(*) FROM n) GROUP BY model)
SELECT CAST(position AS BIGINT) AS position, provider, provider_name, base_url, base_url || '/chat/completions' AS endpoint, array_to_string(models, ' ') AS models, CAST(coalesce(sum(sessions), 0) AS BIGINT) AS sessions
FROM m LEFT JOIN s USING (model) GROUP BY position, provider, provider_name, base_url, models""")
def provider_dimension(spark, sf):
    offered = providers(spark)
    names = [m for *_, models in PROVIDERS for m in models.split()]
    sessions = table(spark, sf, "conversations").select("conv_id").distinct().select(F.get(F.array(*map(F.lit, names)), (F.col("conv_id") % len(names)).cast("int")).alias("model"))
    used = sessions.groupBy("model").agg(F.count("*").alias("sessions"))
    met = offered.select("*", F.explode("model_options.value").alias("model")).join(used, "model", "left").groupBy("provider").agg(F.coalesce(F.sum("sessions"), F.lit(0)).alias("sessions"))
    told = offered.join(met, "provider")
    return told.select("position", "provider", "provider_name", "base_url", urls.completions_url(F.col("base_url")).alias("endpoint"), F.array_join("model_options.value", " ").alias("models"), "sessions")


_FILES = """f AS (SELECT DISTINCT source AS path, source || '.pdf' AS name, CAST(length(source) AS BIGINT) AS size FROM documents),
p AS (SELECT path FROM f WHERE length(path) % 2 = 0 OR suffix(path, '1')), x AS (SELECT name FROM f WHERE suffix(path, '1'))"""


def _files(spark, sf):
    f = table(spark, sf, "documents").select(F.col("source").alias("path")).distinct().withColumns({"name": F.concat("path", F.lit(".pdf")), "size": F.length("path").cast("long")})
    return f, f.where("length(path) % 2 = 0 OR endswith(path, '1')").select("path"), f.where("endswith(path, '1')").select("name")


@query("incremental_files", f"WITH {_FILES} SELECT path, name, size, false AS retry FROM f WHERE path NOT IN (SELECT path FROM p) UNION ALL SELECT path, name, size, true FROM f WHERE path IN (SELECT path FROM p) AND name IN (SELECT name FROM x)")
def incremental_files(spark, sf):
    return kb.files_to_process(*_files(spark, sf)).select("path", "name", "size", "retry")


_UPLOADS = """u(name, size) AS (SELECT 'd' || doc_id || '.pdf', n_chars % 7 FROM documents UNION ALL SELECT 'd' || doc_id || '_1700000000' || lpad(CAST(doc_id % 1000 AS VARCHAR), 3, '0') || '.pdf', n_chars % 7 + doc_id % 2 FROM documents)"""


@query("duplicate_uploads", f"WITH {_UPLOADS} SELECT s.name, s.size FROM u s WHERE regexp_matches(s.name, '_\\d{{13}}\\.pdf$') AND EXISTS (SELECT 1 FROM u b WHERE b.name = regexp_replace(s.name, '_\\d{{13}}\\.pdf$', '.pdf') AND b.size = s.size)")
def duplicate_uploads(spark, sf):
    d = table(spark, sf, "documents")
    u = d.selectExpr("concat('d', doc_id, '.pdf') AS name", "n_chars % 7 AS size").unionByName(d.selectExpr("concat('d', doc_id, '_1700000000', lpad(doc_id % 1000, 3, '0'), '.pdf') AS name", "n_chars % 7 + doc_id % 2 AS size"))
    return kb.duplicate_uploads(u).select("name", "size")


@query("result_counts", "WITH r AS (SELECT n_chars % 3 - 1 AS n FROM documents) SELECT count(*) FILTER (n > 0) AS indexed, count(*) FILTER (n = 0) AS skipped, count(*) FILTER (n < 0) AS failed FROM r")
def result_counts(spark, sf):
    return kb.result_counts(table(spark, sf, "documents").selectExpr("n_chars % 3 - 1 AS chunks"))


@query("failed_files", "SELECT count(*) AS n_failed FROM (SELECT DISTINCT source FROM documents WHERE suffix(source, '1'))")
def failed_files(spark, sf):
    return _files(spark, sf)[2].agg(F.count("*").alias("n_failed"))


@query("progress_pct", "SELECT doc_id, CAST(CASE WHEN doc_id % 7 = 0 THEN 0 ELSE trunc((doc_id % 5) / (doc_id % 7) * 100) END AS INTEGER) AS pct FROM documents")
def progress_pct(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.progress(F.col("doc_id") % 5, F.nullif(F.col("doc_id") % 7, F.lit(0))).alias("p"), (F.col("doc_id") % 7).alias("t")).select("doc_id", F.when(F.col("t") == 0, 0).otherwise(F.col("p")).cast("int").alias("pct"))


@query("crawl_log_tail", "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 10")
def crawl_log_tail(spark, sf):
    return table(spark, sf, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(10).select("event_id", "event_type")


@query("soft_delete", "SELECT conv_id, 'u' || conv_id % 3 AS owner_sid, (conv_id = 4 AND conv_id % 3 = 1) AS deleted FROM (SELECT DISTINCT conv_id FROM conversations)")
def soft_delete(spark, sf):
    from stratalex.operators import history

    return history.soft_delete(_sessions(spark, sf), 4, "u1").select("conv_id", "owner_sid", "deleted")


@query("rename_session", "SELECT conv_id, CASE WHEN conv_id = 4 AND conv_id % 3 = 1 THEN 'new' ELSE 'old' END AS title FROM (SELECT DISTINCT conv_id FROM conversations)")
def rename_session(spark, sf):
    from stratalex.operators import history

    return history.rename(_sessions(spark, sf), 4, "u1", "new").select("conv_id", "title")


def _sessions(spark, sf):
    return table(spark, sf, "conversations").select("conv_id").distinct().selectExpr("conv_id", "concat('u', conv_id % 3) AS owner_sid", "false AS deleted", "'old' AS title")
