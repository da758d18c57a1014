"""Hybrid retrieval: BM25 and exact nearest neighbours, fused by reciprocal rank.

A search scans the store twice: once for the few corpus figures that BM25 needs (one row
comes back), once for the scores.  Term counts are taken inside each row, so nothing is
exploded or shuffled, and the top lists are bounded.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalex.functions import enrich
from stratalex.functions import text as T
from stratalex.functions.segment import HAN, tokens
from stratalex.sources.scratch import written

K1, B, RRF_K = 1.2, 0.75, 60
BM25_TOP, KNN_TOP = 100, 200


def words_of(rows: DataFrame, field: str) -> Column:
    """The terms of a field: those of its text, or the list itself where a segmenter has cut it."""
    return F.col(field) if rows.schema[field].dataType.typeName() == "array" else tokens(F.col(field))


def postings(rows: DataFrame, id_col: str, text_col: str, in_order: bool = False) -> DataFrame:
    """term, id, tf, dl: the inverted index as a table, for many queries at once; ``in_order`` by term and id.

    In order, a row counts its own terms and Spark merges neighbours, so a task holds no table of what it has met.
    """
    words = rows.select(F.col(id_col).alias("id"), words_of(rows, text_col).alias("w"))
    if in_order:
        dealt = _counted(words).repartitionByRange("term", "id").sortWithinPartitions("term", "id")
        # a struct can't be updated in a hash table, so this is an aggregate over sorted rows
        summed = dealt.groupBy("term", "id").agg(F.sum("tf").alias("tf"), F.first(F.struct("dl")).alias("dl"))
        return summed.select("term", "id", "tf", "dl.dl")
    # not the plain explode: for that Spark infers a filter by size, which cuts each text a second time
    each = words.select("id", F.size("w").alias("dl"), F.posexplode_outer("w").alias("_place", "term")).where("_place is not null")
    return each.groupBy("term", "id").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def _counted(words: DataFrame) -> DataFrame:
    """id, dl, term, tf: a row for each different word of the lists ``w``; sorted, equal words stand together."""
    each = words.select("id", F.size("w").alias("dl"), F.sort_array("w").alias("w"))
    each = each.withColumn("ends", F.expr("filter(if(dl > 0, sequence(1, dl), array()), i -> i = dl OR NOT get(w, i) <=> get(w, i - 1))"))
    runs = each.select("id", "dl", F.expr("transform(ends, (e, k) -> struct(get(w, e - 1) AS term, e - coalesce(get(ends, k - 1), 0) AS tf))").alias("runs"))
    return runs.select("id", "dl", F.inline_outer("runs")).where("tf is not null")


def write_index(rows: DataFrame, id_col: str, fields: Sequence[str], path: str) -> None:
    """The postings of ``fields`` in order of (field, term), and the figures of each field.

    A query then reads only the row groups that its terms are in, however large the store.
    """
    every = reduce(DataFrame.unionByName, [postings(rows, id_col, f, in_order=True).withColumn("field", F.lit(f)) for f in fields])
    every.write.parquet(f"{path}/postings")
    lengths = [rows.select(F.lit(f).alias("field"), F.size(words_of(rows, f)).alias("dl")) for f in fields]
    reduce(DataFrame.unionByName, lengths).groupBy("field").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).write.parquet(f"{path}/figures")


def search_index(spark: SparkSession, path: str, terms: Sequence[str], fields: dict[str, float]) -> DataFrame:
    """id, bm25 of what has a term, from a written index."""
    wanted = [t.lower() for t in terms]
    hits = spark.read.parquet(f"{path}/postings").where(F.col("term").isin(wanted) & F.col("field").isin(list(fields)))
    boosts = spark.createDataFrame(list(fields.items()), "field string, boost double")
    known = hits.groupBy("field", "term").agg(F.count("*").alias("df")).join(spark.read.parquet(f"{path}/figures"), "field").join(boosts, "field")
    norm = K1 * (1 - B + B * F.col("dl") / F.when(F.col("avgdl") > 0, F.col("avgdl")).otherwise(1.0))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    scored = hits.join(F.broadcast(known), ["field", "term"])  # a row for each term and field of the query
    return scored.groupBy("id").agg(F.sum(F.col("boost") * idf * F.col("tf") / (F.col("tf") + norm)).alias("bm25"))


def bm25(rows: DataFrame, terms: Sequence[str], fields: dict[str, float], where: Column | None = None) -> DataFrame:
    """``rows`` that have a term, without the text fields, with ``bm25``; the corpus figures count all rows.

    The texts are read once: counts and lengths are written, and read for figures and scores.
    """
    terms = [t.lower() for t in terms]
    made = rows
    for f in fields:
        made = made.withColumn(f"_t_{f}", _spaced(F.col(f)))
        made = made.withColumns({f"_dl_{f}": _length(F.col(f"_t_{f}")), f"_tf_{f}": F.array(*[_times(F.col(f"_t_{f}"), t) for t in terms])}).drop(f"_t_{f}")
    made = made.drop(*fields)
    if not terms:
        return made.withColumn("bm25", F.lit(0.0)).where(F.lit(False)).drop(*[f"_{k}_{f}" for f in fields for k in ("dl", "tf")])
    made = written(made, "term-counts")
    figures = [F.count("*").alias("n")]
    for f in fields:
        figures.append(F.avg(f"_dl_{f}").alias(f"avg_{f}"))
        figures += [F.count_if(F.get(f"_tf_{f}", i) > 0).alias(f"df_{f}_{i}") for i in range(len(terms))]
    g = made.agg(*figures).first()
    score = F.lit(0.0)
    for f, boost in fields.items():
        norm = K1 * (1 - B + B * F.col(f"_dl_{f}") / F.lit(g[f"avg_{f}"] or 1.0))
        for i in range(len(terms)):
            df, tf = g[f"df_{f}_{i}"], F.get(f"_tf_{f}", i)
            score = score + boost * F.log(F.lit(1 + (g["n"] - df + 0.5) / (df + 0.5))) * tf / (tf + norm)
    scored = made.withColumn("bm25", score).drop(*[f"_{k}_{f}" for f in fields for k in ("dl", "tf")])
    scored = scored.where("bm25 > 0")
    return scored.where(where) if where is not None else scored


def _spaced(text: Column) -> Column:
    """The words of a text in lower case, a space between them; the same words as ``tokens``."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.when(F.coalesce(F.rlike(text, F.lit(HAN)), F.lit(False)), F.array_join(tokens(text), " ")).otherwise(plain)


def _length(spaced: Column) -> Column:
    spaces = F.octet_length(spaced) - F.octet_length(F.replace(spaced, F.lit(" "), F.lit("")))
    return F.when(spaced == "", 0).otherwise(spaces + 1)


def _times(spaced: Column, term: str) -> Column:
    """How often the words have a term, each between two spaces of its own; bytes are counted, as their number is known."""
    apart = F.concat(F.lit(" "), F.replace(spaced, F.lit(" "), F.lit("  ")), F.lit(" "))
    less = F.octet_length(apart) - F.octet_length(F.replace(apart, F.lit(f" {term} "), F.lit("")))
    return F.floor(less / (len(term.encode()) + 2)).cast("int") if term else F.lit(0)


def cosine(vector: Column, query: Sequence[float]) -> Column:
    q = F.array(*[F.lit(float(x)) for x in query])
    dot = F.aggregate(F.zip_with(vector, q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda a, x: a + x)
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    own = sum(float(x) ** 2 for x in query) ** 0.5
    return F.when((norm > 0) & F.lit(own > 0), dot / (norm * own)).otherwise(0.0)


def knn(rows: DataFrame, query: Sequence[float], k: int = KNN_TOP, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k most similar rows, exactly: a scan with a heap of k rows in each task."""
    return rows.withColumn("cos", cosine(F.col(vector), query)).orderBy(F.desc("cos"), id_col).limit(k)


def ranked(rows: DataFrame, score: str, id_col: str) -> DataFrame:
    """Adds the rank in a bounded list."""
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), id_col)))


def fuse(text_list: DataFrame, vector_list: DataFrame, id_col: str = "id") -> DataFrame:
    """id, rrf (1 for the first of both lists), first_seen; both lists have id and rank.

    The best possible sum always counts the text list, and the vector list if it has rows.
    """
    slots = 1 if vector_list.isEmpty() else 2
    both = text_list.select(id_col, "rank", F.col("rank").alias("seen")).unionByName(vector_list.select(id_col, "rank", (F.col("rank") + 1_000_000).alias("seen")))
    return both.groupBy(id_col).agg((F.sum(1.0 / (RRF_K + F.col("rank"))) / (slots / (RRF_K + 1))).alias("rrf"), F.min("seen").alias("first_seen"))


def search(chunks: DataFrame, vectors: DataFrame, terms: Sequence[str], query: Sequence[float], stage: str | None, extend: bool = False, k: int = 5, prefilter: bool = False, by_text: DataFrame | None = None) -> DataFrame:
    """The k best chunks: both lists, fused and cut, then weighted by grade and chunk.

    ``by_text`` is the text list (id, bm25) where an index has given it; else the chunks are read for it.

    The stage filter narrows the text list before it is cut and the vector list after
    (``prefilter`` moves it ahead); weights don't change the order.
    """
    chosen = enrich.in_stage(F.col("grade"), stage, extend)
    if by_text is None:
        by_text = bm25(chunks, terms, {"content": 1.0, "chapter_title": 2.0}, chosen).select(F.col("chunk_id").alias("id"), "bm25").orderBy(F.desc("bm25"), "id").limit(BM25_TOP)
    by_text = ranked(by_text, "bm25", "id")
    pool = vectors.join(chunks.where(chosen).select(F.col("chunk_id").alias("vec_id")), "vec_id", "left_semi") if prefilter else vectors
    near = knn(pool, query).select(F.col("vec_id").alias("id"), "cos")
    if not prefilter:
        near = near.join(chunks.where(chosen).select(F.col("chunk_id").alias("id")), "id", "left_semi")
    near = ranked(near, "cos", "id")
    top = fuse(by_text, near).orderBy(F.desc("rrf"), "first_seen").limit(min(max(k, 1), 20))
    top = top.withColumn("position", F.row_number().over(Window.orderBy(F.desc("rrf"), "first_seen")))
    found = chunks.join(F.broadcast(top.withColumnRenamed("id", "chunk_id")), "chunk_id")  # at most 20 rows
    return found.select(
        "position", "chunk_id", "source_file", "grade", F.coalesce("chapter_title", F.lit("")).alias("chapter_title"),
        (F.col("rrf") * enrich.result_weight(F.col("grade"), F.col("weight"))).alias("score"), T.snippet(F.col("content")).alias("snippet"),
    )
