"""Benchmark decontamination by winnowing, with DataFrame functions only.

Both sides hash every run of GRAM words and keep, in every SPAN consecutive hashes, the
smallest: the mark of that window of WINDOW = GRAM + SPAN - 1 words.  A shared window has the
same mark on both sides, so none is missed.  The places of windows whose mark an item has too
are kept; the windows there are then cut out and compared with the items' windows, whole
texts of windows and not hashes, which extends the hits and drops chance matches.  Each step
takes time in proportion to a text's words, whatever it shares with the benchmark.  Items of fewer words than a
window are one window of all their words, and its hash is its mark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalex.llm.common import lower_ascii, written

#: A word: digits, lower-case letters and everything beyond ASCII.  All other characters stand
#: in the class one by one, for Java looks those up in a table; of ranges it tries each in turn.
WORD = "[^" + "".join(rf"\x{c:02X}" for c in range(128) if not (0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A)) + "]+"
WINDOW, GRAM = 10, 6
SPAN = WINDOW - GRAM + 1
#: Bytes of what the benchmark gives to a join, about, up to which it is broadcast; beyond, a
#: shuffle join takes its place.
MOST_BROADCAST = 1 << 24


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def _grams(hashes: Column, k: int) -> Column:
    """Hash of every run of ``k`` words."""
    empty = F.array().cast("array<bigint>")
    gram = lambda i: F.xxhash64(F.lit(k), *[F.get(hashes, i + j) for j in range(k)])
    return F.when(F.size(hashes) >= k, F.transform(F.sequence(F.lit(0), F.size(hashes) - k), gram)).otherwise(empty)


def _window_marks(hashes: Column, k: int) -> Column:
    """The mark of every window of ``k`` words, from the hashes of a text's words."""
    if k < WINDOW:
        return _grams(hashes, k)
    least = lambda g: F.transform(F.sequence(F.lit(1), F.size(g) - SPAN + 1), lambda i: F.array_min(F.slice(g, i, SPAN)))
    return F.when(F.size(hashes) >= WINDOW, _let(_grams(hashes, GRAM), least)).otherwise(F.array().cast("array<bigint>"))


def _hashed(words: Column) -> Column:
    return F.transform(words, lambda x: F.xxhash64(x))


def _marks(words: Column, k: int) -> Column:
    """array of struct(size, at, mark) for the windows of ``k`` words."""
    return F.transform(_let(_hashed(words), lambda h: _window_marks(h, k)), lambda m, i: F.struct(F.lit(k).alias("size"), i.alias("at"), m.alias("mark")))


def _with_words(words: Column, x: Column) -> Column:
    return F.concat_ws(" ", F.slice(words, x["at"] + 1, x["size"]))


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id (string), size, mark, words: the windows of each item, each once."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item_id"), words_of(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    windows = _marks(F.col("w"), WINDOW)
    for k in range(WINDOW - 1, 0, -1):
        windows = F.when(F.size("w") == k, _marks(F.col("w"), k)).otherwise(windows)
    each = items.select("item_id", "w", F.explode(windows).alias("x"))
    return each.select("item_id", "x.size", "x.mark", _with_words(F.col("w"), F.col("x")).alias("words")).distinct()


def _joined(rows: DataFrame, few: DataFrame, on: str, bytes_: int) -> DataFrame:
    return rows.join(F.broadcast(few) if bytes_ <= MOST_BROADCAST else few.hint("merge"), on)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """For each document: id, _k, n_words, n_hit, n_items, items_sha256, contaminated.

    ``_k`` is a hash of the text that tells rows apart which repeat an id.  Null texts have
    no words; items without words never match; items with a null id mark words but are not
    counted.  Repeated rows get equal results; empty tables give no rows or no hits.
    """
    items = written(benchmark_windows(benchmark, item_col, item_text), "windows")
    bench = written(items.groupBy("words").agg(F.first("size").alias("size"), F.first("mark").alias("mark")), "bench")
    marks = written(bench.select("mark").distinct(), "marks")
    n_marks, mark_bytes = marks.count(), 24
    window_bytes = bench.agg(F.coalesce(F.sum(F.octet_length("words") + 48), F.lit(0))).first()[0]
    sizes = sorted({WINDOW, *(r[0] for r in bench.select("size").distinct().collect())})  # WINDOW of them at most

    text = F.coalesce(F.col(text_col), F.lit(""))
    keys = ["_id", "_k"]

    def prepared(words: Column) -> Column:
        return F.struct(F.size(words).cast("long").alias("n"), F.concat(*[_marks(words, k) for k in sizes]).alias("marks"))

    base = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_k"), _let(words_of(F.col(text_col)), prepared).alias("_p"))
    # a null mark stands for the document itself, so that one scan gives both
    none = F.array(F.struct(F.lit(0).alias("size"), F.lit(0).alias("at"), F.lit(None).cast("bigint").alias("mark")))
    rows = base.select(*keys, F.col("_p.n").alias("n"), F.explode(F.concat("_p.marks", none)).alias("x")).select(*keys, "n", "x.size", "x.at", "x.mark")
    if n_marks * mark_bytes <= MOST_BROADCAST:
        rows = rows.join(F.broadcast(marks.withColumn("_met", F.lit(True))), "mark", "left").where("mark IS NULL OR _met").drop("_met")
    else:
        rows = rows.where("mark IS NULL").unionByName(rows.where("mark IS NOT NULL").join(marks.hint("merge"), "mark"))
    rows = written(rows, "hits")
    each, met = rows.where("mark IS NULL").select(*keys, "n"), rows.where("mark IS NOT NULL")
    met = met.groupBy(*keys).agg(F.collect_set(F.struct("size", "at")).alias("met"))  # no more than the text has windows

    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.xxhash64(text).alias("_k"))
    both = own.alias("o").join(met.alias("f"), (F.col("o._k") == F.col("f._k")) & F.col("o._id").eqNullSafe(F.col("f._id")))
    cut = lambda w: F.transform("met", lambda x: F.struct(x["at"].alias("at"), x["size"].alias("size"), _with_words(w, x).alias("words")))
    found = both.select("o._id", "o._k", _let(words_of(F.col("_text")), cut).alias("w"))
    found = found.select(*keys, F.explode("w").alias("x")).select(*keys, "x.at", "x.size", "x.words")
    hits = written(_joined(found, bench.select("words", F.col("size").alias("_size")), "words", window_bytes).where("size = _size").drop("_size"), "found")

    places = hits.groupBy(*keys).agg(F.collect_set(F.struct("at", "size")).alias("at"))  # no more than the text has words, for each size
    covered = F.array_distinct(F.flatten(F.transform("at", lambda x: F.sequence(x["at"], x["at"] + x["size"] - 1))))
    places = places.select(*keys, F.size(covered).cast("long").alias("n_hit"))
    item_bytes = items.agg(F.coalesce(F.sum(F.octet_length("words") + F.coalesce(F.octet_length("item_id"), F.lit(0)) + 48), F.lit(0))).first()[0]
    named = _joined(hits.select(*keys, "words").distinct(), items.select("words", "item_id"), "words", item_bytes)
    ids = named.where("item_id IS NOT NULL").select(*keys, "item_id").distinct().groupBy(*keys).agg(F.array_sort(F.collect_list("item_id")).alias("item_ids"))
    same = lambda x, y: (F.col(f"{x}._k") == F.col(f"{y}._k")) & F.col(f"{x}._id").eqNullSafe(F.col(f"{y}._id"))
    result = places.alias("p").join(ids.alias("i"), same("p", "i"), "left").select("p._id", "p._k", "n_hit", "item_ids")
    out = each.alias("e").join(result.alias("r"), same("e", "r"), "left")
    return out.select(
        F.col("e._id").alias(id_col),
        F.col("e._k").alias("_k"),
        F.col("n").alias("n_words"),
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.concat_ws(",", "item_ids"), F.lit("")), 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that hold a window of the benchmark."""
    bad = contamination(docs, benchmark, id_col, text_col).where("contaminated").select(F.col(id_col).alias("_bad_id"), F.col("_k").alias("_bad_k")).distinct()
    key = F.xxhash64(F.coalesce(docs[text_col], F.lit("")))
    # columns of one side each, so that no name of the caller's is mistaken
    return docs.join(bad, (key == bad["_bad_k"]) & docs[id_col].eqNullSafe(bad["_bad_id"]), "left_anti")
