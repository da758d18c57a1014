"""Groups of spelling variants: words one edit apart, by an even-partition pigeonhole join.

A word of l code points is cut into two segments, the first l // 2 code points and the rest.
One edit leaves one of the two whole, so a word and its neighbour of equal or one-longer length
share a segment: the first at the start, the second at the end, where a longer word has it
shifted by one.  Words are indexed by (length, segment, piece); each word probes the pieces
of its own length and of the length below.  What the join meets is compared inside the join,
so only pairs that are one edit apart leave it, and a pair that shares both segments is taken
at the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalex.llm.common import Scratch, lower_ascii, written

LEAST_LENGTH, LEAST_COUNT, TIMES = 6, 5, 5
#: One in so many runs loses a code point before words are counted.
DAMAGED = 199


def damaged_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH) -> DataFrame:
    """word: a row for each run of letters with at least ``least_length`` code points, some with one code point deleted.

    A run's hash with its document decides, so all its places in a document fare alike.  A
    null id counts as an empty one, a null text has no runs.
    """
    # a run as long as this is never cut by the pattern, as it takes all letters that follow
    runs = F.regexp_extract_all(F.col(text_col), F.lit(f"[A-Za-zÀ-ÿ]{{{least_length},}}"), F.lit(0))
    each = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("d"), F.explode(runs).alias("w")).select("d", lower_ascii(F.col("w")).alias("w"))
    each = each.select("w", F.crc32(F.concat("d", F.lit(":"), "w").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("w")).cast("int")
    shorter = F.concat(F.substring("w", F.lit(1), at), F.substring("w", at + 2, F.length("w")))
    return each.select(F.when(F.col("h") % DAMAGED == 0, shorter).otherwise(F.col("w")).alias("word")).where(F.length("word") >= least_length)


def counted(words: DataFrame, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n of the words that occur often enough; counts are summed up before the shuffle."""
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _pieces(word: Column, length: Column) -> Column:
    """The pieces that a word has in common with a word of ``length`` code points at the same start or end."""
    half = F.floor(length / 2).cast("int")
    return F.array(
        F.struct(length.alias("l"), F.lit(1).alias("s"), F.substring(word, F.lit(1), half).alias("piece")),
        F.struct(length.alias("l"), F.lit(2).alias("s"), F.substring(word, F.length(word) - (length - half) + 1, length - half).alias("piece")),
    )


def near_pairs(words: DataFrame) -> DataFrame:
    """a, n_a, b, n_b: each pair of distinct words that are one edit apart, once."""
    length = F.length("word")
    index = words.select(F.col("word").alias("a"), F.col("n").alias("n_a"), F.explode(_pieces(F.col("word"), length)).alias("k")).select("a", "n_a", "k.*")
    probes = words.select(F.col("word").alias("b"), F.col("n").alias("n_b"), F.explode(F.concat(_pieces(F.col("word"), length), _pieces(F.col("word"), length - 1))).alias("k"))
    probes = probes.select("b", "n_b", "k.*").where("l > 0")
    half = F.floor(F.col("l") / 2).cast("int")
    once = (F.col("s") == 1) | (F.substring("a", F.lit(1), half) != F.substring("b", F.lit(1), half))
    each_way = (F.length("b") > F.col("l")) | (F.col("a") < F.col("b"))
    met = index.join(probes, ["l", "s", "piece"]).where(each_way & once & (F.levenshtein("a", "b", 1) == 1))
    return met.select("a", "n_a", "b", "n_b")


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """word, root for the words of ``forms`` (word, form): where following forms ends.

    A form is ``TIMES`` as frequent as its word at least, so there are no circles and a chain
    has few links; each round doubles the links that a word has behind it.
    """
    now = scratch.written(forms.select("word", F.col("form").alias("root")), "links")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        now = scratch.written(now.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "links")
        moved = now.where("_moved").limit(1).count()
        now = now.drop("_moved")
        if not moved:
            return now


def variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near, form_n for each row of ``words`` (word, n; each word once).

    ``form`` is the near word of largest n (ties: the smallest in code-point order) if it is
    at least ``times`` as frequent, else null; ``root`` is where following forms ends, the
    word itself if it has none.  An empty table gives no rows; other columns are ignored.
    """
    with Scratch(words.sparkSession, "variants") as scratch:
        words = scratch.written(words.select("word", "n"), "words")
        pairs = scratch.written(near_pairs(words), "pairs")
        ways = pairs.select(F.col("a").alias("word"), F.col("b").alias("_w"), F.col("n_b").alias("_n"))
        ways = ways.unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("_w"), F.col("n_a").alias("_n")))
        best = ways.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("_n")).alias("less"), F.col("_w").alias("w"))).alias("_best"))
        known = words.join(best, "word", "left")
        chosen = -F.col("_best.less") >= times * F.col("n")
        known = known.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(chosen, F.col("_best.w")).alias("form"), F.when(chosen, -F.col("_best.less")).alias("form_n"))
        known = scratch.written(known, "known")
        ends = roots(known.where("form IS NOT NULL"), scratch)
        out = known.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
        return written(out, "variants")
