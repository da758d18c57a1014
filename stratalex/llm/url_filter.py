"""URL filter: host and path rules first, gradient-boosted trees on lexical features else.

Everything is DataFrame functions and the JVM's tree learner; no Python runs on executors.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalex.llm.common import lower_ascii, written

#: Labelled URLs that the trees are fitted on, about; a hash picks them.
TRAIN_ROWS = 20_000
#: Bytes of suffix statistics, about, up to which they are broadcast; more are joined by a shuffle.
MOST_BROADCAST = 1 << 24
#: Weight of the overall rate in a suffix's smoothed rate.
SMOOTHING = 20.0
#: Lengths of the suffixes of a host that have statistics, in labels.
SUFFIXES = (1, 2)
#: Parts of the labelled hosts; rows to fit on get the suffix statistics of the other parts.
FOLDS = 5
#: Rules are tried in one expression; more of them are refused.
MOST_RULES = 1_000

#: Seed terms of weak labels: a URL whose host has one is labelled block. (Fixed values.)
SEED_TERMS = ("casino", "pills", "bets", "spam", "adult", "ads", "porn", "viagra", "poker", "warez", "escort", "lottery")


@dataclass(frozen=True)
class Rule:
    verdict: str
    pattern: str  # host, then the start of the path

    @property
    def host(self) -> str:
        return self.pattern.partition("/")[0].lower()

    @property
    def path(self) -> str:
        return self.pattern[len(self.host) :]


def host_of(url: Column) -> Column:
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise("")
    return lower_ascii(F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise("")
    return F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """struct(pattern, verdict) of the longest rule that fits, or null."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    out = F.lit(None).cast("struct<pattern:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.pattern), r.pattern)):
        fits = ((host == r.host) | F.endswith(host, F.lit(f".{r.host}"))) & F.startswith(path, F.lit(r.path))
        out = F.when(fits, F.struct(F.lit(r.pattern).alias("pattern"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def _count(text: Column, part: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("double")


def _entropy(text: Column) -> Column:
    n = F.length(text).cast("double")
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    bits = F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0), lambda a, c: a - F.when(F.length(c) > 0, share(c) * F.log2(share(c))).otherwise(0.0))
    return F.when(n > 0, bits).otherwise(0.0)


def suffix_of(host: Column, labels: int) -> Column:
    """The last labels of a host."""
    return F.substring_index(host, ".", -labels)


def fold_of(host: Column) -> Column:
    return F.pmod(F.xxhash64(host, F.lit(23)), F.lit(FOLDS)).cast("int")


def with_features(urls: DataFrame, host: str, path: str, url: str) -> DataFrame:
    """Adds the lexical features of a URL as columns ``f_...``."""
    u, h, p = F.coalesce(F.col(url), F.lit("")), F.col(host), F.col(path)
    length = F.greatest(F.length(u), F.lit(1)).cast("double")
    made = {
        "f_length": F.length(u).cast("double"),
        "f_host_length": F.length(h).cast("double"),
        "f_path_length": F.length(p).cast("double"),
        "f_depth": _count(p, "/"),
        "f_labels": _count(h, "."),
        "f_longest_label": F.array_max(F.transform(F.split(h, r"\."), lambda x: F.length(x))).cast("double"),
        "f_hyphens": _count(h, "-"),
        "f_digit_ratio": F.length(F.regexp_replace(u, "[^0-9]", "")) / length,
        "f_host_digits": F.length(F.regexp_replace(h, "[^0-9]", "")).cast("double"),
        "f_symbol_ratio": F.length(F.regexp_replace(u, "[A-Za-z0-9]", "")) / length,
        "f_vowel_ratio": F.length(F.regexp_replace(h, "[^aeiou]", "")) / F.greatest(F.length(h), F.lit(1)).cast("double"),
        "f_entropy": _entropy(u),
        "f_host_entropy": _entropy(h),
        "f_params": _count(u, "&") + _count(u, "?"),
        "f_fragment": F.contains(u, F.lit("#")).cast("double"),
        "f_https": F.startswith(u, F.lit("https")).cast("double"),
    }
    return urls.withColumns(made)


@dataclass(frozen=True)
class UrlModel:
    """Fitted trees, and the suffix statistics of all labelled URLs."""

    model: GBTClassificationModel | None
    suffixes: DataFrame  # labels, suffix, URLs to block, URLs, and both for each fold
    rate: float
    names: tuple[str, ...]
    small: bool  # whether the suffixes can be broadcast

    def score(self, urls: DataFrame, host: str, path: str, url: str) -> DataFrame:
        """Adds ``f_...`` features and ``_block``: 1.0 to block, 0.0 to allow."""
        if self.model is None:
            return urls.withColumn("_block", F.lit(float(self.rate >= 0.5)))
        rows = _with_suffix(with_features(urls, host, path, url), host, self.suffixes, self.rate, self.small)
        rows = VectorAssembler(inputCols=list(self.names), outputCol="_features").transform(rows)
        return self.model.transform(rows).withColumn("_block", F.col("_prediction"))


def _suffix_counts(known: DataFrame) -> DataFrame:
    """_labels, _suffix, _y (labels summed up), _n (URLs), _folds (both for each fold)."""
    host = host_of(F.col("_url"))
    kinds = F.array(*[F.struct(F.lit(k).alias("k"), suffix_of(host, k).alias("s")) for k in SUFFIXES])
    rows = known.select(fold_of(host).alias("fold"), "_label", F.explode(kinds).alias("x")).select("fold", "_label", F.col("x.k").alias("_labels"), F.col("x.s").alias("_suffix"))
    rows = rows.groupBy("_labels", "_suffix", "fold").agg(F.sum("_label").alias("y"), F.count("*").cast("double").alias("n"))
    folds = F.map_from_entries(F.collect_list(F.struct("fold", F.struct("y", "n"))))  # FOLDS at most
    return rows.groupBy("_labels", "_suffix").agg(F.sum("y").alias("_y"), F.sum("n").alias("_n"), folds.alias("_folds"))


def _with_suffix(rows: DataFrame, host: str, suffixes: DataFrame, rate: float, small: bool, out_of_fold: bool = False) -> DataFrame:
    """Adds the statistics of the host's suffixes; a frequent one is split by AQE in a shuffle join.

    Out of fold they leave out the URLs of the row's own fold, so that what is fitted on
    them does not learn from a row's own label.
    """
    for k in SUFFIXES:
        of = suffixes.where(F.col("_labels") == k).drop("_labels")
        rows = rows.join(F.broadcast(of) if small else of.hint("merge"), suffix_of(F.col(host), k) == F.col("_suffix"), "left")
        own = F.col("_folds")[fold_of(F.col(host))]
        less = (lambda c: F.coalesce(own[c], F.lit(0.0))) if out_of_fold else (lambda c: F.lit(0.0))
        y, n = (F.coalesce(F.col(f"_{c}"), F.lit(0.0)) - less(c) for c in ("y", "n"))
        rows = rows.withColumns({f"f_suffix_rate_{k}": (y + SMOOTHING * rate) / (n + SMOOTHING), f"f_suffix_seen_{k}": F.log1p(n)}).drop("_suffix", "_y", "_n", "_folds")
    return rows


def fit(labelled: DataFrame, url: str = "url", label: str = "label", rows: int = TRAIN_ROWS) -> UrlModel:
    """Suffix statistics of all distinct labelled URLs, and trees fitted on about ``rows`` of them.

    ``label`` is 1 to block, 0 to allow; rows without a URL or a label are left out.  With
    one class only, or no rows, the model gives that class.
    """
    known = labelled.select(F.col(url).alias("_url"), F.col(label).cast("double").alias("_label")).where("_url IS NOT NULL AND _label IS NOT NULL")
    known = written(known.groupBy("_url").agg(F.max("_label").alias("_label")), "labelled")
    n, blocked = known.agg(F.count("*"), F.coalesce(F.sum("_label"), F.lit(0.0))).first()
    rate = blocked / n if n else 0.0
    suffixes = written(_suffix_counts(known), "suffixes")
    small = suffixes.agg(F.coalesce(F.sum(F.octet_length("_suffix") + 32 * (2 + FOLDS)), F.lit(0))).first()[0] <= MOST_BROADCAST
    cells = 1 << 30
    picked = known.where(F.pmod(F.xxhash64("_url", F.lit(17)), F.lit(cells)) < int(min(1.0, rows / max(n, 1)) * cells))
    sample = written(picked.withColumns({"_host": host_of(F.col("_url")), "_path": path_of(F.col("_url"))}), "urls")
    rows_ = _with_suffix(with_features(sample, "_host", "_path", "_url"), "_host", suffixes, rate, small, out_of_fold=True)
    names = tuple(c for c in rows_.columns if c.startswith("f_"))
    if not 0 < rate < 1:
        return UrlModel(None, suffixes, rate, names, small)
    train = VectorAssembler(inputCols=list(names), outputCol="_features").transform(rows_)
    trees = GBTClassifier(featuresCol="_features", labelCol="_label", predictionCol="_prediction", maxIter=15, maxDepth=4, stepSize=0.3, seed=7)
    return UrlModel(trees.fit(train.select("_features", "_label")), suffixes, rate, names, small)


def weak_labels(urls: DataFrame, url: str = "url", terms: Sequence[str] = SEED_TERMS) -> DataFrame:
    """url, label: 1 where the host holds a seed term as a whole part of a label."""
    host = host_of(F.col(url))
    parts = F.split(host, r"[.\-_]")
    hit = reduce(lambda a, b: a | b, [F.array_contains(parts, t) for t in terms])
    return urls.select(F.col(url).alias("url"), hit.cast("double").alias("label"))


def judge(urls: DataFrame, rules: Sequence[Rule], model: UrlModel, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """For each row: id, host, path, rule, verdict.

    A null URL, or one without ``://``, has an empty host and path; the trees judge what no
    rule fits.  Repeated rows are judged alike; other columns are ignored.
    """
    rows = urls.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url")).withColumns({"_host": host_of(F.col("_url")), "_path": path_of(F.col("_url"))})
    rows = model.score(rows, "_host", "_path", "_url").withColumn("_rule", rule_for(F.col("_host"), F.col("_path"), rules))
    return rows.select(
        F.col("_id").alias(id_col),
        F.col("_host").alias("host"),
        F.col("_path").alias("path"),
        F.col("_rule.pattern").alias("rule"),
        F.coalesce("_rule.verdict", F.when(F.col("_block") > 0.5, "block").otherwise("allow")).alias("verdict"),
    )
