"""Toxicity scores by non-negative positive-unlabelled learning with numpy classifiers.

The learner sees confirmed toxic texts and unlabelled ones.  With p the share of toxic
texts among the unlabelled and l the logistic loss, the risk is

    p * E_toxic[l(f)] + max(0, E_unlabelled[l(-f)] - p * E_toxic[l(-f)]):

the bracket estimates the risk on clean texts from unlabelled ones, and where it falls
below zero, which only overfitting brings about, the step goes the other way.  Features are
the words that a text has and their first letters, as abuse is inflected in many languages;
they are chosen by their shares on the two sides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from math import fsum

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalex.llm.common import batches_of, parts, written

#: Bounds of the sample the classifier is fitted on, about; a hash of the id picks it.
TOXIC_ROWS, UNLABELLED_ROWS = 4_000, 12_000
#: Words in the model; toxic sample texts, and their share, that a word must stand in.
WORDS, LEAST_TEXTS, LEAST_SHARE = 3_000, 3, 0.01
#: Share of toxic texts among those with the word, as the two samples tell it, at least.
LEAST_POSTERIOR = 0.4
#: Class prior where the labels don't give one (no clean labels); score of a toxic text.
PRIOR, THRESHOLD = 0.1, 0.3
#: Lengths of the beginnings of words.
STEMS = (4, 5, 6)
#: Texts of the sample that go to a Python worker at a time.
BATCH_ROWS = 1000
#: Adam steps and their size; pull of weights to zero, divided by the toxic texts.
STEPS, RATE, DECAY = 500, 0.1, 0.15

_WORD = re.compile(r"[^\W_]+")


def text_words(text: str | None) -> set[str]:
    """The words of a text and, marked by a tilde, their beginnings."""
    words = set(_WORD.findall((text or "").lower()))
    return words.union(*({w[:n] + "~" for w in words if len(w) > n} for n in STEMS))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    bias: float

    def score(self, text: str | None) -> float:
        """0 to 1; a text without known words, or none, gets the bias's."""
        known = self.weights
        f = self.bias + fsum(map(known.__getitem__, text_words(text) & known.keys()))  # in any order
        return float(1 / (1 + np.exp(-np.clip(f, -30, 30))))


class _Rows:
    """Rows of word numbers as one flat list; a row's value is the sum of its words'."""

    def __init__(self, rows: list[list[int]], words: int) -> None:
        self.at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.word = np.array([w for r in rows for w in r], np.int64)
        self.n, self.words = len(rows), words

    def values(self, weights: np.ndarray, bias: float) -> np.ndarray:
        return np.bincount(self.at, weights[self.word], self.n) + bias

    def back(self, slope: np.ndarray) -> np.ndarray:
        """Gradient of the words and the bias, from that of the rows."""
        return np.append(np.bincount(self.word, slope[self.at], self.words), slope.sum())


def _sigmoid(f: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(f, -30, 30)))


def risks(x: np.ndarray, p: _Rows, u: _Rows, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """The risk on toxic texts and that on clean ones as estimated, and the gradients of both.

    ``x``: weights of the words, then the bias; ``p`` and ``u``: toxic and unlabelled texts.
    """
    fp, fu = p.values(x[:-1], x[-1]), u.values(x[:-1], x[-1])
    toxic, clean = prior * np.logaddexp(0, -fp).mean(), np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
    of_toxic = prior * p.back((_sigmoid(fp) - 1) / p.n)
    of_clean = u.back(_sigmoid(fu) / u.n) - prior * p.back(_sigmoid(fp) / p.n)
    return float(toxic), float(clean), of_toxic, of_clean


def fit_nnpu(toxic: list[list[int]], other: list[list[int]], words: int, prior: float) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear classifier under the non-negative risk (Adam steps)."""
    p, u = _Rows(toxic, words), _Rows(other, words)
    x = np.append(np.zeros(words), np.log(prior / (1 - prior)))
    mean, square = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, STEPS + 1):
        _, clean, of_toxic, of_clean = risks(x, p, u, prior)
        slope = of_toxic + of_clean if clean >= 0 else -of_clean
        slope[:-1] += DECAY / p.n * x[:-1]
        mean, square = 0.9 * mean + 0.1 * slope, 0.999 * square + 0.001 * slope**2
        x = x - RATE * mean / (1 - 0.9**step) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return x[:-1], float(x[-1])


def _share(rows: int, n: int) -> int:
    return int(min(1.0, rows / max(n, 1)) * (1 << 30))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fits on the labels of rows that aren't held out.

    Toxic are the texts labelled 1; unlabelled texts are a sample of all that aren't held
    out, labelled or not.  The class prior is the share of 1 among the labels learned from.
    Ids and labels only choose rows.  Without toxic texts every score is the prior.
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).where(F.col("_id").isNotNull() & F.col("_y").isNotNull() & ~held_out(F.col("_id")))
    known = known.groupBy("_id").agg(F.max("_y").alias("_y"))
    n, n_toxic = known.agg(F.count("*"), F.coalesce(F.sum("_y"), F.lit(0))).first()
    prior = min(max(n_toxic / n if 0 < n_toxic < n else PRIOR, 1e-4), 0.9)
    pick = lambda share, seed: F.pmod(F.xxhash64("_id", F.lit(seed)), F.lit(1 << 30)) < share
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where(~held_out(F.col(id_col)))
    toxic = texts.join(F.broadcast(known.where((F.col("_y") == 1) & pick(_share(TOXIC_ROWS, n_toxic), 1)).select("_id")), "_id", "left_semi")
    other = texts.where(F.coalesce(pick(_share(UNLABELLED_ROWS, texts.count()), 2), F.lit(False)))
    sample = toxic.select(F.lit(1).alias("y"), "_text").unionByName(other.select(F.lit(0).alias("y"), "_text"))

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([sorted(text_words(t)) for t in b.column(1).to_pylist()], pa.list_(pa.string()))], ["y", "words"])

    with batches_of(docs.sparkSession, BATCH_ROWS):
        sample = written(sample.mapInArrow(words_of, "y int, words array<string>"), "sample")  # read three times
    sizes = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    if not sizes.get(1) or not sizes.get(0):
        return Model({}, float(np.log(prior / (1 - prior))))
    seen = sample.select("y", F.explode("words").alias("w")).groupBy("w").agg(F.count_if(F.col("y") == 1).alias("t"), F.count_if(F.col("y") == 0).alias("u"))
    t, u = F.col("t") / sizes[1], F.col("u") / sizes[0]
    # words that, by their shares, mark toxic texts; how far the share among toxic texts stands out from that among all
    ranked = seen.where(F.col("t") >= max(LEAST_TEXTS, LEAST_SHARE * sizes[1])).where(prior * t >= LEAST_POSTERIOR * u).withColumn("gain", F.abs(t - u) * F.abs(F.log((t + 1e-3) / (u + 1e-3))))
    number = {r["w"]: i for i, r in enumerate(ranked.orderBy(F.desc("gain"), "w").limit(WORDS).collect())}

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            rows = [sorted(number[w] for w in set(words) & number.keys()) for words in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.int32()))], ["y", "numbers"])

    with batches_of(docs.sparkSession, BATCH_ROWS):
        rows = sorted((r["y"], list(r["numbers"])) for r in sample.mapInArrow(numbered, "y int, numbers array<int>").collect())  # a bounded sample
    weights, bias = fit_nnpu([r for y, r in rows if y], [r for y, r in rows if not y], len(number), prior)
    return Model({w: float(weights[i]) for w, i in number.items()}, bias)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: id, held_out, score, predicted; whole texts, null as empty."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([model.score(t) for t in b.column(2).to_pylist()], pa.float64())], ["id", "held_out", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    rows = rows.mapInArrow(scored, "id long, held_out boolean, score double")
    return rows.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose score reaches the threshold; no shuffle."""

    @F.pandas_udf("double")
    def scores(texts):
        return texts.map(model.score, na_action=None)

    return docs.where(scores(F.col(text_col)) < THRESHOLD)
