"""Local embeddings: hashed character bigrams and trigrams and words, L2-normalised."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

DIM = 256
_SPACE = re.compile(r"[ \t\n\x0b\f\r]+")
# Fixed value: what separates words.
_BETWEEN = " \t\n\x0b\f\r，。；：！？、()[]{}"
_SEPARATES = np.zeros(1 << 16, bool)
_SEPARATES[[ord(c) for c in _BETWEEN]] = True
_INVERSE = pow(31, -1, 1 << 64)


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of 31 and of its inverse modulo 2**64."""
    out = []
    for base in (31, _INVERSE):
        a = np.full(n, base, np.uint64)
        a[0] = 1
        out.append(np.cumprod(a, dtype=np.uint64))
    return out[0], out[1]


def word_slots(c: np.ndarray) -> np.ndarray:
    """Slots of the words of two characters or more in a text's code points.

    A word's hash is the polynomial of its characters in signed 32 bits; all are read off
    one running sum.  The slot is the amount of its remainder.
    """
    inside = np.zeros(len(c) + 2, bool)
    inside[1:-1] = ~_SEPARATES[np.minimum(c, (1 << 16) - 1)]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    long = ends - starts >= 2
    starts, ends = starts[long], ends[long]
    up, down = _powers(max(1 << 12, 1 << int(len(c)).bit_length()))
    sums = np.zeros(len(c) + 1, np.uint64)
    np.cumsum(c.astype(np.uint64) * down[: len(c)], out=sums[1:])
    h = ((sums[ends] - sums[starts]) * up[ends - 1]).astype(np.uint32).view(np.int32).astype(np.int64)
    return np.abs(np.fmod(h, DIM))


def embed(text: str | None) -> np.ndarray:
    if not text:
        return np.zeros(DIM, np.float32)
    plain = _SPACE.sub(" ", text.lower())
    c = np.frombuffer(plain.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    out = 2.0 * np.bincount(word_slots(c), minlength=DIM)
    if len(c) > 1:
        out += np.bincount((c[:-1] * 31 + c[1:]) % DIM, minlength=DIM)
    if len(c) > 2:
        out += np.bincount((c[:-2] * 961 + c[1:-1] * 31 + c[2:]) % DIM, minlength=DIM)
    norm = np.sqrt((out * out).sum())
    return (out / norm if norm else out).astype(np.float32)


@F.pandas_udf(ArrayType(FloatType()))
def embed_local(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: embed(t), na_action=None)


def embed_native(text: Column) -> Column:
    """The same vector with built-in functions; slow, a cross-check of ``embed_local``."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " ")
    zero = F.array_repeat(F.lit(0.0), DIM)

    def bag(c: Column) -> Column:
        n = F.size(c)
        two = F.when(n > 1, F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.struct(((F.get(c, i) * 31 + F.get(c, i + 1)) % DIM).alias("s"), F.lit(1.0).alias("w"))))
        three = F.when(n > 2, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(((F.get(c, i) * 961 + F.get(c, i + 1) * 31 + F.get(c, i + 2)) % DIM).alias("s"), F.lit(1.0).alias("w"))))
        none = F.array().cast("array<struct<s:bigint,w:double>>")
        return F.concat(F.coalesce(two, none), F.coalesce(three, none))

    def slot(word: Column) -> Column:
        code = lambda x: F.ascii(x).cast("bigint")
        h = F.aggregate(F.split(word, ""), F.lit(0).cast("bigint"), lambda a, x: F.when(x == "", a).otherwise((a * 31 + code(x)).bitwiseAND(F.lit(4294967295))))
        return F.abs(F.when(h >= 2147483648, h - 4294967296).otherwise(h) % DIM)

    chars = F.filter(F.transform(F.split(plain, ""), lambda x: F.when(x != "", F.ascii(x).cast("bigint"))), lambda x: x.isNotNull())
    words = F.filter(F.split(plain, r"[\s，。；：！？、()\[\]{}]+"), lambda w: F.length(w) >= 2)
    hits = F.concat(F.get(F.transform(F.array(chars), bag), 0), F.transform(words, lambda w: F.struct(slot(w).alias("s"), F.lit(2.0).alias("w"))))
    sums = F.get(F.transform(F.array(hits), lambda hs: F.transform(F.sequence(F.lit(0), F.lit(DIM - 1)), lambda d: F.aggregate(hs, F.lit(0.0), lambda a, x: a + F.when(x["s"] == d, x["w"]).otherwise(0.0)))), 0)
    unit = lambda v: F.get(F.transform(F.array(F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))), lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(0.0).cast("float"))), 0)
    return F.when(plain == "", F.transform(zero, lambda x: x.cast("float"))).otherwise(F.get(F.transform(F.array(sums), unit), 0))
