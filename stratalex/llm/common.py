"""What the operators share: table access, shared scratch tables, byte-level hashing."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalex.sources.scratch import Scratch, scratch_path, written  # noqa: F401  the operators' way to shared tables

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows for the jobs that run inside, which bounds what long texts take."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def parts(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most ``rows`` rows, so that a task holds the results of no more at a time."""
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


# -- hashing of words in whole batches, on the UTF-8 bytes -------------------------------

_U = np.uint64
_MULT, _M1, _M2 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
_SHIFTS = _U(30), _U(27), _U(31), _U(32), _U(29)
#: Keeps the first k of eight bytes.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], _U)

#: Tables for ``bytes.translate`` that turn what separates words into spaces.
SPACES = bytes(32 if 9 <= b <= 13 else b for b in range(256))
LOWER_ALNUM = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> _SHIFTS[0])
    x *= _M1
    x ^= x >> _SHIFTS[1]
    x *= _M2
    x ^= x >> _SHIFTS[2]
    return x


def hash_words(text: bytes, seeds: tuple[np.uint64, ...] = (_MULT,)) -> list[np.ndarray]:
    """For each seed the hashes of the words of ``text``, which spaces separate.

    Every eight bytes of a word go through a bijection that depends on the seed and, from
    the second eight on, on their place; so words of up to eight bytes never meet, and the
    hashes of two seeds are independent.
    """
    raw = np.frombuffer(text + b"        ", np.uint8)
    inside = np.zeros(len(raw) + 1, bool)
    np.not_equal(raw, 32, out=inside[1:])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return [np.zeros(0, _U) for _ in seeds]
    size = ends - starts
    eight = np.ndarray((len(raw) - 7,), "<u8", raw, 0, (1,))  # the eight bytes from every place
    first = eight[starts] & _FIRST[np.minimum(size, 8)]
    long = np.flatnonzero(size > 8)
    if len(long):
        more = (size[long] - 1) // 8
        begin = np.cumsum(more) - more
        nth = np.arange(more.sum()) - np.repeat(begin, more) + 1
        at = np.repeat(starts[long], more) + 8 * nth
        rest = eight[at] & _FIRST[np.minimum(np.repeat(ends[long], more) - at, 8)]
        place = nth.astype(_U) * _MULT
    out = []
    for seed in seeds:
        h = mix64(first ^ seed)
        if len(long):
            h[long] += np.add.reduceat(mix64((rest ^ seed) + place), begin)
        out.append(mix64(h + size.astype(_U) * seed))
    return out


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _MULT
    x += b
    x ^= x >> _SHIFTS[3]
    x *= _M1
    x ^= x >> _SHIFTS[4]
    return x


def hash_windows(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` consecutive values, put together from runs of 1, 2, 4, ..."""
    places = len(words) - k + 1
    if places < 1:
        return words[:0]
    out, of, have, size = None, 0, words, 1
    while True:
        if k & size:
            out = have[:places] if out is None else _joined(out, have[of : of + places])
            of += size
            if of == k:
                return out
        have = _joined(have[:-size], have[size:])
        size *= 2
