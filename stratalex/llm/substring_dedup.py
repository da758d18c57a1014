"""Removal of repeated passages, found by level-wise doubling of window lengths.

The lengths are halves of the window, from LEAST words or more up to the window itself.  On
a level below the window's only a sample of windows is counted, the smallest hash among
those that lie in a full window; the content alone decides which, so all occurrences of a
full window have the same.  A full window whose sample is the only one of its kind in the
corpus cannot repeat and is out; what is left goes on to twice the length, and a document
with nothing left is done.  On the last level the surviving windows are counted by 96-bit
hashes; the smallest document id among a window's occurrences tells where it starts first.
Nothing longer is needed: a longer repeat is a run of repeated windows.

Counts are sums and minima, so a passage that stands in a third of all documents crosses
the shuffle once for each task.  What goes back to a document is a list no longer than the
document itself: where an id has several texts, lists are kept for each id and text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalex.llm.common import SPACES, batches_of, hash_windows, hash_words, parts, written

WINDOW = 20
#: Words of the shortest windows that are counted; shorter ones repeat by chance.
LEAST = 10
#: Texts that go to a Python worker at a time.
BATCH_ROWS = 1000

_SEEDS = np.uint64(0x8EBC6AF09C88C6E3), np.uint64(0xA0761D6478BD642F)


def lengths(window: int) -> list[int]:
    """Lengths of the levels, shortest first."""
    out = [window]
    while (half := (out[0] + 1) // 2) >= LEAST and half < out[0]:
        out.insert(0, half)
    return out


def _hashes(text: bytes, seeds: tuple[np.uint64, ...] = _SEEDS[:1]) -> list[np.ndarray]:
    return hash_words(text.translate(SPACES), seeds)


def _slide(a: np.ndarray, n: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` over every ``n`` consecutive values."""
    have = 1
    while have < n:
        step = min(have, n - have)
        a = pick(a[:-step], a[step:])
        have += step
    return a


def samples(words: np.ndarray, length: int, window: int) -> np.ndarray:
    """For every full window the smallest hash of its windows of ``length`` words."""
    return _slide(hash_windows(words, length), window - length + 1, np.minimum)


def full_windows(text: bytes, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of every full window."""
    one, two = (hash_windows(x, window) for x in _hashes(text, _SEEDS))
    return one.view(np.int64), two.astype(np.uint32).view(np.int32)


def _spread(starts: np.ndarray, n: int, window: int) -> np.ndarray:
    """Which of ``n`` words a window at one of ``starts`` covers."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return np.cumsum(edge[:-1]) > 0


def _runs(flags: np.ndarray) -> bytes:
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)]).astype("<u4").tobytes()


def _flags(runs: bytes | None, n: int) -> np.ndarray:
    """Which of ``n`` places lie in the runs; all without any."""
    out = np.full(n, runs is None)
    if runs is not None:
        out[_unrun(runs)] = True
    return out


def _unrun(blob: bytes) -> np.ndarray:
    first, last = np.frombuffer(blob, "<u4").reshape(2, -1).astype(np.int64)
    return np.concatenate([np.arange(a, b) for a, b in zip(first, last, strict=True)]) if len(first) else np.zeros(0, np.int64)


def _batch(names: str, types: list, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names.split())


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """For each document: id, n_words, n_removed, kept_sha256, kept_text.

    ``kept_text`` is the kept words joined by spaces, as zstd bytes; null if all are kept.

    A word goes if a window over it starts earlier too, in a document of a smaller id or
    further up in the same one; windows are judged on the input.  Words are separated by
    ASCII white space and compared as they are.  Null text has no words; documents of fewer
    words than a window keep all.  A null id is smaller than any other; rows with the same
    id do not count as earlier than each other, so repeated rows get equal results.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = texts.withColumn("hash", F.xxhash64("text"))
    repeated = not texts.groupBy("key").agg(F.min("hash").alias("a"), F.max("hash").alias("b")).where("a != b").isEmpty()
    by = ["key", "hash"] if repeated else ["key"]

    longs = ", ".join(f"{c} long" for c in by)

    def marks_of(length: int):
        """Function of (key, text or zstd bytes, runs of possible windows): samples and how often each is met, 2 at most."""

        def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            unpack, span = zstandard.ZstdDecompressor().decompress, window - length + 1
            for b in parts(batches):
                found, keys, times = [], [[] for _ in by], []
                for *of, body, runs in zip(*(b.column(c).to_pylist() for c in (*by, "body", "runs")), strict=True):
                    words = _hashes(body.encode() if isinstance(body, str) else unpack(body))[0]
                    if len(words) < window:
                        continue
                    part = hash_windows(words, length)
                    low = _slide(part, span, np.minimum)
                    if runs is not None:
                        low[~_flags(runs, len(low))] = 0
                    edge = np.zeros(span - 1, np.uint64)
                    chosen = _slide(np.concatenate([edge, low, edge]), span, np.maximum) == part
                    value, n = np.unique(part[chosen], return_counts=True)
                    found.append(value.view(np.int64))
                    times.append(np.minimum(n, 2))
                    for column, x in zip(keys, of, strict=True):
                        column.append(np.full(len(value), x, np.int64))
                if found:
                    yield _batch(" ".join(["mark", *by, "n"]), [pa.int64(), *(pa.int64() for _ in by), pa.int32()], [np.concatenate(found), *map(np.concatenate, keys), np.concatenate(times).astype(np.int32)])

        return marks

    def squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for b in parts(batches):
            z = pa.array([pack(t.encode()) for t in b.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("key"), b.column("hash"), z, pa.nulls(b.num_rows, pa.binary())], ["id", "key", "hash", "z", "runs"])

    def narrowed_by(length: int):
        """Function of (id, hash, z, runs, samples met once): the runs that are left, and the digest of a text with none."""

        def narrowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            unpack = zstandard.ZstdDecompressor().decompress
            for b in parts(batches):
                out: list[list] = [[], [], [], [], [], []]
                single = b.column("single")
                for i, (doc, hashed, z, before) in enumerate(zip(*(b.column(c).to_pylist() for c in ("id", "hash", "z", "runs")), strict=True)):
                    text = unpack(z) if z else b""
                    words, runs = _hashes(text)[0], None
                    if len(words) >= window:
                        maybe = _flags(before, len(words) - window + 1)
                        if single[i].is_valid:
                            maybe &= ~np.isin(samples(words, length, window).view(np.int64), single[i].values.to_numpy())
                        runs = _runs(maybe) if maybe.any() else None
                    sha = None if runs else hashlib.sha256(b" ".join(text.split())).hexdigest()
                    for column, x in zip(out, (doc, hashed, len(words), z if runs else None, runs, sha), strict=True):
                        column.append(x)
                yield _batch("id hash n_words z runs sha", [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.string()], out)

        return narrowed

    key = F.coalesce("id", F.lit(-(2**63))).alias("key")
    bodies = texts.select(*by, F.col("text").alias("body"), F.lit(None).cast("binary").alias("runs"))
    left, done = texts.mapInArrow(squeezed, "id long, key long, hash long, z binary, runs binary"), []
    for length in lengths(window)[:-1] or [window]:
        single = bodies.mapInArrow(marks_of(length), f"mark long, {longs}, n int").groupBy("mark").agg(F.sum("n").alias("n"), *(F.min(c).alias(c) for c in by)).where("n = 1")
        single = single.groupBy(*by).agg(F.collect_list("mark").alias("single"))
        left = left.join(single, by, "left").select("id", "hash", "z", "runs", "single")
        with batches_of(docs.sparkSession, BATCH_ROWS):
            prepared = written(left.mapInArrow(narrowed_by(length), "id long, hash long, n_words long, z binary, runs binary, sha string"), "passages")
        done.append(prepared.where("runs IS NULL").select("id", "n_words", F.lit(0).cast("long").alias("n_removed"), "sha", "z"))
        left = prepared.where("runs IS NOT NULL").select("id", key, "hash", "z", "runs")
        bodies = left.select(*by, F.col("z").alias("body"), "runs")
        if left.isEmpty():
            break
    keyed = left

    def doubled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for b in parts(batches):
            out: list[list] = [[], [], *([] for _ in by)]
            for *of, z, runs in zip(*(b.column(c).to_pylist() for c in (*by, "z", "runs")), strict=True):
                one, two = full_windows(unpack(z), window)
                at = _unrun(runs)
                pair = np.unique(np.rec.fromarrays([one[at], two[at]], names="one,two"))
                for column, x in zip(out, (pair.one, pair.two, *(np.full(len(pair), k, np.int64) for k in of)), strict=True):
                    column.append(x)
            if out[0]:
                yield _batch(" ".join(["one two", *by]), [pa.int64(), pa.int32(), *(pa.int64() for _ in by)], [np.concatenate(c) for c in out])

    windows = keyed.select(*by, "z", "runs").mapInArrow(doubled, f"one long, two int, {longs}")
    first = windows.groupBy("one", "two").agg(F.min("key").alias("key"))
    if repeated:  # every text of the smallest id that has the window
        first = windows.join(first.hint("merge"), ["one", "two", "key"], "left_semi").select("one", "two", *by).distinct()
    first = first.groupBy(*by).agg(F.collect_list("one").alias("one"), F.collect_list("two").alias("two"))

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, pack = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=3).compress
        for b in parts(batches):
            out: list[list] = [[], [], [], [], []]
            lists = b.column("one"), b.column("two")
            for i, (doc, z, runs) in enumerate(zip(*(b.column(c).to_pylist() for c in ("id", "z", "runs")), strict=True)):
                text = unpack(z)
                at, split = _unrun(runs), text.split()
                one, two = (x[at] for x in full_windows(text, window))
                here = np.rec.fromarrays([one, two], names="one,two")
                again = np.ones(len(here), bool)
                value, start = np.unique(here, return_index=True)
                if lists[0][i].is_valid:
                    own = np.rec.fromarrays([x[i].values.to_numpy() for x in lists], names="one,two")
                    again[start[np.isin(value, own)]] = False
                gone = _spread(at[again], len(split), window)
                kept = b" ".join(w for w, g in zip(split, gone.tolist(), strict=True) if not g)
                for column, x in zip(out, (doc, len(split), int(gone.sum()), hashlib.sha256(kept).hexdigest(), pack(kept) if gone.any() else None), strict=True):
                    column.append(x)
            yield _batch("id n_words n_removed sha z", [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()], out)

    changed = keyed.select("id", *by, "z", "runs").join(first, by, "left").select("id", "z", "runs", "one", "two").mapInArrow(removed, "id long, n_words long, n_removed long, sha string, z binary")
    return reduce(DataFrame.unionByName, done, changed).select(F.col("id").alias(id_col), "n_words", "n_removed", F.col("sha").alias("kept_sha256"), F.col("z").alias("kept_text"))
