"""Fixed-window rate limits, each window opened by its key's first request.

``limit_batch`` counts a table's requests in ranges of time, ``limit_stream`` those of a stream
with state for each key that expires with its window.
"""

from __future__ import annotations

from array import array
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from stratalex.sources.scratch import Scratch, written

WINDOW_MS, CHAT_LIMIT, API_LIMIT = 60_000, 30, 300


def with_key(requests: DataFrame) -> DataFrame:
    """Adds tier and key of API requests; others aren't limited and are left out."""
    api = requests.where(F.startswith("path", F.lit("/api/")))
    return api.withColumn("tier", F.when(F.col("path") == "/api/chat", "chat").otherwise("api")).withColumn("key", F.concat_ws("|", "ip", "tier"))


def limit_batch(requests: DataFrame, chat_limit: int = CHAT_LIMIT, api_limit: int = API_LIMIT, window_ms: int = WINDOW_MS) -> DataFrame:
    """request_id, key, window_start, n_in_window, allowed; rejected requests count too.

    Columns: request_id, ip, path, ms (milliseconds).  Requests are dealt by ranges of (key,
    ms), so a key with a third of all requests is spread over many tasks.  Only the first
    key of a range can have begun in the range before; its requests wait.  For them each
    request points to the first one after the window it would open, these pointers are
    doubled, and so every request that may be the first to open a window in this range knows
    the last one that does.  A row for the edge keys of each range, with a value for each
    millisecond of one window at most, is enough to carry windows from range to range; then
    the waiting requests are counted, again in their ranges.
    """
    limits = {"chat": chat_limit, "api": api_limit}
    keyed = with_key(requests).select("key", "tier", F.col("ms").cast("long").alias("ms"), F.col("request_id").cast("long").alias("request_id"))
    ranged = keyed.repartitionByRange("key", "ms", "request_id").sortWithinPartitions("key", "ms", "request_id").withColumn("part", F.spark_partition_id())
    spark = requests.sparkSession
    with Scratch(spark, "limits") as scratch:
        made = scratch.written(ranged.mapInArrow(_in_ranges(limits, window_ms), f"{_RESULT}, tier string, ms long, part int, edge {_EDGE}"), "ranges")
        edges = made.where("edge IS NOT NULL").select("key", "part", "edge.*").repartition("key").sortWithinPartitions("key", "part")
        before = scratch.written(edges.mapInArrow(_carried(window_ms), "key string, part int, window_start long, n_in_window long"), "before")
        waiting = made.where("edge IS NULL AND n_in_window IS NULL").select("part", F.lit(1).alias("kind"), "key", "tier", "ms", "request_id", "window_start", "n_in_window")
        first = before.select("part", F.lit(0).alias("kind"), "key", F.lit(None).cast("string").alias("tier"), F.lit(None).cast("long").alias("ms"), F.lit(None).cast("long").alias("request_id"), "window_start", "n_in_window")
        parts = made.agg(F.coalesce(F.max("part") + 1, F.lit(1))).first()[0]
        # the ranges as they were, so no task has more than one
        again = first.unionByName(waiting).repartitionById(parts, F.col("part")).sortWithinPartitions("part", "key", "kind", "ms", "request_id")
        late = again.mapInArrow(_counted(limits, window_ms), _RESULT)
        done = made.where("n_in_window IS NOT NULL").select(*late.columns)
        return written(done.unionByName(late), "limited")


_RESULT = "request_id long, key string, window_start long, n_in_window long, allowed boolean"
#: Of the requests that a key has in a range: their number, the last time, and for runs of
#: possible first openers the run's last time, and start and count of the window they end in.
_EDGE = "struct<n:long,last:long,until:array<long>,start:array<long>,count:array<long>>"
_EDGE_TYPE = pa.struct([("n", pa.int64()), ("last", pa.int64()), *((name, pa.list_(pa.int64())) for name in ("until", "start", "count"))])


def _edge(times: np.ndarray, window_ms: int) -> dict:
    """What a range does to a key's window, for each way in which the window before it may end."""
    n = len(times)
    after = np.searchsorted(times, times + window_ms, "right")
    last = np.where(after < n, after, np.arange(n))
    while True:  # each round doubles the windows that a pointer passes
        further = last[last]
        if (further == last).all():
            break
        last = further
    opens = np.flatnonzero(np.r_[True, times[1:] != times[:-1]])
    # the window before ends inside the first window's length, so the first opener is there or the next after it
    opens = opens[: np.searchsorted(times[opens], times[0] + window_ms, "right") + 1]
    ends = np.flatnonzero(np.r_[last[opens][1:] != last[opens][:-1], True])
    own = last[opens][ends]
    return {"n": n, "last": int(times[-1]), "until": times[opens][ends].tolist(), "start": times[own].tolist(), "count": (n - own).tolist()}


def _in_ranges(limits: dict[str, int], window_ms: int):
    """Counts the requests of a range but its first key's, which wait; ends with a row for its first and last key."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = key = start = part = None
        n, times = 0, array("q")

        def edge() -> pa.RecordBatch:
            rows = {"request_id": [None], "key": [key], "window_start": [None], "n_in_window": [None], "allowed": [None], "tier": [None], "ms": [None], "part": [part]}
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.int64(), pa.int32()]
            value = pa.array([_edge(np.frombuffer(times, np.int64), window_ms)], _EDGE_TYPE)
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows.values(), kinds, strict=True)] + [value], [*rows, "edge"])

        for b in batches:
            starts, counts, allowed, ends = [], [], [], []
            for k, tier, ms, p in zip(*(b.column(c).to_pylist() for c in ("key", "tier", "ms", "part")), strict=True):
                if k != key:
                    if key is not None and key == first:
                        ends.append(edge())
                    first = k if first is None else first
                    key, part, start, n, times = k, p, None, 0, array("q")
                times.append(ms)
                if key == first:
                    starts.append(None)
                    counts.append(None)
                    allowed.append(None)
                    continue
                start, n = (ms, 1) if start is None or start < ms - window_ms else (start, n + 1)
                starts.append(start)
                counts.append(n)
                allowed.append(n <= limits[tier])
            rows = [b.column("request_id"), b.column("key"), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(allowed, pa.bool_()), b.column("tier"), b.column("ms"), b.column("part"), pa.nulls(len(b), _EDGE_TYPE)]
            yield pa.RecordBatch.from_arrays(rows, ["request_id", "key", "window_start", "n_in_window", "allowed", "tier", "ms", "part", "edge"])
            yield from ends
        if key is not None:
            yield edge()

    return count


def _carried(window_ms: int):
    """The window of a key before each of its ranges, from its edges in order."""

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, start, count = None, None, 0
        for b in batches:
            starts, counts = [], []
            for key, n, last, until, starting, counted in zip(*(b.column(c).to_pylist() for c in ("key", "n", "last", "until", "start", "count")), strict=True):
                if key != now:
                    now, start, count = key, None, 0
                starts.append(start)
                counts.append(count)
                if start is not None and last <= start + window_ms:
                    count += n
                else:
                    run = 0 if start is None else bisect_right(until, start + window_ms)
                    start, count = starting[run], counted[run]
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("part"), pa.array(starts, pa.int64()), pa.array(counts, pa.int64())], ["key", "part", "window_start", "n_in_window"])

    return carry


def _counted(limits: dict[str, int], window_ms: int):
    """Counts requests in order, each range's from the window before it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, n = None, 0
        for b in batches:
            starts, counts, allowed, kept = [], [], [], []
            for kind, tier, ms, start_before, n_before in zip(*(b.column(c).to_pylist() for c in ("kind", "tier", "ms", "window_start", "n_in_window")), strict=True):
                kept.append(kind == 1)
                if kind == 0:
                    start, n = start_before, n_before
                    continue
                start, n = (ms, 1) if start is None or start < ms - window_ms else (start, n + 1)
                starts.append(start)
                counts.append(n)
                allowed.append(n <= limits[tier])
            mask = pa.array(kept, pa.bool_())
            columns = [b.column("request_id").filter(mask), b.column("key").filter(mask), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(allowed, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["request_id", "key", "window_start", "n_in_window", "allowed"])

    return count


def limit_stream(requests: DataFrame, chat_limit: int = CHAT_LIMIT, api_limit: int = API_LIMIT) -> DataFrame:
    """The streaming form: start and count of a key's window as state.

    A key that is silent for two windows loses its state, which changes no decision.
    """
    limits = {"chat": chat_limit, "api": api_limit}

    def count(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["ms", "request_id"])
        start, n = state.get if state.exists else (None, 0)
        out = []
        for ms, request, tier in zip(rows["ms"], rows["request_id"], rows["tier"], strict=True):
            start, n = (int(ms), 1) if start is None or start < ms - WINDOW_MS else (start, n + 1)
            out.append((int(request), key[0], start, n, n <= limits[tier]))
        state.update((start, n))
        state.setTimeoutDuration(2 * WINDOW_MS)
        yield pd.DataFrame(out, columns=["request_id", "key", "window_start", "n_in_window", "allowed"])

    schema = "request_id long, key string, window_start long, n_in_window long, allowed boolean"
    return with_key(requests).groupBy("key").applyInPandasWithState(count, schema, "start long, n long", "append", GroupStateTimeout.ProcessingTimeTimeout)
