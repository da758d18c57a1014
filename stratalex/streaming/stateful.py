"""Streams with state for each key: token streams put in order, and the last messages of sessions.

The processors run under ``transformWithState``, which wants the RocksDB state store
(``use_rocksdb``).  State that nothing has touched for a while expires by its own time to live.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from stratalex.operators.history import LAST

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: How long a stream may be silent, and how long one waits for a line that is missing.
SILENT_MS, WAIT_MS = 180_000, 30_000
#: How long an idle session is remembered.
IDLE_MS = 24 * 3_600_000


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _deltas(line: str) -> list[tuple[str, str]]:
    """(type, piece) of a line's first choice: reasoning before content; none of other lines and bad JSON."""
    try:
        delta = json.loads(line)["choices"][0]["delta"]
        found = [("reasoning", delta.get("reasoning_content")), ("chunk", delta.get("content"))]
    except (ValueError, LookupError, TypeError, AttributeError):
        return []
    return [(kind, piece) for kind, piece in found if isinstance(piece, str) and piece]


class TokenStreams(StatefulProcessor):
    """Lines of a stream (stream_id, seq from 0, line) to its events with the text so far.

    ``waiting`` holds what came ahead of its turn, ``told`` the next place, both texts and
    whether the stream has ended.  A missing line is waited for ``wait_ms``; then what
    waits is told without it.  Lines behind ``[DONE]``, and lines that come twice, are dropped.
    """

    def __init__(self, wait_ms: int = WAIT_MS, silent_ms: int = SILENT_MS) -> None:
        self.wait_ms, self.silent_ms = wait_ms, silent_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "seq long, line string", self.silent_ms)
        self.told = handle.getValueState("told", "next long, reasoning string, chunk string, ended boolean", self.silent_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        came = [(int(s), x) for b in rows for s, x in zip(b["seq"], b["line"], strict=True)]
        yield self._release(key, came, False)
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if self.waiting.exists():
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait_ms)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        yield self._release(key, [], True)

    def _release(self, key: Any, came: list[tuple[int, str]], all_: bool) -> pd.DataFrame:
        due, reasoning, chunk, ended = self.told.get() or (0, "", "", False)
        texts, out = {"reasoning": reasoning, "chunk": chunk}, []
        held = sorted({s: x for s, x in [*(self.waiting.get() if self.waiting.exists() else ()), *came] if s >= due}.items())
        while held and not ended and (all_ or held[0][0] == due):
            seq, line = held.pop(0)
            due = seq + 1
            if line is None or not line.startswith("data: "):
                continue
            data = line[6:].strip()
            ended = data == "[DONE]"
            for kind, piece in [] if ended else _deltas(data):
                texts[kind] += piece
                out.append((key[0], seq, kind, piece, texts[kind]))
        if held and not ended:
            self.waiting.put([(s, x) for s, x in held])
        elif self.waiting.exists():
            self.waiting.clear()
        # an ended stream needs no texts
        self.told.update((due, "" if ended else texts["reasoning"], "" if ended else texts["chunk"], ended))
        return pd.DataFrame(out, columns=["stream_id", "seq", "type", "piece", "full"])


def token_events(lines: DataFrame, wait_ms: int = WAIT_MS, silent_ms: int = SILENT_MS) -> DataFrame:
    """stream_id, seq, type, piece, full of a stream of lines in any order; what ``events.assemble`` gives for a table."""
    use_rocksdb(lines.sparkSession)
    kind = lines.schema["stream_id"].dataType.simpleString()
    schema = f"stream_id {kind}, seq long, type string, piece string, full string"
    return lines.select("stream_id", "seq", "line").groupBy("stream_id").transformWithStateInPandas(TokenStreams(wait_ms, silent_ms), schema, "append", "ProcessingTime")


class LastMessages(StatefulProcessor):
    """The last ``n`` messages of a session as a list; each new message tells the list anew.

    A message that comes again (the same turn) takes the place of the old one.  A session
    that is idle for ``idle_ms`` is forgotten.
    """

    def __init__(self, n: int = LAST, idle_ms: int = IDLE_MS) -> None:
        self.n, self.idle_ms = n, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getListState("last", "turn long, role string, text string", self.idle_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        known = {t: (r, x) for t, r, x in (self.last.get() if self.last.exists() else ())}
        for b in rows:
            for t, r, x in zip(b["turn"], b["role"], b["text"], strict=True):
                known[int(t)] = (r, x)
        kept = [(t, *known[t]) for t in sorted(known)[-self.n :]]
        self.last.put(kept)
        yield pd.DataFrame([(key[0], kept[-1][0], *k) for k in kept if (k[2] or "").strip(" ")], columns=["conv_id", "as_of", "turn", "role", "text"])


def session_memory(messages: DataFrame, n: int = LAST, idle_ms: int = IDLE_MS) -> DataFrame:
    """conv_id, as_of, turn, role, text: the memory of each session that a batch touched; the largest ``as_of`` is the newest.

    ``messages``: conv_id, turn, role, text.  Blank messages are left out after the cut, as in ``history.last_messages``.
    """
    use_rocksdb(messages.sparkSession)
    kind = messages.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, as_of long, turn long, role string, text string"
    rows = messages.select("conv_id", "turn", "role", "text")
    return rows.groupBy("conv_id").transformWithStateInPandas(LastMessages(n, idle_ms), schema, "update", "ProcessingTime")
