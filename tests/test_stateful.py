"""Streams with state against their batch forms, over a restart, and their expiry under a clock of the test's own."""

import json
import random
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from stratalex.operators import history, kb
from stratalex.streaming import events, progress, stateful


class State:
    """A state of one key that forgets after its time to live, by the test's clock."""

    def __init__(self, clock, ttl, many):
        self.clock, self.ttl, self.many, self.value, self.at = clock, ttl, many, None, 0

    def exists(self):
        return self.value is not None and self.clock.now < self.at + self.ttl

    def get(self):
        return (iter(self.value) if self.many else self.value) if self.exists() else (iter(()) if self.many else None)

    def put(self, value):
        self.value, self.at = value, self.clock.now

    update = put

    def clear(self):
        self.value = None


class Clock:
    """The handle and timer values of one key, with a clock that the test moves."""

    def __init__(self):
        self.now, self.timers = 0, set()

    def getListState(self, name, schema, ttl):
        return State(self, ttl, True)

    def getValueState(self, name, schema, ttl):
        return State(self, ttl, False)

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)

    def listTimers(self):
        return iter(sorted(self.timers))

    def getCurrentProcessingTimeInMs(self):
        return self.now


def say(**delta):
    return "data: " + json.dumps({"choices": [{"delta": delta}]})


def feed(p, clock, *lines):
    rows = pd.DataFrame(lines, columns=["seq", "line"])
    return [tuple(r) for b in p.handleInputRows(("s",), iter([rows]), clock) for r in b.itertuples(index=False)]


def test_missing_lines_and_silence():
    clock, p = Clock(), stateful.TokenStreams(1000, 5000)
    p.init(clock)
    assert feed(p, clock, (2, say(content="c")), (0, say(content="a"))) == [("s", 0, "chunk", "a", "a")]
    assert clock.timers == {1000}
    assert feed(p, clock, (0, say(content="again"))) == [] and clock.timers == {1000}
    clock.now = 1001
    late = [tuple(r) for b in p.handleExpiredTimer(("s",), clock, SimpleNamespace()) for r in b.itertuples(index=False)]
    assert late == [("s", 2, "chunk", "c", "ac")]
    assert feed(p, clock, (1, say(content="too late"))) == []
    assert feed(p, clock, (3, "data: [DONE]"), (4, say(content="x"))) == [] and feed(p, clock, (5, say(content="x"))) == []
    clock.now += 5001
    assert feed(p, clock, (0, say(content="new"))) == [("s", 0, "chunk", "new", "new")]


def test_sessions_are_forgotten():
    clock, p = Clock(), stateful.LastMessages(2, 100)
    p.init(clock)
    add = lambda *turns: [t for b in p.handleInputRows((1,), iter([pd.DataFrame([(t, "user", f"m{t}") for t in turns], columns=["turn", "role", "text"])]), clock) for t in b["turn"]]
    assert add(0, 1, 2) == [1, 2]
    clock.now = 99
    assert add(3) == [2, 3]
    clock.now = 250
    assert add(4) == [4]


@pytest.fixture
def stateful_spark(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def run(stream, tmp_path, mode):
    """Runs what is new and keeps it as JSON; a second call goes on from the checkpoint."""

    def keep(batch, n):
        batch.write.mode("overwrite").json(str(tmp_path / "out" / f"batch={n}"))

    stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()


def test_token_stream_equals_batch_over_a_restart(stateful_spark, tmp_path):
    spark, r = stateful_spark, random.Random(1)
    rows = []
    for s in range(6):
        lines = [r.choice([say(content=f"c{s}{i} "), say(reasoning_content="r", content="b"), ": ping", "data: bad", say(content="")]) for i in range(12)]
        lines[9:10] = ["data: [DONE]"] if s % 2 else lines[9:10]
        rows += [(f"s{s}", i, x) for i, x in enumerate(lines)]
    schema = "stream_id string, seq long, line string"
    r.shuffle(rows)
    stream = lambda: stateful.token_events(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    for part in (rows[:30], rows[30:]):
        spark.createDataFrame(part, schema).repartition(2).write.mode("append").parquet(str(tmp_path / "in"))
        run(stream(), tmp_path, "append")
    got = sorted(tuple(x) for x in spark.read.schema("stream_id string, seq long, type string, piece string, full string").json(str(tmp_path / "out")).select("stream_id", "seq", "type", "piece", "full").collect())
    want = sorted(tuple(x) for x in events.assemble(spark.createDataFrame(rows, schema)).select("stream_id", "seq", "type", "piece", "full").collect())
    assert got == want and len(got) > 20


def test_session_memory_equals_last_messages(stateful_spark, tmp_path):
    spark = stateful_spark
    rows = [(c, t, "user" if t % 2 else "assistant", f"m{t}" if t % 5 else " ") for c in range(4) for t in range(8 + 9 * c)]
    schema = "conv_id long, turn long, role string, text string"
    stream = lambda: stateful.session_memory(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    for part in ([x for x in rows if x[1] < 7], [x for x in rows if x[1] >= 7]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run(stream(), tmp_path, "update")
    told = spark.read.schema("conv_id long, as_of long, turn long, role string, text string").json(str(tmp_path / "out"))
    newest = told.join(told.groupBy("conv_id").agg(F.max("as_of").alias("as_of")), ["conv_id", "as_of"]).select("conv_id", "turn", "role", "text")
    want = history.last_messages(spark.createDataFrame(rows, schema)).select("conv_id", "turn", "role", "text")
    assert sorted(map(tuple, newest.collect())) == sorted(map(tuple, want.collect()))


def test_ingest_into_a_store_and_progress(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"text {i % 30}") for i in range(60)], "id long, content string")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    path = str(tmp_path / "store")
    kb.write_store(spark.createDataFrame([(-1, "text 3"), (-2, "other")], rows.schema), "content", path)
    log = progress.Progress()
    spark.streams.addListener(log)
    try:
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        events.ingest_into(stream, path, str(tmp_path / "cp"), "content", "id").awaitTermination()
        for _ in range(100):
            if sum(r[2] for r in log.rows) >= 60:
                break
            import time

            time.sleep(0.1)
    finally:
        spark.streams.removeListener(log)
    assert sorted(r["content"] for r in kb.read_store(spark, path).collect()) == sorted({f"text {i}" for i in range(30)} | {"other"})
    told = log.table(spark, 60).orderBy("batch").collect()
    assert told[-1]["done"] == 60 and told[-1]["percent"] == 100 and len(told) == 3


def test_counters_of_a_batch(spark):
    rows, seen = progress.counted(spark.range(100), "pages", odd=F.col("id") % 2 == 1, large=F.col("id") > 89)
    rows.write.format("noop").mode("overwrite").save()
    assert seen.get == {"rows": 100, "odd": 50, "large": 10}


def test_distinct_within(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"t{i % 4}", i) for i in range(20)], "id long, content string, s long").select("id", "content", F.timestamp_seconds("s").alias("at"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = events.distinct_within(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "content", "at", "1 hour")
    q = stream.writeStream.format("memory").queryName("within").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["content"] for r in spark.table("within").collect()) == ["t0", "t1", "t2", "t3"]
