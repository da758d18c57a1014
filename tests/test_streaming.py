import json

from stratalex.functions import text as T
from stratalex.operators import kb
from stratalex.streaming import events, rate_limit

REQUEST = "request_id long, ip string, path string, ms long"


def requests():
    rows = [(i, "a", "/api/chat", 0) for i in range(31)] + [(100, "b", "/api/x", 0), (101, "b", "/api/x", 60_000), (102, "b", "/api/x", 60_001), (103, "a", "/page", 0), (104, "a", "/api/chat/", 5)]
    return rows


def test_rate_limit_batch(spark):
    got = {r.request_id: r for r in rate_limit.limit_batch(spark.createDataFrame(requests(), REQUEST)).collect()}
    assert [i for i in range(31) if not got[i].allowed] == [30]
    assert 103 not in got and got[104].key == "a|api"
    assert (got[101].n_in_window, got[101].window_start) == (2, 0) and (got[102].n_in_window, got[102].window_start) == (1, 60_001)


def test_rate_limit_stream_equals_batch(spark, tmp_path):
    # else timeouts keep an available-now run going for ever
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    rows = spark.createDataFrame(requests(), REQUEST)
    rows.where("ms = 0").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = rate_limit.limit_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    run = lambda: stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    run()
    rows.where("ms > 0").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    got = sorted(spark.read.parquet(str(tmp_path / "out")).collect())
    want = sorted(rate_limit.limit_batch(rows).select(*spark.read.parquet(str(tmp_path / "out")).columns).collect())
    assert got == want


def test_events(spark):
    d = lambda **k: "data: " + json.dumps({"choices": [{"delta": k}]})
    lines = [d(content="a"), ": ping", "data: bad", d(reasoning_content="t", content="b"), d(content=""), "data: [DONE]", d(content="late")]
    rows = spark.createDataFrame([("s", i, x) for i, x in enumerate(lines)] + [("u", 0, d(content="z"))], "stream_id string, seq long, line string")
    got = sorted((r.stream_id, r.seq, r.type, r.piece, r.full) for r in events.assemble(rows).collect())
    assert got == [("s", 0, "chunk", "a", "a"), ("s", 3, "chunk", "b", "ab"), ("s", 3, "reasoning", "t", "t"), ("u", 0, "chunk", "z", "z")]


def test_ingest_and_distinct(spark, tmp_path):
    row = spark.createDataFrame([(1, "x"), (2, "y"), (3, "x")], "id long, content string")
    row.coalesce(1).write.parquet(str(tmp_path / "in"))
    store = str(tmp_path / "store")

    def merge(batch, n):
        old = spark.read.parquet(f"{store}-{n - 1}") if n else batch.limit(0).withColumn("content_hash", T.content_hash(batch.content))
        kb.upsert(old.drop("content_hash"), batch, "content", "id").write.mode("overwrite").parquet(f"{store}-{n}")

    stream = spark.readStream.schema(row.schema).parquet(str(tmp_path / "in"))
    events.ingest(stream, str(tmp_path / "cp"), merge).awaitTermination()
    assert sorted((r.id, r.content) for r in spark.read.parquet(f"{store}-0").collect()) == [(2, "y"), (3, "x")]
    once = events.distinct_stream(stream, "content").writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    once.awaitTermination()
    assert spark.table("once").count() == 2


def test_rate_limit_of_a_hot_key(spark):
    n = 30_000
    rows = [(i, "a", "/api/x", (i * 7919) % n * 10) for i in range(n)]
    limited = rate_limit.limit_batch(spark.createDataFrame(rows, REQUEST), window_ms=5000)
    assert "collect_list" not in limited._jdf.queryExecution().toString()
    want, start, count = {}, None, 0
    for i, _, _, ms in sorted(rows, key=lambda r: (r[3], r[0])):
        start, count = (ms, 1) if start is None or start < ms - 5000 else (start, count + 1)
        want[i] = (start, count, count <= rate_limit.API_LIMIT)
    assert {r.request_id: (r.window_start, r.n_in_window, r.allowed) for r in limited.collect()} == want


def test_rate_limit_over_ranges_equals_a_fold(spark):
    import random

    r = random.Random(6)
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for window, span in ((50, 400), (5000, 400), (7, 100_000)):
            rows = [(i, r.choice("aaaaab") if i % 3 else f"k{i % 40}", r.choice(["/api/chat", "/api/x"]), r.randrange(span)) for i in range(3000)]
            limited = rate_limit.limit_batch(spark.createDataFrame(rows, REQUEST), 2, 5, window)
            want, state = {}, {}
            for i, ip, path, ms in sorted(rows, key=lambda x: (x[3], x[0])):
                key = f"{ip}|{'chat' if path == '/api/chat' else 'api'}"
                start, n = state.get(key, (None, 0))
                state[key] = start, n = (ms, 1) if start is None or start < ms - window else (start, n + 1)
                want[i] = (key, start, n, n <= (2 if key.endswith("chat") else 5))
            assert {x.request_id: (x.key, x.window_start, x.n_in_window, x.allowed) for x in limited.collect()} == want
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_rate_limit_of_nothing(spark):
    assert rate_limit.limit_batch(spark.createDataFrame([], REQUEST)).count() == 0
