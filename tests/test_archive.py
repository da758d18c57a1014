"""The line archive against the files' lines, as a table and as a stream that goes on after a stop."""

import json
import random

from pyspark.sql import functions as F

from stratalex.sources import archive


def write(folder, n=3, lines=400):
    r, rows = random.Random(1), []
    folder.mkdir()
    for k in range(n):
        at, out = 0, b""
        for i in range(lines):
            record = json.dumps({"page_id": k * lines + i, "html": "é" * r.randrange(80)}, ensure_ascii=False) if i % 7 else ""
            rows.append((f"log-{k}.jsonl", at, record))
            line = record.encode() + (b"\r\n" if i % 5 == 0 else b"\n")
            out, at = out + line, at + len(line)
        (folder / f"log-{k}.jsonl").write_bytes(out)
    (folder / "_SUCCESS").write_bytes(b"")
    (folder / "empty").write_bytes(b"")
    return rows


def test_table(spark, tmp_path):
    rows = write(tmp_path / "in")
    archive.register(spark)
    for split in (97, 1 << 20):
        table = spark.read.format("line_archive").option("splitBytes", split).load(str(tmp_path / "in"))
        assert sorted(map(tuple, table.collect())) == sorted(rows)
    one = table.where((F.col("file") == "log-1.jsonl") & (F.col("at") > 100))
    assert sorted(map(tuple, one.collect())) == sorted(x for x in rows if x[0] == "log-1.jsonl" and x[1] > 100)
    assert one.rdd.getNumPartitions() == 1 and table.rdd.getNumPartitions() == 3
    ids = table.where("record != ''").select(F.get_json_object("record", "$.page_id").cast("long").alias("id"))
    assert ids.agg(F.sum("id")).first()[0] == sum(json.loads(x[2])["page_id"] for x in rows if x[2])


def test_stream_equals_table(spark, tmp_path):
    rows = write(tmp_path / "in", 2, 50)
    archive.register(spark)

    def run():
        stream = spark.readStream.format("line_archive").option("splitBytes", 333).load(str(tmp_path / "in"))
        out = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
        out.trigger(availableNow=True).start().awaitTermination()

    run()
    with open(tmp_path / "in" / "log-1.jsonl", "ab") as f:
        at = f.tell()
        f.write(b"more\nhalf a li")
    (tmp_path / "in" / "new.jsonl").write_bytes(b"first\n")
    run()
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert got == sorted([*rows, ("log-1.jsonl", at, "more"), ("new.jsonl", 0, "first")])
