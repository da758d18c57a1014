"""Searches over stored indexes against reading everything."""

import random

import pytest
from pyspark.sql import functions as F

from stratalex.operators import block_index, retrieval, vector_index

FIELDS = {"body": 1.0, "title": 2.0}


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(1)
    hot, others = "hot", [f"w{i}" for i in range(300)]
    text = lambda n: " ".join(r.choice([hot, *r.choices(others, k=2)]) for _ in range(n))
    rows = [(i, text(r.randrange(1, 60)), text(3) if i % 3 else "", "ab"[i % 2]) for i in range(4000)]
    rows += [(5000 + i, "hot " * 40 + "w7 w8", "hot", "a") for i in range(5)] + [(6000, "", "", "a"), (6001, "rare hot", "rare", "b")]
    return spark.createDataFrame(rows, "id long, body string, title string, grade string")


@pytest.fixture(scope="module")
def index(docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("blocks") / "index")
    block_index.write(docs, "id", list(FIELDS), path, ["grade"])
    return path


@pytest.mark.parametrize("terms", [["hot"], ["hot", "rare"], ["w7", "w8", "W9"], ["w1", "w1", "hot"], ["none"], []])
@pytest.mark.parametrize("k", [3, 100])
def test_block_search_equals_scoring_all(spark, docs, index, terms, k):
    for grade in (None, "b"):
        where = None if grade is None else F.col("grade") == grade
        got = [(r["id"], round(r["bm25"], 9)) for r in block_index.search(spark, index, terms, FIELDS, k, where).orderBy(F.desc("bm25"), "id").collect()]
        want = retrieval.bm25(docs, terms, FIELDS, where).orderBy(F.desc(F.round("bm25", 9)), "id").limit(k).collect()
        assert [x[1] for x in got] == [round(r["bm25"], 9) for r in want]
        assert sorted(got) == sorted((r["id"], round(r["bm25"], 9)) for r in want)


#: Null and repeated ids, null and empty texts, texts without words, words that come again.
ODD = [(1, "b a b  c"), (1, "b d"), (None, "a a"), (None, "q a"), (2, None), (3, ""), (4, "z,"), (5, "..."), (6, "a 函数函数 x A"), (7, "same"), (7, "same")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "id long, t string")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def figures(postings):
    # the length of an id with several texts is that of any of them
    return sorted((str(r["term"]), str(r["id"]), r["tf"]) for r in postings.collect())


def test_postings_in_order_hold_no_table(odd):
    got = retrieval.postings(odd, "id", "t", in_order=True)
    # rows pass one shuffle into their order and are summed up as they come
    assert plan(got).count("Exchange") == 1 and "Exchange rangepartitioning" in plan(got)
    assert "SortAggregate" in plan(got) and "HashAggregate" not in plan(got)
    assert got.schema.simpleString() == "struct<term:string,id:bigint,tf:bigint,dl:int>"
    assert figures(got) == figures(retrieval.postings(odd, "id", "t"))
    want = {("b", 1): 3, ("a", 1): 1, ("c", 1): 1, ("d", 1): 1, ("a", None): 3, ("q", None): 1, ("z", 4): 1, ("a", 6): 2, ("x", 6): 1, ("函数", 6): 2, ("数函", 6): 1, ("same", 7): 2}
    assert {(r["term"], r["id"]): r["tf"] for r in got.collect()} == want
    assert {r["id"]: r["dl"] for r in got.collect() if r["id"] in (4, 6, 7)} == {4: 1, 6: 6, 7: 1}


def test_postings_cut_texts_once(spark, odd):
    # Spark infers no filter by the number of words, which would cut each text a second time
    filters = [x for x in plan(retrieval.postings(odd, "id", "t")).splitlines() if "Filter" in x]
    assert filters and not any("size" in x or "split" in x for x in filters)
    assert {(r["id"], r["term"]): (r["tf"], r["dl"]) for r in retrieval.postings(odd.where("id in (2, 3, 4, 7)"), "id", "t").collect()} == {(4, "z"): (1, 1), (7, "same"): (2, 1)}


def test_postings_of_lists(spark):
    lists = spark.createDataFrame([(1, ["b", None, "a b", None, "", "b"]), (2, None), (3, []), (4, [None])], "id long, t array<string>")
    want = [("", "1", 1), ("None", "1", 2), ("None", "4", 1), ("a b", "1", 1), ("b", "1", 2)]
    assert figures(retrieval.postings(lists, "id", "t")) == figures(retrieval.postings(lists, "id", "t", in_order=True)) == want


def test_written_postings_are_in_order(spark, docs, tmp_path):
    path = str(tmp_path / "index")
    retrieval.write_index(docs, "id", list(FIELDS), path)
    for file in (tmp_path / "index/postings").glob("*.parquet"):
        rows = [(r["field"], r["term"], r["id"]) for r in spark.read.parquet(str(file)).collect()]
        assert rows == sorted(rows)
    got = spark.read.parquet(f"{path}/postings")
    for f in FIELDS:
        assert figures(got.where(F.col("field") == f)) == figures(retrieval.postings(docs, "id", f))
    assert {r["field"]: r["n"] for r in spark.read.parquet(f"{path}/figures").collect()} == dict.fromkeys(FIELDS, docs.count())


def test_blocks_are_skipped(spark, index):
    read, every = block_index.blocks_read(spark, index, ["hot", "rare"], FIELDS, 1)
    assert every > 60 and read < every / 2


def test_documents_stand_once(spark, docs, index):
    # no row, shuffled or stored, repeats the id, length or grade of a document for each of its terms
    blocks = spark.read.parquet(f"{index}/blocks")
    assert dict(blocks.dtypes) == {"field": "string", "term": "string", "block": "bigint", "n": "int", "best": "float", "entries": "array<bigint>"}
    got = spark.read.parquet(f"{index}/documents").select(F.explode("id").alias("id")).collect()
    assert sorted(r["id"] for r in got) == sorted(r["id"] for r in docs.collect())
    want = {f: {(r["term"], r["n"]) for r in retrieval.postings(docs, "id", f).groupBy("term").agg(F.sum("tf").alias("n")).collect()} for f in FIELDS}
    for f in FIELDS:
        found = blocks.where(F.col("field") == f).select("term", F.explode("entries").alias("e")).groupBy("term").agg(F.sum(F.floor(F.col("e") / block_index.BLOCK)).alias("n")).collect()
        assert {(r["term"], r["n"]) for r in found} == want[f]


@pytest.mark.parametrize("part", [1, 3])
def test_blocks_of_uneven_batches(docs, monkeypatch, part):
    import pyarrow as pa

    monkeypatch.setattr(block_index, "PART", part)
    words = pa.array([["a", "b", "a"], [], ["c"], None, ["a"]] * 41, pa.list_(pa.string()))
    b = pa.RecordBatch.from_arrays([pa.array(range(205)), words, pa.array([5] * 205)], ["id", "_w0", "_task"])
    schema = pa.schema([("field", pa.string()), ("term", pa.string()), ("block", pa.int64()), ("best", pa.float32()), ("entries", pa.list_(pa.int64())), ("id", pa.list_(pa.int64())), ("_dl_f", pa.list_(pa.int32()))])
    rows = [r for x in block_index._blocks(["f"], {"f": 1.0}, ["id"], schema)(iter([b.slice(0, 70), b.slice(70), b.slice(0, 0)])) for r in x.to_pylist()]
    of = {(r["block"], i): (x, dl) for r in rows if r["term"] is None for i, (x, dl) in enumerate(zip(r["id"], r["_dl_f"], strict=True))}
    assert sorted(x for x, _ in of.values()) == list(range(205)) and max(i for _, i in of) < block_index.BLOCK
    got = sorted((*of[r["block"], e % block_index.BLOCK], r["term"], e // block_index.BLOCK) for r in rows if r["term"] for e in r["entries"])
    lists = words.to_pylist()
    assert got == sorted((i, len(w), t, w.count(t)) for i, w in enumerate(lists) if w for t in set(w))


def test_block_index_of_nothing(spark, docs, tmp_path):
    block_index.write(docs.limit(0), "id", list(FIELDS), str(tmp_path / "none"))
    assert block_index.search(spark, str(tmp_path / "none"), ["hot"], FIELDS, 5).count() == 0


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")


@pytest.fixture(scope="module")
def cells(vectors, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("cells") / "index")
    vector_index.write(vectors, "vec_id", "embedding", path)
    return path


def asked(vectors, n=8):
    return [[float(v) for v in r["embedding"]] for r in vectors.orderBy(F.xxhash64("vec_id")).limit(n).collect()]


def test_all_cells_give_the_exact_neighbours(spark, vectors, cells):
    for q in asked(vectors, 2):
        got = [(r["id"], r["cos"]) for r in vector_index.search(spark, cells, q, 50, exact=True).orderBy(F.desc("cos"), "id").collect()]
        assert got == [(r["vec_id"], r["cos"]) for r in retrieval.knn(vectors, q, 50).collect()]


def test_recall_of_probed_cells(spark, vectors, cells):
    found = 0
    queries = asked(vectors)
    for q in queries:
        got = {r["id"] for r in vector_index.search(spark, cells, q, 200).collect()}
        found += len(got & {r["vec_id"] for r in retrieval.knn(vectors, q, 200).collect()})
    assert found / (200 * len(queries)) >= 0.95
    read, every = vector_index.files_read(spark, cells, queries[0])
    assert read < every


def test_vectors_in_clusters_need_few_cells(spark, tmp_path):
    r = random.Random(2)
    centres = [[r.gauss(0, 1) for _ in range(16)] for _ in range(40)]
    table = spark.createDataFrame([(i, [c + r.gauss(0, 0.15) for c in centres[i % 40]]) for i in range(6000)], "id long, v array<double>").cache()
    path = str(tmp_path / "index")
    q = vector_index.write(table, "id", "v", path, cells=40, k=50)
    assert q.probes <= 8
    queries = [x["v"] for x in table.where("id < 6").collect()]
    found = sum(len({x["id"] for x in vector_index.search(spark, path, v, 50).collect()} & {x["id"] for x in retrieval.knn(table, v, 50, "id", "v").collect()}) for v in queries)
    assert found / (50 * len(queries)) >= 0.95
    read, every = vector_index.files_read(spark, path, queries[0])
    assert read < every / 3


def test_many_queries(spark, vectors, cells):
    some = vectors.where("vec_id % 500 = 0")
    got = vector_index.search_many(some, "vec_id", "embedding", cells, 10).collect()
    hits = 0
    for r in some.collect():
        hits += len({x["id"] for x in got if x["query_id"] == r["vec_id"]} & {x["vec_id"] for x in retrieval.knn(vectors, r["embedding"], 10).collect()})
    assert hits / (10 * some.count()) >= 0.95
    assert all(1 <= x["rank"] <= 10 for x in got)


def test_many_queries_in_blocks_equal_comparing_all(spark, tmp_path, monkeypatch):
    for name, n in (("LEAST_ROWS", 7), ("BLOCK_NUMBERS", 60), ("TILE", 40), ("COMPARED", 9)):
        monkeypatch.setattr(vector_index, name, n)
    r = random.Random(3)
    some = [[float(r.randrange(-2, 3)) for _ in range(3)] for _ in range(40)]
    rows = [(i, some[i % 40] if i % 11 else [x * r.choice([1e-90, 1.0, 1e60]) for x in some[i % 40]]) for i in range(200)] + [(300, [0.0, 0.0, 0.0]), (301, [float("nan"), 0.0, 1.0]), (302, None)]
    table = spark.createDataFrame(rows, "id long, v array<double>")
    path = str(tmp_path / "index")
    cells = vector_index.write(table, "id", "v", path, cells=6, parts=3).centres.shape[0]
    some = table.where("id % 3 = 0 or id > 290")
    for k in (1, 6, 500):
        found = vector_index.search_many(some, "id", "v", path, k, probes=cells)
        got = {}
        for x in found.orderBy("query_id", "rank").collect():
            got.setdefault(x["query_id"], []).append((x["id"], str(x["cos"])))
        dot = "aggregate(zip_with(q, v, (x, y) -> x * y), 0D, (a, x) -> a + x)"
        pairs = some.where("v is not null").selectExpr("id as query_id", "v as q").crossJoin(table.where("v is not null"))
        size = f"sqrt({dot.replace('(q, v,', '(q, q,')} * {dot.replace('(q, v,', '(v, v,')})"
        want = {}
        for x in pairs.selectExpr("query_id", "id", f"if({size} > 0, {dot} / {size}, 0D) as cos").orderBy("query_id", F.desc("cos"), "id").collect():
            want.setdefault(x["query_id"], []).append((x["id"], str(x["cos"])))
        assert got == {q: x[:k] for q, x in want.items()}
    # blocks meet whole; no join makes a row of each pair of a query and a vector
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().executedPlan().toString()


def test_copies_zeros_and_nulls(spark, tmp_path):
    rows = [(i, [1.0, 0.0, 0.0]) for i in range(400)] + [(1000 + i, [float(i % 7), float(i % 5), 1.0]) for i in range(600)] + [(5000, [0.0, 0.0, 0.0]), (5001, None)]
    table = spark.createDataFrame(rows, "id long, v array<double>")
    path = str(tmp_path / "index")
    vector_index.write(table, "id", "v", path, cells=8, parts=5)
    assert spark.read.parquet(f"{path}/rows").count() == 1001
    got = [r["id"] for r in vector_index.search(spark, path, [1.0, 0.0, 0.0], 5, probes=2).orderBy(F.desc("cos"), "id").collect()]
    assert got == [0, 1, 2, 3, 4]
    assert {r["cos"] for r in vector_index.search(spark, path, [0.0, 0.0, 0.0], 5, exact=True).collect()} == {0.0}
