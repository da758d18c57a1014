"""Near words against comparing all words, roots against following forms, and the query against its SQL."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from stratalex.llm import queries
from stratalex.llm import spelling_variants as S


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


@pytest.fixture(scope="module")
def counts():
    r = random.Random(5)
    return {"".join(r.choice("abé") for _ in range(r.randrange(1, 8))): r.randrange(1, 400) for _ in range(500)}


def test_pairs_equal_all_against_all(spark, counts):
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = [tuple(sorted((r["a"], r["b"]))) for r in S.near_pairs(words).collect()]
    known = sorted(counts)
    want = {(a, b) for i, a in enumerate(known) for b in known[i + 1 :] if one_edit(a, b)}
    assert len(got) == len(set(got)) and set(got) == want


def test_forms_and_roots(spark, counts):
    words = spark.createDataFrame([(*x, "z", 3) for x in counts.items()], "word string, n long, form string, root int")
    got = {r["word"]: r for r in S.variants(words).collect()}
    assert set(got) == set(counts)
    form = {}
    for w, n in counts.items():
        near = [x for x in counts if one_edit(w, x)]
        best = min(near, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 5 * n else None
        assert (got[w]["form"], got[w]["n_near"], got[w]["n"]) == (form[w], len(near), n)
        assert got[w]["form_n"] == (counts[form[w]] if form[w] else None)
    for w in counts:
        end = w
        while form[end]:
            end = form[end]
        assert got[w]["root"] == end


def test_a_long_chain_has_one_root(spark):
    chain = [("a" * (6 + i), 5 ** (9 - i)) for i in range(9)]
    got = {r["word"]: r["root"] for r in S.variants(spark.createDataFrame(chain, "word string, n long")).collect()}
    assert set(got.values()) == {"aaaaaa"}


def test_query_equals_sql(spark, make_docs):
    r = random.Random(7)
    word = lambda: "".join(r.choice(["Ab", "cd", "é", "÷", "Ÿ", "e"]) for _ in range(r.randrange(2, 6)))
    rows = [(i % 90 if i % 17 else None, r.choice([" ", "\n", "7", "-", "'"]).join(word() for _ in range(120))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, "--"), (503, "abcdefg" * 3000), *[rows[5]] * 6]
    docs = make_docs(rows)
    got = {tuple(x) for x in S.variants(S.counted(S.damaged_words(docs))).collect()}
    duck = duckdb.connect()
    duck.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    duck.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = set(duck.sql(queries.OP12).fetchall())
    assert got == want and len(got) > 100


def test_damage_takes_one_code_point(spark, make_docs):
    import zlib

    rows = [(i, "Àbcdefgh") for i in range(2000)]
    got = sorted(r["word"] for r in S.damaged_words(make_docs(rows)).collect())
    want = []
    for i, t in rows:
        w = "Àbcdefgh"
        h = zlib.crc32(f"{i}:{w}".encode())
        want.append(w[: h % 8] + w[h % 8 + 1 :] if h % 199 == 0 else w)
    assert got == sorted(want) and len(set(want)) > 3


def test_empty_tables(spark, make_docs):
    assert S.counted(S.damaged_words(make_docs([]))).count() == 0
    assert S.variants(spark.createDataFrame([], "word string, n long")).count() == 0
    assert S.variants(spark.range(1).select(F.lit("abcdef").alias("word"), F.lit(5).cast("long").alias("n"))).first()["root"] == "abcdef"
