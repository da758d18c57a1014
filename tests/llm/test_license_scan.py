"""License notices against comparing every block with every template, and the query against its SQL."""

import math
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from stratalex.llm import decontaminate as D
from stratalex.llm import license_scan as L
from stratalex.llm import queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain(text, templates):
    w = WORD.findall((text or "").translate(UPPER))
    stride = max(len(t.words.split()) for t in templates)
    base, labels, score, starts = set(), set(), 0.0, []
    for t in templates:
        x = t.words.split()
        if t.phrase:
            at = [i for i in range(len(w)) if w[i : i + len(x)] == x]
            share = 1.0 if at else 0.0
            if t.base:
                starts += at
                base |= {t.label} if at else set()
        else:
            share = max((len(set(w[s : s + 2 * stride]) & set(x)) / len(set(x)) for s in range(0, len(w), stride)), default=0.0)
            share = share if share * len(set(x)) >= math.ceil(len(set(x)) * t.share - 1e-9) else 0.0
        if share:
            labels.add(t.label)
            score = max(score, share)
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score


@pytest.fixture(scope="module")
def texts():
    r = random.Random(11)
    common = ["the", "of", "general", "license", "public", "cc", "by", "rights", "all", "reserved", "mit", "wort", "Ärger", "7"]
    made = [" ".join(r.choice(common) for _ in range(r.randrange(1, 200))) for _ in range(60)]
    for t in L.TEMPLATES:
        kept = [w for w in t.words.split() if t.phrase or r.random() > 0.12]
        before = ["filler"] * r.randrange(60)
        made.append(" ".join(before) + "\n" + " ".join(kept).title() + ". " + "end " * r.randrange(50))
    made.append("cc\nby " * 4000 + "x" * 5000)
    made += ["All rights\nreserved", "all, rights; RESERVED!", "allrights reserved", "general  public\tlicense general public license"]
    return made


def test_scan_equals_comparing_all(spark, make_docs, texts):
    rows = [*enumerate(texts), (900, None), (901, ""), (902, "..."), (None, texts[3]), (None, texts[3]), (3, texts[3]), (3, texts[61])]
    got = sorted(map(repr, (tuple(r) for r in L.scan(make_docs(rows)).collect())))
    assert got == sorted(repr((i, *plain(t, L.TEMPLATES))) for i, t in rows)


def test_other_templates(spark, make_docs, texts):
    r = random.Random(4)
    own = [L.Template(f"l{i}", " ".join(r.choice("abcdefgh") for _ in range(r.randrange(1, 9))), r.choice([0.3, 0.5, 0.8, 1.0])) for i in range(12)]
    docs = [(i, " ".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(60)))) for i in range(150)]
    got = sorted(map(repr, (tuple(x) for x in L.scan(make_docs(docs), own).collect())))
    assert got == sorted(repr((i, *plain(t, own))) for i, t in docs)


def test_query_equals_sql(spark, make_docs, texts):
    rows = [*enumerate(texts), (900, None), (901, "")]
    got = {tuple(r) for r in L.scan(make_docs(rows)).collect()}
    duck = duckdb.connect()
    duck.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    duck.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert got == set(duck.sql(queries.oracle_sql()["op13_license_scan"]).fetchall())


def test_plan_stays_in_the_jvm(spark, make_docs):
    plan = L.matches(make_docs([(1, "cc by")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_words_are_found_by_a_table_of_characters(spark):
    """The words of the contract, by a class without ranges, which take Java ten times as long."""
    assert not re.search(r"-", D.WORD)
    text = "".join(chr(c) + "x" + chr(c) for c in [*range(1, 0x3000), 0xFFFD, 0x1F600, 0x10FFFF] if not 0xD800 <= c < 0xE000)
    rows = [(0, text), (1, "\0a\0B\0"), (2, None), (3, "")]
    got = spark.createDataFrame(rows, "id int, text string").select("id", D.words_of(F.col("text"))).collect()
    assert dict(map(tuple, got)) == {i: WORD.findall((t or "").translate(UPPER)) for i, t in rows}


def test_empty_table_and_templates(spark, make_docs):
    assert L.scan(make_docs([])).count() == 0
    for wrong in ([], [L.Template("x", " ")], [L.Template("x", " ".join(map(str, range(L.MOST_WORDS + 1))))]):
        with pytest.raises(ValueError):
            L.scan(make_docs([(1, "a")]), wrong)
