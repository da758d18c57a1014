"""Repairs against a plain search, blocks against whole conversations, and the query against its SQL."""

import random
from functools import cache

import duckdb
import pytest

from stratalex.llm import conversation_repair as C
from stratalex.llm import queries

NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}


def plain(pattern):
    """Least (cost, audit), by trying every edit; more than two insertions in a row never help."""

    @cache
    def rest(i, before, inserts):
        ways = []
        if i == len(pattern):
            if before in ("", "a"):
                ways.append((0, ""))
        else:
            c = pattern[i]
            ways.append((2, "D", (i + 1, before, 0)))
            if c != "x":
                cut = 5 if c.isupper() else 0
                k = c.lower()
                if (before, k) in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}:
                    ways.append((cut, "K", (i + 1, k, 0)))
                ways.append((1 + cut, "R", (i + 1, NEXT[before], 0)))
        if inserts < 2:
            ways.append((5, "I", (i, NEXT[before], inserts + 1)))
        done = [(w[0] + r[0], w[1] + r[1]) if len(w) > 2 else w for w in ways if len(w) == 2 or (r := rest(*w[2])) is not None]
        return min(done, default=None)

    return rest(0, "", 0)


def whole(pattern):
    edits, state = C.solved(pattern, C.END, (C.START,))
    audit = "".join(edits[0]) + "I" * (C.END[state[0]] // C.INSERT)
    kept = sum(C.TRUNCATED for c, e in zip(pattern, edits[0], strict=True) if c.isupper() and e[-1] != "D")
    return sum({"D": 2, "I": 5, "R": 1, "K": 0}[c] for c in audit) + kept, audit


def test_audits_equal_a_plain_search():
    r = random.Random(1)
    for _ in range(1500):
        p = "".join(r.choice("sssuuuaaaoxSUAO") for _ in range(r.randrange(9)))
        assert whole(p) == plain(p), p


def test_chained_blocks_have_the_distances_of_the_whole():
    r = random.Random(2)
    for _ in range(200):
        p = "".join(r.choice("suaoxUA") for _ in range(r.randrange(1, 12)))
        cut = r.randrange(len(p) + 1)
        behind = C.distances(p[cut:].replace("x", ""), C.END)[0]
        m = C.crossings(p[:cut])
        assert [min(m[4 * q + e] + behind[e] for e in range(4)) for q in range(4)] == C.distances(p.replace("x", ""), C.END)[0]


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    said = ["Yes.", "No!", "a b", "", " \t\n", "é…", None, "x" * 3000 + "?", "Yes."]
    made = [(c, r.choice([None, *range(6)]), r.choice(["user", "assistant", "system", "", None, "tool", "assistant"]), r.choice(said)) for c in [None, 1, 2, 3, 4] for _ in range(14)]
    made += [(7, t, "user" if t % 2 == 0 else "assistant", f"t{t % 11}.") for t in range(60)]  # over several blocks
    made += [(8, 1, "user", "same.")] * 5 + [(9, None, None, None)]
    return [(*m, "h", 1) for m in made]


SCHEMA = "conv_id long, turn long, role string, text string, _h string, c int"


@pytest.mark.parametrize("bits", [12, 2, 0])
def test_query_equals_sql(spark, rows, monkeypatch, bits):
    monkeypatch.setattr(C, "BLOCK_BITS", bits)
    conversations = spark.createDataFrame(rows, SCHEMA)
    got = {tuple(x) for x in C.report_damaged(conversations).collect()}
    duck = duckdb.connect()
    duck.sql("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR, _h VARCHAR, c INTEGER)")
    duck.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?, ?, ?)", rows)
    assert got == set(duck.sql(queries.OP11).fetchall())
    assert len(got) == 8


def test_repaired_rows_have_a_valid_order(spark, rows):
    import re

    made = C.repair(spark.createDataFrame(rows, SCHEMA)).orderBy("conv_id", "place").collect()
    for conv in {r["conv_id"] for r in made}:
        mine = [r for r in made if r["conv_id"] == conv]
        assert [r["place"] for r in mine] == list(range(len(mine)))
        assert re.fullmatch(r"(s?(ua)+)?", "".join(r["role"][0] for r in mine if r["edit"] != "D"))
    assert sum(r["times"] for r in made if r["edit"] != "I") == len(rows)
    assert all(r["text"] == "" for r in made if r["edit"] == "I")


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert C.report_damaged(none).count() == 0
    assert C.repair(none).count() == 0
