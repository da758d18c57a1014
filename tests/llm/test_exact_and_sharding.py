import hashlib
from collections import Counter, defaultdict

from stratalex.llm import exact_dedup, sharding

ROWS = [(1, "a"), (2, "a"), (3, "b"), (4, None), (5, ""), (None, "b"), (6, "a "), (7, "x" * 300_000), (8, "x" * 300_000), (3, "b")]


def test_exact_groups(make_docs):
    got = Counter(tuple(r) for r in exact_dedup.exact_groups(make_docs(ROWS)).collect())
    groups = defaultdict(list)
    for i, t in ROWS:
        groups[t or ""].append(i)
    want = Counter()
    for i, t in ROWS:
        g = groups[t or ""]
        keep = max((x for x in g if x is not None), default=None)
        want[(i, keep, len(g), i == keep, hashlib.sha256((t or "").encode()).hexdigest())] += 1
    assert got == want


def test_drop_exact_copies(make_docs):
    docs = make_docs(ROWS)
    kept = exact_dedup.drop_exact_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(2, "a"), (3, "b"), (5, ""), (6, "a "), (8, "x" * 300_000)]


def test_empty_table(make_docs):
    assert exact_dedup.exact_groups(make_docs([])).count() == 0
    assert exact_dedup.drop_exact_copies(make_docs([])).count() == 0
    assert sharding.assign_shards(make_docs([])).count() == 0


def test_lookup_table_is_even_and_stable():
    table = sharding.lookup_table()
    counts = Counter(table)
    assert len(counts) == 64 and max(counts.values()) - min(counts.values()) <= 1
    fewer = sharding.lookup_table([s for s in sharding.SHARDS if s != "shard-010"])
    names = [s for s in sharding.SHARDS if s != "shard-010"]
    moved = sum(sharding.SHARDS[a] != names[b] for a, b in zip(table, fewer, strict=True))
    assert moved < len(table) * 0.2


def test_table_by_the_definition():
    """Filled by whole preference lists, one turn after another."""
    import zlib

    for shards, slots in ((("a", "b", "c"), 7), (sharding.SHARDS[:9], 101), (sharding.SHARDS, sharding.SLOTS)):
        lists = [[(zlib.crc32(f"offset {s}".encode()) + k * (zlib.crc32(f"step {s}".encode()) % (slots - 1) + 1)) % slots for k in range(slots)] for s in shards]
        assert all(sorted(x) == list(range(slots)) for x in lists)
        owner = {}
        while len(owner) < slots:
            for i, wish in enumerate(lists):
                if len(owner) < slots:
                    owner[next(x for x in wish if x not in owner)] = i
        assert [owner[s] for s in range(slots)] == sharding.lookup_table(shards, slots)


def test_assign_shards(make_docs):
    docs = make_docs([(i, "t") for i in range(500)] + [(None, None), (3, "again")])
    got = sharding.assign_shards(docs).collect()
    table = sharding.lookup_table()
    for r in got:
        slot = int(hashlib.md5(str(r.doc_id if r.doc_id is not None else "").encode()).hexdigest()[:8], 16) % sharding.SLOTS
        assert (r["_slot"], r["_shard"]) == (slot, table[slot])
    assert len(got) == 502


def test_write_shards(spark, make_docs, tmp_path):
    docs = make_docs([(i % 3, f"t{i}") for i in range(200)])
    sharding.write_shards(docs, str(tmp_path / "out"), files=4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 200 and {"_shard", *docs.columns} == set(back.columns)
