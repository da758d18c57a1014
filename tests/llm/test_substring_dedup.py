import hashlib
import re
from collections import Counter

import zstandard

from stratalex.llm import substring_dedup

W = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, k=20):
    split = [W.findall(t or "") for _, t in docs]
    first = {}
    low = -(2**63)
    for (i, _), w in zip(docs, split, strict=True):
        for j in range(len(w) - k + 1):
            g = tuple(w[j : j + k])
            at = (low if i is None else i, j)
            first[g] = min(first.get(g, at), at)
    for (i, _), w in zip(docs, split, strict=True):
        gone = set()
        for j in range(len(w) - k + 1):
            f = first[tuple(w[j : j + k])]
            me = low if i is None else i
            # earlier: a smaller id, or an earlier start in this very row
            if f[0] < me or w[j : j + k] in (w[x : x + k] for x in range(j)):
                gone |= set(range(j, j + k))
        kept = " ".join(x for n, x in enumerate(w) if n not in gone)
        yield i, len(w), len(gone), kept


def check(make_docs, docs, window=20):
    got = Counter()
    for r in substring_dedup.remove_repeats(make_docs(docs), window=window).collect():
        if r.n_removed:
            assert hashlib.sha256(zstandard.ZstdDecompressor().decompress(bytes(r.kept_text)) if r.kept_sha256 != hashlib.sha256(b"").hexdigest() else b"").hexdigest() == r.kept_sha256
        got[(r.doc_id, r.n_words, r.n_removed, r.kept_sha256)] += 1
    assert got == Counter((i, n, g, hashlib.sha256(k.encode()).hexdigest()) for i, n, g, k in brute(docs, window))


def test_brute_force(make_docs, words):
    shared = [words(n, 19 + 7 * n, 5000) for n in range(6)]
    docs = []
    for n in range(60):
        own = words(100 + n, 15 + 3 * n, 5000)
        s = shared[n % 6]
        docs.append((1000 - n, "\n".join([" ".join(own[: n % 20]), " ".join(s[n % 3 :]), "\t".join(own[n % 20 :]), " ".join(s[: 10 + n % 15])])))
    docs += [(2000, docs[3][1]), (2001, docs[3][1]), (2001, docs[3][1]), (None, docs[4][1]), (2, None), (3, ""), (4, " \n\t"), (5, "x " * 19), (6, "x " * 20), (7, "x " * 21), (8, "x y " * 40), (9, "É é z " * 30), (10, "a b " * 25)]
    docs += [(11, " ".join(words(9, 300, 3))), (12, " ".join(words(10, 3000, 5000) + words(10, 3000, 5000)))]
    check(make_docs, docs)


def test_chain_across_documents(make_docs, words):
    line = words(1, 200, 9000)
    docs = [(i, " ".join(line[10 * i : 10 * i + 40])) for i in range(16)]
    check(make_docs, docs)
    check(make_docs, docs[::-1])


def test_empty(make_docs):
    check(make_docs, [])
    check(make_docs, [(1, None)])


def test_ids_of_several_texts(make_docs, words, monkeypatch):
    plans, write = [], substring_dedup.written
    monkeypatch.setattr(substring_dedup, "written", lambda df, label: plans.append(df._jdf.queryExecution().analyzed().toString()) or write(df, label))
    passage, other = words(1, 50, 5000), words(2, 40, 5000)
    docs = [(None if i % 2 else 7, " ".join(words(10 + i, 60, 5000) + (passage if i % 3 else other) + words(50 + i, 30, 5000))) for i in range(20)]
    check(make_docs, docs + docs[:3] + [(8, docs[2][1]), (9, " ".join(other)), (6, " ".join(passage))])
    assert re.search(r"Aggregate \[key#\d+L?, hash#\d+L?\], \[.*collect_list\(mark", "".join(plans))  # a list for each text, not for each id


def test_levels(make_docs, words):
    assert [substring_dedup.lengths(w) for w in (20, 40, 50, 80, 12)] == [[10, 20], [10, 20, 40], [13, 25, 50], [10, 20, 40, 80], [12]]
    shared = [words(n, 35 + 9 * n, 5000) for n in range(4)]
    docs = [(n, " ".join(words(100 + n, 30, 5000) + shared[n % 4] + words(200 + n, 30, 5000))) for n in range(20)]
    for window in (12, 40, 50):
        check(make_docs, docs, window)


def test_words_that_polynomials_confuse(make_docs):
    """Two words of 1024 letters whose polynomial hashes modulo 2**64 are equal for any odd base."""
    one, two = "a", "b"
    for _ in range(10):
        one, two = one + two, two + one
    rest = " ".join(f"w{i}" for i in range(19))
    check(make_docs, [(1, f"{one} {rest}"), (2, f"{two} {rest}"), (3, f"{rest} {one}"), (4, f"{rest} {two}")])
    check(make_docs, [(1, " ".join(one)), (2, " ".join(two))])


def test_workers_get_few_texts_at_a_time(spark, make_docs, words, monkeypatch):
    """Rows of a batch while texts are read; before, Spark's 10 000 whole texts and all their windows."""
    rows, written = [], substring_dedup.written

    def recorded(df, label):
        rows.append(int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")))
        return written(df, label)

    monkeypatch.setattr(substring_dedup, "written", recorded)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    check(make_docs, [(i, " ".join(words(i % 3, 60))) for i in range(6)])
    assert rows and max(rows) <= 1000
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
