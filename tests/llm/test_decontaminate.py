import hashlib
import re
import string
from collections import Counter

from stratalex.llm import decontaminate

FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
W = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(docs, items):
    split = [(i, W.findall((t or "").translate(FOLD))) for i, t in items]
    for i, t in docs:
        w = W.findall((t or "").translate(FOLD))
        hit, ids = set(), set()
        for item, x in split:
            k = min(10, len(x))
            grams = {tuple(x[j : j + k]) for j in range(len(x) - k + 1)} if k else set()
            for j in range(len(w) - k + 1):
                if tuple(w[j : j + k]) in grams:
                    hit |= set(range(j, j + k))
                    ids.add(item)
        names = sorted(str(x) for x in ids if x is not None)
        yield i, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)


def check(spark, make_docs, docs, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = Counter(tuple(r) for r in decontaminate.contamination(make_docs(docs), bench).drop("_k").collect())
    assert got == Counter(brute(docs, items))
    kept = decontaminate.drop_contaminated(make_docs(docs), bench)
    assert kept.columns == make_docs([]).columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(d for d, b in zip(docs, brute(docs, items), strict=True) if not b[-1])


def data(words):
    items = [(n, " ".join(words(n, 8 + 5 * n, 30 + 100 * (n % 2)))) for n in range(8)]
    items += [(20, None), (21, ""), (22, "one"), (23, "Two Words"), (None, " ".join(words(77, 25))), (24, items[3][1]), (25, "a " * 40), (10, items[2][1])]
    docs = []
    for n in range(40):
        base, src = words(100 + n, 60 + n, 60), (items[n % 8][1]).split()
        cut = src[n % 4 : n % 4 + 6 + n % 12]
        docs.append((n, " ".join(base[:20]) + ", " + "-".join(cut).upper() + " " + " ".join(base[20:])))
    docs += [(50, None), (51, ""), (52, "..."), (53, "x one y"), (54, "two, WORDS one"), (55, "a " * 15), (56, "é" * 3 + " a" * 10), (57, " ".join(words(3, 20_000, 40)) + " " + items[7][1])]
    docs += [(57, items[5][1]), (None, items[5][1] + " tail"), (1, docs[1][1]), (58, items[4][1] + " z " + items[4][1]), (59, " ".join(words(77, 25)))]
    return docs, items


def test_brute_force(spark, make_docs, words):
    check(spark, make_docs, *data(words))


def test_shuffle_join(spark, make_docs, words, monkeypatch):
    monkeypatch.setattr(decontaminate, "MOST_BROADCAST", -1)
    check(spark, make_docs, *data(words))


def test_empty(spark, make_docs, words):
    docs, items = data(words)
    check(spark, make_docs, [], items)
    check(spark, make_docs, docs[:5], [])


def test_guarantee_at_every_offset(spark, make_docs, words):
    item = words(5, 30, 10_000)
    docs = [(j, " ".join(words(1000 + j, 7, 10_000) + item[j : j + 10] + words(2000 + j, 9, 10_000))) for j in range(21)]
    check(spark, make_docs, docs, [(1, " ".join(item))])


def test_repetitive_texts(spark, make_docs):
    """Texts of one word again and again, on both sides: a row for each of a text's marks, not for each pair of places."""
    import time

    items = [(n, "a " * (40 + n)) for n in range(30)] + [(99, "a b " * 30)]
    docs = [(1, "a " * 40_000), (2, "a " * 9), (3, "b a " * 2000), (4, "a " * 10)]
    began = time.time()
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in decontaminate.contamination(make_docs(docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {1: (40_000, 40_000, 30), 2: (9, 0, 0), 3: (4000, 4000, 1), 4: (10, 10, 30)}
    assert time.time() - began < 60


def test_a_long_text_of_hits_takes_linear_time(spark, make_docs):
    import time

    passage = [f"p{i}" for i in range(300)]
    items = spark.createDataFrame([(1, " ".join(passage))], "item_id long, text string")
    took = []
    for times in (100, 800):
        began = time.time()
        got = decontaminate.contamination(make_docs([(1, " ".join(passage * times))]), items).first()
        took.append(time.time() - began)
        assert (got["n_words"], got["n_hit"], got["n_items"]) == (300 * times, 300 * times, 1)
    assert took[1] < 60
