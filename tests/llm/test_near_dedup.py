import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from stratalex.llm import near_dedup as nd
from stratalex.llm.common import Scratch


def word_sets(texts):
    """Counts of five-word tuples, without any of the operator's code."""
    out = []
    for t in texts:
        w = re.findall(rb"[0-9A-Za-z\x80-\xff]+", (t or "").encode().lower())
        k = min(5, len(w))
        out.append(Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else Counter())
    return out


def weighted(sets, share=nd.SHARE):
    df = Counter(s for c in sets for s in c)
    floor, n = max(1, df.total() / share), len(sets)
    return [{s: k * (math.log((1 + n) / (1 + max(df[s], floor))) + 1) for s, k in c.items()} for c in sets]


def jaccard(a, b):
    both = sum(min(v, b[s]) for s, v in a.items() if s in b)
    return both / (sum(a.values()) + sum(b.values()) - both)


def brute(docs):
    """Classes over texts, by comparing every pair of different texts."""
    weights = weighted(word_sets([t for _, t in docs]))
    texts = {t or "": w for (_, t), w in zip(docs, weights, strict=True)}
    names, root = list(texts), {t: t for t in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(names):
        for y in names[:i]:
            if texts[x] and texts[y] and jaccard(texts[x], texts[y]) >= 0.8:
                root[find(x)] = find(y)
    members = defaultdict(list)
    for i, t in docs:
        members[find(t or "")].append(i)
    out = Counter()
    for i, t in docs:
        m = members[find(t or "")]
        first = min(m, key=lambda x: (x is not None, x or 0))
        out[(i, first, len(m), i == first)] += 1
    return out


def check(make_docs, docs):
    frame = make_docs(docs)
    got = Counter(tuple(r) for r in nd.near_groups(frame).drop("_h").collect())
    assert got == brute(docs)
    kept = nd.drop_near_duplicates(frame)
    assert kept.columns == frame.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(k[0] for k, n in got.items() for _ in range(n) if k[3])


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.random()}"
    return words


def test_brute_force(make_docs, words):
    rng = random.Random(4)
    docs, n = [], 0
    for g in range(12):
        base = words(g, 120 + 40 * g, 100_000)
        docs.append((n, " ".join(base)))
        n += 1
        for k in range(1 + g % 5):
            docs.append((n, (", " if k % 2 else "\n").join(edited(rng, base, 1 + k)).upper()))
            n += 1
    chain = words(99, 200, 100_000)
    for _ in range(12):  # neighbours are similar, far ones aren't
        docs.append((n, " ".join(chain)))
        chain = chain[9:] + words(1000 + n, 9, 100_000)
        n += 1
    docs += [(500, None), (501, ""), (502, "..."), (503, "one two"), (504, "one, two!"), (505, "three"), (506, "Three."), (None, docs[0][1]), (507, docs[0][1]), (507, docs[0][1]), (508, " ".join(words(5, 30_000, 90_000)))]
    check(make_docs, docs)


def test_hub_and_common_passage(make_docs, words):
    rng = random.Random(7)
    passage = words(1, 60, 9999)
    docs = [(i, " ".join(words(10 + i, 70, 100_000) + passage)) for i in range(40)]
    base = words(3, 150, 100_000)
    docs += [(100 + i, " ".join(edited(rng, base, 2 + i % 3))) for i in range(60)]
    check(make_docs, docs)


def test_empty(make_docs):
    check(make_docs, [])
    check(make_docs, [(1, None)])


def family(words, n, of=120, edits=14):
    """Near copies of one text that differ among themselves, most pairs below the similarity."""
    rng, base = random.Random(1), words(3, of, 100_000)
    return [(i, " ".join(edited(rng, base, rng.randrange(edits // 2, edits)))) for i in range(n)]


def test_comparisons_follow_the_members(make_docs, words, monkeypatch):
    counts, similar = [], nd._similar

    def counting(pairs, *rest):
        counts.append(pairs.count())
        return similar(pairs, *rest)

    monkeypatch.setattr(nd, "_similar", counting)
    per = []
    for n in (400, 1600):
        counts.clear()
        assert nd.near_groups(make_docs(family(words, n))).count() == n
        per.append(sum(counts) / n)
    assert per[1] < nd.BANDS * len(nd.STEPS) and per[1] < 1.3 * per[0] + 5


def test_recall_of_links(make_docs, words):
    """Of all pairs that are similar, those in one group: in a crowd of near copies, and planted one by one."""
    docs, rng, n = family(words, 300, of=650, edits=3), random.Random(2), 1000
    for g in range(150):
        base = words(100 + g, 150, 100_000)
        docs += [(n, " ".join(base)), (n + 1, " ".join(edited(rng, base, g % 4)))]
        n += 2
    group = {r.doc_id: r.class_id for r in nd.near_groups(make_docs(docs)).collect()}
    sets = weighted(word_sets([t for _, t in docs]))
    similar = [(docs[i][0], docs[j][0]) for i in range(len(docs)) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8]
    assert len(similar) > 300
    assert sum(group[x] == group[y] for x, y in similar) >= 0.99 * len(similar)


@pytest.mark.parametrize(("shared", "n"), [(0.3, 400), (0.5, 400), (0.8, 400), (0.95, 400), (0.8, 20_000)])
def test_samples_agree_with_similarity(shared, n):
    rng = np.random.default_rng(3)
    hits, total, sims = 0, 0, []
    for _ in range(40 if n < 1000 else 8):
        both = rng.integers(1, 2**63, int(n * shared), dtype=np.uint64)
        rest = [rng.integers(1, 2**63, (n - len(both)) // 2, dtype=np.uint64) for _ in range(2)]
        pair = [np.sort(np.concatenate([both, x])) for x in rest]
        sets = [(x, 1.0 + (x % np.uint64(3)).astype(np.int64)) for x in pair]
        sims.append(nd.similarity(*sets[0], *sets[1]))
        a, b = (nd.samples(s, w) for s, w in sets)
        hits += int((a == b).sum())
        total += nd.SAMPLES
        assert (nd.bands(a) == nd.bands(b)).sum() <= (a == b).sum() // nd.ROWS
    assert abs(hits / total - np.mean(sims)) < 0.04


@pytest.mark.parametrize("share", [nd.SHARE, 500])
def test_frequencies_are_exact(spark, make_docs, words, monkeypatch, share):
    monkeypatch.setattr(nd, "SHARE", share)
    passage = words(1, 60, 9999)
    docs = [(i, " ".join(words(10 + i, 300, 100_000) + (passage[: 5 + i] if i < 50 else []))) for i in range(200)] + [(300, " ".join(passage)), (301, " ".join(passage))]
    with Scratch(spark, "test") as scratch:
        of = nd.frequencies(make_docs(docs).select("text"), scratch)
    for (_, t), w in list(zip(docs, weighted(word_sets([t for _, t in docs]), share), strict=True))[::7]:
        got = of.weights(*nd.shingles(t.encode()))
        assert np.allclose(np.sort(got), np.sort(list(w.values())))
    assert len(of.known) <= share


def test_weights_of_few_long_texts(spark, make_docs, words, monkeypatch):
    """A share of the shingles may be more than there are texts; no shingle is in more texts than that."""
    monkeypatch.setattr(nd, "SHARE", 500)
    docs = [(i, " ".join(words(i, 4000, 100_000))) for i in range(2)]
    with Scratch(spark, "test") as scratch:
        of = nd.frequencies(make_docs(docs).select("text"), scratch)
    for _, t in docs:
        s, times = nd.shingles(t.encode())
        weights = of.weights(s, times)
        assert np.allclose(weights, times) and np.isfinite(np.log(weights)).all()


def test_no_link_is_left_to_the_leaders(make_docs, words, monkeypatch):
    """Without any link that the leaders find, what shares a large set still comes into one group."""
    found = nd._links

    def no_links(*args):
        links, members = found(*args)
        return links.limit(0), members

    monkeypatch.setattr(nd, "_links", no_links)
    monkeypatch.setattr(nd, "BLOCK", 16)
    docs = family(words, 60, of=650, edits=3)
    group = {r.doc_id: r.class_id for r in nd.near_groups(make_docs(docs)).collect()}
    sets = weighted(word_sets([t for _, t in docs]))
    similar = [(i, j) for i in range(len(docs)) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8]
    assert len(similar) > 300 and all(group[i] == group[j] for i, j in similar)


def test_pairs_that_share_a_set_but_no_group(spark, monkeypatch):
    """Against every pair of the sets, for sets of several blocks."""
    monkeypatch.setattr(nd, "BLOCK", 8)
    rng = np.random.default_rng(5)
    base = rng.integers(-128, 128, nd.SAMPLES)
    marks = {k: np.where(rng.random(nd.SAMPLES) < 0.15, rng.integers(-128, 128, nd.SAMPLES), base).tolist() for k in range(60)}
    rows = spark.createDataFrame([(k, m) for k, m in marks.items()], "row long, marks array<byte>")
    of = {1: range(40), 2: range(30, 60), 3: range(0, 60, 9), 4: range(20)}
    label = {k: 0 if k < 20 else k - k % 3 for k in range(50)}  # others have none: a group of their own
    members = spark.createDataFrame([(s, k, len(x)) for s, x in of.items() for k in x], "sid long, node long, n long")
    got = {tuple(r) for r in nd._missed(members, spark.createDataFrame(list(label.items()), "node long, label long"), rows).collect()}
    agree = lambda x, y: sum(p == q for p, q in zip(marks[x], marks[y], strict=True)) >= nd.AGREE
    want = {(x, y) for s in of.values() if len(s) > nd.ALL for x in s for y in s if x < y and label.get(x, x) != label.get(y, y) and agree(x, y)}
    assert got == want and 0 < len(want)


def test_rows_follow_the_members_of_an_unlike_crowd(spark, make_docs, words, monkeypatch):
    """Pairs that agree in their samples and are not similar are compared where they meet, and make no rows."""
    made, missed = [], nd._missed

    def counting(members, labels, rows, shared, scratch):
        every = scratch.written
        monkeypatch.setattr(scratch, "written", lambda df, name: (out := every(df, name), name == "facing" and made.append(out.count()))[0])
        more = missed(members, labels, rows, shared, scratch)
        made.append((more.count(), missed(members, labels, rows).count()))
        return more

    monkeypatch.setattr(nd, "_missed", counting)
    docs = family(words, 150, of=650, edits=6)
    assert nd.near_groups(make_docs(docs)).count() == len(docs)
    facing, (links, pairs) = made
    assert pairs > 10 * len(docs) and links < len(docs) and facing <= 2 * nd.BANDS * len(docs)


def test_blocks_of_many_bytes_are_split(make_docs, words, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK_BYTES", 4000)
    test_no_link_is_left_to_the_leaders(make_docs, words, monkeypatch)
