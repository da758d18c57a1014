import random
import zlib

import numpy as np

from stratalex.llm import toxicity


def corpus(seed, n):
    r = random.Random(seed)
    stems = ["scumo", "idiota", "trashy"]
    for i in range(n):
        toxic = r.random() < 0.15
        w = [f"{r.choice('abcdefgh')}{r.randrange(300)}" for _ in range(r.randrange(5, 80))]
        if toxic:
            w += [r.choice(stems) + r.choice(["", "en", "ete"]) for _ in range(2)]
            r.shuffle(w)
        yield i, " ".join(w), int(toxic)


def test_held_out_accuracy_and_edges(spark, make_docs):
    rows = list(corpus(1, 3000))
    docs = make_docs([(i, t) for i, t, _ in rows] + [(9000, None), (9001, ""), (9002, "zz " * 100_000), (5, "again"), (None, "null id")])
    labels = spark.createDataFrame([(i, y, 1) for i, _, y in rows] + [(None, 1, 1), (7, None, 1)], "doc_id long, toxic int, text int")
    model = toxicity.fit(docs, labels)
    got = {(r.doc_id, i): r for i, r in enumerate(toxicity.score(docs, model).orderBy("doc_id").collect())}
    assert len(got) == 3005
    truth = {i: y for i, _, y in rows}
    right = total = 0
    for (i, _), r in got.items():
        assert r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
        if r.held_out and i in truth:
            total += 1
            right += truth[i] == r.predicted
    assert total > 500 and right >= 0.95 * total
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r.predicted == 0 for r in got.values())


def test_held_out_labels_and_ids_have_no_part(spark, make_docs):
    rows = list(corpus(2, 600))
    docs = make_docs([(i, t) for i, t, _ in rows])
    flip = [(i, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, _, y in rows]
    a = toxicity.fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    b = toxicity.fit(docs, spark.createDataFrame(flip, "doc_id long, toxic int"))
    assert a == b


def test_no_labels(spark, make_docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(make_docs([(1, "a")]), none)
    assert toxicity.score(make_docs([(1, "a")]), model).first().predicted == 0
    assert toxicity.score(make_docs([]), toxicity.fit(make_docs([]), none)).count() == 0


def numeric(f, x, step=1e-5):
    out = np.zeros_like(x)
    for i in range(len(x)):
        to = np.zeros_like(x)
        to[i] = step
        out[i] = (f(x + to) - f(x - to)) / (2 * step)
    return out


def test_gradients_of_the_risk():
    r = np.random.default_rng(1)
    toxic = [sorted(set(r.integers(0, 8, 4).tolist())) for _ in range(9)] + [[]]
    other = [sorted(set(r.integers(0, 8, 3).tolist())) for _ in range(30)]
    p, u = toxicity._Rows(toxic, 8), toxicity._Rows(other, 8)

    def plain(x):  # the risk by its definition, text by text
        f = lambda words: sum(x[w] for w in words) + x[-1]
        loss = lambda z: np.log1p(np.exp(-z))
        mean = lambda rows, sign: np.mean([loss(sign * f(t)) for t in rows])
        return 0.3 * mean(toxic, 1), mean(other, -1) - 0.3 * mean(toxic, -1)

    signs = set()
    for scale in (0.1, 1.0, 6.0):
        x = r.normal(0, scale, 9)
        on_toxic, on_clean, of_toxic, of_clean = toxicity.risks(x, p, u, 0.3)
        assert np.allclose((on_toxic, on_clean), plain(x))
        assert np.allclose(of_toxic, numeric(lambda y: plain(y)[0], x), atol=1e-6) and np.allclose(of_clean, numeric(lambda y: plain(y)[1], x), atol=1e-6)
    x = np.array([9.0] * 8 + [-60.0])
    signs.add(toxicity.risks(x, toxicity._Rows([[0, 1, 2, 3, 4, 5, 6, 7]] * 3, 8), u, 0.9)[1] < 0)
    assert signs == {True}  # the bracket can fall below zero


def test_against_learning_unlabelled_texts_as_clean():
    """With many toxic texts among the unlabelled ones, taking those for clean finds fewer."""
    r = np.random.default_rng(2)
    text = lambda toxic: sorted({int(r.integers(0, 6) if toxic and r.random() < 0.7 else r.integers(6, 40)) for _ in range(3)})
    toxic, hidden, clean = [text(True) for _ in range(150)], [text(True) for _ in range(300)], [text(False) for _ in range(700)]
    found = {}
    for name, prior in (("prior", 0.3), ("plain", None)):
        if prior:
            w, b = toxicity.fit_nnpu(toxic, hidden + clean, 40, prior)
        else:  # all unlabelled as clean, by the same steps
            p, u = toxicity._Rows(toxic, 40), toxicity._Rows(hidden + clean, 40)
            x = np.zeros(41)
            for _ in range(3000):
                x -= 0.5 * (p.back((toxicity._sigmoid(p.values(x[:-1], x[-1])) - 1) / 1150) + u.back(toxicity._sigmoid(u.values(x[:-1], x[-1])) / 1150))
            w, b = x[:-1], x[-1]
        f = lambda t: sum(w[k] for k in t) + b  # noqa: B023, E731
        found[name] = np.mean([f(t) > 0 for t in hidden]), np.mean([f(t) > 0 for t in clean])
    assert found["prior"][0] > found["plain"][0] + 0.1 and found["prior"][1] < 0.1


def test_risk_is_lowered_by_fit():
    r = np.random.default_rng(0)
    toxic = [[0, int(r.integers(2, 20))] for _ in range(50)]
    other = [[1, int(r.integers(2, 20))] for _ in range(180)] + toxic[:20]
    w, b = toxicity.fit_nnpu(toxic, other, 20, 0.1)
    assert w[0] + b > 0 > w[1] + b


def test_workers_get_few_texts_at_a_time(spark, make_docs, monkeypatch):
    """Rows of a batch while the sample's words are cut; before, Spark's 10 000 with all their words and beginnings."""
    rows, written = [], toxicity.written

    def recorded(df, label):
        rows.append(int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")))
        return written(df, label)

    monkeypatch.setattr(toxicity, "written", recorded)
    found = list(corpus(3, 300))
    toxicity.fit(make_docs([(i, t) for i, t, _ in found]), spark.createDataFrame([(i, y) for i, _, y in found], "doc_id long, toxic int"))
    assert rows and max(rows) <= 1000
