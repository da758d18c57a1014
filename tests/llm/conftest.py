import random

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long, _id string, _h string, id int"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents with extra columns whose names clash with those inside the operators."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "y", 7) for i, t in rows], DOC)

    return make


@pytest.fixture(scope="session")
def words():
    def make(seed, n, vocabulary=400):
        r = random.Random(seed)
        return [f"w{r.randrange(vocabulary)}" for _ in range(n)]

    return make
