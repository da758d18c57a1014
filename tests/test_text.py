import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalex.functions import embedding, enrich, urls
from stratalex.functions import text as T
from stratalex.operators import chunking, web


def values(spark, rows, make):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string")
    return [r.v for r in df.select("i", make(F.col("x")).alias("v")).orderBy("i").collect()]


def test_formulas(spark):
    assert values(spark, ["$$a$$ b $$c$$", "$$$$", "$a$", None], T.formula_blocks) == [2, 1, 0, 0]
    assert values(spark, [r"\frac{1}{2}", r"\FRAC{1}", r"\frac12", r"$\pi$", None], T.has_latex) == [True, True, False, False, False]
    wrap = [r"x \frac{1}{2} y", r"\pi r<b>", r"$$\frac{1}{2}$$", r"\FRAC{1}{2}", None]
    assert values(spark, wrap, T.wrap_latex) == [r"x $$\frac{1}{2} y$$", r"\pi r<b>", r"$$\frac{1}{2}$$", r"\FRAC{1}{2}", None]
    assert values(spark, [r"\(x\)", r"\[x\]", "<math>y</math>", '<script type="math/tex"> z </script>'], T.normalise_formulas) == ["$x$", "$$x$$", "$$y$$", "$$z$$"]


def test_snippets_and_tags(spark):
    assert values(spark, ["a" * 150, "a" * 151, None], T.snippet) == ["a" * 150, "a" * 150 + "...", None]
    assert values(spark, [" a<b>c</b> ", "&lt;p&gt;x"], T.strip_tags) == ["ac", "x"]
    assert values(spark, ["Short", "a. line long enough to be kept here.\n12\nISBN 1\nthe end of the page is here too."], T.clean_page) == ["", "a. line long enough to be kept here.\nthe end of the page is here too."]


def test_urls(spark):
    got = values(spark, ["HTTP://Ex.com:8080/a/b/#f", "http://ex.com", "http://ex.com/a/?q=x/", "ftp://x"], urls.normalise)
    assert [g and g.replace("HTTP", "http") for g in got] == ["http://ex.com:8080/a/b", "http://ex.com/", "http://ex.com/a/?q=x", None]
    assert values(spark, ["http://ex.com/a/b.html", "http://ex.com/"], urls.source_name) == ["ex_com_b", "ex.com_index"]
    assert values(spark, ["http://m.ex.com/", "http://badex.com/", "http://ex.com/"], lambda c: urls.in_domains(c, ["ex.com"])) == [True, False, True]
    assert values(spark, ["http://x/"], lambda c: urls.in_domains(c, [])) == [True]


@pytest.mark.parametrize(("scores", "stage"), [((0, 0, 0, 0), "junior"), ((0, 0, 0, 1), "university"), ((0, 0, 1, 1), "senior"), ((1, 1, 0, 0), "primary"), ((0, 1, 1, 0), "junior")])
def test_stage_ties(spark, scores, stage):
    assert spark.range(1).select(enrich.detect_stage(*map(F.lit, scores))).first()[0] == stage


def test_types(spark):
    assert values(spark, ["求证x", "如图1", "求f(x)的值域", "计算1+1", "none"], enrich.question_type) == ["proof", "geometry", "function", "calculation", "general"]
    assert values(spark, ["Exam", "lecture", "x", "textbook exam"], lambda c: enrich.source_type(c, F.lit(""))) == ["exam", "lecture", "textbook", "textbook"]
    assert values(spark, ["senior"], lambda c: enrich.enhance_query(F.lit("x"), F.lit("junior"))) == ["初中 课内 x 中考考点"]
    assert enrich.allowed_stages("senior") == ["primary", "junior", "senior"]
    assert enrich.allowed_stages("junior", True) == ["primary", "junior", "university"]
    assert enrich.allowed_stages("unknown") is None
    weight = spark.createDataFrame([("university", 0.85), ("senior", 0.0)], "g string, w double").select(F.round(enrich.result_weight(F.col("g"), F.col("w")), 4)).collect()
    assert [r[0] for r in weight] == [0.51, 1.0]


def test_embedding(spark):
    assert not embedding.embed("").any() and not embedding.embed("a").any()
    v = embedding.embed("ab")
    assert v[33] == 1.0 and np.count_nonzero(v) == 1
    assert embedding.word_slots(np.array([ord(c) for c in "polygenelubricants"])).tolist() == [0]
    texts = ["", "a", "ab", "abc", "中文 测试。句子", "Hello  World\tagain (x)", "polygenelubricants", None]
    fast, slow = (values(spark, texts, f) for f in (embedding.embed_local, embedding.embed_native))
    assert np.allclose(np.array(fast), np.array(slow), atol=1e-6)
    norms = np.linalg.norm(np.array(fast), axis=1)
    assert all(abs(n) < 1e-6 or abs(n - 1) < 1e-5 for n in norms)


def test_chunking():
    paragraphs = ["a" * 400, "b" * 300, "c" * 100]
    assert chunking.pack("\n\n".join(paragraphs)) == ["a" * 400, "b" * 300 + "\n\n" + "c" * 100]
    assert chunking.pack("x" * 900) == ["x" * 900]
    starts = [p[3] for p in chunking.pieces("\n\n".join(["a" * 600, "b" * 500, "c" * 300]))]
    assert starts == [0, 500, 500]
    assert list(chunking.pieces(None)) == [] and list(chunking.pieces("short")) == []
    formula = "$$" + "x\n\n" * 300 + "$$"
    assert chunking.pack("a\n\n" + formula + "\n\nb") == ["a\n\n" + formula + "\n\nb"]
    long = "\n".join(["Chapter 1 One", "p" * 1300, "Chapter 2 Two", "q" * 50])
    assert [chunking.chapter_title(s) for s in chunking.sections(long)] == ["Chapter 1 One", "Chapter 2 Two"]


def test_page_text():
    html = "<html><head><title>T</title></head><body><nav><a href='/n'>n</a></nav><article><h2>H</h2><p>One <b>two</b></p><ul><li>x</ul><table><tr><th>a<th>b<tr><td>1<td>2</table><pre>c</pre><img alt='pic'><a href='sub?q=1'>l</a></article></body></html>"
    text = web.page_text(html)
    for part in ("# T", "## H", "One two", "- x", "| a | b |\n| --- | --- |\n| 1 | 2 |", "```\nc\n```", "[图: pic]"):
        assert part in text
    assert web.page("http://h/d/", html, ["links"])["links"] == ["http://h/d/sub?q=1"]
    assert web.page("http://h/d/", html, ["links"], False)["links"] == ["http://h/n", "http://h/d/sub?q=1"]
    assert web.resolve_redirect("http://h/a", "/b c/é") == "http://h/b%20c/%C3%A9"
    assert web.page_text(None) == "" and web.page(None, "", ["tables"])["tables"] == []


def test_wrapping_in_the_jvm_equals_python(spark):
    import random

    r = random.Random(3)
    bits = ["$", "$$", "\\frac{1}{2}", "\\pi", "\\PI", "\\sum_i x", "\\foo", "\\", " ", "\n", "<b>", "x", "\\in1", "\\alpha ", "é", "\t\\sqrt2\n"]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(14))) for _ in range(3000)] + [None, "", "$$", "\\frac{1}{2}" + "y" * 50_000]
    assert values(spark, texts, T.wrap_latex) == [T.wrap_formulas(t) for t in texts]
    plan = spark.createDataFrame([("x",)], "t string").select(T.wrap_latex("t"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
