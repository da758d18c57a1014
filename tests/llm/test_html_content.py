import html
import re

from stratalex.llm import html_content

PARAGRAPHS = ["The first paragraph has a sentence, and one more.", "Second one: it is longer, with commas, points. And text!", "Third &amp; last &lt;one&gt; — done."]


def page(body, head="<title>T</title>"):
    return f"<!DOCTYPE html><html><head>{head}<style>p{{x}}</style><script>var a='<p>no</p>';</script></head><body>{body}</body></html>"


def test_boilerplate_goes():
    ps = "".join(f"<p>{p}" for p in PARAGRAPHS)
    extra = "<nav><ul><li><a>Menu</a></li></ul></nav><div class='cookie-notice'>We use cookies, see our policy. Accept all of it.</div><header>Site name, slogan.</header>"
    tail = "<aside>Side, bar. Links.</aside><form><input><label>Name</label>Send us mail.</form><section id=comments><p>A reader says something, long. Very long indeed, it is.</p></section><footer>&copy; all, rights.</footer>"
    want = "Head " + html.unescape(" ".join(PARAGRAPHS))
    for wrap in ("<article><h1>Head</h1>{}</article>", "<main><div class='content with-sidebar'><h1>Head</h1>{}</div></main>", "<div><h1>Head</h1>{}</div>"):
        assert html_content.main_text(page(extra + wrap.format(ps) + tail)) == want
    inside = f"<article><h1>Head</h1><div class='AdSlot'>Buy, now. It is good.</div>{ps}<div class='comment-list'><p>I, too, think so. Yes.</p></div></article>"
    assert html_content.main_text(page(extra + inside + tail)) == want


def test_white_space_and_inline_markup():
    text = html_content.main_text(page("<article><p>a<b>b</b>\n\n c&nbsp;d<br>e <!-- no --><i>f<p>g</i></p><ul><li>one, two<li>three. four</ul></article>"))
    assert text == "ab c d e f g one, two three. four"


def test_defined_cases(spark):
    assert html_content.main_text(None) == "" and html_content.main_text("") == "" and html_content.main_text("<html><body></body></html>") == ""
    assert html_content.main_text("just text, no tags.") == "just text, no tags."
    assert html_content.main_text("<article><p>a < b and c > d, so.") == "a < b and c > d, so."
    long = "word, and more. " * 60_000
    rows = [(1, "u", f"<article><p>{long}</p></article>", "x", "y"), (1, "u", None, "x", "y"), (None, None, "<p>t, u.", "x", "y"), (2, "u", "<article><p>a.</p>" * 3000, "x", "y")]
    got = html_content.extract(spark.createDataFrame(rows, "page_id long, url string, html string, id string, text string"))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    by = sorted((r.n_chars, r.page_id) for r in got.collect())
    assert by[0] == (0, 1) and by[-1] == (len(long.strip()), 1) and len(by) == 4
    assert html_content.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_generated_pages():
    import pyarrow.parquet as pq

    rows = pq.read_table("/root/testdata/sf0.1/pages.parquet").to_pylist()
    for r in rows[:1500]:
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1|br)>", " ", inner))).split())
        assert html_content.main_text(r["html"]) == want


def test_content_outside_the_largest_element():
    body = " ".join(f"Sentence number {i}, of the body. It goes on, and on; here." for i in range(12))
    lead = "A lead of one sentence, or two."
    got = html_content.main_text(page(f"<div><h1>Title</h1><p>{lead}</p><div class=body><p>{body}</p><p>{body}</p></div></div>"))
    assert got == f"Title {lead} {body} {body}"
    intro = "The intro stands before the list, and says what is in it."
    items = [f"Item {i}, with a sentence. And another, longer one." for i in range(20)]
    got = html_content.main_text(page(f"<div><p>{intro}</p><ul>{''.join(f'<li>{x}</li>' for x in items)}</ul></div>"))
    assert got == " ".join([intro, *items])


def test_ratios_decide_in_an_article():
    body = "".join(f"<p>Sentence number {i}, of the body. It goes on, and on; here. {'More, and more. ' * 12}</p>" for i in range(6))
    tail = "".join(f"<div class=x><a href=#>Link {i}</a></div>" for i in range(30))
    for wrap in ("<article>{}</article>", "<div>{}</div>"):
        got = html_content.main_text(page(wrap.format(f"<h1>Title</h1>{body}<h2>Part</h2>{body}<ul>{''.join(f'<li>item {i}</li>' for i in range(9))}</ul>{tail}")))
        assert got.startswith("Title Sentence") and " Part Sentence" in got and got.endswith(" item 8")


def test_names_of_boilerplate_are_whole():
    lead = "The first paragraph has a sentence, and one more; it is long enough to be read. And so on, it goes."
    for attrs in ('data-id="ad"', 'title="x class=ad"', 'class="legal-history"', 'class="related-work"', 'class="social"', "data-x='a>b' class=lead", 'class="with-sidebar-notes"', 'id="comment-on-the-law"', "class"):
        got = html_content.main_text(page(f"<article><p {attrs}>{lead}</p><p>{lead}</p></article>"))
        assert got == f"{lead} {lead}", attrs
    for attrs in ('class="x ad"', "CLASS=Ad", "id='site-footer'", 'class="cookieNotice"', 'class="comment-list"', 'role="navigation"', "hidden", 'aria-hidden="true"', 'style="color:red; display: none"'):
        got = html_content.main_text(page(f"<article><div {attrs}><p>{lead}</p></div><p>{lead}</p></article>"))
        assert got == lead, attrs
    math = "<p>Let <math><mi>x</mi></math> be one, and <svg><text>y</text></svg> two; so it is, and so on it goes.</p>"
    assert html_content.main_text(page(f"<article>{math}</article>")) == "Let x be one, and y two; so it is, and so on it goes."


def test_without_telling_names(monkeypatch):
    """Pages of plain ``div`` whose names say nothing: the ratios alone choose."""
    body = [f"Sentence number {i}, of the body. It goes on, and on; here. {'More, and more of it. ' * 8}".strip() for i in range(8)]
    menu = "".join(f'<div class=q1><div class=q2><a href="/{i}">Entry {i}</a></div></div>' for i in range(25))
    foot = "".join(f"<div class=q9><span>{w}</span></div>" for w in ("Imprint", "Contact", "Top", "2020 Name", "Help"))
    source = page(f"<div class=q0>{menu}</div><div class=q3><h1>Title</h1>{''.join(f'<div class=q4>{b}</div>' for b in body)}</div><div class=q8>{foot}</div>")
    assert html_content.main_text(source) == " ".join(["Title", *body])
    monkeypatch.setattr(html_content, "THRESHOLD", -1e9)
    assert "Entry 3" in html_content.main_text(source)  # without the ratios


def test_any_depth_and_broken_markup():
    import time

    text = "A sentence, at the end. And one more, here."
    n = 100_000
    cases = {
        "<div>" * n + text: text,
        "".join(f"<div class=c{i}>" for i in range(n)) + text: text,
        "<div>" * n + "</b>" * n + text: text,
        "<b>" * (n // 4) + "<div></div>" * (n // 4) + text: text,
        "<li><ul>" + "<blockquote>" * (n // 4) + "<li></li>" * (n // 4) + text: text,
        f"<p>{text}" + '<a b="' * n + ">": text,
        f"<p>{text}" + '<a "' * n: text,
        f"<p>{text}" + "<!--" * n: text,
        f"<p>{text}" + "<script>" * n: text,
    }
    began = time.process_time()
    for source, want in cases.items():
        assert html_content.main_text(source) == want, source[:40]
    assert time.process_time() - began < 60
