import html as entities
import re

from spoor.llm import html

SCHEMA = "page_id long, url string, html string, host string, path string, text string"


def frame(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "y", "z") for i, u, h in rows], SCHEMA)


def by_template(page):
    """The article of the generated pages, cut out by their one template."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = re.split(r"</?(?:p|h1|br|li|ul|div)\b[^>]*>", inner)
    texts = (re.sub(r"\s+", " ", entities.unescape(re.sub(r"<[^>]+>", "", p))).strip() for p in parts)
    return " ".join(t for t in texts if t)


def test_generated_pages(spark, sf):
    got = {r.page_id: r for r in html.op7_html(spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        assert got[r.page_id].text == by_template(r.html), r.page_id
        assert got[r.page_id].n_chars == len(got[r.page_id].text)


PAGE = """<!doctype html><html><head><title>T &amp; t</title><style>p{}</style></head><body class="home page-7">
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></ul></nav>
<div id="cookie-notice"><p>We use cookies, which is a long notice about nothing at all, dear reader.</p></div>
<div class="wrap"><div class="post post-%d"><h2>Head&nbsp;line &lt;1&gt;</h2><p>First   para<b>graph</b> of text, &eacute;t&#233;.<p>Second one<br>broken
line<ul><li>an item<li>another</ul><script>var a = "<p>no</p>";</script><form><p>Your mail?</p><input></form>
<div class="ad-slot"><p>Buy this now, it is cheap and good and much too long for an advert</p></div><blockquote>A quote.</blockquote></div>
<aside class="sidebar"><p>Related: <a href="#">some other story with a long title</a></p></aside>
<div class="comments"><div class="comment"><p>I am a reader and I write a very long comment, longer than the article itself. I am a reader and I write a very long comment, longer than the article itself. I am a reader and I write.</p></div></div>
</div><!-- <p>gone</p> --><footer>&copy; 2024</footer></body></html>"""
TEXT = "Head line <1> First paragraph of text, été. Second one broken line an item another A quote."


def test_rich_page_and_votes(spark):
    rows = [(i, f"http://h.example/{i}", PAGE % i) for i in range(6)]
    odd = PAGE.replace("post post-%d", "teaser") % ()
    rows += [(7, "http://h.example/odd", odd), (8, None, PAGE % 3), (9, "http://other.example", "<p>Just text &amp; more<p>and more")]
    got = {r.page_id: r.text for r in html.extract(frame(spark, rows)).collect()}
    assert {got[i] for i in (0, 1, 2, 3, 4, 5, 7, 8)} == {TEXT}
    assert got[9] == "Just text & more and more"
    votes = {html.best_path(html.parse(PAGE % i)) for i in range(5)}
    assert votes == {"body/div.wrap/div.post.post-#"}


def test_consensus_beats_a_page_s_own_choice():
    page = html.parse("<div class=body><p>short text</p></div><div class=extra><p>a much longer text that isn't the article</p></div>")
    assert html.main_text(page, ["body/div.body"]) == "short text"
    assert html.main_text(page, ["body/div.none"]) == "a much longer text that isn't the article"


def test_votes_count_decoded_characters(spark):
    page = "<div class=a><p>This is the text of the article.</p></div><div class=b><p>&nbsp;</p><p>&eacute;&eacute;&eacute;&eacute;&eacute;&eacute;&eacute;&eacute;</p></div>"
    got = html.extract(frame(spark, [(i, f"http://h.example/{i}", page) for i in range(3)])).collect()
    assert {r.text for r in got} == {"This is the text of the article."}


def test_edge_rows(spark):
    long = "<article>" + "<p>word &amp; word</p>" * 40000 + "</article>"
    rows = [(1, "http://a.b", None), (2, "http://a.b", ""), (3, "nonsense", "<<<>>> < a"), (4, "http://A.b:80/x", long), (4, "http://A.b:80/x", long), (None, None, "plain"), (5, "u", "<div><p>unclosed <a href='x>y'>link"), (6, "u", "<script>never ends <p>x"), (7, "u", "<!-- never ends <p>x"), (8, "u", "  \n")]
    got = sorted(((r.page_id, r.url, r.text) for r in html.extract(frame(spark, rows)).collect()), key=str)
    texts = {(i, t) for i, _, t in got}
    assert len(got) == len(rows)
    assert {(1, ""), (2, ""), (None, "plain"), (5, "unclosed link"), (6, ""), (7, ""), (8, "")} <= texts
    assert [t for i, _, t in got if i == 4] == [" ".join(["word & word"] * 40000)] * 2
    assert html.extract(frame(spark, rows).limit(0)).collect() == []


def test_deep_pages_and_unclosed_quotes():
    import time

    began = time.time()
    for page in ("<div>x" * 150_000, "<div>x</span></b>" * 60_000, "<p class='a>x" * 80_000, "<ul><li>x" * 100_000, "<table><tr><td>x" * 60_000):
        assert html.best_path(html.parse(page))
        assert "x" in html.main_text(html.parse(page), ["body/div.none"])
    assert time.time() - began < 60  # 5 MB of text; quadratic work would take hours
    assert html.main_text(html.parse('<p class="x>Hello</p><p>more text</p>'), []) == "Hello more text"
    assert html.main_text(html.parse("<div class=w-1/2><p>half</p></div>"), ["body/div.w-#|#"]) == "half"
