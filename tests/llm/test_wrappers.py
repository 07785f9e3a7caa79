"""HTML extraction: planned pages, and an independent reading of the test pages."""

from collections import Counter
from html.parser import HTMLParser

import pytest

from stepfold.llm import wrappers

from . import cases


class Article(HTMLParser):
    """Text inside <article>, blocks apart."""

    BLOCK = {"p", "h1", "h2", "br", "div", "li"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.out = 0, []

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        if self.depth and tag in self.BLOCK:
            self.out.append(" ")

    def handle_endtag(self, tag):
        self.depth -= tag == "article"
        if self.depth and tag in self.BLOCK:
            self.out.append(" ")

    def handle_data(self, data):
        if self.depth:
            self.out.append(data)


def test_pages(spark):
    if not cases.has_data():
        pytest.skip("no test data")
    pages = spark.read.parquet(f"{cases.DATA.replace('0.001', '0.01')}/pages.parquet")
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in wrappers.extract(spark, pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        p = Article()
        p.feed(r.html)
        p.close()
        text = " ".join("".join(p.out).split())
        assert got[r.page_id, r.url] == (text, len(text)), r.html


PAGE = """<html><head><title>T {n}</title></head><body class="page"><div id="cookie-notice">We use cookies</div><div class="top menu"><a href=/>Home</a></div>
<div class="wrap"><div class="content"><h2>Head {n}</h2>{body}<form><input name=q><button>Go</button></form></div>
<div class="sidebar">Latest {n}</div></div><div class="comments"><p>Nice {n}!</p></div><div id="footer">Rights &copy; {n}</div></body></html>"""


def test_wrapper_without_an_article(spark):
    bodies = ["<p>One <b>bo</b>ld &amp; more</p>", "<p>A<p>B <i>c</i><br>d", "<ul><li>x<li>y</ul><p>z</p>", "<p>Long text of this page\n here</p>", "<p>e</p>", "<p>f</p><!-- <p>gone</p> --><script>var x='<p>no</p>'</script>"]
    want = ["One bold & more", "A B c d", "x y z", "Long text of this page here", "e", "f"]
    rows = [(i, f"http://Site.example:80/{i}", PAGE.format(n=i, body=b)) for i, b in enumerate(bodies)]
    rows += [(90, None, None), (91, "", ""), (92, "http://other.example/x", "plain &lt; text"), (93, "nonsense", "<article>a<b>b</b><nav>no</nav><aside>no</aside> c</article>tail"), rows[0]]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "url as text", "url as host", "html as wrapper")
    for limit in (wrappers.BROADCAST_ROWS, 0):
        old, wrappers.BROADCAST_ROWS = wrappers.BROADCAST_ROWS, limit
        got = Counter((r.page_id, r.text) for r in wrappers.extract(spark, pages).collect())
        wrappers.BROADCAST_ROWS = old
        assert got == Counter([*((i, f"Head {i} {t}") for i, t in enumerate(want)), (0, f"Head 0 {want[0]}"), (90, ""), (91, ""), (92, "plain < text"), (93, "ab c")])
    assert wrappers.extract(spark, pages.limit(0)).count() == 0


def test_alignment_finds_groups_slots_and_constants():
    a = wrappers.wrap(wrappers.parse("<body><ul><li>a</li><li>b</li></ul><p>same</p><p>x</p></body>"))
    b = wrappers.wrap(wrappers.parse("<body><div>new</div><ul><li>c</li></ul><p>same</p></body>"))
    w = wrappers.merge(a, b)
    body = w[3][0]
    assert [(c[0], c[1], c[2]) for c in body[3]] == [("div", 0, 1), ("ul", 1, 1), ("p", 1, 2)]
    li = body[3][1][3][0]
    assert li[:3] == ["li", 1, 2] and li[3][0][3] is None
    same = wrappers.merge(*(wrappers.wrap(wrappers.parse("<p>same</p>")) for _ in range(2)))
    assert same[3][0][3][0][3] == "same" and same[3][0][3][0][4] == 2
