"""HTML extraction: names that merely contain a word of boilerplate lose no text, on any partitioning; names made of such words do."""

import pytest

from stepfold.llm import wrappers

KEPT = '<section class="side-effects"><p>nausea {n}</p></section><h2 id="Related_work">Related {n}</h2><div class="search-algorithms">binary {n}</div><ul class="menu-items"><li id="search">soup {n}</li></ul><p id="comments">said {n}</p><div id="header-files">stdio {n}</div>'
GONE = '<div class="cookie-banner">We use cookies</div><div class="ad-slot-3">Buy {n}</div><nav>Home</nav><div id="comments">first {n}!</div><div class="share_buttons">Tweet</div><ul class="related-posts"><li>Other {n}</li></ul><div role="search">find</div><section id="newsletter-form">mail</section>'
TEXT = "nausea {n} Related {n} binary {n} soup {n} said {n} stdio {n}"
PAGES = {
    "article": "<html><body><header>Site</header><article><h1>Title {n}</h1>" + KEPT + GONE + "</article><footer>End</footer></body></html>",
    "plain": '<html><body><div class="site-header">Site</div><div class="page"><h1>Title {n}</h1>' + KEPT + GONE + '</div><div class="site-footer">End</div></body></html>',
}


@pytest.mark.parametrize("partitions", [1, 8, 40])
def test_names(spark, partitions):
    pages = [(100 * k + i, f"http://{host}.example/{i}", page.replace("{n}", str(i))) for k, (host, page) in enumerate(PAGES.items()) for i in range(30)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(partitions)
    got = {r.page_id: r.text for r in wrappers.extract(spark, frame).collect()}
    assert got == {100 * k + i: f"Title {i} " + TEXT.replace("{n}", str(i)) for k in range(2) for i in range(30)}


@pytest.mark.parametrize("name,is_mark", [("ad", True), ("ads-top", True), ("sidebar", True), ("left-sidebar", True), ("main-nav", True), ("comment-list", True), ("breadcrumbs", True), ("side-effects", False), ("Related_work", False), ("headers", False), ("search-algorithms", False), ("menu-items", False), ("main", False), ("page", False), ("advertisement", True), ("loading", False), ("", False)])
def test_marks(name, is_mark):
    assert wrappers.marks(name) is is_mark
