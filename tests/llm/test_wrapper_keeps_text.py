"""HTML extraction: titles, leads and constant headings of hosts without an article stay, whatever the number of pages."""

import pytest

from stepfold.llm import wrappers

PAGE = """<body><div id="menu"><a>Ingredients</a></div><div class="top"><p>Welcome</p></div><div class="page"><h1>Title {n}</h1><div class="lead">{lead}</div>
<div class="text"><h2>Ingredients</h2><p>{text}</p></div></div></body>"""


@pytest.mark.parametrize("n", [5, 8])
def test_title_lead_and_headings_stay(spark, n):
    lead, text = (lambda i: f"lead {i} " * 12), (lambda i: f"text {i} " * 30)
    pages = [(i, f"http://a.example/{i}", PAGE.format(n=i, lead=lead(i), text=text(i))) for i in range(n)]
    got = {r.page_id: r.text for r in wrappers.extract(spark, spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {i: " ".join(f"Title {i} {lead(i)} Ingredients {text(i)}".split()) for i in range(n)}


def test_a_constant_heading_above_all_of_the_text_stays():
    w = None
    for i in range(6):
        one = wrappers.wrap(wrappers.parse(f"<body><div class=top>Hi</div><div class=text><h2>Ingredients</h2><div class=steps><p>text {i}</p></div></div></body>"))
        w = one if w is None else wrappers.merge(w, one)
    assert wrappers.rule(w) == ["body", "div text"]


def test_an_article_with_most_of_the_text_is_the_main_text():
    page = "<body><div><p>teaser {n}</p><article><h1>T {n}</h1><p>" + "long text {n} " * 9 + "</p></article></div></body>"
    w = wrappers.wrap(wrappers.parse(page.format(n=0)))
    for i in range(1, 6):
        w = wrappers.merge(w, wrappers.wrap(wrappers.parse(page.format(n=i))))
    assert wrappers.rule(w) == ["body", "div", "article"]
