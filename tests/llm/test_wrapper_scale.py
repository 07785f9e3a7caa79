"""HTML extraction: deep pages, many pages, long lists, and hosts whose wrapper decides."""

import random
import time

from stepfold.llm import wrappers

SITE = """<html><body id="p-{n}"><div class="masthead-x"><p>Our offers this week</p><p>Call us</p></div>
<div class="c7" id="entry-{n}"><div class="story" id="s{n}"><h2>Head {n}</h2><p>{text}</p><p>Ingredients</p></div></div>
<div class="box" id="b-{n}"><p>Five ways to save</p><ul><li>one</li><li>two</li></ul></div></body></html>"""


def folded(pages):
    w = None
    for x in pages:
        one = wrappers.wrap(wrappers.parse(x))
        w = one if w is None else wrappers.merge(w, one)
    return w


def size(w):
    return 1 + (sum(map(size, w[3])) if isinstance(w[3], list) else 0)


def site(n):
    return SITE.format(n=n, text=f"words of page {n} " * 9)


def test_the_wrapper_decides(spark):
    """Neither tags nor names tell the main text here: without the wrapper every page has the template's text too."""
    pages = [(n, f"http://a.example/{n}", site(n)) for n in range(40)]
    got = {r.page_id: r.text for r in wrappers.extract(spark, spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    want = {n: f"Head {n} {' '.join(f'words of page {n} ' for _ in range(9))} Ingredients" for n in range(40)}
    assert got == {n: " ".join(x.split()) for n, x in want.items()}
    assert all(wrappers.main_text(html, None) != got[n] for n, _, html in pages)


def test_wrappers_do_not_grow_with_the_pages():
    few, many = folded(map(site, range(200))), folded(map(site, range(2000)))
    assert size(many) <= size(few) + 2
    odd = [f"<body><div class=main><p>text {n}</p><div class=k{chr(97 + n % 26)}{chr(97 + n // 26 % 26)}x>own</div></div></body>" for n in range(600)]
    assert size(folded(odd)) < 3 * wrappers.RARE


def test_many_pages_take_linear_time():
    def seconds(n):
        start = time.process_time()
        folded(map(site, range(n)))
        return time.process_time() - start

    seconds(200)
    assert seconds(10_000) < 25 * max(seconds(1000), 0.05)


def test_deep_pages(spark):
    deep = "<div>" * 5000 + "<p>in</p>side" + "<nav>no</nav><p>more</p>" + "</div>" * 5000 + "<p>out</p>"
    rows = [(n, "http://deep.example/", deep) for n in range(3)] + [(3, "http://deep.example/", "<article>" * 3000 + "x<b>y</b>")]
    got = {r.page_id: r.text for r in wrappers.extract(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {0: "in side more out", 1: "in side more out", 2: "in side more out", 3: "xy"}


def test_long_pages_and_lists():
    words = " ".join(f"w{i}" for i in range(200_000))
    assert wrappers.main_text(f"<article><p>{words}</p></article>", None) == words
    rng = random.Random(1)
    one = [[f"div k{chr(97 + x % 26)}{x}", 1, 1, [], 1] for x in rng.choices(range(4000), k=3000)]
    two = one[:1000] + one[1500:] + one[:200]
    start = time.process_time()
    out = wrappers.align(one, two)
    assert time.process_time() - start < 5 and len(out) <= len(one) + len(two)


def test_common_subsequences():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.choice("abcdefgh") for _ in range(rng.randrange(12))] for _ in range(2))
        for limit in (0, 2500):
            old, wrappers.PAIRS = wrappers.PAIRS, limit
            pairs = wrappers._common(a, b)
            wrappers.PAIRS = old
            assert all(a[i] == b[j] for i, j in pairs)
            assert all(p < q and x < y for (p, x), (q, y) in zip(pairs, pairs[1:], strict=False))


def test_long_constants_are_told_by_hash():
    line = "terms and conditions " * 60
    w = folded(f"<body><div><p>{line}</p></div><div class=t><p>text {n} {'x' * n}</p></div></body>" for n in range(8))
    assert wrappers.rule(w) == ["body", "div t"]
