"""Ranked search against a plain ranking of all documents."""

import math
import random
import re
from collections import Counter

import pytest

from stepfold.llm import ranked_search
from stepfold.llm.common import Scratch

from . import cases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items, k):
    """(item, rank, doc, score), doc ids of equal scores in ascending order, null first."""
    rows = [(i, Counter(terms(t))) for i, t in docs]
    rows = [(i, c, sum(c.values())) for i, c in rows if c]
    n, total = len(rows), sum(x for _, _, x in rows)
    df = Counter(t for _, c, _ in rows for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, words in asked.items():
        scored = []
        for i, c, x in rows:
            m = 100 - 50 + (50 * x * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in words if t in c)
            if s > 0:
                scored.append((-s, (i is not None, i or 0), i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda x: x[:2])[:k], 1)]
    return Counter(out)


def run(spark, docs, items, **limits):
    path = Scratch(spark, "test").path("index")
    ranked_search.write_index(spark, docs, path)
    return Counter(map(tuple, ranked_search.search(spark, ranked_search.read_index(spark, path), items, **limits).collect()))


@pytest.mark.parametrize("limits", [{"k": 50}, {"k": 3}, {"k": 7, "broadcast_rows": 0}])
def test_same_as_all_documents(spark, limits):
    rng = random.Random(2)
    words = ["the", "of", "and", "Über", "日本語", "x1"] + [f"w{i}" for i in range(150)]
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(words[: rng.choice([6, 30, 156])]) for _ in range(n))
    copy = text(40)
    texts = [*cases.TEXTS, *(text(rng.randrange(1, 120)) for _ in range(250)), *[copy] * 70, "the " * 20000 + "w3"]
    docs = cases.docs(spark, texts, extra=True)
    docs = docs.union(docs.limit(9)).union(docs.where("doc_id in (30, 275)").withColumn("doc_id", docs.doc_id * None)).repartition(5)
    rows = [(1, copy), (2, text(30)), (2, text(5)), (2, text(5)), (3, None), (4, ""), (5, "nowhere"), (6, "THE Und x1 the"), (None, text(9)), (7, "...!?"), (8, "w3 w4 w5")]
    items = spark.createDataFrame(rows, "item_id long, text string")
    assert run(spark, docs, items, **limits) == brute([(r.doc_id, r.text) for r in docs.collect()], rows, limits["k"])


def test_empty_tables(spark):
    docs, items = cases.docs(spark), spark.createDataFrame([(1, "one two")], "item_id long, text string")
    assert run(spark, docs.limit(0), items) == run(spark, docs, items.limit(0)) == run(spark, docs.limit(3), items) == Counter()


def test_index_holds_every_term(spark):
    docs = cases.docs(spark)
    path = Scratch(spark, "test").path("index")
    ranked_search.write_index(spark, docs.repartition(3), path)
    index = ranked_search.read_index(spark, path)
    blocks = {r.block: r for r in index.where("bucket = -1").collect()}
    hits = [(r.term, blocks[r.block], *divmod(x, ranked_search.PLACE)) for r in index.where("bucket >= 0").collect() for x in r.hits]
    got = Counter((t, b.docs[k], n, b.lengths[k]) for t, b, k, n in hits)
    rows = [(r.doc_id, Counter(terms(r.text))) for r in docs.collect()]
    assert got == Counter((t, i, n, sum(c.values())) for i, c in rows for t, n in c.items())
    assert Counter(x for b in blocks.values() for x, n in zip(b.docs, b.lengths, strict=True) if n) == Counter(i for i, c in rows if c)
