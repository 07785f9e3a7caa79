"""Personal data: terms far from an entity and at the edges of a text count as well."""

import math
import re
from collections import defaultdict

from stepfold.llm import pii

from . import cases
from .test_native import TERM, base


def brute(texts):
    n, both, terms, entities = len({t or "" for t in texts}), defaultdict(set), defaultdict(set), defaultdict(set)
    for text in set(t or "" for t in texts):
        for w in set(TERM.findall(text.lower())):
            terms[w].add(text)
        masked = text
        for _, a, b, _ in base(text):
            masked = masked[:a] + " " * (b - a) + masked[b:]
        for k, _, _, v in base(text):
            entities[k, v.lower()].add(text)
            for w in TERM.findall(masked.lower()):
                both[w, (k, v.lower())].add(text)
    return {w for (w, e), x in both.items() if len(x) >= pii.SUPPORT and 1 + math.log(len(x) / max(len(terms[w]), len(x))) / -math.log(min(0.5, len(entities[e]) / max(n, 2))) >= pii.DISCLOSURE}


def test_terms_of_whole_texts(spark):
    far = [f"Lindqvist {i} " + "and so on " * 30 + f"write to kl@example.org {i}" for i in range(6)]
    edges = [f"Alice{' ' * (i + 1)}alice@x.org" for i in range(3)] + [f"bob@x.org{' ' * (i + 1)}Bobby" for i in range(3)]
    rest = [f"other words and so on, write to them {i}" for i in range(30)]
    texts = [*cases.TEXTS, *far, *edges, *rest, far[0], rest[0], rest[0]]
    for limit in (pii.BROADCAST_ROWS, 0):
        old, pii.BROADCAST_ROWS = pii.BROADCAST_ROWS, limit
        rows = pii.report(spark, cases.docs(spark, texts)).collect()
        pii.BROADCAST_ROWS = old
        terms = brute(texts)
        assert {"lindqvist", "alice", "bobby"} <= terms and not terms & {"and", "write", "words"}
        assert len(rows) == len(texts)
        for r in rows:
            text = texts[r.doc_id] or ""
            want = [f"term:{m.start()}:{m.end()}" for m in TERM.finditer(text) if m[0].lower() in terms and not any(a < m.end() and m.start() < b for _, a, b, _ in base(text))]
            assert re.findall(r"term:\d+:\d+", r.spans) == want
