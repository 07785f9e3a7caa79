"""Periodic runs against a scan of every period."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stepfold.llm import runs

from . import cases


def brute(w, least=6, exponent=4):
    n, best = len(w), {}
    for p in range(1, n // exponent + 1):
        i = 0
        while i + p < n:
            if w[i] != w[i + p]:
                i += 1
                continue
            s = i
            while i + p < n and w[i] == w[i + p]:
                i += 1
            if i + p - s >= max(least, exponent * p):
                best.setdefault((s, i + p), p)
    return sorted(((s, e - s, p) for (s, e), p in best.items()), key=lambda x: (x[0], x[2]))


def collapsed(w, found):
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


@st.composite
def repetitive(draw):
    w = draw(st.lists(st.integers(0, 2), max_size=30))
    for _ in range(draw(st.integers(0, 3))):
        unit = draw(st.lists(st.integers(0, 2), min_size=1, max_size=7))
        at = draw(st.integers(0, len(w)))
        w[at:at] = (unit * 14)[: draw(st.integers(0, 14 * len(unit)))]
    return w


@settings(max_examples=300, deadline=None)
@given(st.lists(repetitive(), min_size=1, max_size=4), st.sampled_from([(6, 4), (1, 4), (9, 5)]))
def test_runs_of_every_period(texts, asked):
    counts = np.array([len(w) for w in texts])
    got = runs.find(np.array(sum(texts, []), np.int64), counts, *asked)
    assert [tuple(x) for x in got.tolist()] == [(r, *x) for r, w in enumerate(texts) for x in brute(w, *asked)]


def test_long_texts():
    text = np.concatenate([np.arange(50), np.tile(np.arange(1000), 100), np.zeros(200_000, np.int64), np.tile([1, 2, 1, 1, 1, 1, 1, 1], 9000)])
    got = runs.find(text, np.array([len(text)]), 6, 4)[:, 1:].tolist()
    # the first zero is the next word of the period before it, and the eight words of the last part hold seven equal ones across their ends
    assert [x for x in got if x[1] > 7] == [[50, 100_001, 1000], [100_050, 200_000, 1], [300_050, 72_000, 8]]
    assert [x for x in got if x[1] <= 7] == [[300_052 + 8 * k, 7 if k < 8999 else 6, 1] for k in range(9000)]


def test_operator_and_digest(spark):
    rng = random.Random(3)
    unit = [f"u{i}" for i in range(5)]
    texts = [*cases.TEXTS, "x x x x x", "x x x x x x", " ".join([*unit * 4, "end"]), "\t".join(rng.choice("ab") for _ in range(400)), "é é é é é é 😀", "A a A a A a A a"]
    docs = cases.docs(spark, texts, extra=True)
    docs = docs.union(docs.limit(5)).union(docs.where("doc_id = 16").withColumn("doc_id", docs.doc_id * None))
    rows = runs.detect(docs).collect()
    assert len(rows) == docs.count()
    by_text = {r.doc_id: r for r in rows}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        want = brute(w)
        assert (by_text[i].n_words, [tuple(x) for x in by_text[i].runs], by_text[i].collapsed) == (len(w), want, collapsed(w, want))


def test_planted_query(spark):
    texts = [" ".join(f"w{(i * k) % 97}" for i in range(20 + 3 * k)) for k in range(120)]
    got = {r.doc_id: r for r in runs.digest(runs.detect(runs.planted(cases.docs(spark, texts)))).collect()}
    for i, t in enumerate(texts):
        w = t.split()
        h, n = zlib.crc32(str(i).encode()), len(t.split())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[j] if j < a else w[a + (j - a) % p] for j in range(n)]
        found = brute(w)
        best = max(found, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=(None,) * 3)
        lines = "".join(f"{s},{n},{p}\n" for s, n, p in found)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        r = got[i]
        assert (r.n_runs, r.start, r.length, r.period) == (len(found), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if found else None)
        assert (r.runs_sha256, r.collapsed_sha256) == (sha(lines), sha(collapsed(w, found)))


def test_empty_table_and_parameters(spark):
    assert runs.digest(runs.detect(cases.docs(spark).limit(0))).count() == 0
    with pytest.raises(ValueError):
        runs.detect(cases.docs(spark), exponent=3)
