"""Removal of repeated passages against a count of all strings."""

import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stepfold.llm import suffix_dedup as sd

from . import cases


def brute(rows):
    seen = Counter()
    texts = [(i, (t or "").encode()) for i, t in rows]
    for _, t in texts:
        seen.update(t[p : p + 200] for p in range(len(t) - 199))
    out = Counter()
    for i, t in texts:
        gone = bytearray(len(t) + 1)
        for p in range(len(t) - 199):
            if seen[t[p : p + 200]] > 1:
                gone[p : p + 200] = b"\1" * 200
        runs = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(t)))
        out[i, len(t), sum(gone), runs, bytes(c for c, g in zip(t, gone, strict=False) if not g)] += 1
    return out


def corpus(seed):
    rng = random.Random(seed)
    letter = lambda n: "".join(rng.choice("abcdefgh é\n\0") for _ in range(n))
    passages = [letter(n) for n in (180, 199, 200, 201, 230, 420, 1000)]
    out = []
    for _ in range(70):
        text = letter(rng.choice([0, 5, 150, 400]))
        for _ in range(rng.randrange(4)):
            p = rng.choice(passages)
            a = rng.randrange(0, 30)
            text += (p[a:] if rng.random() < 0.5 else p[: len(p) - a]) + letter(rng.choice([0, 1, 3, 60, 300]))
        out.append(text)
    return [*out, "St " * 300, "ab" * 500, "St " * 80, "x" * 199, "y" * 200, "z" * 201, *cases.TEXTS]


@pytest.mark.parametrize("hot,merge", [(sd.HOT, sd.MERGE), (sd.HOT, 50), (2, 100)])
def test_removal_is_exact(spark, hot, merge):
    docs = cases.docs(spark, corpus(merge), extra=True).repartition(5)
    docs = docs.union(docs.where("doc_id in (3, 9, 80)")).union(docs.where("doc_id = 12").withColumn("doc_id", docs.doc_id * None))
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in sd.deduplicate(spark, docs, hot, merge).collect())
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert [x[:4] for x in (got - want)] == [x[:4] for x in (want - got)]
    assert got == want and any(x[2] for x in want)


def test_tables(spark):
    assert sd.deduplicate(spark, cases.docs(spark, [])).count() == 0
    if not cases.has_data():
        pytest.skip("no test data")
    docs = spark.read.parquet(f"{cases.DATA}/documents.parquet")
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in sd.deduplicate(spark, docs).collect())
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.binary(max_size=6).map(lambda b: bytes(x & 1 for x in b)), max_size=8), max_size=6))
def test_loser_tree(groups):
    def shared(a, b):
        return next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))

    runs = [sorted(g) for g in groups]
    coded = [(g, np.array([0, *(shared(a, b) for a, b in zip(g, g[1:], strict=False))][: len(g)], np.int64)) for g in runs]
    run, place, common = sd.merged(coded)
    out = [runs[r][p] for r, p in zip(run, place, strict=True)]
    assert out == sorted(x for g in runs for x in g)
    assert common.tolist() == [0, *(shared(a, b) for a, b in zip(out, out[1:], strict=False))][: len(out)]
