"""The n-gram join against a comparison of all pairs."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stepfold.llm import ngram_join
from stepfold.llm.common import Scratch
from stepfold.llm.components import components
from stepfold.llm.textsets import shingle_sets

from . import cases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute(rows, size, percent):
    sets = [(i, shingles(t, size)) for i, t in rows]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for k, (a, x) in enumerate(sets):
        for b, y in sets[k + 1 :]:
            if a is not None and b is not None and x and y and 10 * min(len(x), len(y)) >= 7 * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= percent * (len(x) + len(y) - both):
                    a_, b_ = find(a), find(b)
                    root[max(a_, b_)] = min(a_, b_)
    return Counter((i, len(s), find(i) if i is not None else None) for i, s in sets)


def corpus(seed):
    """Copies, near copies in chains and stars, long shared passages, and documents of every size."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    out, passage = [], text(150)
    for n in [1, 2, 3, 4, 5, 7, 9, 10, 12, 19, 30, 45, 80, 150, 400, 1500]:
        base = text(n)
        out += [base, list(base), base + text(max(1, n // 15))]
        chain = list(base)
        for _ in range(6):
            chain = list(chain)
            for _ in range(max(1, n // 60)):
                chain[rng.randrange(len(chain))] = rng.choice(vocabulary)
            out.append(chain)
    out += [passage + text(rng.choice([2, 8, 12, 20, 30])) for _ in range(40)]
    out += [text(rng.randrange(1, 60)) for _ in range(80)]
    rng.shuffle(out)
    return [" ".join(x) for x in out]


@pytest.mark.parametrize("size,percent", [(3, 90), (5, 80)])
def test_components_are_those_of_all_pairs(spark, monkeypatch, size, percent):
    monkeypatch.setattr(ngram_join, "TILE", 16)
    monkeypatch.setattr(ngram_join, "CHUNK", 8)
    for rounds in (0, 2):
        monkeypatch.setattr(ngram_join, "ROUNDS", rounds)
        texts = [*cases.TEXTS, *corpus(rounds)]
        docs = cases.docs(spark, texts, extra=True)
        docs = docs.union(docs.where("doc_id in (3, 9)")).union(docs.where("doc_id = 20").replace(20, 21, subset="doc_id")).union(docs.where("doc_id = 30").withColumn("doc_id", docs.doc_id * None))
        got = Counter(map(tuple, ngram_join.join(spark, docs, size, percent).collect()))
        want = brute([(r.doc_id, r.text) for r in docs.collect()], size, percent)
        assert sorted((got - want).items(), key=str) == sorted((want - got).items(), key=str)


def test_empty_table(spark):
    assert ngram_join.join(spark, cases.docs(spark, [])).count() == 0
    assert [tuple(r) for r in ngram_join.join(spark, cases.docs(spark, [None])).collect()] == [(0, 0, 0)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("ab AB\n é", max_size=30), max_size=8))
def test_sets(texts):
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    starts = np.cumsum([0, *(len(t.encode()) for t in texts)])
    h, counts = shingle_sets(data, starts, 3)
    assert counts.tolist() == [len(shingles(t, 3)) for t in texts]
    ends = np.cumsum(counts)
    known = {}
    for t, a, b in zip(texts, ends - counts, ends, strict=True):
        for x in sorted(shingles(t, 3)):
            known.setdefault(x, set(h[a:b].tolist())).intersection_update(h[a:b].tolist())
    assert all(known.values())


def test_words_of_a_pair_agree_somewhere():
    """At the threshold some word of the sketches is equal, whatever differs: the pigeonhole bound of every band."""
    rng = np.random.default_rng(1)
    for percent in (90, 80):
        for n in [1, 5, 9, 10, 18, 37, 64, 71]:
            for _ in range(30):
                a = rng.integers(0, 2**64, n, dtype=np.uint64)
                most = n * 100 // percent - n
                b = np.concatenate([a, rng.integers(0, 2**64, int(rng.integers(0, most + 1)), dtype=np.uint64)])
                keys, counts = ngram_join._keys(np.concatenate([a, b]), np.array([len(a), len(b)]), percent)
                assert set(keys[: counts[0]]) & set(keys[counts[0] :])


@pytest.mark.parametrize("percent", [90, 80, 60])
def test_no_pair_of_large_sets_is_missed(percent):
    """Pairs at the very threshold, of sets of 72 to 3,000 shingles that differ by replacement or by growth."""
    rng = np.random.default_rng(2)
    for n in [72, 73, 100, 150, 333, 800, 3000]:
        for _ in range(40 if n < 800 else 8):
            grown = bool(rng.integers(2))
            # as many shared shingles as the threshold lets be
            both = -(-n * percent // 100) if grown else -(-2 * n * percent // (100 + percent))
            a = rng.integers(0, 2**64, n, dtype=np.uint64)
            b = a[:both] if grown else np.concatenate([a[:both], rng.integers(0, 2**64, n - both, dtype=np.uint64)])
            keys, counts = ngram_join._keys(np.concatenate([a, b]), np.array([len(a), len(b)]), percent)
            assert set(keys[: counts[0]]) & set(keys[counts[0] :])


def test_unrelated_sets_rarely_share_a_word():
    """Twice the documents make about four times the chance pairs, so there must be next to none."""
    rng = np.random.default_rng(3)
    for n in (30, 60, 200):
        h, counts = rng.integers(0, 2**64, 3000 * n, dtype=np.uint64), np.full(3000, n)
        keys, _ = ngram_join._keys(h, counts, 80)
        assert len(keys) - len(np.unique(keys)) == 0


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = dict(components(Scratch(spark, "test"), spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}}
