"""SimHash against a plain computation of fingerprints and a comparison of all pairs."""

import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from stepfold.llm import simhash
from stepfold.llm.common import Scratch
from stepfold.llm.components import components

from . import cases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fingerprint(text, size=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + size]).encode(), 42) for i in range(max(1, len(w) - size + 1))] if w else []
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def classes(values, radius):
    """The least value that links reach, of each."""
    values = sorted(set(values))
    root = {x: x for x in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {x: find(x) for x in values}


def chains(rng, n):
    """Numbers in clusters and chains of steps of up to six bits, and others."""
    out = []
    while len(out) < n:
        x = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 5, 40])):
            out.append(x)
            for _ in range(rng.choice([1, 2, 4, 5, 6])):
                x ^= 1 << rng.randrange(64)
    return out[:n]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**9), st.integers(1, 300), st.integers(0, 9))
def test_joined_in_a_bucket(seed, n, radius):
    rng = random.Random(seed)
    rows = [(k, x) for k in range(rng.choice([1, 3])) for x in dict.fromkeys(chains(rng, n))]
    bucket, values = (np.array(x, kind) for x, kind in zip(zip(*rows, strict=True), (np.int64, np.uint64), strict=True))
    a, b = simhash.spanning(values, bucket, np.zeros(len(values), np.int32), radius)
    assert len(a) < len(values) and all((int(x) in set(values.tolist())) for x in [*a, *b])
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        root[max(find(x), find(y))] = min(find(x), find(y))
    assert {x: find(x) for x in values.tolist()} == classes(values.tolist(), radius)


@pytest.mark.parametrize("radius,members,tile", [(4, 2048, 16384), (4, 0, 7), (4, 1, 64), (1, 2048, 5), (0, 2048, 3)])
def test_links_join_all_that_are_near(spark, monkeypatch, radius, members, tile):
    monkeypatch.setattr(simhash, "MEMBERS", members)
    monkeypatch.setattr(simhash, "TILE", tile)
    values = sorted(set(chains(random.Random(radius + tile), 1500)))
    if members == 0:  # all blocks must agree but few: many tables
        monkeypatch.setattr(simhash, "chosen_for", lambda n, radius: 3)
    scratch = Scratch(spark, "test")
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    frame = spark.createDataFrame([(signed(x),) for x in values], "f long")
    got = {r.id: r.component for r in components(scratch, simhash.links(scratch, frame, radius, tile)).collect()}
    want = classes(values, radius)
    groups = {}
    for x in values:
        groups.setdefault(want[x], set()).add(signed(x))
    assert got == {x: min(g) for g in groups.values() if len(g) > 1 for x in g}


def test_every_number_of_blocks_covers_all_bits():
    for r in range(1, 9):
        found = simhash.masks(4, r)
        assert all(x < 1 << 64 for x in found)
        rng = random.Random(r)
        for _ in range(200):
            apart = sum({1 << rng.randrange(64) for _ in range(4)})
            assert any(not apart & m for m in found)
    assert [simhash.chosen_for(n, 4) for n in (0, 10**6, 10**8, 10**10)] == [1, 1, 2, 3]


def test_operator(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(300)}" for _ in range(400)]
    texts = [*cases.TEXTS, "x", "X", "one two three four", "One  two\tthree FOUR five", " ".join(base), " ".join(base[:-1]), " ".join([*base, "more"]), "   ", "A b c d " * 300]
    texts += [" ".join([*base[:k], "new", *base[k + 1 :]]) for k in range(0, 400, 40)]
    docs = cases.docs(spark, texts, extra=True)
    docs = docs.union(docs.limit(6)).union(docs.where("doc_id in (20, 22)").withColumn("doc_id", docs.doc_id * None))
    got = simhash.report(simhash.deduplicate(spark, docs)).collect()
    rows = [(r.doc_id, fingerprint(r.text)) for r in docs.collect()]
    want = classes([f for _, f in rows], 4)
    least = {}
    for i, f in rows:
        if i is not None:
            least[want[f]] = min(i, least.get(want[f], i))
    assert Counter(map(tuple, got)) == Counter((i, f"{f:016x}", least.get(want[f])) for i, f in rows)


def test_bits_of_many_hashes():
    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    first = np.array([0, 1, 256, 511, 1500])
    got = simhash._bit_sums(hashes, first)
    parts = np.split(hashes, first[1:])
    assert got.tolist() == [[int((p >> np.uint64(k) & np.uint64(1)).sum()) for k in range(64)] for p in parts]


def test_empty_table(spark):
    assert simhash.report(simhash.deduplicate(spark, cases.docs(spark).limit(0))).count() == 0
