"""Token store and packing against the tokenizers library alone."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from stepfold.llm import packing, token_store
from stepfold.llm.common import Scratch
from stepfold.llm.tokens import encoder

from . import cases

ODD = [" a b  c", "it's <|endoftext|> foo's 'S", "é́ é  Q", "\x1c \x1f a\x85b", "x  \n\n y ", "ÀÖ×÷ßÿ straße", "a,b;c!! d'll", "  lead", "İstanbul ſ"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.text(st.one_of(st.sampled_from("ab Z'’.,!-\n\t é0 ́ñß"), st.characters(codec="utf-8"))), max_size=6))
def test_chunks_give_the_ids_of_the_whole_text(name, texts):
    import pyarrow as pa

    path = str(public_tokenizers.path(name))
    plain = Tokenizer.from_file(path)
    texts = [*texts, *ODD, None, ""]
    ids, counts = encoder(path).encode(pa.array(texts, pa.string()))
    want = [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])


@given(st.lists(st.integers(0, 2**32 - 1)))
def test_coding_round_trip(values):
    v = np.array(values, np.uint32)
    control, data = token_store.pack(v)
    assert len(control) == -(-len(v) // 4)
    assert token_store.unpack(control, data, len(v)).tolist() == values


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def encoded(rows, name, end):
    plain = Tokenizer.from_file(str(public_tokenizers.path(name)))
    return [(r.doc_id, plain.encode(r.text or "", add_special_tokens=False).ids + [end]) for r in rows]


def test_store(spark):
    path = str(public_tokenizers.path("word_bpe_49k.json"))
    for docs in [cases.docs(spark, extra=True), cases.docs(spark, [])] + ([spark.read.parquet(f"{cases.DATA}/documents.parquet")] if cases.has_data() else []):
        folder = Scratch(spark, "test").path("store")
        token_store.write_store(spark, docs, folder, path, 1)
        got = token_store.digest(token_store.read_store(spark, folder)).collect()
        want, start = Counter(), 0
        for doc_id, ids in sorted(encoded(docs.collect(), "word_bpe_49k.json", 1), key=lambda x: (x[0], len(x[1]))):
            want[(doc_id, start, len(ids), crc(ids))] += 1
            start += len(ids)
        assert Counter(map(tuple, got)) == want
        n = Counter(i for _, ids in encoded(docs.collect(), "word_bpe_49k.json", 1) for i in ids)
        ranks = [(r.id, r.n) for r in spark.read.parquet(f"{folder}/ranks").orderBy("rank").collect()]
        assert ranks == sorted(n.items(), key=lambda x: (-x[1], x[0]))


def test_packing(spark):
    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    for capacity in (16, 2048):
        for docs in [cases.docs(spark, extra=True), cases.docs(spark, [])]:
            rows = packing.pack(spark, docs, path, 0, capacity).collect()
            want = Counter()
            for doc_id, ids in encoded(docs.collect(), "byte_bpe_50k.json", 0):
                head = len(ids) - (-(-len(ids) // capacity) - 1) * capacity
                cuts = [0, *range(head, len(ids) + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    want[(doc_id, k, a, b - a, crc(ids[a:b]))] += 1
            assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
            held = defaultdict(list)
            for r in rows:
                held[r.sequence_id].append((r.offset, r.length))
            for parts in held.values():
                at = 0
                for offset, length in sorted(parts):
                    assert offset == at
                    at += length
                assert at <= capacity
            total = sum(r.length for r in rows)
            assert len(held) <= max(1, 1.3 * total / capacity + 1)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.integers(1, 4), max_size=5))
def test_reduction_loses_nothing(counts):
    """With the reduction, an exact packing of the remainder is as good as an exact packing of the whole."""
    from functools import lru_cache

    @lru_cache(None)
    def least(items):
        if not items:
            return 0
        first, rest = items[0], items[1:]

        def fills(i, room):
            yield ()
            for j in range(i, len(rest)):
                if rest[j] <= room:
                    for more in fills(j + 1, room - rest[j]):
                        yield (j, *more)

        return 1 + min(least(tuple(x for j, x in enumerate(rest) if j not in used)) for used in set(fills(0, 12 - first)))

    items = tuple(sorted((x for x, n in counts.items() for _ in range(n)), reverse=True))[:8]
    fixed, left = packing.reduce_instance(Counter(items), 12)
    rest = tuple(sorted((x for x, n in left.items() for _ in range(n)), reverse=True))
    assert sum(n for _, n in fixed) + least(rest) == least(items)
    assert Counter(x for held, n in fixed for x in held for _ in range(n)) + Counter(rest) == Counter(items)
    packed = packing.best_fit(dict(left), 12)
    assert all(sum(held) <= 12 for held, _ in packed)
    assert Counter(x for held, n in packed for x in held for _ in range(n)) == Counter(rest)


def test_reduction_fixes_sets_of_three():
    fixed, left = packing.reduce_instance({10: 1, 7: 1, 4: 1, 3: 1}, 20)
    assert fixed == [((10, 7, 3), 1), ((4,), 1)] and not left
    # two lengths between that fit together may do better
    assert packing._third({10: 1, 7: 1, 5: 1, 4: 1, 3: 1}, 10, 10) is None
    assert packing._third({11: 3, 7: 3, 5: 1, 3: 1}, 11, 10) == (7, 3)


def test_packing_meets_the_lower_bound(spark):
    """Of the test table, within one sequence of what the sum of lengths allows."""
    if not cases.has_data():
        pytest.skip("no test data")
    docs = spark.read.parquet(f"{cases.DATA.replace('0.001', '0.01')}/documents.parquet")
    rows = packing.pack(spark, docs, str(public_tokenizers.path("byte_bpe_50k.json")), 0, 2048).collect()
    assert len({r.sequence_id for r in rows}) <= -(-sum(r.length for r in rows) // 2048) + 1
