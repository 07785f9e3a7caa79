"""Personal data: texts of very many entities and terms, held by the same texts, meet as classes."""

import pytest

from stepfold.llm import pii

from . import cases
from .test_native import revealing


@pytest.mark.parametrize("broadcast_rows", [0, 50_000])
def test_entities_and_terms_in_thousands(spark, broadcast_rows, monkeypatch):
    monkeypatch.setattr(pii, "BROADCAST_ROWS", broadcast_rows)
    many = " ".join(f"a{i}@x.org word{i}q" for i in range(10_000))
    texts = [f"{many} tail{i}" for i in range(3)] + [f"plain text number {i}" for i in range(40)]
    got = pii.report(spark, cases.docs(spark, texts)).orderBy("doc_id").collect()
    assert [r.n_email for r in got] == [10_000] * 3 + [0] * 40
    assert [r.n_term for r in got] == [10_000] * 3 + [0] * 40


def test_classes_of_texts(spark):
    """Sets of texts that overlap, nest and repeat: the terms are those of brute force."""
    texts = []
    for i in range(60):
        own = [f"u{k}@x.org" for k in range(12) if i % (k + 2) == 0] + [f"host{k} of 10.0.0.{k}" for k in range(6) if i % (3 * k + 4) < 2]
        texts.append(" ".join([*own, *(f"near{k}" for k in range(12) if i % (k + 2) == 0 and i % 17), *(f"some{k}" for k in range(9) if i % (k + 1) == k // 2), f"row{i}"]))
    texts += [texts[0], texts[12], None, ""]
    docs = cases.docs(spark, texts)
    scratch = pii.Scratch(spark, "test")
    got = pii.revealing(spark, docs, pii.with_spans(docs, ["doc_id"]), scratch).collect()
    assert {r.term for r in got} == revealing(texts) and len(got) == len({r.term for r in got}) > 3
