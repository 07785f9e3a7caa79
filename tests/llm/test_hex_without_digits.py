"""Hexadecimal runs in texts that hold no digit at all."""

from stepfold.llm import secrets

from . import cases


def test_hex_of_letters_alone(spark):
    texts = ["key deadbeefdeadbeefdeadbeef end", "a" * 24, "b" * 23, "deadbeefdeadbeefdeadbeef again", "no run", "Xdeadbeefdeadbeefdeadbeef"]
    got = {r.doc_id: r for r in secrets.scan(spark, cases.docs(spark, texts), ["doc_id"], ["doc_id"]).collect()}
    assert [got[i].spans for i in range(6)] == ["hex:4:28", "hex:0:24", "", "hex:0:24", "", "hex:1:25"]
    assert [(got[i].n_hex, got[i].n_live, got[i].n_example) for i in range(6)] == [(1, 0, 1), (1, 1, 0), (0, 0, 0), (1, 0, 1), (0, 0, 0), (1, 0, 1)]
