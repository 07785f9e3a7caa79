"""Mended JSON against a recursive reader of the same grammar."""

import json
import re

import pytest
from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stepfold.functions.json_repair import LITERALS, repaired

WORDS = {"true": True, "false": False, "null": None}


class Reader:
    """Reads a value by recursive descent, character by character."""

    def __init__(self, text):
        at = [i for i in (text.find("{"), text.find("[")) if i >= 0]
        self.s, self.i = text[min(at) :] if at else "", 0

    def skip(self):
        while self.i < len(self.s):
            if self.s[self.i] in " \t\n\x0b\f\r":
                self.i += 1
            elif self.s.startswith(("//", "#"), self.i):
                self.i = (self.s.find("\n", self.i) + 1 or len(self.s) + 1) - 1
            elif self.s.startswith("/*", self.i):
                self.i = (self.s.find("*/", self.i + 2) + 2) if self.s.find("*/", self.i + 2) >= 0 else len(self.s)
            else:
                return self.s[self.i]
        return ""

    def quoted(self):
        quote, start = self.s[self.i], self.i + 1
        self.i = start
        while self.i < len(self.s) and self.s[self.i] != quote:
            self.i += 2 if self.s[self.i] == "\\" else 1
        raw = self.s[start : self.i]
        if self.i >= len(self.s):  # not closed
            raw = re.sub(r"[ \t\n\x0b\f\r}\]]+$", "", raw)
        self.i += 1
        out, k = [], 0
        while k < len(raw):
            code = raw[k + 2 : k + 6]
            if raw[k] != "\\":
                out.append(raw[k])
                k += 1
            elif raw[k + 1 : k + 2] == "u" and re.fullmatch("[0-9A-Fa-f]{4}", code):
                out.append(chr(int(code, 16)))
                k += 6
            else:
                nxt = raw[k + 1 : k + 2]
                out.append({"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}.get(nxt, nxt))
                k += 2
        return "".join(out)

    def bare(self):
        start = self.i
        while self.i < len(self.s) and (self.s[self.i] not in '{}[]:,"\n#' + ("'" if self.i == start else "")) and not self.s.startswith(("//", "/*"), self.i):
            self.i += 1
        return re.sub(r"[ \t\n\x0b\f\r]+$", "", self.s[start : self.i])

    def scalar(self, key):
        if self.s[self.i] in "\"'":
            return self.quoted()
        word = self.bare()
        if key:
            return word
        if re.fullmatch(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?", word):
            return json.loads(word)
        return WORDS[LITERALS[word]] if word in LITERALS else word

    def value(self, open_):
        c = self.skip()
        if c == "{":
            self.i += 1
            return self.members(open_ + "{")
        if c == "[":
            self.i += 1
            return self.items(open_ + "[")
        return self.scalar(False)

    def ends(self, c, open_, own):
        """Whether a closing bracket ends the own value; one of an outer value does so too and stays, one of none is skipped."""
        if c == "":
            return True
        want = {"}": "{", "]": "["}[c]
        if want == own:
            self.i += 1
            return True
        if want in open_[:-1]:
            return True
        self.i += 1
        return False

    def members(self, open_):
        out = {}
        while True:
            c = self.skip()
            if c == "" or c in "}]":
                if self.ends(c, open_, "{"):
                    return out
            elif c in ",:":
                self.i += 1
            elif c in "{[":
                out[""] = self.value(open_)
            else:
                key, out_value = self.scalar(True), None
                while True:  # one colon, closing brackets of nothing, then a value unless a comma or an end comes
                    c = self.skip()
                    if c != "" and c in "}]" and {"}": "{", "]": "["}[c] not in open_:
                        self.i += 1
                    elif c == ":":
                        self.i += 1
                    else:
                        break
                if c != "" and c not in ",}]":
                    out_value = self.value(open_)
                out[key] = out_value

    def items(self, open_):
        out = []
        while True:
            c = self.skip()
            if c == "" or c in "}]":
                if self.ends(c, open_, "["):
                    return out
            elif c in ",:":
                self.i += 1
            else:
                out.append(self.value(open_))

    def read(self):
        return self.value("") if self.s else None


def mend(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", repaired(F.col("t")).alias("x")).collect()
    return [x for _, x in sorted((r.i, r.x) for r in rows)]


CASES = [
    ('{"answer": "Mary"}', {"answer": "Mary"}),
    ("{'answer': 'Mary'}", {"answer": "Mary"}),
    ('{"answer": "Mary', {"answer": "Mary"}),
    ('{"answer": "Mary}', {"answer": "Mary"}),
    ('{"answer": ["Mary", "John"', {"answer": ["Mary", "John"]}),
    ('{"answer": 5,}', {"answer": 5}),
    ("{answer: John Smith}", {"answer": "John Smith"}),
    ('so {"answer": True, "why": None} // done', {"answer": True, "why": None}),
    ('```json\n{"a": 1 /* one */, # two\n "b": [1, 2,, 3,]}\n```', {"a": 1, "b": [1, 2, 3]}),
    ('{"a": {"b": [1, {"c": "x"}', {"a": {"b": [1, {"c": "x"}]}}),
    ('{"a": [1, 2}', {"a": [1, 2]}),
    ('{"a" "b" "c": 1}', {"a": "b", "c": 1}),
    ('{"a": "line\nbreak \\d \\" \\u00e9"}', {"a": 'line\nbreak d " é'}),
    ("{'say': 'a \"word\" it\\'s'}", {"say": 'a "word" it\'s'}),
    ('{"a":, "b"}', {"a": None, "b": None}),
    ("[1, [2, [3", [1, [2, [3]]]),
    ("{", {}),
    ("[]]]", []),
    ('{"a": 007, "b": -1.5e3, "c": .5}', {"a": "007", "b": -1500.0, "c": ".5"}),
    ('{"a": "' + "\\n" * 5000 + '"}', {"a": "\n" * 5000}),
]


def test_cases(spark):
    got = mend(spark, [t for t, _ in CASES] + ["no bracket", "", None])
    assert [json.loads(x) for x in got[:-3]] == [want for _, want in CASES]
    assert got[-3:] == [None, None, None]
    assert [Reader(t).read() for t, _ in CASES] == [want for _, want in CASES]


values = st.recursive(
    st.one_of(st.text("ab é\"'\\{}[]:,#\n", max_size=6), st.integers(-99, 99), st.booleans(), st.none()),
    lambda x: st.one_of(st.lists(x, max_size=3), st.dictionaries(st.text("abc", min_size=1, max_size=2), x, max_size=3)),
    max_leaves=8,
).filter(lambda x: isinstance(x, dict | list))


@settings(max_examples=8, deadline=None, phases=[Phase.generate], suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(values, st.integers(0, 60)), min_size=60, max_size=60))
def test_whole_and_cut_off_json(spark, given_):
    """Valid JSON stays what it is; cut off, it reads as the recursive reader does."""
    whole = [json.dumps(v, ensure_ascii=i % 2 == 0) for v, i in given_]
    cut = [t[: max(1, len(t) - n % len(t))] for t, (_, n) in zip(whole, given_, strict=True)]
    got = mend(spark, whole + cut)
    assert [json.loads(x) for x in got[:60]] == [v for v, _ in given_]
    assert [json.loads(x) for x in got[60:]] == [Reader(t).read() for t in cut]


@settings(max_examples=8, deadline=None, phases=[Phase.generate], suppress_health_check=list(HealthCheck))
@given(st.lists(st.text("{}[]:,\"'ab1 \n#/*T", max_size=16).map(lambda t: "{" + t), min_size=150, max_size=150), st.lists(st.lists(st.sampled_from(["{", "}", "[", "]", ":", ",", '"k"', "'v'", "True", "None", "12", "word", "//c\n", "/*c*/", " "]), max_size=12).map("".join), min_size=100, max_size=100))
def test_any_text(spark, texts, more):
    texts = texts + more
    for t, x in zip(texts, mend(spark, texts), strict=True):
        assert (None if x is None else json.loads(x)) == Reader(t).read(), t


@pytest.mark.parametrize("n", [20_000])
def test_long_strings(spark, n):
    text = '{"answer": "' + "word \\t" * n + '", "list": [' + "1," * 500
    assert json.loads(mend(spark, [text])[0]) == {"answer": "word \t" * n, "list": [1] * 500}
