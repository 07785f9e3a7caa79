"""Decontamination and personal data against brute force."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest

from stepfold.llm import decontaminate, pii

from . import cases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items, window=10):
    for doc_id, text in docs:
        own, hit, found = words(text), set(), set()
        for item, item_text in items:
            w = words(item_text)
            for i in range(max(1, len(w) - window + 1)) if w else []:
                part = w[i : i + window]
                for p in range(len(own) - len(part) + 1):
                    if own[p : p + len(part)] == part:
                        hit.update(range(p, p + len(part)))
                        found.add(str(item) if item is not None else "null")
        yield doc_id, len(own), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


PASSAGE = "the quick brown Fox jumps over the lazy dog and runs far away"


@pytest.mark.parametrize("broadcast_rows", [0, 10_000])
def test_decontamination(spark, broadcast_rows):
    texts = [*cases.TEXTS, PASSAGE, PASSAGE.upper() + " " + PASSAGE, "x " + PASSAGE.replace(" ", "-") + " é", "Quick brown", "ÉTÉ été", "a a a a a a a a a a a a a"]
    items = [(1, PASSAGE), (2, "quick, brown"), (3, "dog"), (3, "été"), (4, None), (5, ""), (None, "one two three"), (6, " ".join(["a"] * 11)), (7, PASSAGE), (8, "absent words here")]
    for extra in (False, True):
        docs = cases.docs(spark, texts, extra).union(cases.docs(spark, texts, extra).where("doc_id in (3, 16)"))
        bench = spark.createDataFrame(items, "item_id long, text string")
        got = decontaminate.report(spark, docs, bench, broadcast_rows=broadcast_rows).drop("t").collect()
        assert Counter(map(tuple, got)) == Counter(brute([(r.doc_id, r.text) for r in docs.collect()], items))


@pytest.mark.parametrize("broadcast_rows", [0, 10_000])
def test_decontamination_of_the_tables(spark, broadcast_rows):
    if not cases.has_data():
        pytest.skip("no test data")
    docs, bench = (spark.read.parquet(f"{cases.DATA}/{t}.parquet") for t in ("documents", "benchmark"))
    got = decontaminate.report(spark, docs, bench, broadcast_rows=broadcast_rows).drop("t").collect()
    want = Counter(brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()]))
    assert Counter(map(tuple, got)) == want and sum(r.contaminated for r in got)


def test_decontamination_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert not any(r.contaminated for r in decontaminate.report(spark, cases.docs(spark), none).collect())
    assert decontaminate.report(spark, cases.docs(spark, []), none).count() == 0


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def only(s):
    return re.sub("[^0-9]", "", s)


KINDS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda x: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda x: all(int(p) <= 255 for p in x.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda x: 13 <= len(only(x)) <= 19 and luhn(only(x))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda x: 9 <= len(only(x)) <= 15),
}
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]{3,}")


def base(text):
    return [(k, m.start(), m.end(), m[0]) for k, (p, ok) in KINDS.items() for m in re.finditer(p, text or "") if ok(m[0])]


def revealing(texts):
    """Terms by co-occurrence in whole texts; equal texts count once, also in the total."""
    texts = {t or "" for t in texts}
    near, terms, entities = defaultdict(set), defaultdict(set), defaultdict(set)
    for text in texts:
        for w in set(TERM.findall(text.lower())):
            terms[w].add(text)
        own, masked = base(text), text
        for _, a, b, _ in own:
            masked = masked[:a] + " " * (b - a) + masked[b:]
        for k, _, _, v in own:
            entities[k, v.lower()].add(text)
            for w in TERM.findall(masked.lower()):
                near[w, (k, v.lower())].add(text)
    return {w for (w, e), both in near.items() if len(both) >= pii.SUPPORT and 1 + math.log(len(both) / max(len(terms[w]), len(both))) / -math.log(min(0.5, len(entities[e]) / max(len(texts), 2))) >= pii.DISCLOSURE}


def test_personal_data(spark):
    own = [f"case {i}: Johansson of room {i} writes from kj@example.org every day {i}" for i in range(6)] + [f"other words of day {i}" for i in range(30)]
    texts = [*cases.TEXTS, *own, own[0], "Johansson again, and JOHANSSON", "9" * 5000, "1.2.3.4." * 300, "a@b.c " * 200, "x" * 20000 + "@", "- +1 23 456 789-0 4-2" * 3]
    tables = [cases.docs(spark, texts, extra=True)] + ([spark.read.parquet(f"{cases.DATA}/documents.parquet")] if cases.has_data() else [])
    for docs in tables:
        rows = docs.collect()
        terms = revealing([r.text for r in rows])
        want = Counter()
        for r in rows:
            spans = base(r.text)
            more = [("term", m.start(), m.end(), m[0]) for m in TERM.finditer(r.text or "") if m[0].lower() in terms and not any(a < m.end() and m.start() < b for _, a, b, _ in spans)]
            text = lambda xs: ",".join(f"{k}:{a}:{b}" for k, a, b, _ in xs)
            n = Counter(k for k, *_ in spans)
            want[(r.doc_id, n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(text(spans).encode()).hexdigest(), text(spans + more))] += 1
        got = pii.report(spark, docs).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans").collect()
        found = Counter(map(tuple, got))
        assert sorted((found - want).items(), key=str) == sorted((want - found).items(), key=str)
        if docs is tables[0]:
            assert {"room", "writes"} <= terms and "johansson" not in terms and len(terms) < 10


def test_sanitised_text(spark):
    texts = ["mail kj@example.org now", None, "", "4111 1111 1111 1111 and 1.2.3.4", "plain é text"]
    got = {r.doc_id: r for r in pii.sanitised(spark, cases.docs(spark, texts, extra=True)).collect()}
    assert [got[i].text for i in range(5)] == ["mail <EMAIL> now", None, "", "<CARD> and <IP>", "plain é text"]
    assert got[0].lang == "de" and got[0].words == "de"
    assert pii.report(spark, cases.docs(spark, [])).count() == 0
