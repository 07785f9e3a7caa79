"""Quality rules, secrets and the classifier against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from stepfold.llm import compression_classifier, quality_rules, secrets

from . import cases

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    seen = Counter(zip(words, words[1:], words[2:], strict=False))
    hit = {p for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for p in range(i, i + 3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    return n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit), n < 50 or 100 * len(hit) > 50 * n


def rows_of(spark):
    small = cases.docs(spark, extra=True)
    return [small] + ([spark.read.parquet(f"{cases.DATA}/documents.parquet")] if cases.has_data() else [])


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def test_base_rules(spark):
    for docs in rows_of(spark):
        got = quality_rules.assess(docs, labels(spark, [(14, 1, 0), (None, 1, 0), (5, 1, None)]))
        columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
        want = Counter((r.doc_id, *base(r.text)) for r in docs.collect())
        found = got.collect()
        assert Counter((r.doc_id, *(r[c] for c in columns)) for r in found) == want
        assert not any(r.kept and r.base_failed for r in found)


def test_log_ratio_is_the_mean_over_all_grams(spark):
    docs = cases.docs(spark)
    trusted = labels(spark, [(3, 1, 0), (5, 1, 0), (6, 0, 0)])
    model = quality_rules.log_ratios(docs, trusted)
    grams, target, raw, buckets = {}, Counter(), Counter(), quality_rules.BUCKETS
    for r in docs.collect():
        words = WORD.findall(r.text or "")
        own = [(w,) for w in words] + list(zip(words, words[1:], strict=False))
        grams[r.doc_id] = own
        raw.update(own)
        target.update(own if r.doc_id in (3, 5) else [])
    pairs = {g for own in grams.values() for g in own}
    table = spark.createDataFrame([(" ".join(g), g[0], g[1] if len(g) > 1 else None) for g in pairs], "g string, a string, b string")
    bucket = {tuple(r.g.split(" ")): r.k for r in table.select("g", F.when(F.col("b").isNull(), quality_rules._bucket(F.col("a"))).otherwise(quality_rules._bucket(F.col("a"), F.col("b"))).alias("k")).collect()}
    import math

    t, w = Counter(), Counter()
    for g, n in raw.items():
        w[bucket[g]] += n
        t[bucket[g]] += target[g]
    want = [math.log((t[b] + 1) / (sum(t.values()) + buckets)) - math.log((w[b] + 1) / (sum(w.values()) + buckets)) for b in range(buckets)]
    assert model == pytest.approx(want)
    for r in quality_rules.assess(docs, trusted).collect():
        own = grams[r.doc_id]
        assert r.log_ratio == pytest.approx(sum(model[bucket[g]] for g in own) / len(own) if own else 0.0)


def test_threshold_parts_the_labels_best():
    cut = quality_rules.best_cut
    assert cut([]) is None and cut([(1.0, 1), (2.0, 1)]) is None
    assert cut([(0.0, 0), (1.0, 0), (2.0, 1), (5.0, 1)]) == 1.5
    assert cut([(0.0, 0), (1.0, 1), (1.0, 0), (2.0, 1), (2.0, 1), (2.0, 1)]) == 0.5
    import random

    rng = random.Random(5)
    for _ in range(200):
        rows = [(rng.randrange(8) / 4, rng.randrange(2)) for _ in range(rng.randrange(2, 12))]
        n = [sum(q == k for _, q in rows) for k in (0, 1)]
        gain = lambda t: quality_rules.LOSS * sum(x >= t and q == 1 for x, q in rows) / n[1] - sum(x >= t and q == 0 for x, q in rows) / n[0]
        if min(n) and (t := cut(rows)) is not None:
            assert gain(t) == pytest.approx(max(map(gain, [x + 0.01 for x, _ in rows][:-1] + [t])))


def test_kept_on_labels_that_nothing_was_drawn_from(spark):
    if not cases.has_data():
        pytest.skip("no test data")
    folder = cases.DATA.replace("0.001", "0.1")
    docs, marks = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r.quality for r in marks.collect()}
    held = {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 1}
    few = docs.where(F.col("doc_id").isin(*sorted(held)))
    ratios = quality_rules.log_ratios(docs, marks)
    threshold = quality_rules.threshold_of(docs, marks, ratios)
    rows = quality_rules.base_rules(few.select("doc_id", "text")).withColumn("x", quality_rules.mean_ratio(F.col("words"), quality_rules._literal(ratios))).where("not base_failed").select("doc_id", "x").collect()
    good, bad = ([r.x >= threshold for r in rows if truth[r.doc_id] == q] for q in (1, 0))
    assert len(good) > 500 and len(bad) > 30
    assert sum(good) / len(good) > 0.99 and sum(bad) / len(bad) < 0.1


def test_rules_on_empty_tables(spark):
    assert quality_rules.assess(cases.docs(spark, []), labels(spark)).count() == 0
    assert all(r.log_ratio == 0 for r in quality_rules.assess(cases.docs(spark), labels(spark)).collect())


KINDS = {
    "assign": (re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    "hex": (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
}


def secret_spans(text):
    found = [(m.start(), k, m.end(), m[2] if kind == "assign" else m[0]) for k, (kind, (p, ok)) in enumerate(KINDS.items()) for m in p.finditer(text or "") if ok(m)]
    return sorted(found)


def test_secrets(spark):
    names = ["assign", "access", "hex", "key"]
    key = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}")
    texts = [*cases.TEXTS, *["copied Zm9vYmFyQmF6UXV4MTIzNDU2 here"] * 3, "own Qm9vYmFyQmF6UXV4MTIzNDU2 here", "own Qm9vYmFyQmF6UXV4MTIzNDU2 again", None]
    for docs in [cases.docs(spark, texts), *rows_of(spark)]:
        rows = docs.collect()
        owners = defaultdict(set)
        spans = []
        for r in rows:
            own = secret_spans(r.text)
            keys = [(m.start(), 3, m.end(), m[0]) for m in key.finditer(r.text or "") if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0])]
            keys = [x for x in keys if not any(a < x[2] and x[0] < e for a, _, e, _ in own)]
            spans.append((own, keys))
            for x in own + keys:
                owners[x[3]].add(r.source)
        want = Counter()
        for r, (own, keys) in zip(rows, spans, strict=True):
            live = [x for x in keys if len(owners[x[3]]) < secrets.WIDE]
            text = lambda xs: ",".join(f"{names[k]}:{a}:{e}" for a, k, e, _ in sorted(xs))
            n = Counter(k for _, k, _, _ in own)
            alive = sum(len(owners[x[3]]) < secrets.WIDE for x in own)
            want[(r.doc_id, n[0], n[1], n[2], hashlib.sha256(text(own).encode()).hexdigest(), text(own + live), alive, len(own) - alive)] += 1
        got = secrets.scan(spark, docs, ["source"], ["source", "lang"])
        assert Counter(map(tuple, got.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_live", "n_example").collect())) == want
    assert secrets.scan(spark, cases.docs(spark, []), ["source"], ["lang"]).count() == 0


def test_ownership_takes_owners_and_repositories(spark):
    token = "Zm9vYmFyQmF6UXV4MTIz"
    one = [(i, f"x {token}AA y", "a", f"r{i}") for i in range(40)]  # one owner, many repositories
    two = [(100 + i, f"x {token}BB y", "ab"[i % 2], f"r{i}") for i in range(secrets.COPIED)]
    few = [(200 + i, f"x {token}CC y", "ab"[i % 2], f"r{i}") for i in range(secrets.COPIED - 1)]
    wide = [(300 + i, f"x {token}DD y", "abc"[i], "r0") for i in range(3)]
    docs = spark.createDataFrame(one + two + few + wide, "doc_id long, text string, owner string, repository string")
    rows = secrets.scan(spark, docs, ["owner"], ["owner", "repository"]).collect()
    assert {r.doc_id for r in rows if r.spans} == {r[0] for r in one + few}
    assert {r.spans for r in rows} == {"", "key:2:24"}


def test_classifier_on_held_out_rows(spark):
    if not cases.has_data():
        pytest.skip("no test data")
    folder = cases.DATA.replace("0.001", "0.01")
    docs, marks = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = compression_classifier.classify(docs, marks).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.7) for r in rows)
    truth = {r.doc_id: r.quality for r in marks.collect()}
    held = [(truth[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in truth]
    assert sum(a == b for a, b in held) / len(held) > 0.93


def test_classifier_without_labels_or_rows(spark):
    assert {r.score for r in compression_classifier.classify(cases.docs(spark, extra=True), labels(spark)).collect()} == {0.5}
    few = labels(spark, [(3, 1, 0), (4, 0, 0), (5, 1, 0), (5, 0, 0), (6, None, 0), (None, 1, 0)])
    assert compression_classifier.classify(cases.docs(spark), few).count() == len(cases.TEXTS) + 2
    assert compression_classifier.classify(cases.docs(spark, []), few).count() == 0
