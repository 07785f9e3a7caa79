"""Abbreviations of a corpus against a plain count, and the sentences that follow."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from stepfold.functions import rewards, sentences

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(texts):
    with_, without = Counter(), Counter()
    for t in texts:
        for w in re.findall(r"[^\x00-\x2D\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER)):
            base = w.removesuffix(".")
            if base:
                (with_ if w.endswith(".") else without)[base] += 1
    n = sum(with_.values()) + sum(without.values())
    p = sum(with_.values()) / n
    out = {}
    for w, a in with_.items():
        b, inside = without[w], w.count(".")
        size = len(w) - inside
        if not re.fullmatch(r"[0-9.]*", w):
            ratio = -2 * (a * math.log(p) + b * math.log(1 - p) - a * math.log(0.99) - b * math.log(0.01))
            out[w] = (a, b, ratio * math.exp(-size) * (inside + 1) * size**-b)
    return out


def corpus():
    rng = random.Random(1)
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in ("lo", "rin", "stem", "ké")]
    texts = [None, "", "...", "3. 4.5. x"]
    for _ in range(300):
        line = [rng.choice(words) for _ in range(rng.randrange(5, 30))]
        for i in range(len(line)):
            if rng.random() < 0.08:
                line[i] = rng.choice(["Dr. Baru", "e.g. so", "etc. and", "U.S. law", "approx. ten"])
        texts.append(" ".join(line).capitalize() + ". " + rng.choice(words).capitalize() + "!")
    return texts


def test_types(spark):
    texts = corpus()
    frame = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)
    rows = sentences.scored_types(sentences.type_counts(frame)).collect()
    want = brute(texts)
    assert {r.word: (r.with_period, r.without) for r in rows} == {w: x[:2] for w, x in want.items()}
    assert {r.word: r.score for r in rows} == pytest.approx({w: x[2] for w, x in want.items()})
    known = sentences.abbreviations(frame)
    assert {"dr", "e.g", "etc", "u.s"} <= set(known) and not set(known) & {"balo", "kurin"}


def test_sentences_and_rewards(spark):
    said = [
        ("Dr. Smith met J. Doe. He left. So it is, e.g. Mary. ", ["Dr. Smith met J. Doe.", "He left.", "So it is, e.g. Mary."]),
        ("Is it so? Yes! etc. etc.", ["Is it so?", "Yes!", "etc. etc."]),
        ("1. 2 is 3", ["1.", "2 is 3"]),
        ("no end", ["no end"]),
        ("  ", []),
        ("dr.", ["dr."]),
    ]
    df = spark.createDataFrame([(t,) for t, _ in said], "t string")
    assert [r.s for r in df.select(sentences.split(F.col("t"), ["dr", "e.g", "etc"]).alias("s")).collect()] == [s for _, s in said]
    t = spark.createDataFrame([("<think>Ask Dr. Who. Done</think><answer>Mary</answer>",)], "t string")
    plain, known = t.select(rewards.reasoning(F.col("t")), rewards.reasoning(F.col("t"), ["dr"])).first()
    assert plain - known == pytest.approx(0.1)  # three parts, two sentences


def test_no_words(spark):
    assert sentences.abbreviations(spark.createDataFrame([], "text string")) == []
