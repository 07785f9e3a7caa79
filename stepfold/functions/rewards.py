"""Rewards of completions, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from stepfold.functions import sentences
from stepfold.functions.answers import tagged
from stepfold.functions.sentences import let
from stepfold.model import CHARS, NOBODY, ROOMS

# Lengths in characters, words that show reasoning, weights, bands of correctness, patterns of form.
SHORT, BEST, LONG = 50, 300, 1000
INDICATORS = ["because", "therefore", "thus", "since", "as a result", "if", "then", "otherwise", "however", "although", "consequently", "given that", "first", "second", "third", "finally", "lastly", "consider", "assume", "suppose", "let's", "we know"]
WEIGHTS = {"correctness": 1.0, "format": 0.5, "reasoning": 0.8, "consistency": 0.7, "atype": 0.3, "length": 0.4}
EXACT, SAME_LETTERS, PART, SIMILAR, ALIKE = 2.0, 1.5, 1.0, 0.75, 0.8
STRICT, GOOD, LEAST = r"(?sm)\A^<think>\n.*?\n</think>\n<answer>\n.*?\n</answer>$", r"(?sm)\A<think>.*?</think>\s*<answer>.*?</answer>", r"(?sm)\A<think>.*?</think>.*?<answer>.*?</answer>"
STRICT_JSON, GOOD_JSON, LEAST_JSON = r"(?sm)\A^.*?</think>\n\{\"answer\":\s.*?\}$", r"(?sm)\A.*?</think>\s*\{\"answer\":\s.*?\}", r"(?sm)\A.*?</think>.*?\{\"answer\":\s.*?\}"
NAMES = ROOMS + [NOBODY] + CHARS


def similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).when(F.least(F.length(a), F.length(b)) == 0, 0.0).otherwise(1 - F.levenshtein(a, b) / longest)


def _bare(x: Column) -> Column:
    return F.replace(F.trim(x), F.lit('"'), F.lit(""))


# Each reward is an expression of what the tags hold; these are bound once a row, as finding them costs more than all else.


def _correctness(bare: Column, gold: Column) -> Column:
    gold = F.trim(gold)
    return F.when(bare == gold, EXACT).when(F.lower(bare) == F.lower(gold), SAME_LETTERS).when(gold.contains(bare) | bare.contains(gold), PART).when(similarity(bare, gold) > ALIKE, SIMILAR).otherwise(0.0)


def _kind(bare: Column) -> Column:
    return F.when(bare.rlike(r"^\d+$") | bare.isin(NAMES), 0.5).when(F.lower(bare).isin([n.lower() for n in NAMES]), 0.3).otherwise(0.0)


def _ramp(n: Column) -> Column:
    """0.1 up to SHORT characters, rising to 0.5 at BEST; null beyond."""
    return F.when(n < SHORT, 0.1).when(n < BEST, 0.1 + 0.4 * (n - SHORT) / (BEST - SHORT))


def _reasoning(thought: Column, parts: Column) -> Column:
    by_length = let(F.length(thought), lambda n: _ramp(n).when(n <= LONG, 0.5 * (1 - (n - BEST) / (LONG - BEST))).otherwise(0.1))
    hits = let(F.lower(thought), lambda low: sum((low.contains(w).cast("int") for w in INDICATORS), F.lit(0)))
    several = let(F.size(parts), lambda k: F.when(k >= 3, 0.2).when(k == 2, 0.1).otherwise(0.0))
    return by_length + F.least(F.lit(0.3), 0.05 * hits) + several


def _consistency(thought: Column, said: Column, parts: Column) -> Column:
    last = F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))
    ends = let(last, lambda x: (x != "") & (x.contains(said) | said.contains(x)))
    return F.when((thought == "") | (said == ""), 0.0).when(thought.contains(said), 0.3).when(F.lower(thought).contains(F.lower(said)), 0.2).when(ends, 0.3).otherwise(0.0)


def _length(thought: Column, correct: Column) -> Column:
    n = F.length(thought)
    decay = 0.5 * F.cos(F.least(F.lit(1.0), (n - BEST) / (LONG - BEST)) * (F.pi() / 2))
    return F.when(correct <= 0, 0.0).otherwise(_ramp(n).otherwise(decay))


def correctness(text: Column, gold: Column, json: bool = False) -> Column:
    return let(_bare(tagged(text, "answer", json)), lambda said: _correctness(said, gold))


def kind(text: Column, json: bool = False) -> Column:
    return let(_bare(tagged(text, "answer", json)), _kind)


def form(text: Column, json: bool = False) -> Column:
    strict, good, least = (STRICT_JSON, GOOD_JSON, LEAST_JSON) if json else (STRICT, GOOD, LEAST)
    return F.when(text.rlike(strict), 1.0).when(text.rlike(good), 0.75).when(text.rlike(least), 0.5).otherwise(0.0)


def _told(text: Column, known: Column | list[str], body: Callable[[Column], Column]) -> Column:
    """`body` of what a completion holds: thought and its sentences (parts), said, and said without quotes (bare)."""
    tags = F.struct(tagged(text, "think").alias("thought"), tagged(text, "answer").alias("said"))
    return let(tags, lambda x: let(F.struct(x["thought"].alias("thought"), x["said"].alias("said"), _bare(x["said"]).alias("bare"), sentences.split(x["thought"], known).alias("parts")), body))


def reasoning(text: Column, known: Column | list[str] = ()) -> Column:
    """known: the abbreviations that end no sentence."""
    return let(tagged(text, "think"), lambda thought: _reasoning(thought, sentences.split(thought, known)))


def consistency(text: Column, known: Column | list[str] = ()) -> Column:
    return _told(text, known, lambda x: _consistency(x["thought"], x["said"], x["parts"]))


def length(text: Column, gold: Column) -> Column:
    return let(tagged(text, "think"), lambda thought: _length(thought, correctness(text, gold)))


def shares(text: Column, gold: Column, known: Column | list[str] = ()) -> Column:
    """A struct of all rewards by name: tags and sentences are found once for all of them."""

    def of(x: Column) -> Column:
        rest = {"format": form(text), "reasoning": _reasoning(x["thought"], x["parts"]), "consistency": _consistency(x["thought"], x["said"], x["parts"]), "atype": _kind(x["bare"])}
        return let(_correctness(x["bare"], gold), lambda c: F.struct(c.alias("correctness"), *(v.alias(k) for k, v in rest.items()), _length(x["thought"], c).alias("length")))

    return _told(text, known, of)


def combined(text: Column, gold: Column, weights: dict[str, float] = WEIGHTS, known: Column | list[str] = ()) -> Column:
    return let(shares(text, gold, known), lambda x: sum((weights[k] * x[k] for k in ("correctness", "format", "reasoning", "consistency", "atype", "length")), F.lit(0.0)))
