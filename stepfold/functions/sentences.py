"""Sentence boundaries that know abbreviations, which are learned from counts of a corpus without any list (Kiss and Strunk, 2006).

A type of word that is nearly always followed by a period is an abbreviation, more so if it is short, holds periods and
is rare without one. The evidence is a log-likelihood ratio: that the period depends on the word (with probability
0.99) against that it comes as often as after any word.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the method: how surely a period follows an abbreviation, and the score from which a type is one.
SURE, LEAST = 0.99, 0.3
#: Types of abbreviations that a model may have; the likeliest count.
TYPES = 10_000
#: Words with their periods: runs of anything but white space and ASCII punctuation other than periods.
WORD = r"[^\x00-\x2D\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once a row, however often it is used there."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def type_counts(texts: DataFrame, column: str = "text") -> DataFrame:
    """word, with_period, without: how often each type of word, A-Z in lower case and without its last period, ends in one. Null and empty texts have no words."""
    words = texts.select(F.explode(F.regexp_extract_all(_lower(F.coalesce(F.col(column), F.lit(""))), F.lit(WORD), F.lit(0))).alias("w"))
    ends = F.endswith("w", F.lit("."))
    typed = words.select(F.regexp_replace("w", r"\.$", "").alias("word"), ends.alias("ends")).where("word <> ''")
    return typed.groupBy("word").agg(F.count_if("ends").alias("with_period"), F.count_if(~F.col("ends")).alias("without"))


def scored_types(counts: DataFrame) -> DataFrame:
    """`counts` with score, of the types that have a letter and ever end in a period."""
    total = counts.agg(F.sum("with_period").alias("periods"), F.sum(F.col("with_period") + F.col("without")).alias("n")).first()  # two numbers
    a, b = F.col("with_period"), F.col("without")
    p = F.lit(max(total.periods or 0, 1) / (total.n or 1))
    # where every word ends in a period, its coming is no evidence; a hair of doubt keeps the logarithm finite
    usual = a * F.log(p) + b * F.log(F.greatest(1 - p, F.lit(1e-12)))
    surely = a * F.log(F.lit(SURE)) + b * F.log(F.lit(1 - SURE))
    inside = F.length("word") - F.length(F.replace("word", F.lit("."), F.lit("")))
    letters = F.length("word") - inside
    score = -2 * (usual - surely) * F.exp(-letters) * (inside + 1) * F.pow(letters.cast("double"), -b)
    rows = counts.where("with_period > 0").where(~F.col("word").rlike(r"^[0-9.]*$"))
    return rows.select("word", "with_period", "without", score.alias("score"))


def abbreviations(texts: DataFrame, column: str = "text") -> list[str]:
    """The types that are abbreviations in a corpus, TYPES at most, of which the likeliest count."""
    found = scored_types(type_counts(texts, column)).where(F.col("score") >= LEAST)
    return [r.word for r in found.orderBy(F.desc("score"), "word").limit(TYPES).collect()]


def split(text: Column, known: Column | list[str] = ()) -> Column:
    """The sentences of a text as an array: they end in . ! or ? before white space, but not in the period of an abbreviation or an initial that goes on."""
    pieces = F.array_remove(F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda x: F.trim(x)), "")
    within = WORD[:-1]
    initial = rf"(?<!{within})[A-Za-z]\."
    listed = isinstance(known, Column) or len(known) > 0
    # without abbreviations a text with no initial before white space is as it was cut
    may = F.lit(True) if listed else text.rlike(initial + r"\s")
    known = known if isinstance(known, Column) else F.array(*map(F.lit, known)).cast("array<string>")

    def goes_on(x: Column) -> Column:
        ends = x.rlike(initial + "$")
        if listed:
            ends = ends | F.array_contains(known, _lower(F.regexp_extract(x, rf"(?<!{within})({within}*)\.$", 1)))
        return F.endswith(x, F.lit(".")) & ends

    def joined(x: Column) -> Column:
        """Each run of pieces that go on and the one after them as one, in a pass over the places where sentences start."""
        at = F.filter(F.sequence(F.lit(1), F.size(x["pieces"])), lambda i: (i == 1) | ~F.get(x["on"], i - 2))
        after = lambda starts, k: F.coalesce(F.get(starts, k + 1), F.size(x["pieces"]) + 1)
        return let(at, lambda starts: F.transform(starts, lambda i, k: F.array_join(F.slice(x["pieces"], i, after(starts, k) - i), " ")))

    marked = lambda p: F.struct(p.alias("pieces"), F.transform(p, goes_on).alias("on"))
    checked = lambda p: let(marked(p), lambda x: F.when(F.array_contains(x["on"], True), joined(x)).otherwise(x["pieces"]))
    return let(pieces, lambda p: F.when(may, checked(p)).otherwise(p))
