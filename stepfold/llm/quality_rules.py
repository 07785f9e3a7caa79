"""Quality rules: base counts, and a hashed n-gram log-likelihood ratio between trusted text and the raw corpus.

Words and pairs of neighbouring words are hashed into BUCKETS counters, over all documents for the raw multinomial
and over trusted labelled documents for the target. A document's evidence is the mean over its n-grams of
log(p_target / p_raw); one below the threshold is rejected. Both multinomials are smoothed by one count a bucket. All
is DataFrame operations; the model is one array of BUCKETS numbers, whatever the corpus. Ratios are whole multiples of
2**-32, so sums of them don't depend on the order of rows and every document gets the same verdict in every run.

Documents with labels take parts by crc32 of doc_id mod 4. With 2 or 3 they are targets (quality 1, toxic 0), all of
them; the raw counts take every document. The threshold comes from all with 0, which no target has seen: it lies in the
middle of the gap between two of their ratios that parts good from bad best (LOSS times the share of good ones lost and
the share of bad ones kept add up to the least; of equals the widest gap, then the lowest). Their ratios are sorted by
ranges, and only the counts of ranges come to the driver. Those with 1 take part in neither and are left to test by. With no trusted row the ratio is 0
everywhere; without labels of both qualities beside the target there is no threshold. Then nothing is rejected.

Null text has no words, and fails the base rules as it has under 50. Repeated rows are rows of their own. Documents
that repeat a labelled doc_id all count. Texts of any length are taken whole. Only doc_id and text are read, so other
columns of any name do not matter.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepfold.llm.common import Scratch, settled, words_of

BUCKETS = 1 << 14
#: Labelled rows up to which they are broadcast, some 20 bytes each; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: How much more it weighs to lose a share of good documents than to keep as large a share of bad ones.
LOSS = 10
#: Ratios are whole numbers of this many parts.
PARTS = 1 << 32
LEAST_WORDS = 50
SYMBOLS = "#*$%&|<>"


def repeat_windows(words: Column) -> Column:
    """Hashes of the 3-word windows."""
    hashes = F.transform(F.slice(words, F.lit(1), F.size(words) - 2), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) >= 3, hashes)


def _covered(starts: Column) -> Column:
    """How many words the 3-word windows at these ascending positions cover."""

    def step(acc: Column, p: Column) -> Column:
        return F.struct((p + 3).alias("end"), (acc["n"] + p + 3 - F.greatest(acc["end"], p)).alias("n"))

    return F.aggregate(starts, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), step, lambda acc: acc["n"])


def base_rules(docs: DataFrame) -> DataFrame:
    """`docs` with words and the base columns."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = settled(docs, "words", words_of(F.col("text").cast("string")))
    rows = settled(rows, "hashes", repeat_windows(F.col("words")))
    # (hash, position), sorted, so that equal windows are neighbours; most documents have none
    some = F.size(F.array_distinct("hashes")) < F.size("hashes")
    rows = settled(rows, "windows", F.when(some, F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))))
    same = lambda x, i: F.coalesce(x["h"] == F.get("windows", i)["h"], F.lit(False))
    rows = rows.withColumn("starts", F.sort_array(F.transform(F.filter("windows", lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["p"])))
    rows = rows.withColumn("lines", F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    n = lambda c: c.cast("long")
    rows = rows.withColumns({
        "n_words": n(F.size("words")),
        "word_chars": n(F.length(F.array_join("words", ""))),
        # most texts hold no symbol, which a search tells sooner than taking them out
        "n_symbols": n(F.when(text.rlike(f"[{SYMBOLS}]"), F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).otherwise(0)),
        "n_dup_lines": n(F.size("lines") - F.size(F.array_distinct("lines"))),
        "n_repeat_words": n(F.coalesce(_covered(F.col("starts")), F.lit(0))),
    })
    return rows.drop("hashes", "windows", "starts", "lines").withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _bucket(*words: Column) -> Column:
    return F.pmod(F.xxhash64(*words), F.lit(BUCKETS)).cast("int")


def _part(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def _labelled(labels: DataFrame, *parts: int) -> DataFrame:
    """doc_id, q, most, t of the documents with labels of these parts: least and greatest quality, greatest toxicity."""
    known = labels.where(F.col("doc_id").isNotNull() & _part(F.col("doc_id")).isin(*parts))
    return known.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("quality").alias("most"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))


def target_ids(labels: DataFrame) -> DataFrame:
    """doc_id of all trusted rows; a document that any label marks bad or toxic isn't trusted."""
    return _labelled(labels, 2, 3).where((F.col("q") == 1) & (F.col("t") == 0)).select("doc_id")


def _small(rows: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= broadcast_rows else rows


def log_ratios(docs: DataFrame, labels: DataFrame) -> list[float]:
    """log(p_target / p_raw) of each bucket, in whole PARTS."""
    chosen = _small(target_ids(labels)).withColumn("trusted", F.lit(1))
    rows = docs.select("doc_id", "text").join(chosen, "doc_id", "left").select("trusted", words_of(F.col("text").cast("string")).alias("words"))
    grams = _grams(rows, "trusted")
    counts = grams.groupBy("b").agg(F.count("*").alias("raw"), F.count("trusted").alias("target"))
    found = {r.b: (r.raw, r.target) for r in counts.collect()}  # at most BUCKETS rows
    raw, target = (sum(x[k] for x in found.values()) + BUCKETS for k in (0, 1))
    if target == BUCKETS:
        return [0.0] * BUCKETS
    ratios = (math.log((t + 1) / target) - math.log((r + 1) / raw) for r, t in (found.get(b, (0, 0)) for b in range(BUCKETS)))
    return [round(x * PARTS) / PARTS for x in ratios]


def _grams(rows: DataFrame, *carried: str) -> DataFrame:
    """The carried columns and b, the bucket of each word and word pair of `rows` (with words)."""
    each = rows.select(*carried, "words", F.posexplode("words").alias("p", "w"))
    after = F.get("words", F.col("p") + 1)
    grams = each.select(*carried, F.explode(F.array(_bucket(F.col("w")), F.when(after.isNotNull(), _bucket(F.col("w"), after)))).alias("b"))
    return grams.where("b is not null")


def mean_ratio(words: Column, ratios: Column) -> Column:
    """Mean of the ratios (in PARTS) of a document's words and word pairs; 0 without words."""
    at = lambda *x: F.get(ratios, _bucket(*x))

    def step(acc: Column, i: Column) -> Column:
        w, after = F.get(words, i), F.get(words, i + 1)
        return acc + at(w) + F.when(after.isNotNull(), at(w, after)).otherwise(F.lit(0).cast("long"))

    total = F.aggregate(F.sequence(F.lit(0), F.size(words) - 1), F.lit(0).cast("long"), step)
    return F.when(F.size(words) > 0, total / PARTS / (2 * F.size(words) - 1)).otherwise(0.0)


def _literal(ratios: list[float]) -> Column:
    return F.from_json(F.lit(json.dumps([round(x * PARTS) for x in ratios])), "array<bigint>")


def best_cut(scored: list[tuple[float, int]]) -> float | None:
    """The middle of the gap between the scores that parts label 1 (above) from 0 best; None without both."""
    good, bad = (sum(q == k for _, q in scored) for k in (1, 0))
    if not good or not bad:
        return None
    values = sorted(set(x for x, _ in scored))
    weight = dict.fromkeys(values, 0.0)
    for x, q in scored:
        weight[x] += 1 / bad if q == 0 else -LOSS / good
    # with the cut above a value, what is at or below it goes
    gain, best = 0.0, (0.0, 0.0, None)
    for x, y in zip(values, values[1:], strict=False):
        gain += weight[x]
        if (round(gain, 9), y - x) > best[:2]:
            best = (round(gain, 9), y - x, (x + y) / 2)
    return best[2]


def cut_of(scored: DataFrame) -> float | None:
    """best_cut of a table (x, q) of any size: values in ranges, counts before them from those of the ranges."""
    total = scored.agg(F.count_if(F.col("q") == 1).alias("good"), F.count_if(F.col("q") == 0).alias("bad")).first()
    if not total.good or not total.bad:
        return None
    values = scored.groupBy("x").agg(F.count_if(F.col("q") == 1).alias("good"), F.count_if(F.col("q") == 0).alias("bad"))
    scratch = Scratch(scored.sparkSession, "quality-cut")
    values = scratch.write(values.repartitionByRange("x").withColumn("part", F.spark_partition_id()), "values")
    try:
        parts = sorted(values.groupBy("part").agg(F.min("x").alias("least"), F.sum("good").alias("good"), F.sum("bad").alias("bad")).collect(), key=lambda r: r.part)  # a row for each range
        before, rows = [0, 0], []
        for r, after in zip(parts, [*parts[1:], None], strict=True):
            rows.append((r.part, *before, after and after.least))
            before = [before[0] + r.good, before[1] + r.bad]
        offsets = F.broadcast(values.sparkSession.createDataFrame(rows, "part int, g long, b long, next double"))
        order = Window.partitionBy("part").orderBy("x")
        y = F.coalesce(F.lead("x").over(order), F.col("next"))
        found = values.join(offsets, "part").select("x", y.alias("y"), (F.sum("good").over(order) + F.col("g")).alias("lost"), (F.sum("bad").over(order) + F.col("b")).alias("gone"))
        gain = F.round(F.col("gone") / total.bad - LOSS * F.col("lost") / total.good, 9)
        cuts = found.where("y is not null").select("x", "y", gain.alias("gain"), (F.col("y") - F.col("x")).alias("gap")).where("gain >= 0")
        best = cuts.orderBy(F.desc("gain"), F.desc("gap"), "x").limit(1).collect()
    finally:
        scratch.drop(values)
    return (best[0].x + best[0].y) / 2 if best else None


def threshold_of(docs: DataFrame, labels: DataFrame, ratios: list[float]) -> float | None:
    """The threshold that all labelled documents outside the target ask for, None if there are none of either quality."""
    known = _small(_labelled(labels, 0).where((F.col("q") == F.col("most")) & F.col("q").isin(0, 1)).select("doc_id", F.col("q").cast("int").alias("q")))
    rows = docs.select("doc_id", "text").where(_part(F.col("doc_id")) == 0).join(known, "doc_id")
    rows = settled(rows, "words", words_of(F.col("text").cast("string"))).where(F.size("words") >= LEAST_WORDS)
    return cut_of(rows.select("doc_id", "q", mean_ratio(F.col("words"), _literal(ratios)).alias("x")).groupBy("doc_id").agg(F.first("q").alias("q"), F.min("x").alias("x")))


def assess(docs: DataFrame, labels: DataFrame, threshold: float | None = None) -> DataFrame:
    """The rows of `docs` with the base columns, log_ratio and kept. The threshold is drawn from the labels where none is given."""
    ratios = log_ratios(docs, labels)
    if threshold is None:
        threshold = threshold_of(docs, labels, ratios)
    rows = base_rules(docs.select("doc_id", "text"))
    rows = rows.withColumn("log_ratio", mean_ratio(F.col("words"), _literal(ratios)))
    above = F.lit(True) if threshold is None else F.col("log_ratio") >= threshold
    return rows.withColumn("kept", ~F.col("base_failed") & above).drop("words", "text")
