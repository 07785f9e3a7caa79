"""Leaderboard tables from scored rows."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepfold.functions import answers
from stepfold.model import TASKS

# Fixed values of the gates and of the weighted mean.
PER_CELL = 50
EPSILON = 1e-6
SHORT_TOKENS = 32
#: Characters of the parts that names are looked up by.
GRAM = 3
#: Of approximate percentiles; values that are sorted at once.
ACCURACY, AT_ONCE = 10_000, 50_000


def hit_rates(scored: DataFrame, per_cell: int = PER_CELL) -> DataFrame:
    """hit: per cent of `per_cell` rows, as published; mean_hit: of the rows that are there."""
    out = scored.groupBy("seq_len", "qtype", "model").agg(F.sum("hit").alias("hits"), F.avg("hit").alias("m"))
    return out.select("seq_len", "qtype", "model", F.bround(F.col("hits") / per_cell * 100, 3).alias("hit"), F.bround(F.col("m") * 100, 3).alias("mean_hit"))


def harmonic(x: str | Column) -> Column:
    """Harmonic mean of a group; 0 if any value is."""
    x = F.col(x) if isinstance(x, str) else x
    return F.when(F.min(x) <= 0, 0.0).otherwise(F.count(x) / F.sum(F.when(x > 0, 1 / x)))


def means(rates: DataFrame, *by: str) -> DataFrame:
    return rates.groupBy(*by).agg(F.avg("hit").alias("mean"), harmonic("hit").alias("hmean"))


def pivoted(rates: DataFrame, row: str, column: str, how=F.avg) -> DataFrame:
    """A heatmap table; columns in descending order of their mean, ties by name."""
    order = [r[column] for r in rates.groupBy(column).agg(F.avg("hit").alias("m")).orderBy(F.desc("m"), column).collect()]
    return rates.groupBy(row).pivot(column, order).agg(how("hit"))


def with_task(df: DataFrame) -> DataFrame:
    return df.withColumn("task", F.element_at(F.create_map(*(F.lit(x) for kv in TASKS.items() for x in kv)), F.col("qtype")))


def weighted(cells: DataFrame) -> DataFrame:
    """model, score, n_tasks: the mean of em by task, weighted 2**(seq_len / 32), then the harmonic mean over tasks."""
    w = F.pow(F.lit(2.0), F.col("seq_len") / 32)
    tasks = cells.groupBy("model", "task").agg((F.sum(w * F.col("em")) / F.sum(w)).alias("em"))
    return tasks.groupBy("model").agg((F.count("*") / F.sum(1 / (F.col("em") + EPSILON))).alias("score"), F.count("*").alias("n_tasks"))


def ranked_values(rows: DataFrame, by: str, value: str) -> DataFrame:
    """by, value, n, upto, total: how many rows have each value, how many have it or less, and how many there are. Ranks come from a table of counts, so no group is ever held in one row."""
    counts = rows.groupBy(by, value).agg(F.count("*").alias("n"))
    of = Window.partitionBy(by)
    return counts.withColumn("upto", F.sum("n").over(of.orderBy(value))).withColumn("total", F.sum("n").over(of))


def at_rank(rank: Column, value: str) -> Column:
    """An aggregate over ranked_values: the value at a rank from 0."""
    return F.min(F.when(F.col("upto") > rank, F.col(value)))


def upper_median(x: str) -> Column:
    """Of a bounded group, such as the cells of a report; run_stats ranks by counts instead."""
    return F.element_at(F.array_sort(F.collect_list(x)), F.floor(F.count(x) / 2).cast("int") + 1)


def rescored(new: DataFrame, old: DataFrame, least: float = 0.005) -> DataFrame:
    """new (model, task, em), old (model, task, old_em): delta and whether it is worth a look, with a MEAN row for each model."""
    both = new.join(old, ["model", "task"], "left").withColumn("delta", F.col("em") - F.col("old_em"))
    # one grouping gives the rows, one for each model and task, and the means of models
    rows = both.rollup("model", "task").agg(*(F.avg(c).alias(c) for c in ("em", "old_em", "delta")), F.grouping_id().alias("g")).where("g < 3")
    rows = rows.select("model", F.when(F.col("g") == 1, "MEAN").otherwise(F.col("task")).alias("task"), "em", "old_em", "delta")
    return rows.withColumn("changed", F.coalesce(F.abs("delta") >= least, F.lit(False)))


def run_stats(samples: DataFrame) -> DataFrame:
    """One row for each model of samples (model, resp, em): counts, upper median and 90th length, and rates."""
    rows = samples.select("model", "em", "resp", F.length("resp").alias("len"))
    rate = lambda c: F.avg(c.cast("double"))
    rates = rows.groupBy("model").agg(
        F.count("*").alias("n"),
        F.avg("em").alias("em"),
        rate(F.col("resp").contains("<think>") | F.col("resp").contains("<|channel>thought")).alias("think_rate"),
        rate(F.trim("resp") == "").alias("empty_rate"),
        rate(F.col("resp").contains("<think>") & ~F.col("resp").contains("</think>")).alias("truncation_rate"),
        rate(F.col("len") < SHORT_TOKENS * 4).alias("short_rate"),
    )
    lengths = ranked_values(rows.where("len is not null"), "model", "len").groupBy("model").agg(at_rank(F.floor(F.col("total") / 2), "len").alias("median_len"), at_rank(F.floor((F.col("total") - 1) * 0.9), "len").alias("p90_len"))
    return rates.join(lengths, "model", "left").select("model", "n", "em", "median_len", "p90_len", "think_rate", "empty_rate", "truncation_rate", "short_rate")


def gated(stats: DataFrame, expect_thinking: bool) -> DataFrame:
    """failures: what is wrong with a run; warnings: what may be."""
    think = F.when(F.col("think_rate") < 0.5, "no thinking") if expect_thinking else F.when(F.col("think_rate") > 0.5, "thinking")
    bad = [think, F.when(F.col("empty_rate") > 0.2, "empty")] + ([F.when(F.col("short_rate") > 0.5, "short")] if expect_thinking else []) + [F.when(F.col("em") == 0, "zero score")]
    return stats.select("model", F.array_join(F.array_compact(F.array(*bad)), ",").alias("failures"), (F.col("truncation_rate") > 0.3).alias("warning"))


def _grams(text: Column, q: Column) -> Column:
    """The distinct parts of q characters of a text that has as many at least."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - q + 1), lambda i: F.substr(text, i, q)))


def fuzzy_matched(models: DataFrame, external: DataFrame) -> DataFrame:
    """models (model) left join external (id, ...): the shortest id that holds the model's last name part, without the characters of '-Instruct' at its ends.

    An id holds a name only if it holds all parts of GRAM characters of it (a shorter name is one part), so each name is
    looked up by that one of its parts that the fewest ids have, in an index of the parts of ids, and then compared.
    """
    tail = F.btrim(F.element_at(F.split("model", "/"), -1), F.lit("-Instruct"))
    named = models.select("model", tail.alias("tail")).distinct()
    sized = named.where("tail <> ''").select("tail", F.least(F.lit(GRAM), F.length("tail")).alias("q")).distinct()
    wanted = sized.select("tail", F.explode(_grams(F.col("tail"), F.col("q"))).alias("gram"))
    sizes = [r.q for r in sized.select("q").distinct().collect()]  # GRAM rows at most
    of_size = lambda q: external.where(F.length("id") >= q).select("*", F.explode(_grams(F.col("id"), F.lit(q))).alias("gram"))
    index = reduce(DataFrame.unionByName, map(of_size, sizes or [GRAM]))
    counts = index.select("gram").join(wanted.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    order = Window.partitionBy("tail").orderBy(F.coalesce("n", F.lit(0)), "gram")
    rarest = wanted.join(counts, "gram", "left").withColumn("nth", F.row_number().over(order)).where("nth = 1 and n > 0").select("gram", "tail")
    shortest = F.min(F.struct(F.length("id").alias("n"), "id", *(c for c in external.columns if c != "id"))).alias("x")
    best = index.join(rarest, "gram").where(F.col("id").contains(F.col("tail"))).groupBy("tail").agg(shortest)
    # every id holds the empty name
    best = best.unionByName(external.where("id is not null").agg(shortest).where("x is not null").select(F.lit("").alias("tail"), "x"))
    found = named.join(best, "tail").select(F.col("model").alias("m"), "x")
    return models.join(found, F.col("model") == F.col("m"), "left").select(*models.columns, *(F.col(f"x.{c}").alias(c) for c in external.columns))


def correlated(pairs: DataFrame, *by: str) -> DataFrame:
    """Pearson's r of x and y by group; 0 for a single pair; and its standard error."""
    got = pairs.where("x is not null and y is not null").groupBy(*by).agg(F.count("*").alias("n"), F.corr("x", "y").alias("c"))
    r = F.when(F.col("n") <= 1, 0.0).otherwise(F.col("c"))
    return got.select(*by, "n", r.alias("r"), F.sqrt((1 - r * r) / (F.greatest("n", F.lit(3)) - 2)).alias("std"))


def only_models(rates: DataFrame, wanted: list[str]) -> tuple[DataFrame, list[str]]:
    """The rows of the wanted models, and which of these are missing; all rows where none is wanted or none is there."""
    if not wanted:
        return rates, []
    found = {r.model for r in rates.where(F.col("model").isin(wanted)).select("model").distinct().collect()}
    return (rates.where(F.col("model").isin(wanted)) if found else rates), [m for m in wanted if m not in found]


def of_model(rates: DataFrame, model: str) -> DataFrame:
    """seq_len by question type, of one model."""
    return pivoted(rates.where(F.col("model") == model), "seq_len", "qtype")


def ordered_tasks(rates: DataFrame, order: list[str]) -> DataFrame:
    """`rates` with code (null for an unknown type) and place, the rank of the code in `order` (null beyond it)."""
    coded = with_task(rates).withColumnRenamed("task", "code")
    return coded.withColumn("place", F.nullif(F.array_position(F.array(*map(F.lit, order)), F.col("code")), F.lit(0)) - 1)


def token_table(samples: DataFrame) -> DataFrame:
    """Of samples (task, seq_len, em, resp): exact match, count, reasoning and output tokens by cell, and the share with more than 10 reasoning tokens."""
    rows = samples.withColumn("reasoning", answers.reasoning_tokens(F.col("resp")))
    return rows.groupBy("task", "seq_len").agg(
        F.avg("em").alias("em"),
        F.count("*").alias("n"),
        F.avg("reasoning").alias("reasoning_tokens"),
        (F.sum(F.length("resp")) / (4 * F.count("*"))).alias("output_tokens"),
        F.avg((F.col("reasoning") > 10).cast("double")).alias("share_reasoning"),
    )


def model_summary(cells: DataFrame) -> DataFrame:
    """Of cells (model, task, seq_len, em, n, reasoning_tokens, output_tokens): a row for each model, best mean first, with the weighted score."""
    plain = cells.groupBy("model").agg(F.avg("em").alias("em"), F.sum("n").alias("n"), F.avg("reasoning_tokens").alias("reasoning_tokens"), F.avg("output_tokens").alias("output_tokens"))
    return plain.join(weighted(cells.select("model", "task", "seq_len", "em")), "model").orderBy(F.desc("em"), "model")


def mean_hits(rates: DataFrame) -> DataFrame:
    """seq_len, model, hit: the mean over questions, without models that never hit anything."""
    out = rates.groupBy("seq_len", "model").agg(F.avg("hit").alias("hit"))
    return out.join(rates.where("hit <> 0").select("model").distinct(), "model", "left_semi").select("seq_len", "model", "hit")


def histogram(rows: DataFrame, column: str) -> DataFrame:
    """value, n: how often each value occurs."""
    return rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def order_statistics(rows: DataFrame, x: Column, ranks: list[int], at_once: int = AT_ONCE) -> dict[int, float]:
    """The values of some ranks, from 0, of a column in ascending order, exactly; null and NaN don't count.

    A range that holds a rank's value is narrowed, pass by pass, to what lies between two approximate percentiles around
    it, and counted; when at_once values are left, these are sorted. No task holds more than a sketch or that many values.
    """
    values = rows.select(x.cast("double").alias("x")).where("x is not null and not isnan(x)")
    whole = values.agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count("*").alias("n")).first()
    found: dict[int, float] = {}
    # rank: least and greatest value of its range, how many are below and within
    ranges = {r: (whole.low, whole.high, 0, whole.n) for r in ranks if 0 <= r < whole.n}
    while ranges:
        found |= {r: low for r, (low, high, _, _) in ranges.items() if low == high}
        small = {x[:3] for x in ranges.values() if x[0] < x[1] and x[3] <= at_once}
        for low, high, below in small:
            got = [r.x for r in values.where(F.col("x").between(low, high)).orderBy("x").collect()]  # at_once at most
            found |= {r: got[r - below] for r, x in ranges.items() if x[:3] == (low, high, below)}
        ranges = {r: x for r, x in ranges.items() if r not in found}
        if not ranges:
            break
        inside = lambda low, high: F.when(F.col("x").between(low, high), F.col("x"))
        around = lambda r, below, n: [min(1.0, max(0.0, (r - below) / n + d)) for d in (-2 / ACCURACY, 2 / ACCURACY)]
        sketch = values.agg(*(F.percentile_approx(inside(low, high), around(r, below, n), ACCURACY).alias(f"r{r}") for r, (low, high, below, n) in ranges.items())).first()
        counts = []
        for r, (low, high, _, _) in ranges.items():
            a, b = sketch[f"r{r}"]
            # the two ends are told on their own, so that a range of few values that repeat gets narrower too
            parts = {"l": F.col("x") < a, "a": F.col("x") == a, "m": (F.col("x") > a) & (F.col("x") < b), "b": (F.col("x") == b) & F.lit(a < b), "h": F.col("x") > b}
            within = F.col("x").between(low, high)
            counts += [F.count_if(within & c).alias(f"{k}{r}") for k, c in parts.items()]
            limits = {"l": F.max(F.when(within & parts["l"], F.col("x"))), "m": F.min(F.when(within & parts["m"], F.col("x"))), "n": F.max(F.when(within & parts["m"], F.col("x"))), "h": F.min(F.when(within & parts["h"], F.col("x")))}
            counts += [c.alias(f"e{k}{r}") for k, c in limits.items()]
        told = values.agg(*counts).first().asDict()
        narrowed = {}
        for r, (low, high, below, _) in ranges.items():
            a, b = sketch[f"r{r}"]
            bounds = {"l": (low, told[f"el{r}"]), "a": (a, a), "m": (told[f"em{r}"], told[f"en{r}"]), "b": (b, b), "h": (told[f"eh{r}"], high)}
            for k, (x0, x1) in bounds.items():
                if r < below + told[f"{k}{r}"]:
                    narrowed[r] = (x0, x1, below, told[f"{k}{r}"])
                    break
                below += told[f"{k}{r}"]
        ranges = narrowed
    return found


def described(rows: DataFrame, column: str) -> DataFrame:
    """One row: count, mean, standard deviation, least, quartiles (interpolated) and greatest of a column."""
    x = F.col(column).cast("double")
    n = rows.select(x.alias("x")).where("x is not null and not isnan(x)").count()
    places = {f"p{int(100 * q)}": q * (n - 1) for q in (0.25, 0.5, 0.75)}
    at = order_statistics(rows, x, sorted({k for p in places.values() for k in (math.floor(p), math.ceil(p))}))
    quartile = lambda p: at[math.floor(p)] + (at[math.ceil(p)] - at[math.floor(p)]) * (p - math.floor(p)) if n else None
    quartiles = [F.lit(quartile(p)).cast("double").alias(c) for c, p in places.items()]
    return rows.agg(F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max")).select("count", "mean", "std", "min", *quartiles, "max")


def run_report(samples: DataFrame) -> DataFrame:
    """task, n, em of samples (task, em), with a TOTAL row."""
    out = samples.rollup("task").agg(F.count("*").alias("n"), F.avg("em").alias("em"), F.grouping("task").alias("g"))
    return out.select(F.when(F.col("g") == 1, "TOTAL").otherwise(F.col("task")).alias("task"), "n", "em")
