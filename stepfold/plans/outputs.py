"""Model outputs made from the answers, as data for extraction, scoring and leaderboards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepfold.model import LEADERBOARD_TASKS, atype
from stepfold.operators.questions import QUESTIONS
from stepfold.plans import question_sql
from stepfold.plans.state import World

LENGTHS = (16, 32)
MODELS = ["one/alpha-Instruct", "two/beta", "three/gamma"]


def _dense(w: World) -> DataFrame:
    """A row for each sequence: its bindings and its answers to the leaderboard's questions by name, null where one isn't valid. One pass over the state, whose partitioning by sequence serves the grouping."""
    rows = w.with_param(w.company).where("step_id between f0 and f1")
    crowd, c0, r0 = F.col("n") >= F.col("n_crowd"), F.col("ch") == F.col("c0"), F.col("room") == F.col("r0")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("step_id") % 63)
    steps = [F.bit_or(F.when(crowd & (F.floor(F.col("step_id") / 63) == k), bit)).alias(f"crowd{k}") for k in range(w.length // 63 + 1)]
    counts = rows.groupBy("seq_id", "is_more", "f0", "f1").agg(
        F.array(*(F.count_if((F.col("ch") == x) & (F.col("n") == 1)) for x in w.chars)).alias("alone"),
        F.array(*(F.count_if((F.col("ch") == x) & r0) for x in w.chars)).alias("who"),
        F.array(*(F.count_if((F.col("room") == x) & c0) for x in w.rooms)).alias("where"),
        F.count_if(c0 & r0).alias("steps"),
        *steps,
    )

    def extreme(counts: str, names: tuple[str, ...]) -> Column:
        """The one name with the most or least, null if several have it."""
        best = F.when(F.col("is_more"), F.array_max(counts)).otherwise(F.array_min(counts))
        tied = F.filter(F.arrays_zip(F.col(counts).alias("n"), F.array(*map(F.lit, names)).alias("name")), lambda x: x["n"] == best)
        return F.when(F.size(tied) == 1, F.get(tied, F.lit(0))["name"])

    span = F.col("f1") - F.col("f0") + 1
    found = {
        "spend_alone": F.when(F.col("is_more") | (span >= 3), extreme("alone", w.chars)),
        "steps_in_room": F.col("steps").cast("string"),
        "crowd_count": sum((F.coalesce(F.bit_count(f"crowd{k}"), F.lit(0)) for k in range(len(steps))), F.lit(0)).cast("string"),
        "where_spend": F.when(F.col("is_more") | (len(w.rooms) - span <= 1), extreme("where", w.rooms)),
        "who_spend": extreme("who", w.chars),
    }
    return counts.select("seq_id", "f0", "f1", *(x.alias(q) for q, x in found.items()))


def dense_answers(w: World) -> DataFrame:
    """seq_id, qtype, answer of every valid answer to the leaderboard's questions."""
    each = F.explode(F.array(*(F.struct(F.lit(q).alias("qtype"), F.col(q).alias("answer")) for q in LEADERBOARD_TASKS))).alias("x")
    return _dense(w).select("seq_id", each).select("seq_id", "x.*").where("answer is not null")


def dense_cells(w: World) -> DataFrame:
    """qtype, seq_id, step_id, room of the cells that support these answers, each once: the state meets the answers of its sequence within the one partitioning, and each row tells what it supports."""
    won = _dense(w).select("seq_id", *(F.col(q).alias(f"won_{q}") for q in ("spend_alone", "where_spend", "who_spend")))
    rows = w.with_param(w.company.join(won, "seq_id")).where("step_id between f0 and f1")
    mine, here = F.col("ch") == F.col("c0"), F.col("room") == F.col("r0")
    supports = {
        "spend_alone": (F.col("n") == 1) & (F.col("ch") == F.col("won_spend_alone")),
        "steps_in_room": mine & here,
        "crowd_count": F.col("n") >= F.col("n_crowd"),
        "where_spend": mine & (F.col("room") == F.col("won_where_spend")),
        # every step of the range, whether anyone is there or not
        "who_spend": (F.col("ch") == w.chars[0]) & F.col("won_who_spend").isNotNull(),
    }
    cell = {q: F.struct(F.lit(q).alias("qtype"), F.col("r0" if q == "who_spend" else "room").alias("room")) for q in supports}
    each = F.explode(F.array_compact(F.array(*(F.when(on, cell[q]) for q, on in supports.items())))).alias("x")
    return rows.select("seq_id", "step_id", each).select("x.qtype", "seq_id", "step_id", "x.room").where("room is not null").distinct()


def gold(worlds: dict, qtypes: list[str] = LEADERBOARD_TASKS) -> DataFrame:
    """qid, qtype, seq_len, atype, gold of every valid answer; worlds by length."""
    if set(qtypes) <= set(LEADERBOARD_TASKS):
        place = F.array_position(F.array(*map(F.lit, qtypes)), F.col("qtype")) - 1
        kind = F.element_at(F.create_map(*(F.lit(x) for q in qtypes for x in (q, atype(q)))), F.col("qtype"))
        parts = [dense_answers(w).where(F.col("qtype").isin(qtypes)).select((F.col("seq_id") * 10 + place).alias("qid"), "qtype", F.lit(n).alias("seq_len"), kind.alias("atype"), F.col("answer").alias("gold")) for n, w in worlds.items()]
        return reduce(DataFrame.unionByName, parts)
    parts = [
        QUESTIONS[q](w)[0].where("valid").select((F.col("seq_id") * 10 + k).alias("qid"), F.lit(q).alias("qtype"), F.lit(n).alias("seq_len"), F.lit(atype(q)).alias("atype"), F.col("answer").alias("gold"))
        for n, w in worlds.items()
        for k, q in enumerate(qtypes)
    ]
    return reduce(DataFrame.unionByName, parts)


def model_output(answers: DataFrame) -> DataFrame:
    """answers with model and resp: right or wrong values in nine wrappings."""
    m = F.col("m")
    rows = answers.withColumn("m", F.explode(F.sequence(F.lit(0), F.lit(len(MODELS) - 1))))
    wrong = F.when(F.col("atype") == "number", (F.col("gold").cast("long") + 1).cast("string")).when(F.col("atype") == "room", "Kitchen").otherwise("Mary")
    x = F.when((F.col("qid") * 7 + m) % 5 == 0, wrong).otherwise(F.col("gold"))
    forms = ["{}", '{{"answer": "{}"}}', "The answer is {}", "Ответ: {}", "\\boxed{{{}}}", "so **{}**", "<think>answer: 99</think>{}", "<|channel>thought hm<channel|>{}", ""]
    k = (F.col("qid") + m) % len(forms)
    resp = F.lit("")
    for i, f in enumerate(forms):
        a, _, b = f.partition("{}") if "{}" in f else (f, "", "")
        text = F.concat(F.lit(a.replace("{{", "{")), x, F.lit(b.replace("}}", "}"))) if f else F.lit("")
        resp = F.when(k == i, text).otherwise(resp)
    return rows.withColumn("resp", resp).withColumn("model", F.element_at(F.array(*map(F.lit, MODELS)), m + 1)).drop("m")


def gold_sql(qtypes: list[str] = LEADERBOARD_TASKS) -> str:
    return " UNION ALL ".join(f"SELECT seq_id * 10 + {k} AS qid, '{q}' AS qtype, {n} AS seq_len, '{atype(q)}' AS atype, answer AS gold FROM ({question_sql.answer_sql(q, length=n)}) WHERE valid" for n in LENGTHS for k, q in enumerate(qtypes))


def output_sql() -> str:
    models = "[" + ", ".join(f"'{x}'" for x in MODELS) + "]"
    forms = ["x", "concat('{\"answer\": \"', x, '\"}')", "'The answer is ' || x", "'Ответ: ' || x", "'\\boxed{' || x || '}'", "'so **' || x || '**'", "'<think>answer: 99</think>' || x", "'<|channel>thought hm<channel|>' || x", "''"]
    return f"""WITH gold AS ({gold_sql()}),
v AS (SELECT *, CASE WHEN (qid * 7 + m) % 5 = 0 THEN CASE atype WHEN 'number' THEN CAST(TRY_CAST(gold AS BIGINT) + 1 AS VARCHAR) WHEN 'room' THEN 'Kitchen' ELSE 'Mary' END ELSE gold END AS x FROM gold, range(0, {len(MODELS)}) t(m)),
outputs AS (SELECT qid, qtype, seq_len, atype, gold, {models}[m + 1] AS model, CASE (qid + m) % {len(forms)} {' '.join(f'WHEN {i} THEN {f}' for i, f in enumerate(forms))} END AS resp FROM v)"""
