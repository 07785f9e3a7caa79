"""Queries beyond the 24, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stepfold.functions import answers, rewards, wording
from stepfold.model import LEADERBOARD_TASKS, ROOMS, TASKS, GenerationConfig
from stepfold.operators import curation, leaderboard, segments
from stepfold.plans import generate, outputs, question_sql
from stepfold.plans.state import World, rooms_map, wide, world_of_events

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def world(spark: SparkSession, sf_dir: str, length: int = 32, ranged: bool = False) -> World:
    return world_of_events(table(spark, sf_dir, "events"), length, ranged)


P = question_sql.prelude()
_texts = " UNION ALL ".join(f"SELECT seq_id, '{q}' AS qtype, {wording.question_sql(q, 'en', 32)} AS en, {wording.question_sql(q, 'ru', 32)} AS ru FROM param" for q in TASKS)


@query(question_sql.prelude(32, True) + f"x AS (SELECT 1) {_texts}")
def fmt_questions(spark, sf_dir):
    texts = [F.struct(F.lit(q).alias("qtype"), wording.question(q, "en", 32).alias("en"), wording.question(q, "ru", 32).alias("ru")) for q in TASKS]
    return world(spark, sf_dir, ranged=True).param.select("seq_id", F.explode(F.array(*texts)).alias("x")).select("seq_id", "x.*")


@query(question_sql.prelude(32, True) + f"x AS ({_texts}) SELECT seq_id, qtype, ru AS translated, true AS matched FROM x")
def loc_translated(spark, sf_dir):
    en = fmt_questions(spark, sf_dir)
    ru = wording.translate_question(F.col("en"))
    return en.select("seq_id", "qtype", ru.alias("translated"), (ru != F.col("en")).alias("matched"))


_cells = "string_agg(room || '=' || coalesce(names, ''), ';' ORDER BY room_ord)"
_rooms = "(SELECT unnest([" + ", ".join(f"'{r}'" for r in ROOMS) + "]) AS room, unnest(range(0, 6)) AS room_ord)"


@query(P + f"o AS (SELECT seq_id, step_id, room, string_agg(ch, '|' ORDER BY ch_ord) AS names FROM state GROUP BY ALL), g AS (SELECT DISTINCT seq_id, step_id FROM state) SELECT g.seq_id, g.step_id, {_cells} AS cells FROM g CROSS JOIN {_rooms} r LEFT JOIN o USING (seq_id, step_id, room) GROUP BY ALL")
def nest_steps(spark, sf_dir):
    steps = rooms_map(world(spark, sf_dir).state)
    return steps.select("seq_id", "step_id", F.array_join(F.transform(F.map_entries("rooms"), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], "|"))), ";").alias("cells"))


def jsonl_context(state: DataFrame) -> DataFrame:
    """seq_id, context: a JSON line for each step, with ', ' and ': ' between, as other writers have it."""
    entry = lambda e: F.concat(F.lit('"'), e["key"], F.lit('": ['), F.array_join(F.transform(e["value"], lambda c: F.concat(F.lit('"'), c, F.lit('"'))), ", "), F.lit("]"))
    line = F.concat(F.lit('{"step_id": '), F.col("step_id").cast("string"), F.lit(', "rooms": {'), F.array_join(F.transform(F.map_entries("rooms"), entry), ", "), F.lit("}}"))
    lines = rooms_map(state).select("seq_id", F.struct("step_id", line.alias("line")).alias("x")).groupBy("seq_id").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return lines.select("seq_id", F.array_join(F.transform("xs", lambda x: x["line"]), "\n").alias("context"))


@query(P + f"o AS (SELECT seq_id, step_id, room, string_agg('\"' || ch || '\"', ', ' ORDER BY ch_ord) AS names FROM state GROUP BY ALL), g AS (SELECT DISTINCT seq_id, step_id FROM state), l AS (SELECT g.seq_id, g.step_id, '{{\"step_id\": ' || g.step_id || ', \"rooms\": {{' || string_agg('\"' || room || '\": [' || coalesce(names, '') || ']', ', ' ORDER BY room_ord) || '}}}}' AS line FROM g CROSS JOIN {_rooms} r LEFT JOIN o USING (seq_id, step_id, room) GROUP BY g.seq_id, g.step_id) SELECT seq_id, sha256(string_agg(line, chr(10) ORDER BY step_id)) AS hash FROM l GROUP BY seq_id")
def fmt_jsonl_hash(spark, sf_dir):
    return jsonl_context(world(spark, sf_dir).state).select("seq_id", F.sha2("context", 256).alias("hash"))


@query(P + "x AS (SELECT 1) SELECT seq_id, step_id, max(room) FILTER (ch = 'Sandra') AS Sandra, max(room) FILTER (ch = 'Mary') AS Mary, max(room) FILTER (ch = 'John') AS John, max(room) FILTER (ch = 'Daniel') AS Daniel, max(room) FILTER (ch = 'Michael') AS Michael FROM state GROUP BY ALL")
def nest_wide(spark, sf_dir):
    return wide(world(spark, sf_dir).state)


_all_cells = " UNION ALL ".join(f"SELECT '{q}' AS qtype, seq_id, step_id, room FROM ({question_sql.cells_sql(q)})" for q in LEADERBOARD_TASKS)


@query(f"SELECT qtype, seq_id, step_id, count(*) AS n_relevant, CAST(sum(count(*)) OVER (PARTITION BY qtype, seq_id) AS BIGINT) AS n_total FROM ({_all_cells}) GROUP BY qtype, seq_id, step_id")
def rel_counts(spark, sf_dir):
    cells = outputs.dense_cells(world(spark, sf_dir))
    return cells.groupBy("qtype", "seq_id", "step_id").agg(F.count("*").alias("n_relevant")).withColumn("n_total", F.sum("n_relevant").over(Window.partitionBy("qtype", "seq_id")))


# answers and scores


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = outputs.model_output(outputs.gold({n: world(spark, sf_dir, n) for n in outputs.LENGTHS}))
    out = answers.with_answer(out).withColumn("want", answers.normalized(F.col("gold"), F.col("atype")))
    return leaderboard.with_task(out.withColumn("em", answers.exact(F.col("pred"), F.col("want"))))


# the SQL states names and patterns for itself, so that a wrong one of the library shows
_names = (
    "WHEN 'kitchen' THEN 'Кухня' WHEN 'bathroom' THEN 'Ванная' WHEN 'garden' THEN 'Сад' WHEN 'office' THEN 'Офис' WHEN 'bedroom' THEN 'Спальня' WHEN 'hallway' THEN 'Коридор' "
    "WHEN 'sandra' THEN 'Сандра' WHEN 'mary' THEN 'Мария' WHEN 'john' THEN 'Иван' WHEN 'daniel' THEN 'Даниил' WHEN 'michael' THEN 'Михаил' "
    "WHEN 'nobody' THEN 'Никто' WHEN 'no one' THEN 'Никто' WHEN 'none' THEN 'Никто' WHEN 'никого' THEN 'Никто' WHEN 'никто' THEN 'Никто'"
)
_json = """\\{ *["'']answer["''] *: *["'']?([^"''} ]+)"""
_said = """(?:answer|result|Answer|Result) *(?:is|:) *([A-Za-zА-Яа-я0-9]+)"""
_ru = """(?:ответ|Ответ|результат|Результат) *[:—–-] *([A-Za-zА-Яа-я0-9]+)"""
_norm = "CASE WHEN {0} = '' THEN '' WHEN atype = 'number' THEN coalesce(nullif(regexp_replace({0}, '[^0-9]', '', 'g'), ''), '0') ELSE CASE lower(regexp_replace(trim({0}), '[.,!?;:]+$', '')) " + _names + " ELSE upper(left(trim({0}), 1)) || lower(substr(regexp_replace(trim({0}), '[.,!?;:]+$', ''), 2)) END END"
SCORED = (
    outputs.output_sql()
    + rf""",
r1 AS (SELECT *, regexp_replace(trim(resp), '(?s)<think>.*?</think>', '', 'g') AS t FROM outputs),
r2 AS (SELECT *, trim(CASE WHEN contains(t, '<channel|>') THEN split_part(list_last(string_split(t, '<channel|>')), '<|channel>', 1) ELSE t END) AS rest FROM r1),
r3 AS (SELECT *, coalesce(nullif(regexp_extract(rest, '{_json}', 1), ''), list_last(regexp_extract_all(rest, '{_said}', 1)), list_last(regexp_extract_all(rest, '{_ru}', 1)), nullif(regexp_extract(rest, '\\boxed\{{([^}}]+)\}}', 1), ''), list_last(regexp_extract_all(rest, '\*\*([A-Za-zА-Яа-я0-9]+)\*\*', 1)), CASE WHEN atype = 'number' THEN nullif(regexp_extract(rest, '\d+'), '') ELSE string_split(rest, ' ')[1] END, '') AS raw FROM r2),
scored AS (SELECT *, {_norm.format('raw')} AS pred, {_norm.format('gold')} AS want, CASE qtype {' '.join(f"WHEN '{q}' THEN '{t}'" for q, t in TASKS.items())} END AS task FROM r3),
s AS (SELECT *, CAST(lower(pred) = lower(want) AS DOUBLE) AS em FROM scored)
"""
)


@query(SCORED + "SELECT model, qid, qtype, seq_len, pred, want, em FROM s")
def extract_answers(spark, sf_dir):
    return scored(spark, sf_dir).select("model", "qid", "qtype", "seq_len", "pred", "want", "em")


@query(SCORED + """, n AS (SELECT *, regexp_matches(resp, '\\d') AND regexp_matches(pred, '^\\d+$') AS ok, TRY_CAST(pred AS DOUBLE) AS p, TRY_CAST(gold AS DOUBLE) AS g FROM s WHERE atype = 'number'),
e AS (SELECT *, CASE WHEN ok THEN abs(p - g) ELSE CAST(seq_len AS DOUBLE) END AS mae FROM n)
SELECT model, qid, qtype, seq_len, mae, least(mae / greatest(seq_len, 1), 1.0) AS mae_norm, CASE WHEN NOT ok THEN 1.0 WHEN p = 0 AND g = 0 THEN 0.0 ELSE abs(p - g) / (abs(p) + abs(g)) END AS smape, CAST(ok AS DOUBLE) AS parsed FROM e""")
def score_numbers(spark, sf_dir):
    rows = scored(spark, sf_dir).where("atype = 'number'")
    return rows.select("model", "qid", "qtype", "seq_len", *(c.alias(k) for k, c in answers.numeric_scores(F.col("pred"), F.col("gold"), F.col("resp"), F.col("seq_len")).items()))


@query(SCORED + "SELECT model, coalesce('em.' || task || coalesce('.len' || seq_len, ''), 'em.dc_aggregate') AS metric, avg(em) AS value FROM s GROUP BY GROUPING SETS ((model), (model, task), (model, task, seq_len))")
def score_metrics(spark, sf_dir):
    sets = scored(spark, sf_dir).groupingSets([["model"], ["model", "task"], ["model", "task", "seq_len"]], "model", "task", "seq_len").agg(F.avg("em").alias("value"))
    name = F.coalesce(F.concat(F.lit("em."), F.col("task"), F.coalesce(F.concat(F.lit(".len"), F.col("seq_len").cast("string")), F.lit(""))), F.lit("em.dc_aggregate"))
    return sets.select("model", name.alias("metric"), "value")


def _rates(spark, sf_dir):
    return leaderboard.hit_rates(scored(spark, sf_dir).withColumn("hit", F.col("em").cast("int")))


_RATES = SCORED + ", h AS (SELECT seq_len, qtype, model, round_even(sum(em) / 50 * 100, 3) AS hit, round_even(avg(em) * 100, 3) AS mean_hit FROM s GROUP BY ALL) "
_HM = "CASE WHEN min(hit) <= 0 THEN 0.0 ELSE count(hit) / sum(1 / hit) END"


@query(_RATES + "SELECT * FROM h")
def lb_hit_rates(spark, sf_dir):
    return _rates(spark, sf_dir)


@query(_RATES + f"SELECT qtype, model, avg(hit) AS mean, {_HM} AS hmean FROM h GROUP BY ALL")
def lb_means_over_lengths(spark, sf_dir):
    return leaderboard.means(_rates(spark, sf_dir), "qtype", "model")


@query(_RATES + f"SELECT seq_len, model, avg(hit) AS mean, {_HM} AS hmean FROM h GROUP BY ALL")
def lb_means_over_questions(spark, sf_dir):
    return leaderboard.means(_rates(spark, sf_dir), "seq_len", "model")


@query(_RATES + "SELECT seq_len, " + ", ".join(f"avg(hit) FILTER (qtype = '{q}') AS {q}" for q in LEADERBOARD_TASKS) + " FROM h GROUP BY seq_len")
def lb_pivot(spark, sf_dir):
    return leaderboard.pivoted(_rates(spark, sf_dir), "seq_len", "qtype")


_CELLS = SCORED + ", c AS (SELECT model, task, seq_len, avg(em) AS em FROM s GROUP BY ALL) "


@query(_CELLS + ", t AS (SELECT model, task, sum(pow(2, seq_len / 32) * em) / sum(pow(2, seq_len / 32)) AS em FROM c GROUP BY ALL) SELECT model, count(*) / sum(1 / (em + 1e-6)) AS score, count(*) AS n_tasks FROM t GROUP BY model")
def lb_weighted_hmean(spark, sf_dir):
    return leaderboard.weighted(scored(spark, sf_dir).groupBy("model", "task", "seq_len").agg(F.avg("em").alias("em")))


@query(_CELLS + ", b AS (SELECT model, task, avg(em) AS em, avg(em) FILTER (qid % 3 = 0) AS old_em FROM s GROUP BY ALL), d AS (SELECT *, em - old_em AS delta FROM b UNION ALL SELECT model, 'MEAN', avg(em), avg(old_em), avg(em - old_em) FROM b GROUP BY model) SELECT *, coalesce(abs(delta) >= 0.005, false) AS changed FROM d")
def lb_rescore_diff(spark, sf_dir):
    s = scored(spark, sf_dir)
    by = lambda df, name: df.groupBy("model", "task").agg(F.avg("em").alias(name))
    return leaderboard.rescored(by(s, "em"), by(s.where("qid % 3 = 0"), "old_em"))


_STATS = SCORED + ", g AS (SELECT model, count(*) AS n, avg(em) AS em, list_sort(list(length(resp)))[count(*) // 2 + 1] AS median_len, list_sort(list(length(resp)))[CAST(floor((count(*) - 1) * 0.9) AS BIGINT) + 1] AS p90_len, avg(CAST(contains(resp, '<think>') OR contains(resp, '<|channel>thought') AS DOUBLE)) AS think_rate, avg(CAST(trim(resp) = '' AS DOUBLE)) AS empty_rate, avg(CAST(contains(resp, '<think>') AND NOT contains(resp, '</think>') AS DOUBLE)) AS truncation_rate, avg(CAST(length(resp) < 128 AS DOUBLE)) AS short_rate FROM s GROUP BY model) "


@query(_STATS + "SELECT * FROM g")
def lb_run_stats(spark, sf_dir):
    return leaderboard.run_stats(scored(spark, sf_dir))


@query(_STATS + "SELECT model, concat_ws(',', CASE WHEN think_rate < 0.5 THEN 'no thinking' END, CASE WHEN empty_rate > 0.2 THEN 'empty' END, CASE WHEN short_rate > 0.5 THEN 'short' END, CASE WHEN em = 0 THEN 'zero score' END) AS failures, truncation_rate > 0.3 AS warning FROM g")
def lb_gates(spark, sf_dir):
    return leaderboard.gated(leaderboard.run_stats(scored(spark, sf_dir)), expect_thinking=True)


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, CASE WHEN count(*) <= 1 THEN 0.0 ELSE corr(l_quantity, l_discount) END AS r, sqrt((1 - power(CASE WHEN count(*) <= 1 THEN 0.0 ELSE corr(l_quantity, l_discount) END, 2)) / (greatest(count(*), 3) - 2)) AS std FROM lineitem GROUP BY ALL")
def lb_correlation(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"))
    return leaderboard.correlated(rows, "l_returnflag", "l_linestatus")


@query("WITH m AS (SELECT DISTINCT split_part(p_type, ' ', 1) AS model FROM part), e AS (SELECT DISTINCT p_name AS id FROM part) SELECT model, id FROM (SELECT model, id, row_number() OVER (PARTITION BY model ORDER BY length(id) NULLS FIRST, id) AS nth FROM m LEFT JOIN e ON contains(id, trim(split_part(model, '/', -1), '-Instruct'))) WHERE nth = 1")
def lb_fuzzy_join(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return leaderboard.fuzzy_matched(part.select(F.split("p_type", " ")[0].alias("model")).distinct(), part.select(F.col("p_name").alias("id")).distinct())


# curation


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def cur_resume(spark, sf_dir):
    return curation.remaining(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "source")


@query("WITH r AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY sha256('42:' || doc_id), doc_id) AS nth, count(*) OVER (PARTITION BY lang, source) AS n FROM documents) SELECT doc_id, lang, source, CASE WHEN nth <= round_even(n * 0.8, 0) THEN 'train' ELSE 'test' END AS split FROM r")
def cur_split(spark, sf_dir):
    return curation.split_stratified(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), ["lang", "source"], "doc_id")


@query("SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS nth FROM documents) WHERE nth <= 5")
def cur_limit(spark, sf_dir):
    return curation.first_per(table(spark, sf_dir, "documents"), 5, ["source"], "doc_id").select("doc_id", "source")


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS hash FROM documents GROUP BY sha256(text)")
def cur_dedup(spark, sf_dir):
    return curation.deduplicated(table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("hash")), ["hash"], "doc_id")


@query(question_sql.prelude() + "m AS (SELECT *, CAST('0x' || left(sha256('42:' || seq_id || ':' || step_id || ':' || ch_ord), 8) AS BIGINT) / 4294967296.0 AS u FROM state) SELECT seq_id, step_id, ch, CASE WHEN u < 0.25 THEN '?' ELSE room END AS room FROM m")
def cur_masked(spark, sf_dir):
    return curation.masked(world(spark, sf_dir).state, 0.25).select("seq_id", "step_id", "ch", "room")


_POOL = "WITH pool AS (SELECT conv_id * 100 + turn AS example_id, role AS qtype, CAST(4 * pow(2, turn % 3) AS INT) AS seq_len FROM conversations), "


@query(_POOL + "w AS (SELECT conv_id * 100 + turn AS qid, role AS qtype, CAST(8 * pow(2, conv_id % 4) AS INT) AS seq_len FROM conversations), r AS (SELECT *, row_number() OVER (PARTITION BY qtype, seq_len ORDER BY example_id) AS nth FROM pool), o AS (SELECT qtype, seq_len AS at, string_agg(example_id, ',' ORDER BY example_id) AS own FROM r WHERE nth <= 3 GROUP BY ALL), y AS (SELECT string_agg(example_id, ',' ORDER BY example_id) AS everything FROM (SELECT example_id FROM pool ORDER BY example_id LIMIT 3)) SELECT qid, coalesce(own, everything) AS shots FROM w LEFT JOIN o ON o.qtype = w.qtype AND o.at = least(w.seq_len, 16) CROSS JOIN y")
def cur_few_shots(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    key, kind = F.col("conv_id") * 100 + F.col("turn"), F.col("role").alias("qtype")
    pool = c.select(key.alias("example_id"), kind, (4 * F.pow(F.lit(2), F.col("turn") % 3)).cast("int").alias("seq_len"))
    return curation.few_shots(c.select(key.alias("qid"), kind, (8 * F.pow(F.lit(2), F.col("conv_id") % 4)).cast("int").alias("seq_len")), pool, 3)


@query(_POOL + "r AS (SELECT *, row_number() OVER (PARTITION BY qtype, seq_len ORDER BY example_id) AS nth FROM pool) SELECT example_id, qtype, seq_len FROM r WHERE (seq_len = 8 AND nth <= 3) OR (seq_len = 16 AND nth <= 2)")
def cur_quota(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    pool = c.select((F.col("conv_id") * 100 + F.col("turn")).alias("example_id"), F.col("role").alias("qtype"), (4 * F.pow(F.lit(2), F.col("turn") % 3)).cast("int").alias("seq_len"))
    return curation.quota(pool, {8: 3, 16: 2}, "qtype", "example_id")


# segments


@query("WITH c AS (SELECT conv_id, list(CAST(ceil(length(coalesce(text, '')) / 4.0) AS INT) ORDER BY turn) AS l FROM conversations GROUP BY conv_id), w AS (SELECT conv_id, list_reduce(list_prepend({'s': 1, 'f': 0}, list_transform(l, lambda x: {'s': 0, 'f': x})), lambda a, b: CASE WHEN a.f + b.f < 400 THEN {'s': a.s, 'f': a.f + b.f} ELSE {'s': a.s + 1, 'f': b.f} END) AS r FROM c) SELECT conv_id, r.s AS n, r.f AS fill FROM w")
def seg_packed(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", segments.proxy_tokens(F.coalesce("text", F.lit(""))).alias("n")))).alias("l"))
    packed = c.select("conv_id", segments.packed_steps(F.transform("l", lambda x: x["n"]), 400).alias("r"))
    return packed.select("conv_id", F.col("r.segments").alias("n"), F.col("r.fill").alias("fill"))


@query("WITH v AS (SELECT vec_id, range(0, vec_id % 11) AS t FROM embeddings), w AS (SELECT vec_id, len(t) AS n, t FROM v) SELECT vec_id, n // 4 + 1 AS n_segments, list_aggregate(list_transform(range(0, CAST(ceil(n / 4) AS BIGINT)), lambda i: list_aggregate(t[i * 4 + 1:i * 4 + 4], 'string_agg', '-')), 'string_agg', '|') AS parts FROM w WHERE n > 0")
def seg_cut(spark, sf_dir):
    t = F.when(F.col("vec_id") % 11 > 0, F.sequence(F.lit(0), (F.col("vec_id") % 11 - 1).cast("int")))
    v = table(spark, sf_dir, "embeddings").select("vec_id", t.alias("t")).where("t is not null")
    return v.select("vec_id", segments.n_segments(F.size("t"), 4).alias("n_segments"), F.array_join(F.transform(segments.cut(F.col("t"), 4), lambda s: F.array_join(s, "-")), "|").alias("parts"))


# rewards


@query("SELECT p_partkey, 1 - levenshtein(p_name, p_type) / greatest(length(p_name), length(p_type)) AS similarity FROM part WHERE length(p_name) > 0 AND length(p_type) > 0")
def rw_similarity(spark, sf_dir):
    return table(spark, sf_dir, "part").where("length(p_name) > 0 and length(p_type) > 0").select("p_partkey", rewards.similarity(F.col("p_name"), F.col("p_type")).alias("similarity"))


_COMPLETION = "concat('<think>', chr(10), repeat('because it is so. ', CAST(qid % 40 AS INT)), chr(10), '</think>', CASE WHEN qid % 2 = 0 THEN chr(10) ELSE ' then ' END, '<answer>', chr(10), CASE qid % 4 WHEN 0 THEN gold WHEN 1 THEN upper(gold) WHEN 2 THEN 'it is ' || gold ELSE 'none' END, chr(10), '</answer>')"


@query("WITH gold AS (" + outputs.gold_sql() + f"), c AS (SELECT *, {_COMPLETION} AS t FROM gold), x AS (SELECT *, trim(regexp_extract(t, '(?s)<answer>(.*?)</answer>', 1), chr(10)) AS said FROM c) SELECT qid, qtype, seq_len, CAST(CASE WHEN said = gold THEN 2.0 WHEN lower(said) = lower(gold) THEN 1.5 WHEN contains(said, gold) OR contains(gold, said) THEN 1.0 WHEN 1 - levenshtein(said, gold) / greatest(length(said), length(gold)) > 0.8 THEN 0.75 ELSE 0.0 END AS DOUBLE) AS correctness, CAST(CASE WHEN qid % 2 = 0 THEN 1.0 ELSE 0.5 END AS DOUBLE) AS form FROM x")
def rw_scores(spark, sf_dir):
    g = outputs.gold({n: world(spark, sf_dir, n) for n in outputs.LENGTHS})
    q = F.col("qid")
    said = F.when(q % 4 == 0, F.col("gold")).when(q % 4 == 1, F.upper("gold")).when(q % 4 == 2, F.concat(F.lit("it is "), F.col("gold"))).otherwise("none")
    text = F.concat(F.lit("<think>\n"), F.repeat(F.lit("because it is so. "), (q % 40).cast("int")), F.lit("\n</think>"), F.when(q % 2 == 0, "\n").otherwise(" then "), F.lit("<answer>\n"), said, F.lit("\n</answer>"))
    c = g.withColumn("t", text)
    return c.select("qid", "qtype", "seq_len", rewards.correctness(F.col("t"), F.col("gold")).alias("correctness"), rewards.form(F.col("t")).alias("form"))


@query(None)
def gen_questions(spark, sf_dir):
    """Question sets of the default configuration: 50 of each of 24 types at 8 lengths."""
    return generate.questions(spark, GenerationConfig()).drop("seq_id")


@query(
    P
    + """t AS (SELECT seq_id, count(*) FILTER (m.room = j.room) AS target FROM state AS m JOIN state AS j USING (seq_id, step_id) WHERE m.ch = 'Mary' AND j.ch = 'John' GROUP BY seq_id)
SELECT seq_id, target, target AS hits, 32 AS steps, 31 AS moves FROM t"""
)
def gen_controlled(spark, sf_dir):
    """A new sequence for each one of the events, in which Mary and John are together for as many steps; counted again from its state."""
    together = F.col("Mary") == F.col("John")
    of = lambda state: wide(state).groupBy("seq_id").agg(F.count_if(together).alias("target"))
    asked = of(world(spark, sf_dir).state)
    made = generate.controlled_for(asked.select("seq_id", F.col("target").alias("low"), F.col("target").alias("high")), 32, GenerationConfig(), together)
    hits = of(made).withColumnRenamed("target", "hits")
    before = F.lag("room").over(Window.partitionBy("seq_id", "ch_ord").orderBy("step_id"))
    moves = made.withColumn("moved", (F.col("room") != before).cast("int")).groupBy("seq_id").agg(F.sum("moved").cast("int").alias("moves"), F.max("step_id").alias("steps"))
    return asked.join(hits, "seq_id").join(moves, "seq_id").select("seq_id", "target", "hits", "steps", "moves")
