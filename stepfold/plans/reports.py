"""Queries over records, reports, segments and rewards, with DuckDB SQL that states names and patterns for itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepfold.functions import answers, json_repair, rewards, sentences
from stepfold.model import TASKS
from stepfold.operators import curation, leaderboard, segments
from stepfold.plans import generate, outputs, question_sql, records
from stepfold.plans.catalog import _RATES, SCORED, P, _rates, query, scored, table, world
from stepfold.plans.state import sequences

_GOLD = "WITH gold AS (" + outputs.gold_sql() + ") "


def _gold(spark, sf_dir) -> DataFrame:
    return outputs.gold({n: world(spark, sf_dir, n) for n in outputs.LENGTHS})


# legacy scoring: what each wrapping must score is known from how it is made


@query(
    _GOLD
    + """SELECT qid, qtype, seq_len,
CASE WHEN qid % 9 = 7 THEN 0
     WHEN qid % 9 = 4 THEN CASE WHEN gold IN ('Nobody', '0') THEN 1 ELSE 0 END
     ELSE 1 END AS hit
FROM gold WHERE qid % 9 <> 8"""
)
def legacy_hits(spark, sf_dir):
    """Nine wrappings of a right answer: JSON, single quotes, bare, after reasoning, a list of two people, in tags, in a sentence, a wrong one, an error."""
    g, k = F.col("gold"), F.col("qid") % 9
    forms = ['{"answer": "%s"}', "{'answer': '%s'}", "%s", 'hm</think>{"answer": "%s"}', '{"answer": ["Mary", "John"]}', '</think><answer>{"answer": "%s"}</answer>', "it is %s", "Attic", "Error: %s"]
    text = F.lit("")
    for i, form in enumerate(forms):
        text = F.when(k == i, F.format_string(form, g) if "%s" in form else F.lit(form)).otherwise(text)
    rows = _gold(spark, sf_dir).withColumn("answer", g).withColumn("Predicted_Answer", text)
    return answers.legacy_scored(rows).select("qid", "qtype", "seq_len", "hit")


@query(
    r"""WITH c AS (SELECT conv_id, turn, role, trim(regexp_replace(text, '[\x00-\x20''"\\\[\]{}]+', ' ', 'g')) AS note, (conv_id * 8 + turn) % 12 AS k FROM conversations)
SELECT conv_id, turn, CASE WHEN k NOT IN (8, 9) THEN CASE WHEN k = 11 THEN 'q ' || role || ' "said"' ELSE role END END AS answer,
CASE WHEN k <> 9 THEN note END AS note, CASE WHEN k <> 9 THEN conv_id END AS first, CASE WHEN k <> 9 THEN turn END AS second FROM c"""
)
def ans_mended(spark, sf_dir):
    """Answers in twelve kinds of broken JSON, made whole: quotes, commas, colons, ends and comments that are wrong or missing."""
    note = F.trim(F.regexp_replace("text", r"""[\x00-\x20'"\\\[\]{}]+""", " "))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", note.alias("note"))
    forms = [
        '{"answer": "<r>", "note": "<n>", "ids": [<c>, <t>]}',
        "{'answer': '<r>', 'note': '<n>', 'ids': [<c>, <t>]}",
        '{"answer": "<r>", "note": "<n>", "ids": [<c>, <t>',
        '{answer: <r>, note: "<n>", ids: [<c>, <t>,],}',
        '```json\n{"answer": "<r>", // it\'s {\n "note": "<n>" /* "ids": [] */, "ids": [<c>, <t>]}\n``` {"answer": 0}',
        'So: {"answer" "<r>" "note" "<n>" "ids" [<c>, <t>]} I think',
        '{"answer": "<r>", "ids": [<c>, <t>], "note": "<n> ]}',
        '{"deep": {"list": [[<c>, {"turn": <t>]}, "answer": "<r>", "note": "<n>", "ids": [<c>, <t>]}',
        '{"ok": True, "answer": None, "note": "<n>", "ids": [<c>, <t>]}',
        "<r> <n>",
        '{"answer": "<r>",, "note": "<n>",,, "ids": [<c>,, <t>]]}}',
        '{"answer": "\\q <r> \\"said\\"", "note": "<n>", "ids": [<c>, <t>]}',
    ]
    text = F.element_at(F.array(*map(F.lit, forms)), ((F.col("conv_id") * 8 + F.col("turn")) % 12 + 1).cast("int"))
    for mark, c in (("<r>", "role"), ("<c>", "conv_id"), ("<t>", "turn"), ("<n>", "note")):
        text = F.replace(text, F.lit(mark), F.col(c).cast("string"))
    found = rows.select("conv_id", "turn", F.from_json(json_repair.repaired(text), "answer string, note string, ids array<long>").alias("x"))
    return found.select("conv_id", "turn", "x.answer", "x.note", F.get("x.ids", F.lit(0)).alias("first"), F.get("x.ids", F.lit(1)).alias("second"))


# reports


@query(_RATES + "SELECT seq_len, " + ", ".join(f"max(hit) FILTER (qtype = '{q}') AS {q}" for q in ("spend_alone", "steps_in_room", "crowd_count", "where_spend", "who_spend")) + " FROM h WHERE model = 'two/beta' GROUP BY seq_len")
def lb_one_model(spark, sf_dir):
    return leaderboard.of_model(_rates(spark, sf_dir), "two/beta")


@query(_RATES + "SELECT * FROM h WHERE model IN ('one/alpha-Instruct', 'two/beta')")
def lb_some_models(spark, sf_dir):
    return leaderboard.only_models(_rates(spark, sf_dir), ["two/beta", "one/alpha-Instruct", "no/such"])[0]


@query(_RATES + "SELECT * FROM h")
def lb_unknown_models(spark, sf_dir):
    return leaderboard.only_models(_rates(spark, sf_dir), ["no/such"])[0]


@query(_RATES + "SELECT seq_len, model, avg(hit) AS hit FROM h GROUP BY ALL HAVING max(hit) > 0")
def lb_mean_hits(spark, sf_dir):
    return leaderboard.mean_hits(_rates(spark, sf_dir))


@query(
    _RATES
    + """SELECT DISTINCT qtype,
CASE qtype WHEN 'spend_alone' THEN 'DC-SA-C' WHEN 'steps_in_room' THEN 'DC-SR-I' WHEN 'crowd_count' THEN 'DC-CC-I' WHEN 'where_spend' THEN 'DC-WS-R' ELSE 'DC-WHS-C' END AS code,
CASE qtype WHEN 'steps_in_room' THEN 0 WHEN 'spend_alone' THEN 1 END AS place FROM h"""
)
def lb_ordered_tasks(spark, sf_dir):
    return leaderboard.ordered_tasks(_rates(spark, sf_dir), ["DC-SR-I", "DC-SA-C"]).select("qtype", "code", "place").distinct()


_TOKENS = (
    SCORED
    + """, k AS (SELECT *, CASE WHEN contains(resp, '</think>') THEN split_part(split_part(resp, '<think>', 2), '</think>', 1)
    WHEN contains(resp, '<|channel>thought') THEN split_part(split_part(resp, '<|channel>thought', 2), '<channel|>', 1) ELSE '' END AS thought FROM s),
c AS (SELECT model, task, seq_len, avg(em) AS em, count(*) AS n, avg(length(thought) // 4) AS reasoning_tokens, sum(length(resp)) / (4 * count(*)) AS output_tokens, avg(CASE WHEN length(thought) // 4 > 10 THEN 1.0 ELSE 0.0 END) AS share_reasoning FROM k GROUP BY ALL)
"""
)


def _cells(spark, sf_dir) -> DataFrame:
    rows = scored(spark, sf_dir)
    parts = [leaderboard.token_table(rows.where(F.col("model") == m)).withColumn("model", F.lit(m)) for m in outputs.MODELS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(_TOKENS + "SELECT model, task, seq_len, em, n, reasoning_tokens, output_tokens, share_reasoning FROM c")
def lb_tokens(spark, sf_dir):
    return _cells(spark, sf_dir)


@query(
    _TOKENS
    + """, t AS (SELECT model, task, sum(pow(2, seq_len / 32) * em) / sum(pow(2, seq_len / 32)) AS em FROM c GROUP BY ALL),
w AS (SELECT model, count(*) / sum(1 / (em + 0.000001)) AS score, count(*) AS n_tasks FROM t GROUP BY model)
SELECT c.model, avg(em) AS em, CAST(sum(n) AS BIGINT) AS n, avg(reasoning_tokens) AS reasoning_tokens, avg(output_tokens) AS output_tokens, any_value(score) AS score, any_value(n_tasks) AS n_tasks FROM c JOIN w USING (model) GROUP BY c.model"""
)
def lb_summary(spark, sf_dir):
    return leaderboard.model_summary(_cells(spark, sf_dir))


@query(SCORED + "SELECT coalesce(task, 'TOTAL') AS task, count(*) AS n, avg(em) AS em FROM s GROUP BY ROLLUP (task)")
def lb_report(spark, sf_dir):
    return leaderboard.run_report(scored(spark, sf_dir))


@query("SELECT p_size AS value, count(*) AS n FROM part GROUP BY p_size")
def lb_histogram(spark, sf_dir):
    return leaderboard.histogram(table(spark, sf_dir, "part"), "p_size")


@query("SELECT count(p_size) AS count, avg(p_size) AS mean, stddev(p_size) AS std, CAST(min(p_size) AS DOUBLE) AS min, quantile_cont(p_size, 0.25) AS p25, quantile_cont(p_size, 0.5) AS p50, quantile_cont(p_size, 0.75) AS p75, CAST(max(p_size) AS DOUBLE) AS max FROM part")
def lb_described(spark, sf_dir):
    return leaderboard.described(table(spark, sf_dir, "part"), "p_size")


# curation


@query("SELECT p_partkey, limit_ AS stage FROM part, (SELECT unnest([10, 25, 50]) AS limit_) WHERE p_size <= limit_")
def cur_stages(spark, sf_dir):
    parts = curation.stages(table(spark, sf_dir, "part"), [10, 25, 50], "p_size")
    tables = [p.select("p_partkey", F.lit(n).alias("stage")) for p, n in zip(parts, (10, 25, 50), strict=True)]
    return tables[0].unionByName(tables[1]).unionByName(tables[2])


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM documents")
def cur_indexed(spark, sf_dir):
    return curation.indexed(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"])


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM documents QUALIFY row_number() OVER (ORDER BY doc_id) <= 50")
def cur_selected(spark, sf_dir):
    return curation.selected(table(spark, sf_dir, "documents").select("doc_id"), 50, "doc_id")


@query("SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY sha256('42:' || doc_id), doc_id) <= 7")
def cur_subsample(spark, sf_dir):
    return curation.subsample(table(spark, sf_dir, "documents").select("doc_id", "lang"), 7, ["lang"], "doc_id")


@query("SELECT doc_id, 'train' AS split FROM documents UNION ALL SELECT doc_id, 'test' AS split FROM labels")
def cur_with_split(spark, sf_dir):
    old = records.with_split(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "documents").select("doc_id").limit(3))
    return records.with_split(old, table(spark, sf_dir, "labels").select("doc_id"))


# records


_TASK_ROWS = "(VALUES " + ", ".join(f"({i}, '{q}', '{t}')" for i, (q, t) in enumerate(TASKS.items())) + ") AS t(nth, qtype, task)"


@query(
    f"""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'rooms_' ELSE '' END || lower(replace(coalesce(task, 'XX-OTHER'), '-', '_')) || '_' || user_id AS config,
coalesce(task, 'XX-OTHER') AS task, CAST(user_id AS INT) AS seq_len, qtype FROM events LEFT JOIN {_TASK_ROWS} ON nth = event_id % {len(TASKS) + 1}"""
)
def rec_configs(spark, sf_dir):
    """Names of configs for each event, of all tasks and an unknown one, with a prefix or not, and what they hold."""
    names = F.array(*(F.lit(t.lower().replace("-", "_")) for t in (*TASKS.values(), "XX-OTHER")))
    prefix = F.when(F.col("event_id") % 2 == 0, "rooms_").otherwise("")
    config = F.concat(prefix, F.element_at(names, (F.col("event_id") % (len(TASKS) + 1) + 1).cast("int")), F.lit("_"), F.col("user_id").cast("string"))
    rows = table(spark, sf_dir, "events").select("event_id", config.alias("config"))
    return rows.select("event_id", "config", *(c.alias(k) for k, c in records.task_of_config(F.col("config"), "rooms").items()))


_CELLS_SQL = question_sql.cells_sql("spend_alone")


@query(
    f"WITH cells AS ({_CELLS_SQL}), ids AS (SELECT DISTINCT event_id // 32 AS seq_id FROM events GROUP BY event_id // 32 HAVING count(*) = 32) "
    "SELECT i.seq_id, g.step_id, CAST(count(c.room) AS INT) AS n FROM ids i CROSS JOIN (SELECT unnest(range(1, 33)) AS step_id) g LEFT JOIN cells c ON c.seq_id = i.seq_id AND c.step_id = g.step_id GROUP BY ALL"
)
def rec_metadata(spark, sf_dir):
    from stepfold.operators.questions import QUESTIONS

    w = world(spark, sf_dir)
    grid = records.dense_metadata(QUESTIONS["spend_alone"](w)[1], w.param.select("seq_id", F.lit(32).alias("seq_len")))
    steps, _ = records.relevant_counts(F.col("metadata"))
    return grid.select("seq_id", F.posexplode(steps).alias("p", "n")).select("seq_id", (F.col("p") + 1).alias("step_id"), "n")


@query(P + "x AS (SELECT 1) SELECT seq_id, step_id, ch, room FROM state")
def rec_inverse(spark, sf_dir):
    steps = sequences(world(spark, sf_dir).state).select("seq_id", F.explode("sequence").alias("s"))
    return steps.select("seq_id", "s.step_id", F.explode(records.rooms_of_chars(F.col("s.rooms"))).alias("ch", "room"))


@query(
    P
    + """o AS (SELECT *, list_position(['Kitchen', 'Bathroom', 'Garden', 'Office', 'Bedroom', 'Hallway'], room) - 1 AS spot FROM state)
SELECT seq_id, step_id, ch, CAST(round((spot % 3) * 1.1 + [0.25, 0.75, 0.25, 0.75, 0.5][ch_ord + 1], 6) AS DOUBLE) AS x, CAST(round((1 - spot // 3) * 1.6 + [0.8, 0.8, 0.25, 0.25, 0.5][ch_ord + 1] * 1.5, 6) AS DOUBLE) AS y FROM o"""
)
def rec_layout(spark, sf_dir):
    return records.frame_layout(world(spark, sf_dir).state).select("seq_id", "step_id", "ch", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(P + "x AS (SELECT 1) SELECT DISTINCT seq_id, true AS same FROM state")
def rec_round_trip(spark, sf_dir):
    from stepfold.sources.tables import text_steps

    rows = sequences(world(spark, sf_dir).state)
    room = lambda e: F.concat(e["key"], F.lit(": ["), F.array_join(e["value"], ", "), F.lit("]"))
    text = F.array_join(F.transform("sequence", lambda s: F.concat(F.lit("Step "), s["step_id"].cast("string"), F.lit(": "), F.array_join(F.transform(F.map_entries(s["rooms"]), room), "; "))), "\n")
    return rows.select("seq_id", records.round_trips(text, records.jsonl_of(F.col("sequence")), text_steps).alias("same"))


@query(P + """r AS (SELECT seq_id, step_id, '[' || string_agg('"' || room || '"', ', ' ORDER BY ch_ord) || ']' AS row FROM state GROUP BY ALL) SELECT seq_id, sha256('[' || string_agg(row, ', ' ORDER BY step_id) || ']') AS seq_hash FROM r GROUP BY seq_id""")
def gen_hash(spark, sf_dir):
    return generate.hashed(world(spark, sf_dir).state)


@query("SELECT conv_id, string_agg(coalesce(text, ''), chr(10) ORDER BY turn) || chr(10) || 'q' || conv_id || '?' AS text, CAST(conv_id AS VARCHAR) AS answer FROM conversations GROUP BY conv_id")
def rec_flat(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("t")))).alias("x"))
    rows = turns.select("conv_id", F.transform("x", lambda e: e["t"]).alias("frames"), F.concat(F.lit("q"), F.col("conv_id").cast("string"), F.lit("?")).alias("question"))
    return rows.select("conv_id", records.joined_text(F.col("frames"), F.col("question")).alias("text"), F.col("conv_id").cast("string").alias("answer"))


@query(
    """WITH r AS (SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN NULL ELSE role END AS task, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) - 1 AS idx FROM conversations)
SELECT conv_id, turn, CAST(CASE WHEN conv_id % 4 = 0 THEN idx + 1 ELSE conv_id END AS INT) AS id, coalesce(task, 'unknown') AS task_type, CASE WHEN conv_id % 5 = 0 THEN 0 ELSE 32 END AS seq_len, 'person' AS atype, CAST(idx % 10 AS INT) AS prompt FROM r"""
)
def rec_normalized(spark, sf_dir):
    c, k = table(spark, sf_dir, "conversations"), F.col("conv_id")
    meta = F.struct(F.when(k % 4 != 0, k).cast("int").alias("id"), F.when(k % 3 != 0, F.col("role")).alias("task"), F.when(k % 5 != 0, F.lit(32)).alias("seq_len"), F.lit(None).cast("string").alias("atype"))
    rows = records.numbered(c.select(F.col("role").alias("config"), "conv_id", "turn", F.struct("conv_id", "turn").alias("inputs"), F.lit("x").alias("outputs"), meta.alias("meta")), "conv_id", "turn")
    out = records.normalized_records(rows)
    prompt = F.array_position(F.array(*map(F.lit, records.PROMPTS)), F.col("instruction")) - 1
    return out.select("inputs.conv_id", "inputs.turn", "meta.id", "meta.categories.task_type", "meta.categories.seq_len", "meta.categories.atype", prompt.cast("int").alias("prompt"))


@query(
    """WITH s AS (SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) + 10000 AS id, CASE role WHEN 'user' THEN 'DC-SA-C' WHEN 'assistant' THEN 'DC-SR-I' ELSE 'system' END AS task FROM conversations),
own AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY id) AS nth FROM s),
c AS (SELECT unnest(['rooms_dc_sa_c_32', 'rooms_dc_sr_i_64', 'rooms_dc_ws_r_32']) AS config, unnest(['DC-SA-C', 'DC-SR-I', 'DC-WS-R']) AS task)
SELECT config, CAST(id AS INT) AS id FROM c JOIN own USING (task) WHERE nth <= 4
UNION ALL SELECT 'rooms_dc_ws_r_32', CAST(id AS INT) FROM s WHERE id <= 10004"""
)
def rec_shots(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    kind = F.when(F.col("role") == "user", "spend_alone").when(F.col("role") == "assistant", "steps_in_room").otherwise("system")
    rows = curation.indexed(c, ["conv_id", "turn"]).select("idx", kind.alias("qtype"), F.lit(8).alias("seq_len"), F.lit("person").alias("atype"), F.lit("?").alias("question"), F.lit("x").alias("answer"), F.array().cast(records.SEQUENCE).alias("sequence"))
    configs = spark.createDataFrame([("rooms_dc_sa_c_32",), ("rooms_dc_sr_i_64",), ("rooms_dc_ws_r_32",)], "config string")
    shots = records.attached_shots(configs.select("config"), records.shot_records(rows), 4, prefix="rooms")
    return shots.select("config", "meta.id")


@query("SELECT r_regionkey, CASE r_regionkey % 5 WHEN 0 THEN 'Кухня' WHEN 1 THEN 'Мария' WHEN 2 THEN 'Никто' ELSE CAST(r_regionkey AS VARCHAR) END AS said FROM region")
def loc_swapped(spark, sf_dir):
    k = F.col("r_regionkey") % 5
    text = F.when(k == 0, "Kitchen").when(k == 1, "Mary").when(k == 2, "Nobody").otherwise(F.col("r_regionkey").cast("string"))
    return table(spark, sf_dir, "region").select("r_regionkey", records.swapped(text).alias("said"))


# answers


@query(
    SCORED
    + """SELECT model, qid, seq_len, atype, CASE atype WHEN 'number' THEN regexp_matches(gold, '^[0-9]+$') WHEN 'room' THEN gold IN ('Kitchen', 'Bathroom', 'Garden', 'Office', 'Bedroom', 'Hallway')
ELSE gold IN ('Sandra', 'Mary', 'John', 'Daniel', 'Michael', 'Nobody') END AS fits, contains(resp, '**') AS bold, split_part(resp, ' ', 1) AS first_word FROM s"""
)
def ans_forms(spark, sf_dir):
    rows = scored(spark, sf_dir)
    return rows.select("model", "qid", "seq_len", "atype", answers.fits_schema(F.col("gold"), F.col("atype")).alias("fits"), F.col("resp").contains("**").alias("bold"), answers.truncated_at(F.col("resp"), [" "]).alias("first_word"))


@query("SELECT vec_id, CAST(vec_id % 3 <> 2 AND vec_id % 5 <> 0 AS BOOLEAN) AS hit FROM embeddings")
def ans_token_hits(spark, sf_dir):
    """Labels of vec_id % 5 tokens that count, of which the last is predicted wrongly in a third of the rows."""
    n = (F.col("vec_id") % 5).cast("int")
    ids = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    said = F.when(F.col("vec_id") % 3 == 2, F.transform(ids, lambda x: F.when(x == n, -1).otherwise(x))).otherwise(ids)
    prompt = F.array_repeat(F.lit(9), 2)
    return table(spark, sf_dir, "embeddings").select("vec_id", answers.token_hit(segments.labels(F.lit(2), ids), F.concat(prompt, said)).alias("hit"))


# segments


_T = "WITH v AS (SELECT vec_id, CAST(vec_id % 11 + 1 AS INT) AS n FROM embeddings) "


def _tokens(spark, sf_dir) -> DataFrame:
    n = (F.col("vec_id") % 11 + 1).cast("int")
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.sequence(F.lit(1), n).alias("ids"))


@query(_T + "SELECT vec_id, CAST(ceil(n / 4.0) AS INT) AS n_segments, CAST(ceil(n / 4.0) * 4 AS INT) AS length, CAST(ceil(n / 4.0) * 4 - n AS INT) AS pads FROM v")
def seg_filled(spark, sf_dir):
    whole, n = segments.filled_segments(F.col("ids"), 4, pad=-1)
    return _tokens(spark, sf_dir).select("vec_id", n.alias("n_segments"), F.size(whole).alias("length"), F.size(F.filter(whole, lambda x: x == -1)).alias("pads"))


@query(
    "WITH v AS (SELECT vec_id, label, CAST(vec_id % 11 + 1 AS INT) AS n FROM embeddings), m AS (SELECT label, max(n) AS longest FROM v GROUP BY label) "
    "SELECT vec_id, longest AS length, n AS tokens, longest - n AS pads FROM v JOIN m USING (label)"
)
def seg_collated(spark, sf_dir):
    rows = segments.collated(_tokens(spark, sf_dir), "ids", "label", 0, ignore=-100)
    return rows.select("vec_id", F.size("ids").alias("length"), F.aggregate("mask", F.lit(0), lambda a, x: a + x).alias("tokens"), F.size(F.filter("ids", lambda x: x == -100)).alias("pads"))


@query(_T + "SELECT vec_id, CASE WHEN n >= 4 THEN 2 ELSE -1 END AS at, '0-0-' || array_to_string(list_transform(range(n), lambda x: 1), '-') AS mask FROM v")
def seg_found(spark, sf_dir):
    t = _tokens(spark, sf_dir)
    mask = segments.completion_mask(F.lit(2), F.size("ids"))
    return t.select("vec_id", segments.position(F.col("ids"), F.array(F.lit(3), F.lit(4))).alias("at"), F.array_join(mask, "-").alias("mask"))


@query("SELECT conv_id, turn, 'system:be brief|' || role || ':' || coalesce(text, '') AS chat FROM conversations")
def seg_messages(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    first = segments.messages(("system", F.lit("be brief")))
    both = F.concat(first, F.array(F.struct(F.col("role").alias("role"), F.coalesce("text", F.lit("")).alias("content"))))
    return c.select("conv_id", "turn", F.array_join(F.transform(both, lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|").alias("chat"))


@query(P + "x AS (SELECT 1) SELECT seq_id, room, count(*) AS n, min(step_id) AS first FROM state GROUP BY ALL")
def seg_quoted(spark, sf_dir):
    """Steps written with single quotes, read back: how often anyone is in each room, and from which step on."""
    rows = sequences(world(spark, sf_dir).state)
    text = F.replace(F.to_json("sequence"), F.lit('"'), F.lit("'"))
    steps = rows.select("seq_id", F.explode(segments.quoted_steps(text)).alias("s")).select("seq_id", F.col("s.step_id").cast("long").alias("step_id"), F.explode("s.rooms").alias("room", "chars"))
    return steps.where(F.size("chars") > 0).groupBy("seq_id", "room").agg(F.sum(F.size("chars")).alias("n"), F.min("step_id").alias("first"))


# rewards


_SAID_NAMES = "['" + "', '".join(rewards.NAMES) + "']"
_SHOWS = "['" + "', '".join(w.replace("'", "''") for w in rewards.INDICATORS) + "']"
_REWARDS = (
    _GOLD
    + f""", c AS (SELECT *, CAST(qid % 5 AS INT) AS k, repeat('because it is so. ', CAST(qid % 70 AS INT)) AS lead FROM gold),
t AS (SELECT qid, qtype, seq_len, gold, CASE k WHEN 4 THEN '' ELSE trim(lead || CASE k WHEN 0 THEN gold || '.' WHEN 1 THEN upper(gold) || '!' WHEN 2 THEN gold ELSE '' END) END AS thought,
 CASE k WHEN 2 THEN 'it is ' || gold WHEN 3 THEN 'what' WHEN 4 THEN lower(gold) ELSE gold END AS said, CASE WHEN qid % 2 = 0 THEN 1.0 ELSE 0.75 END AS form FROM c),
n AS (SELECT *, length(thought) AS len, CASE WHEN thought = '' THEN 0 ELSE 1 + len(regexp_extract_all(thought, '[.!?]\\s+')) END AS parts, regexp_replace(thought, '^(?s:.*[.!?]\\s+)', '') AS last FROM t),
p AS (SELECT *, CASE WHEN regexp_matches(said, '^[0-9]+$') OR list_contains({_SAID_NAMES}, said) THEN 0.5 WHEN list_contains(list_transform({_SAID_NAMES}, lambda x: lower(x)), lower(said)) THEN 0.3 ELSE 0.0 END AS atype_reward,
CASE WHEN len < 50 THEN 0.1 WHEN len < 300 THEN 0.1 + 0.4 * (len - 50) / 250 WHEN len <= 1000 THEN 0.5 * (1 - (len - 300) / 700.0) ELSE 0.1 END
 + least(0.3, 0.05 * len(list_filter({_SHOWS}, lambda w: contains(lower(thought), w)))) + CASE WHEN parts >= 3 THEN 0.2 WHEN parts = 2 THEN 0.1 ELSE 0 END AS reasoning,
CASE WHEN thought = '' OR said = '' THEN 0.0 WHEN contains(thought, said) THEN 0.3 WHEN contains(lower(thought), lower(said)) THEN 0.2 WHEN last <> '' AND (contains(last, said) OR contains(said, last)) THEN 0.3 ELSE 0.0 END AS consistency,
CASE WHEN said = gold THEN 2.0 WHEN lower(said) = lower(gold) THEN 1.5 WHEN contains(gold, said) OR contains(said, gold) THEN 1.0 WHEN 1 - levenshtein(said, gold) / greatest(length(said), length(gold)) > 0.8 THEN 0.75 ELSE 0.0 END AS correctness FROM n),
r AS (SELECT *, CASE WHEN correctness <= 0 THEN 0.0 WHEN len < 50 THEN 0.1 WHEN len < 300 THEN 0.1 + 0.4 * (len - 50) / 250 ELSE 0.5 * cos(least(1.0, (len - 300) / 700.0) * (pi() / 2)) END AS of_length FROM p)
"""
)


def _completions(spark, sf_dir) -> DataFrame:
    """Answers after five kinds of reasoning: it says the answer, says it in capitals, ends in what the answer holds, never comes to it, isn't there; in strict form or in one line."""
    g, q = F.col("gold"), F.col("qid")
    k, lead = q % 5, F.repeat(F.lit("because it is so. "), (q % 70).cast("int"))
    ends = F.when(k == 0, F.concat(g, F.lit("."))).when(k == 1, F.concat(F.upper(g), F.lit("!"))).when(k == 2, g).otherwise("")
    thought = F.when(k == 4, "").otherwise(F.concat(lead, ends))
    said = F.when(k == 2, F.concat(F.lit("it is "), g)).when(k == 3, "what").when(k == 4, F.lower(g)).otherwise(g)
    strict = F.concat(F.lit("<think>\n"), thought, F.lit("\n</think>\n<answer>\n"), said, F.lit("\n</answer>"))
    plain = F.concat(F.lit("<think>"), thought, F.lit("</think><answer>"), said, F.lit("</answer>"))
    return _gold(spark, sf_dir).withColumn("t", F.when(q % 2 == 0, strict).otherwise(plain))


@query(_REWARDS + "SELECT qid, qtype, seq_len, CAST(atype_reward AS DOUBLE) AS atype_reward, CAST(reasoning AS DOUBLE) AS reasoning, CAST(consistency AS DOUBLE) AS consistency FROM r")
def rw_parts(spark, sf_dir):
    rows = _completions(spark, sf_dir).select("qid", "qtype", "seq_len", rewards.shares(F.col("t"), F.col("gold")).alias("x"))
    return rows.select("qid", "qtype", "seq_len", F.col("x.atype").alias("atype_reward"), "x.reasoning", "x.consistency")


@query(_REWARDS + "SELECT qid, qtype, seq_len, CAST(correctness + 0.5 * form + 0.8 * reasoning + 0.7 * consistency + 0.3 * atype_reward + 0.4 * of_length AS DOUBLE) AS reward FROM r")
def rw_combined(spark, sf_dir):
    """All rewards of a completion by their weights."""
    return _completions(spark, sf_dir).select("qid", "qtype", "seq_len", rewards.combined(F.col("t"), F.col("gold")).alias("reward"))


@query(
    r"""WITH w AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2D\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM documents),
c AS (SELECT regexp_replace(w, '\.$', '') AS word, count(*) FILTER (w LIKE '%.') AS with_period, count(*) FILTER (w NOT LIKE '%.') AS without FROM w GROUP BY 1 HAVING word <> ''),
t AS (SELECT sum(with_period) / sum(with_period + without) AS p FROM c),
s AS (SELECT word, with_period, without, length(replace(word, '.', '')) AS n, -2 * (with_period * ln(p) + without * ln(1 - p) - with_period * ln(0.99) - without * ln(1 - 0.99)) AS ratio FROM c, t WHERE with_period > 0 AND NOT regexp_matches(word, '^[0-9.]*$'))
SELECT word, with_period, without, round(ratio * exp(-n) * (length(word) - n + 1) * power(CAST(n AS DOUBLE), -without), 6) + 0.0 AS score FROM s"""
)
def sent_types(spark, sf_dir):
    """How likely each type of word of the documents that ends in a period is an abbreviation."""
    return sentences.scored_types(sentences.type_counts(table(spark, sf_dir, "documents"))).withColumn("score", F.round("score", 6) + F.lit(0.0))  # no zero has a sign
