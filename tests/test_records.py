"""Legacy scoring, records, generation options, reports and rewards on hand-written cases."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from stepfold.functions import answers, rewards, wording
from stepfold.model import TASKS, GenerationConfig
from stepfold.operators import curation, leaderboard, segments
from stepfold.plans import generate, records
from stepfold.plans.state import forward_filled, sequences, state_of_moves
from stepfold.sources import tables


def test_legacy_hits(spark):
    rows = [
        ("3", "3", True), ("3", "<4>", False), ("3", "about 3 rooms", True), ("0", "Nobody", True), ("0", "['Nobody', 'Mary']", True), ("3", "[3]", False), ("3", "many", False),
        ("Kitchen", "Kitchen", True), ("Kitchen", "kitchen", False), ("Kitchen", "['Kitchen']", False), ("Kitchen", "Kitchen 2", False),
        ("Mary", "Mary", True), ("Mary", "{Mary}", True), ("['Mary', 'John']", "['John', 'Mary', 'Mary']", True), ("['Mary', 'John']", "Mary", False), ("Mary", "Bob", False), ("Nobody", "{Nobody}", True),
        ("Basement", "Basement", False), ("3", None, False),
    ]
    df = spark.createDataFrame(rows, "gold string, said string, want boolean")
    assert [r for r in df.withColumn("got", answers.legacy_hit(F.col("gold"), F.col("said"))).collect() if r.got != r.want] == []


def test_legacy_scoring_end_to_end(spark):
    rows = [
        ("8", "n_empty", "3", '{"answer": 3}', 1), ("8", "n_empty", "0", '{"answer": "none"}', 1), ("8", "n_empty", "3", "Error 500", None), ("8", "n_empty", "3", None, None),
        ("8", "who_spend", "Mary", '{"answer": ["Mary"]}', 1), ("8", "who_spend", "Mary", '{"answer": ["Mary", "John"]}', 0), ("8", "who_spend", "Nobody", '{"answer": ["Mary", "John"]}', 1), ("8", "who_spend", "John", "it was john", 0), ("8", "who_spend", "John", "it was John", 1),
    ]
    df = spark.createDataFrame(rows, "seq_len string, qtype string, answer string, Predicted_Answer string, want int").withColumn("model", F.lit("m"))
    scored = answers.legacy_scored(df)
    assert [r for r in scored.collect() if r.hit != r.want] == [] and scored.count() == 7
    rates = {r.qtype: (r.hit, r.mean_hit) for r in leaderboard.hit_rates(scored).collect()}
    assert rates == {"n_empty": (4.0, 100.0), "who_spend": (6.0, 60.0)}


def test_text_after_reasoning(spark):
    text = 'I think</think> <answer>{"answer": 1}</answer>'
    pick = lambda t, **k: spark.range(1).select(answers.after_reasoning(F.lit(t), **k)).first()[0]
    assert pick(text) == '{"answer": 1}' and pick("plain") == "plain" and pick("x</think>no brace") == "</think>no brace"
    assert pick('{x}</think>{"answer": 1}', keep_offset=True) == '{"answer": 1}'


def test_schemas(spark):
    assert answers.strict_schema("number") == {"name": "number", "schema": {"type": "object", "properties": {"answer": {"type": "integer"}}, "required": ["answer"], "additionalProperties": False}}
    rows = [("Kitchen", "room", True), ("Attic", "room", False), ("12", "number", True), ("x", "number", False), ("Nobody", "person", True), (None, "person", False)]
    df = spark.createDataFrame(rows, "v string, k string, want boolean")
    assert all(r.got == r.want for r in df.withColumn("got", answers.fits_schema(F.col("v"), F.col("k"))).collect())


def test_texts(spark):
    rows = [("<think>" + "x" * 40 + "</think>y", 10), ("<|channel>thought" + "x" * 8 + "<channel|>y", 2), ("short", 0), ("\n".join(["x" * 70] * 4), (70 * 3 + 2) // 4)]
    df = spark.createDataFrame(rows, "t string, want int")
    assert all(r.got == r.want for r in df.withColumn("got", answers.reasoning_tokens(F.col("t"))).collect())
    one = spark.range(1)
    assert one.select(answers.truncated_at(F.lit("a STOP b END"), ["END", "STOP"])).first()[0] == "a "
    assert one.select(wording.place(F.lit("Attic")), wording.place(F.lit("Garden")), wording.verb(F.lit("Mary"), "был", "была"), wording.verb(F.lit(None).cast("string"), "был", "была")).first()[:] == ("в Attic", "в Саду", "была", "был")
    assert [wording.language_of(x) for x in ("ru", "en", "de")] == ["ru", "en", "en"]
    assert one.select(answers.token_hit(F.array(F.lit(-100), F.lit(5)), F.array(F.lit(1), F.lit(5))), answers.token_hit(F.array(F.lit(-100)), F.array(F.lit(1))), answers.token_hit(F.array(F.lit(4)), F.array(F.lit(1)))).first()[:] == (True, False, False)


def test_instructions_and_prompts():
    for mode in ("text", "image"):
        for language in ("en", "ru"):
            text = records.instruction(language, mode)
            assert text.count("{context}") == 1 == text.count("{question}") and text.endswith(":")
    assert records.instruction("ru") == records.PROMPTS[0] and records.instruction("xx") == records.instruction("en")
    assert len(set(records.PROMPTS)) == 10 and all("{context}" in p and "{question}" in p for p in records.PROMPTS)
    tree = records.task_tree("p")
    assert len(tree) == 15 and tree[0] == {"name": "p_dc_sa_c_32", "task": "DC-SA-C", "qtype": "spend_alone", "seq_len": 32}


def test_config_names(spark):
    df = spark.createDataFrame([(records.config_name("p", t, 64),) for t in TASKS.values()] + [("p_x_1",), ("odd",)], "c string")
    got = [tuple(r) for r in df.select(*(c.alias(k) for k, c in records.task_of_config(F.col("c"), "p").items())).collect()]
    assert got == [(t, 64, q) for q, t in TASKS.items()] + [("X", 1, None), ("", None, None)]


def test_metadata(spark):
    cells = spark.createDataFrame([(1, 1, "K"), (1, 3, "K"), (1, 3, "G")], "seq_id long, step_id int, room string")
    lengths = spark.createDataFrame([(1, 3), (2, 1)], "seq_id long, seq_len int")
    out = records.dense_metadata(cells, lengths, ["K", "G"])
    got = {r.seq_id: [(m.step_id, m.rooms) for m in r.metadata] for r in out.collect()}
    assert got == {1: [(1, {"K": True, "G": False}), (2, {"K": False, "G": False}), (3, {"K": True, "G": True})], 2: [(1, {"K": False, "G": False})]}
    steps, total = records.relevant_counts(F.col("metadata"))
    assert {r.seq_id: (r.s, r.t) for r in out.select("seq_id", steps.alias("s"), total.alias("t")).collect()} == {1: ([1, 0, 2], 3), 2: ([0], 0)}


def test_samples_as_dicts(spark):
    text = json.dumps({"qid": "1", "seq_len": 1, "metadata": [{"step_id": 1, "rooms": {"K": True}}], "sequence": [{"step_id": 1, "rooms": {"K": ["A"]}}]})
    df = records.from_dict(spark.createDataFrame([(text,)], "value string"), tables.SAMPLE)
    row = df.first()
    assert (row.n_relevant_rooms_per_step, row.n_relevant_rooms) == ([1], 1)
    again = records.from_dict(records.to_dict(df), tables.SAMPLE).first()
    assert again == row and json.loads(records.to_dict(df).first().value)["question"] is None


def test_inverse_map_round_trip_and_layout(spark):
    steps = [{"step_id": 1, "rooms": {"Kitchen": ["Sandra", "Mary"], "Garden": []}}, {"step_id": 2, "rooms": {"Kitchen": [], "Garden": ["Mary", "Sandra"]}}]
    jsonl = "\n".join(map(json.dumps, steps))
    text = "Step 1: Kitchen: [Sandra, Mary]; Garden: []\nStep 2: Kitchen: []; Garden: [Mary, Sandra]"
    df = spark.createDataFrame([(text, jsonl), (text, jsonl.replace("Mary", "John")), (text.replace("Step 2", "Step 3"), jsonl.replace('"step_id": 2', '"step_id": 3'))], "t string, j string")
    assert [r.ok for r in df.select(records.round_trips(F.col("t"), F.col("j"), tables.text_steps).alias("ok")).collect()] == [True, False, False]
    one = df.limit(1).select(tables.text_steps(F.col("t")).alias("s"))
    assert one.select(records.rooms_of_chars(F.get("s", F.lit(0))["rooms"])).first()[0] == {"Sandra": "Kitchen", "Mary": "Kitchen"}
    state = spark.createDataFrame([(0, 1, 0, "A", "Kitchen"), (0, 1, 4, "E", "Hallway")], "seq_id long, step_id int, ch_ord int, ch string, room string")
    layout = records.frame_layout(state)
    got = {r.ch: (round(r.x, 6), round(r.y, 6), round(r.label_y, 6)) for r in layout.collect()}
    assert got == {"A": (0.25, 2.8, 2.88), "E": (2.7, 0.75, 0.83)}
    svg = records.svg_frames(layout).first().svg
    assert svg.startswith("<svg") and svg.endswith("</svg>") and svg.count("<circle") == 2 and svg.count("<rect") == 6 and "Step 1" in svg


def test_joined_texts(spark):
    df = spark.createDataFrame([(["a", "b"], "q?", 4, [(8, "Q", ["f", "g"], "A")])], "frames array<string>, question string, answer int, ex array<struct<seq_len:int,question:string,frames:array<string>,answer:string>>")
    row = df.select(records.joined_text(F.col("frames"), F.col("question")).alias("x"), records.joined_text(F.col("frames"), F.col("question"), True).alias("y"), records.in_context_prompt(F.col("ex"), "Head").alias("z")).first()
    assert row[:] == ("a\nb\nq?", "q?\na\nb", "Head\n\nExample 1 (len=8):\nQuestion: Q\nSequence:\nf\ng\nAnswer: {'answer': 'A'}")
    assert tuple(records.flat_examples(df).first()) == ("a\nb\nq?", "4")


def test_published_records(spark):
    schema = "config string, instruction string, inputs struct<context:string,question:string>, outputs string, meta struct<id:int,task:string,seq_len:int,atype:string>"
    rows = [("p_dc_whs_c_32", "old", ("c", "Кто провёл" + records.ALONE + "?"), "x", (5, "DC-WHS-C", 32, "person")), ("p_dc_cc_i_32", "old", ("c", records.CROWD_OLD + "3)?"), "x", (None, None, None, None))]
    recs = records.numbered(spark.createDataFrame(rows, schema), "meta.id")
    out = {r.config: r for r in records.normalized_records(recs).collect()}
    assert out["p_dc_whs_c_32"].meta.id == 5 and tuple(out["p_dc_cc_i_32"].meta) == (1, ("unknown", 0, "person"))
    once = records.patched(recs)
    assert {r.config: (r.inputs.question, r.instruction) for r in once.collect()} == {"p_dc_whs_c_32": ("Кто провёл?", records.PROMPTS[0]), "p_dc_cc_i_32": (records.CROWD_NEW + "3)?", records.PROMPTS[0])}
    assert sorted(map(str, records.patched(once).collect())) == sorted(map(str, once.collect()))
    assert [r.p for r in spark.range(12).select(records.cyclic_prompt(F.col("id")).alias("p")).collect()] == [records.PROMPTS[i % 10] for i in range(12)]
    swapped = spark.createDataFrame([("Kitchen",), ("Nobody",), ("7",)], "a string").select(records.swapped(F.col("a")).alias("b"))
    assert [r.b for r in swapped.collect()] == ["Кухня", "Никто", "7"]


def test_shots(spark):
    ex = [(i, "spend_alone" if i < 7 else "crowd_count", 8, "person", "?", "A", []) for i in range(9)]
    shots = records.shot_records(spark.createDataFrame(ex, f"idx int, qtype string, seq_len int, atype string, question string, answer string, sequence {records.SEQUENCE}"))
    assert sorted(r.meta.id for r in shots.collect()) == list(range(10_001, 10_010))
    configs = spark.createDataFrame([("p_dc_sa_c_32",), ("p_dc_cc_i_64",), ("p_dc_ws_r_32",)], "config string")
    ids = lambda df: {c: sorted(r.meta.id for r in df.where(F.col("config") == c).collect()) for c in ("p_dc_sa_c_32", "p_dc_cc_i_64", "p_dc_ws_r_32")}
    named = configs.withColumn("config", F.replace("config", F.lit("p_"), F.lit("rooms_")))
    plain = lambda df: df.withColumn("config", F.replace("config", F.lit("rooms_"), F.lit("p_")))
    assert ids(plain(records.attached_shots(named, shots, 5))) == {"p_dc_sa_c_32": list(range(10_001, 10_006)), "p_dc_cc_i_64": [10_008, 10_009], "p_dc_ws_r_32": list(range(10_001, 10_006))}
    assert ids(plain(records.attached_shots(named, shots, 5, whole_pool=False)))["p_dc_ws_r_32"] == []
    both = records.with_split(spark.range(4), spark.range(2))
    assert sorted(map(tuple, both.groupBy("split").count().collect())) == [("test", 2), ("train", 4)]
    assert sorted(map(tuple, records.with_split(both, spark.range(3)).groupBy("split").count().collect())) == [("test", 3), ("train", 4)]


def test_curation(spark):
    rows = spark.createDataFrame([(i, "ab"[i % 2], i % 5) for i in range(40)], "id long, kind string, num_segments int")
    assert [len(x.collect()) for x in curation.stages(rows, [0, 2, 4])] == [8, 24, 40]
    with pytest.raises(ValueError, match=r"\[-1\]"):
        curation.stages(rows, [-1, 4])
    got = curation.indexed(rows.repartition(7), ["id"])
    assert sorted((r.id, r.idx) for r in got.collect()) == [(i, i) for i in range(40)]
    assert sorted((r.id, r.idx) for r in curation.selected(rows, 5, "id").collect()) == [(i, i) for i in range(5)]
    assert curation.selected(rows, 500, "id").count() == 40
    sample = curation.subsample(rows, 3, ["kind"], "id")
    assert {r.kind: r["count"] for r in sample.groupBy("kind").count().collect()} == {"a": 3, "b": 3} and curation.subsample(rows, 7, [], "id").count() == 7
    pool = spark.createDataFrame([(i, "q", 8 if i < 4 else 16) for i in range(8)], "example_id int, qtype string, seq_len int")
    assert curation.full_quota(pool, {8: 3, 16: 2}, "qtype", "example_id").count() == 5
    with pytest.raises(ValueError, match="fewer than 5"):
        curation.full_quota(pool.where("example_id < 4"), {8: 3, 16: 2}, "qtype", "example_id")


def test_segments(spark):
    t = F.array(*map(F.lit, [1, 2, 3, 4, 5]))
    whole, n = segments.filled_segments(t, 3)
    more, m = segments.filled_segments(t, 3, 9, F.array(F.lit(7)))
    row = spark.range(1).select(whole.alias("a"), n.alias("n"), more.alias("b"), m.alias("m"), segments.completion_mask(F.lit(2), F.lit(1)).alias("c"), segments.labels(F.lit(2), F.array(F.lit(4))).alias("l")).first()
    assert row[:] == ([1, 2, 3, 4, 5, 0], 2, [1, 2, 3, 4, 5, 9, 7], 3, [0, 0, 1], [-100, -100, 4])
    rows = spark.createDataFrame([(1, 1, [1]), (2, 1, [1, 2, 3]), (3, 2, [5])], "id int, b int, ids array<int>")
    assert {r.id: (r.ids, r["mask"]) for r in segments.collated(rows, "ids", "b", 0).collect()} == {1: ([1, 0, 0], [1, 0, 0]), 2: ([1, 2, 3], [1, 1, 1]), 3: ([5], [1])}
    assert {r.id: r.ids for r in segments.collated(rows, "ids", "b", 0, -100, left=True).collect()}[1] == [-100, -100, 1]
    text = "[{'step_id': 1, 'rooms': {'K': ['A']}}]"
    assert [(s.step_id, s.rooms) for s in spark.range(1).select(segments.quoted_steps(F.lit(text))).first()[0]] == [(1, {"K": ["A"]})]
    turns = spark.range(1).select(segments.messages(("system", F.lit("s")), ("user", F.lit("u")))).first()[0]
    assert [tuple(x) for x in turns] == [("system", "s"), ("user", "u")]


def test_leaderboards(spark):
    rates = spark.createDataFrame([(8, "q1", "a", 10.0), (8, "q2", "a", 30.0), (16, "q1", "a", 20.0), (8, "q1", "b", 0.0), (8, "spend_alone", "c", 50.0)], "seq_len int, qtype string, model string, hit double")
    some, missing = leaderboard.only_models(rates, ["a", "x"])
    assert some.count() == 3 and missing == ["x"]
    every, missing = leaderboard.only_models(rates, ["x"])
    assert every.count() == 5 and missing == ["x"] and leaderboard.only_models(rates, [])[0].count() == 5
    one = leaderboard.of_model(rates, "a")
    assert one.columns == ["seq_len", "q2", "q1"] and sorted(map(tuple, one.collect())) == [(8, 30.0, 10.0), (16, None, 20.0)]
    assert sorted(map(tuple, leaderboard.mean_hits(rates).collect())) == [(8, "a", 20.0), (8, "c", 50.0), (16, "a", 20.0)]
    coded = {r.qtype: (r.code, r.place) for r in leaderboard.ordered_tasks(rates, ["DC-SR-I", "DC-SA-C"]).collect()}
    assert coded == {"q1": (None, None), "q2": (None, None), "spend_alone": ("DC-SA-C", 1)}
    samples = spark.createDataFrame([("t", 32, 1.0, "<think>" + "x" * 80 + "</think>a"), ("t", 32, 0.0, "abcd"), ("u", 64, 0.5, "")], "task string, seq_len int, em double, resp string")
    cells = leaderboard.token_table(samples)
    assert {tuple(r) for r in cells.collect()} == {("t", 32, 0.5, 2, 10.0, 100 / 8, 0.5), ("u", 64, 0.5, 1, 0.0, 0.0, 0.0)}
    row = leaderboard.model_summary(cells.withColumn("model", F.lit("m"))).first()
    assert (row.model, row.em, row.n, row.n_tasks) == ("m", 0.5, 3, 2) and row.score == pytest.approx(0.5, abs=1e-5)
    assert {r.task: (r.n, r.em) for r in leaderboard.run_report(samples).collect()} == {"t": (2, 0.5), "u": (1, 0.5), "TOTAL": (3, 0.5)}
    assert {tuple(r) for r in leaderboard.histogram(samples, "seq_len").collect()} == {(32, 2), (64, 1)}
    d = leaderboard.described(spark.range(1, 6), "id").first()
    assert (d["count"], d["mean"], d["min"], d.p25, d.p50, d.p75, d["max"]) == (5, 3.0, 1.0, 2.0, 3.0, 4.0, 5.0)


def test_run_statistics_are_exact_ranks(spark):
    for n in (1, 2, 3, 10, 11):
        lens = sorted((i * 7) % 5 * 40 for i in range(n))
        df = spark.createDataFrame([("m", "x" * k, 1.0) for k in lens], "model string, resp string, em double")
        row = leaderboard.run_stats(df).first()
        assert (row.n, row.median_len, row.p90_len) == (n, lens[n // 2], lens[int(0.9 * (n - 1))])


@pytest.mark.parametrize("gram", [1, 3, 9])
def test_fuzzy_match(spark, monkeypatch, gram):
    monkeypatch.setattr(leaderboard, "GRAM", gram)
    names = ["org/Alpha-1-Instruct", "b/Beta", "c/None", "x/y", "-Instruct", "q/1", "Beta", "a/aXa", None]
    ids = [("x-Alpha-1-long", 1), ("Alpha-1", 2), ("Beta-2", 3), ("zBeta-2", 4), ("", 5), (None, 6), ("y", 7), ("Y1", 8), ("aXXa aXaa", 9)]
    models, external = spark.createDataFrame([(n,) for n in names], "model string"), spark.createDataFrame(ids, "id string, score int")
    matched = leaderboard.fuzzy_matched(models, external)
    tail = lambda n: n.split("/")[-1].strip("-Instruct")
    want = {n: min(((len(i), i, s) for i, s in ids if i is not None and tail(n) in i), default=(0, None, None))[1:] if n else (None, None) for n in names}
    assert {r.model: (r.id, r.score) for r in matched.collect()} == want
    assert "NestedLoop" not in matched._jdf.queryExecution().executedPlan().toString()


def test_rewards(spark):
    rows = [
        ("<think>Because it is so. First we know. Then.</think><answer>12</answer>", 0.5, 0.1 + 0.2 + 0.2, 0.0),
        ("<think>" + "the kitchen " * 5 + "</think><answer>Kitchen</answer>", 0.5, 0.1 + 0.4 * 9 / 250 + 0.05 * 0, 0.2),
        ("<think>It is Mary. So Mary</think><answer>mary</answer>", 0.3, 0.1 + 0.1, 0.2),
        ("<think></think><answer>blue</answer>", 0.0, 0.1, 0.0),
    ]
    df = spark.createDataFrame([r[:1] for r in rows], "t string")
    got = df.select(rewards.kind(F.col("t")).alias("k"), rewards.reasoning(F.col("t")).alias("r"), rewards.consistency(F.col("t")).alias("c")).collect()
    assert [r.k for r in got] == [r[1] for r in rows] and [r.c for r in got] == [r[3] for r in rows]
    assert [r.r for r in got] == pytest.approx([r[2] for r in rows])
    js = spark.createDataFrame([('x</think>\n{"answer": "Mary"}',), ('x</think> {"answer": "Mary"}',), ('x</think> so {"answer": "Mary"}',), ("none",)], "t string").select(rewards.form(F.col("t"), json=True).alias("f"))
    assert [r.f for r in js.collect()] == [1.0, 0.75, 0.5, 0.0]
    whole = spark.createDataFrame([("<think>\nMary\n</think>\n<answer>\nMary\n</answer>",)], "t string").select(rewards.combined(F.col("t"), F.lit("Mary")), rewards.length(F.col("t"), F.lit("Mary"))).first()
    assert whole[0] == pytest.approx(2.0 + 0.5 + 0.8 * 0.1 + 0.7 * 0.3 + 0.3 * 0.5 + 0.4 * 0.1) and whole[1] == 0.1


def test_target_keyframes():
    assert GenerationConfig(target_keyframes=[1, 2]).keyframes == (1, 2) and GenerationConfig(target_keyframes=3).keyframes == (3, 3)
    for bad in ([1], (1, 2, 3), [2, 1], "ab", [0, 1]):
        with pytest.raises(ValueError):
            GenerationConfig(target_keyframes=bad)


def test_stretches_and_comparisons(spark):
    n = 64
    df = spark.range(300)
    for fraction in (1, 0.5, 0.1, 0.001):
        first, last, tail = generate.sampled_steps(n, fraction, "id")
        rows = df.select(first.alias("a"), last.alias("b"), tail.alias("t")).collect()
        size = max(1, round(n * fraction))
        assert all(1 <= r.a and r.b <= n and r.b - r.a + 1 == size for r in rows)
        assert {r.t for r in rows} == {"?"} if fraction == 1 else all(r.t == f" between steps {r.a} and {r.b}?" for r in rows) and len({r.a for r in rows}) > 10
    more, words = generate.comparison("id", seed=3)
    got = {(r.m, r.w) for r in df.select(more.alias("m"), words.alias("w")).collect()}
    assert got == {(True, "most"), (False, "least amount of")}
    more, words = generate.comparison("id", superlative=False, is_more=False)
    assert {tuple(r) for r in df.select(more, words).collect()} == {(False, "fewer")}
    assert generate.forced_more("where_spend", 4) and not generate.forced_more("where_spend", 5) and generate.forced_more("spend_alone", 2) and not generate.forced_more("spend_alone", 3)


def test_sequence_hash_is_that_of_its_json(spark):
    rooms = [["Kitchen", 'a"b\\c'], ["Кухня", "Garden"]]
    rows = [(0, s + 1, k, r) for s, step in enumerate(rooms) for k, r in enumerate(step)]
    state = spark.createDataFrame(rows, "seq_id long, step_id int, ch_ord int, room string")
    assert generate.hashed(state).first().seq_hash == hashlib.sha256(json.dumps(rooms).encode()).hexdigest()


def test_controlled_sequences(spark):
    config = GenerationConfig()
    state = generate.controlled(spark, 4, 6, config, F.col("Mary") == F.col("John"), 3)
    wide = {}
    for r in state.collect():
        wide.setdefault(r.seq_id, {}).setdefault(r.step_id, {})[r.ch] = r.room
    assert set(wide) == set(range(4))
    assert all(sum(s["Mary"] == s["John"] for s in steps.values()) == 3 for steps in wide.values())


def test_samples_hold_together(spark):
    config = GenerationConfig(seq_lengths=[2, 5], n_questions=4, question_types=["where_spend", "char_at_frame", "steps_in_room"])
    rows = generate.samples(spark, config).collect()
    assert sorted(r.qid for r in rows) == [f"{i:07d}" for i in range(24)]
    for r in rows:
        assert len(r.sequence) == len(r.metadata) == r.seq_len and [s.step_id for s in r.sequence] == list(range(1, r.seq_len + 1))
        assert r.n_relevant_rooms_per_step == [sum(m.rooms.values()) for m in r.metadata] and r.n_relevant_rooms == sum(r.n_relevant_rooms_per_step)
        assert all(sorted(c for cs in s.rooms.values() for c in cs) == sorted(config.chars) for s in r.sequence)
        if r.qtype == "char_at_frame":
            who, step = r.question.split(" was ")[1].split(" at step ")
            assert who in r.sequence[int(step.rstrip("?")) - 1].rooms[r.answer]
        if r.qtype == "where_spend":
            assert "most" in r.question
    counts = {r.seq_len: r.n for r in generate.count_by_length(spark.createDataFrame(rows)).collect()}
    assert counts == {2: 12, 5: 12}
    few = generate.in_context_examples(spark, config, 1, (1, 2))
    assert few.count() == 6 and "example_id" in few.columns


def test_questions_with_key_frames_and_a_stretch(spark):
    config = GenerationConfig(seq_lengths=[8], n_questions=5, question_types=["steps_in_room"], target_keyframes=[2, 3])
    assert {r.answer for r in generate.questions(spark, config).collect()} <= {"2", "3"}
    config = GenerationConfig(seq_lengths=[8], n_questions=5, question_types=["rooms_visited"])
    rows = generate.samples(spark, config, fraction=0.5).collect()
    assert all(" between steps " in r.question for r in rows)


def test_states_of_moves_agree(spark):
    moves = spark.createDataFrame([(s, t + 1, (s + t * t) % 5, "KGO"[(s * t) % 3]) for s in range(6) for t in range(9)], "seq_id long, step_id int, ch_ord int, room string")
    a, b = state_of_moves(moves), forward_filled(moves, 9)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert sequences(a, ["K", "G", "O"]).count() == 6


def test_dense_answers_agree_with_the_questions(spark):
    from stepfold.model import LEADERBOARD_TASKS
    from stepfold.operators.questions import QUESTIONS
    from stepfold.plans.outputs import dense_answers
    from stepfold.plans.state import World

    for length in (2, 7, 70):
        config = GenerationConfig(seq_lengths=[length])
        state = generate.states(spark, 25, length, config)
        w = World(state, generate.random_params(state, length, config, 0.7, n_crowd=2), length)
        got = {(r.seq_id, r.qtype): r.answer for r in dense_answers(w).collect()}
        want = {(r.seq_id, q): r.answer for q in LEADERBOARD_TASKS for r in QUESTIONS[q](w)[0].where("valid").collect()}
        assert got == want
