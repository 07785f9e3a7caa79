"""Hand-written cases of the queries, texts, scores and reshapes."""

import pytest
from pyspark.sql import functions as F

from stepfold import registry
from stepfold.functions import answers, rewards
from stepfold.model import GenerationConfig
from stepfold.operators import leaderboard, questions, segments
from stepfold.plans import generate
from stepfold.plans.state import World

CHARS, ROOMS = ("A", "B", "C"), ("K", "G", "O")


def world(spark, steps, **bound):
    rows = [(0, s + 1, k, CHARS[k], r) for s, step in enumerate(steps) for k, r in enumerate(step)]
    state = spark.createDataFrame(rows, "seq_id long, step_id int, ch_ord int, ch string, room string")
    bound = {"c0": "A", "c1": "B", "r0": "K", "r1": "G", "frame": 1, "is_more": True, "f0": 1, "f1": len(steps), "n_crowd": 3} | bound
    param = spark.createDataFrame([(0, *bound.values())], "seq_id long, c0 string, c1 string, r0 string, r1 string, frame int, is_more boolean, f0 int, f1 int, n_crowd int")
    return World(state, param, len(steps), CHARS, ROOMS)


CASES = [
    ("first_at_room", ["KKG", "KGG", "OGG"], {}, None),
    ("first_at_room", ["KKG", "KGG", "OGG"], {"r0": "O"}, "A"),
    ("last_at_room", ["KKG", "KGG", "OGG"], {}, "A"),
    ("first_at_room", ["KGG"], {}, "A"),
    ("where_spend", ["KKG", "KKG"], {}, "K"),
    ("where_spend", ["KKG", "KKG"], {"is_more": False}, None),
    ("spend_alone", ["KGO", "KKO"], {}, "C"),
    ("spend_alone", ["KGO", "KKO"], {"is_more": False}, None),
    ("crowd_count", ["KKK", "KKG"], {}, "1"),
    ("crowd_count", ["KKK", "KKG"], {"n_crowd": 2}, "2"),
    ("crowded_room", ["KKK", "KKG"], {}, "K"),
    ("n_empty", ["GGG", "GGK"], {}, "2"),
    ("n_empty", ["GGG", "GGK"], {"frame": 2}, "1"),
    ("room_empty", ["GGG", "GGK"], {}, "O"),
    ("first_at_room", ["GGG", "GGK"], {"r0": "O"}, "Nobody"),
    ("spend_together", ["KKG", "KGG", "GGG"], {"c0": "B"}, None),
    ("char_on_char_first_app", ["KGO", "GGO"], {"c0": "B", "c1": "A", "r0": "G"}, "G"),
    ("n_char_at_frame", ["KGO", "GGO"], {"frame": 2}, "1"),
    ("char_on_char_at_frame", ["KGO", "GGO"], {}, "Nobody"),
    ("crowded_room", ["KKK", "KKK"], {"n_crowd": 4}, None),
    ("rooms_visited", ["KKK", "KKK"], {}, "1"),
]


@pytest.mark.parametrize("qtype,steps,bound,want", CASES)
def test_micro_cases(spark, qtype, steps, bound, want):
    rows, cells = questions.QUESTIONS[qtype](world(spark, steps, **bound))
    assert [tuple(r) for r in rows.collect()] == [(0, want, want is not None)]
    if qtype == "rooms_visited":
        assert [tuple(r) for r in cells.collect()] == [(0, 1, "K")]


def test_strict_reference(spark):
    assert not questions.at_room(world(spark, ["KGG"]), False, strict_reference=True)[0].first().valid


def test_answers(spark):
    rows = [("between 3 and 5.", "number", "35"), ("none", "number", "0"), (" no one! ", "person", "Никто"), ("kitchen", "room", "Кухня"), ("", "room", "")]
    df = spark.createDataFrame(rows, "t string, k string, want string")
    assert all(r.got == r.want for r in df.withColumn("got", answers.normalized(F.col("t"), F.col("k"))).collect())
    rows = [
        ("answer: Mary … answer: John", "person", "Иван"), ("<think>answer: 7</think>12", "number", "12"), ('{"answer": "Garden"}', "room", "Сад"), ("ОТВЕТ: Кухня", "room", "Кухня"),
        ("\\boxed{5}", "number", "5"), ("a **Mary** b **John**", "person", "Иван"), ("The kitchen", "room", "Кухня"), ("<|channel>thought a<channel|>b<|channel>thought c<channel|>Сад", "room", "Сад"), (None, "room", ""), ("no digits", "number", ""),
    ]
    df = spark.createDataFrame(rows, "t string, k string, want string")
    got = df.withColumn("got", answers.extracted(F.col("t"), F.col("k"))).collect()
    assert [(r.t, r.got) for r in got] == [(r.t, r.want) for r in got]
    parsed = spark.createDataFrame([('{"answer": "None"}',), ("{'answer': 'Mary'}",), ("it is 12",), ("hm",)], "t string").select(answers.legacy_parsed(F.col("t")).alias("x")).collect()
    assert [r.x for r in parsed] == ["Nobody", "Mary", "12", "None"]


def test_scores_and_segments(spark):
    one = spark.createDataFrame([("6", "4", "6", 32), ("x", "4", "x", 32)], "p string, g string, raw string, l int")
    got = one.select(*(c.alias(k) for k, c in answers.numeric_scores(F.col("p"), F.col("g"), F.col("raw"), F.col("l")).items())).collect()
    assert [tuple(r) for r in got] == [(2.0, 0.0625, pytest.approx(0.2), 1.0), (32.0, 1.0, 1.0, 0.0)]
    row = spark.range(1).select(rewards.similarity(F.lit("Kitchen"), F.lit("Kitchn")).alias("s"), segments.packed_steps(F.array(*map(F.lit, [3, 4, 2, 5])), 8).alias("p"), segments.position(F.array(*map(F.lit, [1, 2, 3])), F.array(F.lit(2), F.lit(3))).alias("at"), *(segments.cut(F.sequence(F.lit(1), F.lit(5)), 2, a).alias(a) for a in ("left", "right", "center"))).first()
    assert row.s == pytest.approx(1 - 1 / 7) and tuple(row.p) == (2, 7) and row["at"] == 1
    assert (row.left, row.right, row.center) == ([[1, 2], [3, 4], [5]], [[1], [2, 3], [4, 5]], [[1, 2], [3, 4], [5]])
    assert spark.createDataFrame([(x,) for x in (1, 2, 3, 4)], "x int").agg(leaderboard.upper_median("x")).first()[0] == 3


def test_config_errors():
    for bad in ({"rooms": []}, {"chars": []}, {"seq_lengths": []}, {"n_questions": 0}, {"target_keyframes": 0}, {"target_keyframes": (3, 2)}):
        with pytest.raises(ValueError):
            GenerationConfig(**bad)
    with pytest.raises(ValueError):
        GenerationConfig(question_types=["unknown"]).get_question_types()
    assert GenerationConfig.from_dict({"seed": 1, "more": 2}).seed == 1


def test_generated_sequences(spark):
    config = GenerationConfig(seq_lengths=[4], n_questions=6)
    state = generate.states(spark, 30, 4, config)
    rows = {(r.seq_id, r.step_id, r.ch): r.room for r in state.collect()}
    assert len(rows) == 30 * 4 * 5
    assert all(sum(rows[s, t, c] != rows[s, t - 1, c] for c in config.chars) == 1 for s in range(30) for t in range(2, 5))
    made = generate.questions(spark, config).collect()
    assert sorted(r.qid for r in made) == [f"{k:07d}" for k in range(len(made))] and len({(r.qtype, r.seq_hash) for r in made}) == len(made)


def test_every_query_has_sql_or_is_random():
    assert set(registry.QUERIES) - set(registry.ORACLE_SQL) == {"gen_questions"}
