"""What keeps time and memory of a task from growing: no branches zipped into one task, few sorts, parts that aren't put together, values found once a row."""

import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from stepfold import registry
from stepfold.functions import rewards, sentences

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")


def plan(spark, name):
    return registry.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()


@needs_data
@pytest.mark.parametrize("name,sorts", [("fmt_questions", 0), ("loc_translated", 0), ("rel_counts", 4)])
def test_no_union_of_branches_that_share_a_task(spark, name, sorts):
    found = plan(spark, name)
    assert "Union" not in found and len(re.findall(r"\bSort \[", found)) <= sorts


@needs_data
@pytest.mark.parametrize("name", ["extract_answers", "ans_forms", "lb_hit_rates", "rw_combined"])
def test_one_sort_for_each_length_in_fixed_parts(spark, name):
    found = plan(spark, name)
    assert len(re.findall(r"\bSort \[", found)) <= 2 and found.count("REPARTITION_BY_NUM") == 2


@needs_data
def test_tags_are_found_once_a_completion(spark):
    assert plan(spark, "rw_combined").count("<answer>(.*?)</answer>") <= 8  # each is written twice: searched, then taken


def test_sentences_join_in_one_pass(spark):
    rng = random.Random(3)
    words = ["dr.", "a.", "B.", "end.", "so!", "x.y.", "and", "(c.", "Dr.", "why?"]
    texts = ["", " ", "a. b. c", *(" ".join(rng.choices(words, k=rng.randrange(1, 30))) for _ in range(200))]

    def brute(text, known):
        out = []
        for x in (p.strip(" ") for p in re.split(r"(?<=[.!?])\s+", text)):
            word = re.search(r"([^\x00-\x2D\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*)\.$", out[-1].lower()) if out else None
            if x and word and (word[1] in known or re.fullmatch("[a-z]", word[1])):
                out[-1] += " " + x
            elif x:
                out.append(x)
        return out

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("t", sentences.split(F.col("t"), ["dr"]).alias("a"), sentences.split(F.col("t")).alias("b")).collect():
        assert r.a == brute(r.t, ["dr"]) and r.b == brute(r.t, [])


def test_shares_are_the_single_rewards(spark):
    rows = [("<think>Because it is so. Then it is Mary.</think><answer>mary</answer>", "Mary"), ("<think>\n" + "if so. " * 90 + "\n</think>\n<answer>\n12\n</answer>", "12"), ("none", "Mary"), ("<think>a</think><answer>it is \"Mary\"</answer>", "Mary")]
    t, g = F.col("t"), F.col("g")
    alone = F.struct(rewards.correctness(t, g).alias("correctness"), rewards.form(t).alias("format"), rewards.reasoning(t).alias("reasoning"), rewards.consistency(t).alias("consistency"), rewards.kind(t).alias("atype"), rewards.length(t, g).alias("length"))
    for r in spark.createDataFrame(rows, "t string, g string").select(rewards.shares(t, g).alias("x"), alone.alias("y")).collect():
        assert r.x == r.y
