"""Command lines from end to end."""

import json

import pytest

import stepfold
from stepfold.__main__ import main
from stepfold.plans import records
from stepfold.sources import sinks


def test_exports():
    assert all(getattr(stepfold, name) is not None for name in stepfold.__all__) and len(stepfold.QUESTIONS) == 24
    with pytest.raises(AttributeError):
        stepfold.nothing  # noqa: B018


def test_generate_benchmark_and_requests(spark, tmp_path, capsys):
    assert main(["generate", "--list-question-types"], spark) == 0 and "spend_alone" in capsys.readouterr().out
    out = f"{tmp_path}/q.json"
    assert main(["generate", "--output-path", out, "--seq-lengths", "2", "4", "--n-questions", "2", "--question-types", "n_empty"], spark) == 0
    made = json.loads((tmp_path / "q.json").read_text())
    assert len(made) == 4 and "length 2: 2" in capsys.readouterr().out
    assert main(["benchmark", "--output-dir", f"{tmp_path}/set", "--seq-lengths", "4", "--n-questions", "2", "--question-types", "spend_alone", "--n-few-shot", "2", "--few-shot-max-len", "8", "--language", "ru"], spark) == 0
    test, shots = (json.loads((tmp_path / f"set/rooms_dc_sa_c_4/{x}.json").read_text())["data"] for x in ("test", "shots"))
    assert len(test) == 2 and len(shots) == 2 and min(x["meta"]["id"] for x in shots) > 10_000 and test[0]["instruction"].startswith("Задача")
    (tmp_path / "done").mkdir()
    (tmp_path / "done/qa_pairs_answers_a_b.csv").write_text(f"qid,Predicted_Answer\n{int(made[0]['qid'])},3\n{int(made[1]['qid'])},error\n")
    assert main(["requests", "--data-path", out, "--output", f"{tmp_path}/req", "--model", "m", "--done", f"{tmp_path}/done/*.csv", "--in-context", out, "--n-examples", "1"], spark) == 0
    lines = [json.loads(r.value) for r in spark.read.text(f"{tmp_path}/req").collect()]
    assert sorted(x["custom_id"] for x in lines) == sorted(x["qid"] for x in made[1:]) and all("Example 1 (len=" in x["body"]["messages"][0]["content"] for x in lines)
    assert main(["render", "--input-path", out, "--output-dir", f"{tmp_path}/svg", "--limit", "1"], spark) == 0
    assert spark.read.json(f"{tmp_path}/svg").count() == made[0]["seq_len"]
    assert main(["translate", "--input-path", out, "--output-path", f"{tmp_path}/ru.json"], spark) == 0
    assert all("Сколько" in x["question"] for x in json.loads((tmp_path / "ru.json").read_text()))


def test_publish(spark, tmp_path):
    out = f"{tmp_path}/set"
    assert main(["publish", "--output-dir", out, "--seq-lengths", "4", "--n-questions", "3", "--question-types", "spend_alone", "steps_in_room", "--n-shots", "2"], spark) == 0
    rows = spark.read.option("basePath", out).parquet(f"{out}/config=*")
    assert {(r.config, r.split): r["count"] for r in rows.groupBy("config", "split").count().collect()} == {(c, s): n for c in ("rooms_dc_sa_c_4", "rooms_dc_sr_i_4") for s, n in (("test", 3), ("shots", 2))}
    assert {r.instruction for r in rows.collect()} <= set(records.PROMPTS) and all(r.meta.categories.task_type in ("DC-SA-C", "DC-SR-I") for r in rows.collect())
    assert "- config_name: rooms_dc_sa_c_4" in (tmp_path / "set/README.md").read_text()


def test_score_leaderboard_and_correlate(spark, tmp_path, capsys):
    (tmp_path / "data/main").mkdir(parents=True)
    for k, name in enumerate(["org_alpha", "org_beta", "org_gamma"]):
        lines = [f'{i},{n},n_empty,3,"{{""answer"": {3 if i % 3 <= k else 1}}}"' for n in (4, 8) for i in range(6)]
        (tmp_path / f"data/main/qa_pairs_answers_{name}.csv").write_text("\n".join(["qid,seq_len,qtype,answer,Predicted_Answer", *lines, "1,4"]) + "\n")
    assert main(["score", "--input-dir", f"{tmp_path}/data", "--output-dir", f"{tmp_path}/out"], spark) == 0
    said = capsys.readouterr()
    assert "3 malformed" in said.err
    results = said.out.strip()
    got = {(r.model, r.seq_len): r.hit for r in spark.read.option("header", True).csv(results).collect()}
    assert got == {("org/alpha", "4"): "4.0", ("org/alpha", "8"): "4.0", ("org/beta", "4"): "8.0", ("org/beta", "8"): "8.0", ("org/gamma", "4"): "12.0", ("org/gamma", "8"): "12.0"}
    assert main(["leaderboard", "--results", results, "--output-dir", f"{tmp_path}/lb", "--models", "org/alpha", "org/none"], spark) == 0
    assert "org/none" in capsys.readouterr().err and spark.read.option("header", True).csv(f"{tmp_path}/lb/models").count() == 1
    (tmp_path / "scores.csv").write_text("name,Math\nthe-alpha,1\nthe-beta,2\nthe-gamma,3\n")
    assert main(["correlate", "--results", results, "--scores", f"{tmp_path}/scores.csv", "--output", f"{tmp_path}/corr", "--columns", "name=id", "Math=math"], spark) == 0
    rows = spark.read.option("header", True).csv(f"{tmp_path}/corr").collect()
    assert {(r.seq_len, r.benchmark, r.n, round(float(r.r), 6)) for r in rows} == {("4", "math", "3", 1.0), ("8", "math", "3", 1.0)}


def test_runs(spark, tmp_path, capsys):
    logs = [{"resps": [[f"answer: {'Mary' if i % 2 else 'John'}" + " " * 200]], "target": "Mary", "exact_match": 0.0, "doc": {"meta": {"id": i, "atype": "person"}}} for i in range(4)]
    (tmp_path / "samples_set_dc_sa_c_32_2024-01-01.jsonl").write_text("\n".join(map(json.dumps, logs)))
    (tmp_path / "results_2024.json").write_text(json.dumps({"results": {"set_dc_sa_c_32": {"exact_match,scoring": 0.25}}}))
    run = ["--run-dir", str(tmp_path), "--model", "m"]
    assert main(["report", *run], spark) == 0 and "set_dc_sa_c" in capsys.readouterr().out
    assert main(["rescore", *run], spark) == 0 and "0.25" in capsys.readouterr().out
    assert main(["validate", *run], spark) == 0
    assert main(["validate", *run, "--expect-thinking", "yes"], spark) == 1 and "no thinking" in capsys.readouterr().out
    assert json.loads((tmp_path / "eval_manifest.json").read_text())["sample_stats"]["n"] == 4
    (tmp_path / "empty").mkdir()
    assert main(["validate", "--run-dir", f"{tmp_path}/empty", "--model", "m"], spark) == 1


def test_patch_convert_and_serialise(spark, tmp_path):
    schema = "instruction string, inputs struct<context:string,question:string>, outputs string, meta struct<id:int>"
    text = "Step 1: Kitchen: [Mary]; Garden: []"
    sinks.dataset(spark.createDataFrame([("x", (text, records.CROWD_OLD + "3)?"), "1", (1,))], schema), f"{tmp_path}/hub/p_dc_cc_i_32/test")
    at = ["--config", "p_dc_cc_i_32", "--root"]
    assert main(["patch", *at, f"{tmp_path}/hub", "--output", f"{tmp_path}/new"], spark) == 0
    assert main(["convert", *at, f"{tmp_path}/new", "--output", f"{tmp_path}/json"], spark) == 0
    row = spark.read.parquet(f"{tmp_path}/json/p_dc_cc_i_32/test").first()
    assert row.inputs.question.startswith(records.CROWD_NEW) and json.loads(row.inputs.context) == {"step_id": 1, "rooms": {"Kitchen": ["Mary"], "Garden": []}}
    (tmp_path / "seq").mkdir()
    (tmp_path / "seq/a.csv").write_text("A,B\nK,G\n")
    (tmp_path / "questions.json").write_text(json.dumps([{"qid": 1, "sequence_path": "seq/a.csv"}]))
    assert main(["serialise", "--questions", f"{tmp_path}/questions.json", "--sequences", f"{tmp_path}/seq", "--output", f"{tmp_path}/ser", "--chars", "A", "B"], spark) == 0
    assert json.loads(spark.read.text(f"{tmp_path}/ser").first().value)["sequence"] == [{"step_id": 1, "at": {"A": "K", "B": "G"}}]
