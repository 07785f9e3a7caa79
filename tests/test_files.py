"""Scans and sinks on files that each test writes."""

import base64
import json
import time

import pytest
from pyspark.sql import functions as F

from stepfold.functions import answers
from stepfold.plans import records
from stepfold.sources import sinks, tables
from stepfold.streaming import moves

STEPS = [{"step_id": 1, "rooms": {"Kitchen": ["Mary"], "Garden": []}}, {"step_id": 2, "rooms": {"Kitchen": [], "Garden": ["Mary"]}}]
META = [{"step_id": 1, "rooms": {"Kitchen": True, "Garden": False}}, {"step_id": 2, "rooms": {"Kitchen": True, "Garden": True}}]
SAMPLE = {"qid": "0000007", "seq_len": 2, "qtype": "first_app", "atype": "room", "question": "Where?", "answer": "Kitchen", "sequence": STEPS, "metadata": META}


def dump(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value, ensure_ascii=False))
    return str(path)


def test_samples_and_totals(spark, tmp_path):
    dump(tmp_path / "len_2/questions.json", [SAMPLE, SAMPLE | {"qid": "0000008", "n_relevant_rooms": 9}])
    dump(tmp_path / "len_4/questions.json", [SAMPLE | {"qid": "0000009", "seq_len": 4}])
    rows = {r.qid: r for r in tables.samples(spark, f"{tmp_path}/len_*/questions.json").collect()}
    assert {q: (r.seq_len, r.n_relevant_rooms_per_step, r.n_relevant_rooms) for q, r in rows.items()} == {"0000007": (2, [1, 2], 3), "0000008": (2, [1, 2], 9), "0000009": (4, [1, 2], 3)}
    assert rows["0000007"].sequence[1].rooms == {"Kitchen": [], "Garden": ["Mary"]}


def test_one_json_array(spark, tmp_path):
    rows = tables.samples(spark, dump(tmp_path / "in.json", [SAMPLE | {"qid": "0000009"}, SAMPLE]))
    assert sinks.json_array(rows, f"{tmp_path}/out.json", "qid") == 2
    text = (tmp_path / "out.json").read_text()
    out = json.loads(text)
    assert [x["qid"] for x in out] == ["0000007", "0000009"] and out[0]["sequence"] == STEPS and text.startswith("[\n  {")
    assert tables.samples(spark, f"{tmp_path}/out.json").count() == 2


def test_answer_files(spark, tmp_path):
    dump(tmp_path / "qa_pairs_answers_org_model_x.csv", 'qid,N_steps,Type,Answer,Predicted_Answer\n1,4,first_app,Kitchen,"{""answer"": ""Kitchen""}"\n2,4,n_empty,3,Error: timeout\n3,4,n_empty\n4,4,n_empty,3,"a\nb"\n')
    dump(tmp_path / "qa_pairs_answers_other.csv", "qid,seq_len,qtype,answer,Predicted_Answer\n1,8,first_app,Garden,Garden\n")
    rows, bad = tables.well_formed(tables.answer_files(spark, f"{tmp_path}/qa_pairs_answers_*.csv"))
    assert bad == 1
    got = {(r.model, r.qid): (r.seq_len, r.qtype, r.answer, r.Predicted_Answer) for r in rows.collect()}
    assert got == {
        ("org/model_x", "1"): ("4", "first_app", "Kitchen", '{"answer": "Kitchen"}'),
        ("org/model_x", "2"): ("4", "n_empty", "3", "Error: timeout"),
        ("org/model_x", "4"): ("4", "n_empty", "3", "a\nb"),
        ("other", "1"): ("8", "first_app", "Garden", "Garden"),
    }
    assert sorted(r.qid for r in tables.completed(spark, f"{tmp_path}/qa_pairs_answers_org*.csv").collect()) == ["0000001", "0000004"]
    assert tables.completed(spark, f"{tmp_path}/none_*.csv").count() == 0
    assert tables.answer_files(spark, f"{tmp_path}/none_*.csv").count() == 0


def test_logs_and_newest_results(spark, tmp_path):
    log = {"resps": [["answer: Mary"]], "filtered_resps": ["Мария"], "target": "Мария", "exact_match": 1.0, "doc": {"inputs": {"question": "?"}, "meta": {"id": 1, "categories": {"task_type": "DC-SA-C", "seq_len": 32, "atype": "person"}}}}
    dump(tmp_path / "a/b/samples_set_dc_sa_c_32_2024-01-01.jsonl", json.dumps(log) + "\n" + json.dumps(log | {"resps": [["7 rooms"]], "doc": {"meta": {"id": 2, "atype": "number"}}}))
    rows = {r.doc.meta.id: r for r in answers.batch_answers(tables.sample_logs(spark, str(tmp_path))).collect()}
    assert {(i, r.config, r.atype, r.pred) for i, r in rows.items()} == {(1, "set_dc_sa_c_32", "person", "Мария"), (2, "set_dc_sa_c_32", "number", "7")}
    for name, em in (("results_2024-01-01.json", 0.25), ("results_2024-02-01.json", 0.5)):
        dump(tmp_path / name, {"results": {"t": {"exact_match,scoring": em, "alias": "t"}}})
    assert [tuple(r) for r in tables.latest(spark, f"{tmp_path}/results_*.json").collect()] == [("t", 0.5)]
    assert tables.latest(spark, f"{tmp_path}/nothing_*.json").count() == 0


def test_sequences_join_their_questions(spark, tmp_path):
    dump(tmp_path / "seq/s1.csv", "A,B\nK,G\nG,G\n")
    dump(tmp_path / "seq/s2.csv", "A,B\nK,K\n")
    steps = tables.sequences_csv(spark, f"{tmp_path}/seq", ["A", "B"])
    assert sorted((r.seq, r.step_id, r.ch_ord, r.ch, r.room) for r in steps.collect())[:4] == [("s1.csv", 1, 0, "A", "K"), ("s1.csv", 1, 1, "B", "G"), ("s1.csv", 2, 0, "A", "G"), ("s1.csv", 2, 1, "B", "G")]
    questions = spark.createDataFrame([(1, "x/s1.csv"), (2, "y/s2.csv"), (3, "z/none.csv")], "qid int, sequence_path string")
    got = {r.qid: r.sequence for r in tables.with_sequences(questions, steps).collect()}
    assert [(s.step_id, s.at) for s in got[1]] == [(1, {"A": "K", "B": "G"}), (2, {"A": "G", "B": "G"})] and len(got[2]) == 1 and got[3] is None


def test_sets_by_config_and_split(spark, tmp_path):
    sinks.dataset(spark.range(3), f"{tmp_path}/hub/one/test")
    spark.range(2).coalesce(1).write.parquet(f"{tmp_path}/tmp")
    part = next((tmp_path / "tmp").glob("part-*"))
    (tmp_path / "hub/two").mkdir()
    part.rename(tmp_path / "hub/two/shots-00000-of-00001.parquet")
    assert tables.hub_dataset(spark, f"{tmp_path}/hub", "one", "test").count() == 3
    assert tables.hub_dataset(spark, f"{tmp_path}/hub", "two", "shots").count() == 2
    with pytest.raises(FileNotFoundError):
        tables.hub_dataset(spark, f"{tmp_path}/hub", "two", "test")


def test_images(spark, tmp_path):
    dot = base64.b64decode(tables.DUMMY)
    for name in ("vid_1/frame_0002.png", "vid_1/frame_0001.png", "vid_2/frame_0001.png"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(dot + name.encode() if "vid_1" in name else b"broken")
    got = {r.folder: r.frames for r in tables.images(spark, str(tmp_path)).collect()}
    read = [base64.b64decode(x.split(",")[1]) for x in got["vid_1"]]
    assert read == [dot + b"vid_1/frame_0001.png", dot + b"vid_1/frame_0002.png"]
    assert got["vid_2"] == ["data:image/png;base64," + tables.DUMMY]
    rows = spark.createDataFrame([(1, ["vid_1/frame_0001.png", "vid_1/none.png"]), (2, [])], "qid int, images array<string>")
    with pytest.warns(UserWarning, match="1 images"):
        out, missing = tables.with_images(rows, tables.image_files(spark, str(tmp_path)), "qid")
    assert missing == 1 and {r.qid: r.contents and len(r.contents) for r in out.collect()} == {1: 1, 2: None}


def test_external_scores_and_in_context(spark, tmp_path):
    path = dump(tmp_path / "scores.csv", "Model,Math (%),Other\norg/a-1.5,10.5,x\norg/b,,y\norg/c,7,z\n")
    assert sorted(map(tuple, tables.external_scores(spark, path, {"Model": "id", "Math (%)": "math"}).collect())) == [("org/a-1_5", 10.5), ("org/c", 7.0)]
    with pytest.warns(UserWarning, match="no in-context"):
        assert tables.in_context(spark, f"{tmp_path}/none.json").count() == 0
    assert tables.in_context(spark, None).count() == 0
    assert tables.in_context(spark, dump(tmp_path / "ex.json", [SAMPLE])).count() == 1


def test_appending(spark, tmp_path):
    for n in (1, 2):
        sinks.append_rows(spark.range(n).selectExpr("id", "'a\"b' as t"), f"{tmp_path}/csv")
        sinks.append_jsonl(spark.range(n), f"{tmp_path}/jsonl")
    assert spark.read.option("header", True).option("escape", '"').csv(f"{tmp_path}/csv").where("t = 'a\"b'").count() == 3
    assert spark.read.json(f"{tmp_path}/jsonl").count() == 3


def test_requests_and_results(spark, tmp_path):
    df = spark.createDataFrame([("7", [("user", "Hi")])], "custom_id string, messages array<struct<role:string,content:string>>")
    sinks.requests(df, f"{tmp_path}/r", "m")
    line = json.loads(spark.read.text(f"{tmp_path}/r").first().value)
    assert line == {"custom_id": "7", "method": "POST", "url": "/v1/chat/completions", "body": {"model": "m", "messages": [{"role": "user", "content": "Hi"}]}}
    rates = spark.createDataFrame([(8, "q", "b", 2.0), (4, "q", "a", 50.0)], "seq_len int, qtype string, model string, hit double")
    out = spark.read.option("header", True).csv(sinks.results(rates, str(tmp_path), "main"))
    assert [tuple(r) for r in out.collect()] == [("4", "q", "a", "50.0"), ("8", "q", "b", "2.0")]


def test_config_files_info_manifest_and_card(spark, tmp_path):
    made = tables.samples(spark, dump(tmp_path / "in.json", [SAMPLE, SAMPLE | {"qid": "0000003", "answer": "Nobody", "qtype": "other"}]))
    recs = records.benchmark_records(made, "ru", prefix="p")
    assert sinks.config_files(recs, recs.where("meta.id = 7"), f"{tmp_path}/out") == ["p_fa_fa_r_2", "p_other_2"]
    test = json.loads((tmp_path / "out/p_fa_fa_r_2/test.json").read_text())
    assert test["access"] == "public" and len(test["data"]) == 1 and test["data"][0]["outputs"] == "Kitchen"
    assert test["data"][0]["inputs"]["context"].split("\n")[0] == json.dumps(STEPS[0]) and test["data"][0]["meta"] == {"id": 7, "task": "FA-FA-R", "qtype": "first_app", "seq_len": 2, "atype": "room"}
    assert json.loads((tmp_path / "out/p_other_2/shots.json").read_text()) == {"data": []}
    assert json.loads((tmp_path / "out/p_other_2/test.json").read_text())["data"][0]["outputs"] == "Никто"
    info = sinks.dataset_info(recs, f"{tmp_path}/out", "Set", "ru", "text")
    assert json.loads((tmp_path / "out/dataset_info.json").read_text()) == info and info["tasks"] == ["p_fa_fa_r_2", "p_other_2"] and info["total_samples"] == 2
    said = sinks.manifest(spark.range(1), str(tmp_path), model="m")
    assert json.loads((tmp_path / "eval_manifest.json").read_text()) == said == {"model": "m", "sample_stats": {"id": 0}}
    assert sinks.dataset_card(["a", "b"]).splitlines()[:4] == ["---", "configs:", "- config_name: a", "  data_files:"]


def test_prompt_and_text_steps(spark):
    lines = "Step 1: Kitchen: [Mary]; Garden: []\nШаг 2: Kitchen: []; Garden: [Mary, John]"
    df = spark.createDataFrame([(lines,)], "t string")
    got = df.select(tables.text_steps(F.col("t")).alias("s")).first().s
    assert [(x.step_id, x.rooms) for x in got] == [(1, {"Kitchen": ["Mary"], "Garden": []}), (2, {"Kitchen": [], "Garden": ["Mary", "John"]})]
    with pytest.raises(Exception, match="malformed step"):
        spark.createDataFrame([("nonsense",)], "t string").select(tables.text_steps(F.col("t")).alias("s")).collect()
    rec = spark.createDataFrame([("{context} - {question} ", ("c", "q"))], "instruction string, inputs struct<context:string,question:string>")
    assert sinks.prompt(rec).first().prompt == "c - q"


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [(i, f"2024-01-0{1 + i // 4} 0{i % 4}:00:00", i, "click" if i % 2 else "view", 1.0, "{}") for i in range(8)] + [(99, "2024-01-09 00:00:00", 1, "view", 1.0, "{}")]
    spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    query = moves.event_counts(spark, f"{tmp_path}/in").writeStream.format("memory").queryName("counted").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted((str(r.start)[:10], r.event_type, r.n) for r in spark.table("counted").collect()) == [("2024-01-01", "click", 2), ("2024-01-01", "view", 2), ("2024-01-02", "click", 2), ("2024-01-02", "view", 2)]
    stream = spark.readStream.schema(moves.EVENTS).parquet(f"{tmp_path}/in").select("event_id")
    out = sinks.append_stream(stream, f"{tmp_path}/out", f"{tmp_path}/cp2")
    out.processAllAvailable()
    out.stop()
    time.sleep(0.1)
    assert spark.read.option("header", True).csv(f"{tmp_path}/out").count() == 9


def test_elements_are_made_few_at_a_time():
    import pyarrow as pa

    from stepfold.sources import sinks

    batch = pa.RecordBatch.from_arrays([pa.array(range(1050)), pa.array(['{"a":1}'] * 1050)], names=["k", "value"])
    parts = list(sinks._pretty(batch, "  "))
    assert max(p.num_rows for p in parts) <= sinks.AT_ONCE and [k for p in parts for k in p.column(0).to_pylist()] == list(range(1050))
    assert {v for p in parts for v in p.column(1).to_pylist()} == {'  {\n    "a": 1\n  }'}
