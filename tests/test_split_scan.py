"""Scans in parts against Spark's scans of whole files."""

import csv
import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from stepfold.sources import split_scan, tables

SCHEMA = "id long, text string, list array<struct<a: string>>"
NASTY = ['plain', 'a "quoted" {word}', "back\\slash\\", "}{][", "line\nbreak", '\\"', "", "é 日本 😀", ",;[", '"}', "\\\\\"}"]


@pytest.fixture
def small_parts(spark):
    """Files are cut every few bytes."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97b")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def objects(rng, n):
    return [{"id": i, "text": rng.choice(NASTY) * rng.randrange(4), "list": [{"a": rng.choice(NASTY)} for _ in range(rng.randrange(3))]} for i in range(n)]


@pytest.mark.parametrize("indent,broadcast_parts", [(None, 10**6), (2, 10**6), (None, 0)])
def test_json_arrays(spark, tmp_path, small_parts, indent, broadcast_parts):
    rng = random.Random(1)
    for k, n in enumerate((60, 1, 0, 25)):
        (tmp_path / f"{k}.json").write_text(json.dumps(objects(rng, n), indent=indent, ensure_ascii=k % 2 == 0) + "\n" * k)
    (tmp_path / "one.json").write_text(json.dumps(objects(rng, 1)[0], indent=1))
    (tmp_path / "empty.json").write_text("")
    found = split_scan.json_objects(spark, str(tmp_path), SCHEMA, broadcast_parts=broadcast_parts)
    want = [json.loads(p.read_text()) for p in tmp_path.glob("*.json") if p.read_text()]
    want = Counter(json.dumps(x, sort_keys=True) for v in want for x in (v if isinstance(v, list) else [v]))
    assert Counter(json.dumps(r.x.asDict(True), sort_keys=True) for r in found.collect()) == want
    whole = spark.read.schema(SCHEMA).option("multiLine", True).json(str(tmp_path))
    assert found.select("x.*").exceptAll(whole.where("id is not null")).isEmpty()


def test_json_is_read_by_many_tasks(spark, tmp_path):
    (tmp_path / "x.json").write_text(json.dumps([{"id": i, "text": "x" * 200, "list": []} for i in range(40_000)]))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        cut = split_scan._cut(spark, str(tmp_path), "}")
        assert cut.select(F.spark_partition_id()).distinct().count() >= 8
        assert split_scan.json_objects(spark, str(tmp_path), SCHEMA).agg(F.sum("x.id"), F.count("*")).first()[:] == (40_000 * 39_999 // 2, 40_000)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


@pytest.mark.parametrize("newline", ["\n", "\r\n"])
def test_csv_with_line_breaks(spark, tmp_path, small_parts, newline):
    rng = random.Random(2)
    texts = [t for t in NASTY if t and "\\" not in t] + ["two\n\nlines", '""', "a,b", "x" * 300 + "\n" + "y" * 200]
    rows = []
    for k, n in enumerate((50, 3, 0, 20)):
        with (tmp_path / f"answers_org_m{k}.csv").open("w", newline="") as f:
            out = csv.writer(f, lineterminator=newline)
            out.writerow(["qid", "question", "answer"])
            for i in range(n):
                rows.append((str(i), rng.choice(texts), rng.choice(texts), f"org/m{k}"))
                out.writerow(rows[-1][:3])
    found = tables.answer_files(spark, str(tmp_path))
    good, bad = tables.well_formed(found)
    assert bad == 0 and Counter(good.select("qid", "question", "answer", "model").collect()) == Counter(rows)


def test_csv_kinds_of_headers(spark, tmp_path):
    (tmp_path / "answers_a_b.csv").write_text('Answer,N_steps,"Ty""pe"\n1,2,x\n\n3,4\n5,6,"y\nz"')
    (tmp_path / "answers_a_c.csv").write_text("answer,seq_len\n7,8\n")
    (tmp_path / "answers_a_d.csv").write_text("answer,seq_len\n9,10\n")
    got = {(r.answer, r.seq_len, r['Ty"pe'], r.malformed, r.model) for r in tables.answer_files(spark, str(tmp_path)).collect()}
    assert got == {("1", "2", "x", None, "a/b"), ("3", "4", None, "3,4", "a/b"), ("5", "6", "y\nz", None, "a/b"), ("7", "8", None, None, "a/c"), ("9", "10", None, None, "a/d")}
