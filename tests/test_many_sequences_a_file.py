"""Sequence files of many sequences: as many files as parts, each row's sequence from a column, steps in the order of the file."""

from pathlib import Path

import pytest

from stepfold import registry
from stepfold.plans import files
from stepfold.sources import tables

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")
def test_files_are_as_many_as_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "_folder", lambda spark: f"file://{tmp_path}/x")
    rows = registry.QUERIES["io_sequences"](spark, DATA).collect()
    assert len({r.qid for r in rows}) == 31 and len(rows) == 31 * 32 * 5
    assert 0 < len(list(tmp_path.glob("x/**/*.csv"))) <= int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_steps_of_many_sequences_in_split_files(spark, tmp_path):
    want = {str(s): [(f"a{s}.{k}", None if k % 7 == 0 else f"b{k * s % 5}") for k in range(1, 40)] for s in range(50)}
    for at in range(2):
        lines = [f"{s},{a},{b or ''}" for s in want if int(s) % 2 == at for a, b in want[s]]
        (tmp_path / f"{at}.csv").write_text("id,A,B\n" + "\n".join(lines) + "\n")
    conf = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        steps = tables.steps_csv(spark, str(tmp_path), ["A", "B"], key="id")
        questions = spark.createDataFrame([(int(s), f"len_8/{s}") for s in want] + [(99, "len_8/99")], "qid int, sequence_path string")
        by_steps = {r.qid: r.sequence for r in tables.with_sequences(questions, steps).collect()}
        by_cells = {r.qid: r.sequence for r in tables.with_sequences(questions, tables.sequences_csv(spark, str(tmp_path), ["A", "B"], key="id")).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert by_steps == by_cells and by_steps.pop(99) is None
    for s, found in by_steps.items():
        assert [(x.step_id, x.at["A"], x.at["B"]) for x in found] == [(k, a, b) for k, (a, b) in enumerate(want[str(s)], 1)]
