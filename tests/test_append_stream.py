"""Rows of a stream are there once each, wherever its driver dies."""

import pytest

from stepfold.sources import sinks


def feed(spark, tmp_path, k):
    spark.createDataFrame([(10 * k + i, 'a "b",\nc') for i in range(10)], "id long, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")


def run(spark, tmp_path, checkpoint="cp"):
    stream = spark.readStream.schema("id long, text string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = sinks.append_stream(stream, f"{tmp_path}/out", f"{tmp_path}/{checkpoint}", availableNow=True)
    try:
        query.awaitTermination(120)
        return True
    except Exception:
        return False


def ids(spark, tmp_path):
    return sorted(r.id for r in sinks.appended(spark, f"{tmp_path}/out", "id long").collect())


@pytest.mark.parametrize("step", ["append_rows", "_commit", "_finish"])
def test_a_driver_dies_after_or_before_each_step(spark, tmp_path, monkeypatch, step):
    assert ids(spark, tmp_path) == []
    feed(spark, tmp_path, 0)
    assert run(spark, tmp_path) and ids(spark, tmp_path) == list(range(10))
    owner = sinks if step == "append_rows" else sinks.AppendLog
    real = getattr(owner, step)

    def dies_after(*args):
        real(*args)
        raise RuntimeError("lost")

    def dies_before(*args):
        raise RuntimeError("lost")

    for k, dies in enumerate((dies_after, dies_before), 1):
        feed(spark, tmp_path, k)
        monkeypatch.setattr(owner, step, dies)
        assert not run(spark, tmp_path)
        seen = ids(spark, tmp_path)
        assert seen in (list(range(10 * k)), list(range(10 * k + 10)))  # a batch is there as a whole or not at all
        monkeypatch.setattr(owner, step, real)
        assert run(spark, tmp_path) and ids(spark, tmp_path) == list(range(10 * k + 10))
    assert spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"{tmp_path}/out").count() == 30


def test_another_stream_appends_to_the_same_folder(spark, tmp_path):
    feed(spark, tmp_path, 0)
    assert run(spark, tmp_path, "one") and run(spark, tmp_path, "two") and run(spark, tmp_path, "two")
    assert ids(spark, tmp_path) == sorted(2 * list(range(10)))
