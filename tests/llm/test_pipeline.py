"""Each stage of the pipeline on the rows that it is given, against brute force."""

from collections import Counter

import pytest

import corpus_pipeline
from stepfold.llm import compression_classifier

from . import cases
from .test_native import brute as contaminated
from .test_ngram_join import brute as groups


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    if not cases.has_data():
        pytest.skip("no test data")
    docs = spark.read.parquet(f"{cases.DATA}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, out[-1], cases.DATA).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_stages_keep_the_columns(stages):
    assert [s.dtypes for s in stages[1:5]] == [stages[0].dtypes] * 4
    assert len(corpus_pipeline.STAGES) == 5


def test_quality_keeps_the_good(spark, stages):
    kept = {r.doc_id for r in stages[1].collect()}
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{cases.DATA}/labels.parquet").collect()}
    good = [i for i, q in truth.items() if q == 1]
    assert sum(i in kept for i in good) / len(good) > 0.9


def test_one_of_each_group_stays(stages):
    before, after = ([(r.doc_id, r.text) for r in s.collect()] for s in stages[1:3])
    assert Counter(after) == Counter(x for x in before if x[0] in {c for _, _, c in groups(before, 5, 80)})


def test_no_benchmark_stays(spark, stages):
    before, after = ([(r.doc_id, r.text) for r in s.collect()] for s in stages[2:4])
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{cases.DATA}/benchmark.parquet").collect()]
    bad = {r[0] for r in contaminated(before, items) if r[-1]}
    assert Counter(after) == Counter(x for x in before if x[0] not in bad)


def test_personal_data_and_packing(stages):
    before, after = ({r.doc_id: r.text for r in s.collect()} for s in stages[3:5])
    assert before.keys() == after.keys()
    assert all(after[i] == t for i, t in before.items() if not any(c in t for c in "0123456789@"))
    assert not any("@mail" in t for t in after.values())
    assert {r.doc_id for r in stages[5].collect()} == set(after)


def test_repeated_null_and_empty_rows(spark):
    docs = cases.docs(spark, ["same words in each of these rows"] * 3 + [None, "", None]).drop("n_chars")
    docs = docs.union(docs.where("doc_id in (0, 3)")).union(docs.where("doc_id = 0").withColumn("doc_id", docs.doc_id * None))
    kept = Counter((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert kept == Counter([(0, "same words in each of these rows"), (None, "same words in each of these rows"), (3, None), (3, None), (4, ""), (5, None)])
    assert corpus_pipeline.personal_data(spark, docs, "").columns == docs.columns


def test_texts_that_share_an_id_are_no_copies(spark):
    rows = [(1, "alpha beta gamma delta epsilon zeta"), (1, "something else in other words altogether"), (2, "x"), (2, "x"), (3, "Alpha beta gamma delta epsilon ZETA"), (1, "something else in other words altogether")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = Counter((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert kept == Counter([(1, "alpha beta gamma delta epsilon zeta"), (1, "something else in other words altogether"), (2, "x")])


def test_columns_of_any_name(spark):
    docs = cases.docs(spark)
    names = ["_0", "_1", "_2", "_t", "_nth", "_quality", "t", "u", "n", "key", "id", "first", "component", "a.b", "all", "email", "terms", "masked", "owner"]
    for k, name in enumerate(names):
        docs = docs.withColumn(name, docs.doc_id + k)
    # a label or two is too few to learn from
    want = Counter(docs.collect())
    for name, stage in corpus_pipeline.STAGES[:4]:
        got = stage(spark, docs, cases.DATA)
        assert got.columns == docs.columns
        rows = [r for r in got.collect() if name != "personal_data"]
        assert not Counter(rows) - want


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = cases.docs(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.count() == 0
    model = compression_classifier.fit(compression_classifier.sample_rows(cases.docs(spark, []), spark.read.parquet(str(tmp_path / "labels.parquet"))))
    assert model.share == 0.5 and not model.fitted
