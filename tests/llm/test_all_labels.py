"""The quality rules learn from every label: no number of labelled rows is too many to count."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from stepfold.llm import quality_rules


def test_all_trusted_labels_are_targets(spark):
    ids = [i for i in range(50_000) if zlib.crc32(str(i).encode()) % 4 >= 2]
    labels = spark.range(50_000).selectExpr("id as doc_id", "1 as quality", "0 as toxic")
    assert quality_rules.target_ids(labels).count() == len(ids) > 20_000


@pytest.mark.parametrize("n", [1, 2, 9, 60, 3000])
def test_cut_of_a_table_is_that_of_a_list(spark, n):
    rng = random.Random(n)
    rows = [(rng.choice([rng.gauss(q, 1), rng.randrange(4) / 2]), q) for q in (rng.randrange(2) for _ in range(n))]
    got, want = quality_rules.cut_of(spark.createDataFrame(rows, "x double, q int").repartition(7)), quality_rules.best_cut(rows)
    assert got == want


def test_threshold_from_all_labels(spark):
    """Of 3,000 good documents the 100 whose hashes are greatest hold bad words too, and no bucket but that of two words counts: the cut lies below them."""
    ids = [i for i in range(14_000) if zlib.crc32(str(i).encode()) % 4 == 0][:3200]
    order = [r.i for r in spark.createDataFrame([(i,) for i in ids[:3000]], "i long").orderBy(F.xxhash64("i")).collect()]
    words = dict.fromkeys(ids[3000:], "bad " * 60) | dict.fromkeys(order[:2900], "good " * 60) | dict.fromkeys(order[2900:], "good bad " * 30)
    docs = spark.createDataFrame(list(words.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(d, int(d in set(order)), 0) for d in ids], "doc_id long, quality int, toxic int")
    ratios = [0.0] * quality_rules.BUCKETS
    for w, x in (("good", 1.0), ("bad", -1.0)):
        ratios[spark.range(1).select(quality_rules._bucket(F.lit(w))).first()[0]] = x
    assert quality_rules.threshold_of(docs, labels, ratios) == pytest.approx(-60 / 119 / 2)
