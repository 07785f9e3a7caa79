"""Queries of model outputs: the state of each length is one sort of its moves, in parts of their own that aren't put together by size; no task has both lengths."""

import re
from pathlib import Path

import pytest

from stepfold import registry

DATA = "/root/testdata/sf0.001"
NAMES = [
    "extract_answers",
    "lb_gates",
    "lb_hit_rates",
    "lb_mean_hits",
    "lb_means_over_lengths",
    "lb_means_over_questions",
    "lb_one_model",
    "lb_ordered_tasks",
    "lb_pivot",
    "lb_rescore_diff",
    "lb_run_stats",
]


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")
@pytest.mark.parametrize("name", NAMES)
def test_a_sort_of_moves_for_each_scan_of_events(spark, name):
    plan = registry.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    scans = len(re.findall(r"FileScan parquet", plan))
    assert scans and plan.count("REPARTITION_BY_NUM") == scans
    assert len(re.findall(r"\bSort \[seq_id", plan)) == scans and not re.search(r"\bSort \[seq_id[^\]]*(ch_ord|room)", plan)
