"""Physical plans that queries must keep: how often they shuffle and read events."""

from pathlib import Path

import pytest

from stepfold import registry

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")
@pytest.mark.parametrize("name,exchanges,scans", [("q_spend_together", 3, 2), ("q_spend_alone", 3, 2), ("q_room_empty", 3, 2), ("q_first_app", 3, 2)])
def test_exchanges_and_scans(spark, name, exchanges, scans):
    plan = registry.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= exchanges and plan.count("FileScan") <= scans and "NestedLoop" not in plan and "Cartesian" not in plan
