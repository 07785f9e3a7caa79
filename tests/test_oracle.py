"""Every query with SQL against DuckDB on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from stepfold import registry

DATA = "/root/testdata/sf0.001"


def cell(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")
@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {t.stem} AS SELECT * FROM read_parquet('{t}')")
    got = registry.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    want = con.execute(registry.ORACLE_SQL[name])
    at = [[d[0] for d in want.description].index(c) for c in columns]
    assert sorted(([cell(r[c]) for c in columns] for r in got.collect()), key=repr) == sorted(([cell(r[i]) for i in at] for r in want.fetchall()), key=repr)
