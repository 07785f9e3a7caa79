"""All queries of the library with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stepfold.operators.questions import DENSE, QUESTIONS
from stepfold.plans import catalog, files, question_sql, reports
from stepfold.plans.state import World, world_of_events

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def world(spark: SparkSession, sf_dir: str, ranged: bool = False, length: int = 32) -> World:
    return world_of_events(table(spark, sf_dir, "events"), length, ranged)


def _question(qtype: str, part: int, ranged: bool) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: QUESTIONS[qtype](world(spark, sf_dir, ranged))[part]


for _q in QUESTIONS:
    for _ranged in (False, True) if _q in DENSE else (False,):
        _name = f"{_q}_range" if _ranged else _q
        QUERIES[f"q_{_name}"], ORACLE_SQL[f"q_{_name}"] = _question(_q, 0, _ranged), question_sql.answer_sql(_q, _ranged)
        QUERIES[f"prov_{_name}"], ORACLE_SQL[f"prov_{_name}"] = _question(_q, 1, _ranged), question_sql.cells_sql(_q, _ranged)

assert reports.query is files.query is catalog.query  # these modules add themselves to the catalogue
QUERIES |= catalog.QUERIES
ORACLE_SQL |= catalog.ORACLE_SQL
