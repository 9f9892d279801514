"""Every query over the benchmark tables against its SQL in DuckDB."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as contract  # noqa: E402
from lakeweave.benchmark_queries import QUERIES  # noqa: E402
from lakeweave.benchmark_sql import ORACLE_SQL  # noqa: E402
from tests import oracle  # noqa: E402


@pytest.fixture(scope="module")
def duck(sf_dir):
    return oracle.connect(sf_dir)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLE_SQL)
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLE_SQL) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, duck, sf_dir, name):
    columns, answer = oracle.spark_answer(QUERIES[name](spark, sf_dir))
    sql_columns, sql_answer = oracle.sql_answer(duck, ORACLE_SQL[name])
    assert columns == sql_columns
    assert answer == sql_answer
    assert answer


def test_sorted_output_is_sorted(spark, sf_dir):
    rows = contract.queries()["sort_multi_key"](spark, sf_dir).collect()
    keys = [(row["region"], row["tier"], -row["customer_id"]) for row in rows]
    assert keys == sorted(keys)


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns[0] == "customer_id" and df.count() > 0
