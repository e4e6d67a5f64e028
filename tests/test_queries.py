"""Every registered query against its SQL twin, and rules its plan has to keep."""

import re
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as contract  # noqa: E402
from check import TABLES, rows_of  # noqa: E402
from workloads.registry import QUERIES, TWINS  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return con


def test_twins_belong_to_queries():
    assert set(QUERIES) == set(TWINS)


@pytest.mark.parametrize("name", sorted(TWINS))
def test_query_equals_its_twin(spark, con, name):
    df = QUERIES[name](spark, SF)
    result = con.execute(TWINS[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, result.fetchall())
    plan = df._jdf.queryExecution().toString()
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan), plan


def test_entry(spark):
    assert [tuple(r) for r in contract.entry(spark).collect()] == sorted(
        (tuple(r) for r in contract.entry(spark).collect()), key=lambda r: (-r[1], r[0])
    )
