"""Registered queries against their SQL on the smallest driver tables."""

import os
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from check import digest
from codestrata.queries import load_all
from codestrata.queries.views import BASE

FOLDER = os.environ.get("CODESTRATA_TEST_DATA", "/root/testdata/sf0.001")
QUERIES = load_all()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in BASE:
        connection.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, duck, name):
    query = QUERIES[name]
    df = query.run(spark, FOLDER)
    mine = digest(df.columns, [tuple(r) for r in df.collect()])
    result = duck.execute(query.sql)
    theirs = digest([d[0] for d in result.description], result.fetchall())
    assert mine[0] == theirs[0]
    assert mine[1] == theirs[1]


def test_all_have_sql():
    assert [n for n, q in load_all().items() if not q.sql] == []


@pytest.mark.parametrize("name", ["neighbours_j1", "unverified_paths_v2_j8", "call_edges_e7_e8", "import_targets_e2_e3_e4_e5",
                                  "uncovered_lines_g5", "module_edges_a3_j3_j4_u1", "document_search_t2"])
def test_no_nested_loops(spark, name):
    df = load_all()[name].run(spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
