"""Every registered query against its SQL, over the whole tables of the smallest scale."""

from __future__ import annotations

import ast
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from argweave.plans.oracle import ORACLE
from argweave.plans.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "customer supplier orders lineitem conversations".split()
REPO = Path(__file__).resolve().parents[1]

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def ordered(table):
    columns = sorted(table.column_names)
    lists = [table.column(name).to_pylist() for name in columns]
    return columns, sorted(zip(*lists), key=lambda row: [(value is not None, value) for value in row])


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLE.keys()
    assert QUERIES.keys() <= entry.queries().keys() and ORACLE.keys() <= entry.oracle_sql().keys()


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_its_sql(spark, oracle, name):
    got = QUERIES[name](spark, FOLDER).toArrow()
    want = oracle.sql(ORACLE[name]).to_arrow_table()
    assert ordered(got) == ordered(want)
    assert [str(got.schema.field(c).type) for c in sorted(got.column_names)] == [
        str(want.schema.field(c).type) for c in sorted(want.column_names)
    ]


def test_entry(spark):
    overview = entry.entry(spark)
    assert overview.columns == ["title", "description", "node_count", "edge_count", "slug"]
    assert overview.count() == 150


PLANNED = [
    "graph_overview", "graph_nodes", "flow_nodes", "node_details", "violations_edge_from", "cascade_delete_graphs",
    "edges_scan", "graph_edges", "flow_edges", "edge_counts",
]


@pytest.mark.parametrize("name", PLANNED)
def test_plans_have_no_pairwise_join_and_read_few_columns(spark, capsys, name):
    QUERIES[name](spark, FOLDER).explain("formatted")
    plan = capsys.readouterr().out
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "PythonUDF" not in plan and "ArrowEval" not in plan
    reads = {line.split("ReadSchema:")[1] for line in plan.split("\n") if "ReadSchema" in line}
    assert not any("l_extendedprice" in read for read in reads)


def test_no_local_checkpoints_and_no_forced_broadcasts():
    for path in (REPO / "argweave").rglob("*.py"):
        names = {node.attr for node in ast.walk(ast.parse(path.read_text())) if isinstance(node, ast.Attribute)}
        assert not names & {"localCheckpoint", "broadcast", "crossJoin", "toPandas"}, path
