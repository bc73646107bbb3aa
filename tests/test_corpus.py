"""Graphs derived from the order tables: what is shuffled for them, and orders and lines that occur several times."""

from __future__ import annotations

import datetime

import duckdb
import pytest

from argweave.plans.oracle import ORACLE
from argweave.plans.queries import QUERIES
from tests.test_queries import FOLDER, TABLES, ordered


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Orders that are listed twice, lines that repeat, and lines without an order."""
    return written(spark, str(tmp_path_factory.mktemp("odd")), [(10, 1), (11, 1), (11, 1), (12, 2), (13, 2)])


def written(spark, folder, orders):
    day = datetime.datetime(2024, 1, 1)
    tables = {
        "customer": ("c_custkey bigint, c_name string, c_mktsegment string", [(n, f"Customer {n}", "BUILDING") for n in (1, 2)]),
        "supplier": ("s_suppkey bigint", [(5,), (6,)]),
        "orders": (
            "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderdate timestamp_ntz, o_orderpriority string",
            [(o, c, "O", day, "1-URGENT") for o, c in orders],
        ),
        "lineitem": (
            "l_orderkey bigint, l_suppkey bigint, l_linenumber int, l_extendedprice double, l_returnflag string",
            [(o, s, n, p, r) for o in (10, 11, 12, 99) for s, n, p, r in (
                (5, 1, 10.01, "N"), (5, 1, 20.5, "N"), (6, 1, 7.25, "R"), (6, 2, 3.0, "A"), (5, 3, 0.37, "R"))],
        ),
    }
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.mark.parametrize("name", ["nodes_full_scan", "edges_full_scan"])
def test_repeated_lines_of_orders_and_lines(spark, odd, name):
    oracle = duckdb.connect()
    for table in TABLES:
        files = f"{FOLDER}/{table}.parquet" if table == "conversations" else f"{odd}/{table}.parquet/*.parquet"
        oracle.execute(f"CREATE VIEW {table} AS SELECT * FROM '{files}'")
    got, want = QUERIES[name](spark, odd).toArrow(), oracle.sql(ORACLE[name]).to_arrow_table()
    assert ordered(got) == ordered(want)


def test_orders_of_two_customers(spark, tmp_path):
    folder = written(spark, str(tmp_path), [(12, 1), (12, 2), (12, 2)])
    edges = QUERIES["edges_full_scan"](spark, folder)
    found = {(r.id, r.graph_id): r.weight for r in edges.collect()}
    assert (found["E-12-1-E5", 1], found["E-12-1-E5", 2]) == (0.26933, 0.53866)
    assert (found["E-12-1", 1], found["E-12-1", 2]) == (0.30602, 0.61204)
    assert (found["E-12", 1], found["E-12", 2]) == (1.0, 1.0)
    assert len(found) == 16


@pytest.mark.parametrize("name", ["nodes_full_scan", "edges_full_scan"])
def test_lines_are_not_multiplied_before_a_shuffle(spark, capsys, name):
    QUERIES[name](spark, FOLDER).explain("formatted")
    assert "Expand" not in capsys.readouterr().out


@pytest.mark.parametrize("name", ["violations_edge_kind", "violations_edge_confidence", "violations_not_null"])
def test_rules_without_weights_read_no_prices(spark, capsys, name):
    QUERIES[name](spark, FOLDER).explain("formatted")
    assert "l_extendedprice" not in capsys.readouterr().out


@pytest.mark.parametrize("name", ["violations_not_null", "edges_full_scan", "nodes_full_scan", "node_by_id"])
def test_lines_are_dealt_in_one_shape(spark, capsys, name):
    """All levels of nodes and edges read the lines alike, so that their shuffle is shared."""
    QUERIES[name](spark, FOLDER).explain("formatted")
    plan = capsys.readouterr().out
    assert len({line for line in plan.split("\n") if "ReadSchema" in line and "l_orderkey" in line}) == 1
    assert "l_linenumber" in plan


def test_orders_with_very_many_lines_and_orders_without_a_customer(spark, tmp_path):
    """Sums of one order with 3,000 lines of the same number, and of an order of nobody."""
    folder = written(spark, str(tmp_path), [(12, 1), (99, None)])
    many = [(12, 5, 1, 1.0, "N")] * 3000 + [(12, 6, 2, 3000.0, "R"), (99, 5, 1, 1.0, "N")]
    schema = "l_orderkey bigint, l_suppkey bigint, l_linenumber int, l_extendedprice double, l_returnflag string"
    spark.createDataFrame(many, schema).write.mode("overwrite").parquet(f"{folder}/lineitem.parquet")
    weights = {r.id: r.weight for r in QUERIES["edges_full_scan"](spark, folder).where("graph_id is not null").collect()}
    assert weights == {"E-12-1-E5": 1.0, "E-12-2-O6": 1.0, "E-12-1": 0.5, "E-12-2": 0.5, "E-12": 1.0}
