from __future__ import annotations

from functools import reduce

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from argweave.operators import cascade
from argweave.operators.lineage import run_folder, write_out
from argweave.operators.quality import REPORT, counts, dangling, entries, faulty, rules, summary, violations
from argweave.schemas import GraphTables
from tests.conftest import rows


def change(rows_, condition, **values):
    return rows_.withColumns(
        {
            name: F.when(F.expr(condition), F.lit(value).cast(rows_.schema[name].dataType)).otherwise(F.col(name))
            for name, value in values.items()
        }
    )


def twice(rows_, condition):
    return rows_.unionByName(rows_.where(condition))


EDGE, NODE = "id = 'E-R-C1'", "id = 'C1'"

# table, change, rule, key, detail
CASES = [
    ("edges", lambda t: change(t, EDGE, confidence=1.5), "ck_edges_confidence", "E-R-C1", "1.50000"),
    ("edges", lambda t: change(t, EDGE, weight=-0.1), "ck_edges_weight", "E-R-C1", "-0.10000"),
    ("edges", lambda t: change(t, EDGE, kind="doubt"), "ck_edges_kind", "E-R-C1", "doubt"),
    ("edges", lambda t: change(t, EDGE, to_node_id="C1"), "ck_edges_not_self", "E-R-C1", "C1"),
    ("edges", lambda t: change(t, EDGE, polarity=0), "ck_edges_polarity", "E-R-C1", "0"),
    ("nodes", lambda t: change(t, NODE, prior=1.2), "ck_nodes_prior", "C1", "1.20000"),
    ("nodes", lambda t: change(t, NODE, confidence=2), "ck_nodes_confidence", "C1", "2.00000"),
    ("nodes", lambda t: change(t, NODE, weight=-1), "ck_nodes_weight", "C1", "-1.00000"),
    ("nodes", lambda t: change(t, NODE, importance=1.00001), "ck_nodes_importance", "C1", "1.00001"),
    ("nodes", lambda t: change(t, NODE, kind="opinion"), "ck_nodes_kind", "C1", "opinion"),
    ("nodes", lambda t: change(t, NODE, title=None), "nodes_not_null", "C1", "title"),
    ("nodes", lambda t: change(t, NODE, tags=None), "nodes_not_null", "C1", "tags"),
    ("edges", lambda t: change(t, EDGE, kind=None), "edges_not_null", "E-R-C1", "kind"),
    ("graphs", lambda t: change(t, "id = 1", title=None), "graphs_not_null", "1", "title"),
    ("nodes", lambda t: twice(t, NODE), "nodes_pkey", "C1", "2"),
    ("edges", lambda t: twice(t, EDGE), "edges_pkey", "E-R-C1", "2"),
    ("graphs", lambda t: twice(change(t, "id = 1", slug=None), "id = 1"), "graphs_pkey", "1", "2"),
    ("graphs", lambda t: t.unionByName(change(t, "id = 1", id=2)), "graphs_slug_key", "sample-medium", "2"),
    ("edges", lambda t: change(t, EDGE, from_node_id="X"), "edges_from_node_id_fkey", "E-R-C1", "X"),
    ("edges", lambda t: change(t, EDGE, to_node_id="X"), "edges_to_node_id_fkey", "E-R-C1", "X"),
    ("edges", lambda t: change(t, EDGE, graph_id=9), "edges_graph_id_fkey", "E-R-C1", "9"),
    ("nodes", lambda t: change(t, NODE, graph_id=9), "nodes_graph_id_fkey", "C1", "9"),
]


def test_seed_is_clean(seed_tables):
    report = violations(seed_tables)
    assert tuple(report.columns) == REPORT
    assert rows(report) == []


def prefixed(tables, case):
    """A copy of the tables with its own ids."""
    mark, shift = F.lit(f"{case}/"), case * 100
    ids = {name: F.concat(mark, name) for name in ("id", "from_node_id", "to_node_id")}
    return GraphTables(
        tables.graphs.withColumns({"id": F.col("id") + shift, "slug": F.concat(mark, "slug")}),
        tables.nodes.withColumns({"id": ids["id"], "graph_id": F.col("graph_id") + shift}),
        tables.edges.withColumns({**ids, "graph_id": F.col("graph_id") + shift}),
    )


def test_each_rule_finds_its_violation_and_no_other(seed_tables):
    folder = run_folder(seed_tables.graphs.sparkSession)
    copies = [
        prefixed(seed_tables._replace(**{table: broken(getattr(seed_tables, table))}), case)
        for case, (table, broken, *_) in enumerate(CASES, start=1)
    ]
    stored = [write_out(reduce(DataFrame.unionByName, parts), f"{folder}/{i}") for i, parts in enumerate(zip(*copies))]
    found = {}
    for rule, table, key, detail in rows(violations(GraphTables(*stored))):
        if "/" in key:
            case, key = key.split("/")
            detail = detail.split("/")[-1]
        else:
            case, key = divmod(int(key), 100)
        if rule.endswith("graph_id_fkey"):
            detail = str(int(detail) - int(case) * 100)
        found.setdefault(int(case), set()).add((rule, table, str(key), detail))
    for case, (table, _, rule, key, detail) in enumerate(CASES, start=1):
        expected = {(rule, table, key, detail)}
        if rule == "graphs_pkey":  # its slug is NULL, or the slug would be there twice as well
            expected.add(("graphs_not_null", "graphs", "1", "slug"))
        assert found[case] == expected


def test_null_passes_checks(seed_tables):
    nothing = {"weight": None, "confidence": None, "polarity": None}
    edges = change(seed_tables.edges, "true", **nothing)
    nodes = change(seed_tables.nodes, "true", prior=None, weight=None, confidence=None, importance=None, evidence=None)
    assert rows(violations(GraphTables(seed_tables.graphs, nodes, edges))) == []


def test_bounds_are_inside(seed_tables):
    edges = change(change(seed_tables.edges, EDGE, weight=1, confidence=0), "id = 'E-R-C2'", weight=0, confidence=1)
    assert rows(violations(seed_tables._replace(edges=edges))) == []


def test_edges_between_graphs_parallel_edges_and_cycles_are_legal(spark, seed_tables):
    graphs = seed_tables.graphs.unionByName(change(seed_tables.graphs, "id = 1", id=2, slug="other"))
    nodes = change(seed_tables.nodes, "id like 'O%'", graph_id=2)
    back = change(seed_tables.edges.where(EDGE), "true", id="back", from_node_id="R1", to_node_id="C1")
    parallel = change(seed_tables.edges.where(EDGE), "true", id="parallel")
    edges = seed_tables.edges.unionByName(back).unionByName(parallel)
    assert rows(violations(GraphTables(graphs, nodes, edges))) == []


def test_summary(seed_tables):
    nodes = change(seed_tables.nodes, "kind = 'claim'", kind="opinion")
    assert rows(summary(violations(seed_tables._replace(nodes=nodes)))) == [("ck_nodes_kind", "nodes", 5)]


@pytest.fixture(scope="module")
def two_graphs(seed_tables):
    """The seed, with its counters moved to a second graph, so that edges of graph 1 start in graph 2."""
    graphs = seed_tables.graphs.unionByName(change(seed_tables.graphs, "id = 1", id=2, slug="other"))
    return GraphTables(graphs, change(seed_tables.nodes, "id like 'O%'", graph_id=2), seed_tables.edges)


def test_deleting_a_graph_takes_edges_of_other_graphs_along(two_graphs):
    left = cascade.delete_graphs(two_graphs, two_graphs.graphs.where("id = 2"))
    assert rows(left.graphs, "id") == [(1,)]
    assert left.nodes.count() == 18
    assert (left.edges.count(), left.edges.where("kind = 'rebut'").count()) == (17, 0)
    assert rows(violations(left)) == []


def test_deleting_all_graphs_leaves_nothing(seed_tables):
    assert [t.count() for t in cascade.delete_graphs(seed_tables, seed_tables.graphs)] == [0, 0, 0]


def test_deleting_a_node_takes_its_edges_along(seed_tables):
    left = cascade.delete_nodes(seed_tables, seed_tables.nodes.where("id = 'C1'"))
    assert [t.count() for t in left] == [1, 26, 29]
    assert left.edges.columns == seed_tables.edges.columns
    assert rows(violations(left)) == []


def test_deleting_nothing_changes_nothing(seed_tables):
    nobody = seed_tables.nodes.where("false")
    assert [t.count() for t in cascade.delete_nodes(seed_tables, nobody)] == [1, 27, 34]


def test_counts_have_a_row_for_every_rule(seed_tables):
    got = {(r.rule, r.table): r.violations for r in counts(violations(seed_tables)).collect()}
    assert got == dict.fromkeys(rules(), 0) and len(got) == 21
    doubled = seed_tables._replace(graphs=seed_tables.graphs.unionByName(seed_tables.graphs))
    got = {r.rule: r.violations for r in counts(violations(doubled)).collect()}
    assert got["graphs_pkey"] == seed_tables.graphs.count() and got["nodes_pkey"] == 0 and len(got) == 21


def test_keys_are_counted_in_hash_tables_and_not_sorted(spark, seed_tables, capsys):
    faulty(entries(seed_tables.edges, "edges").unionByName(entries(seed_tables.nodes, "nodes"))).explain("formatted")
    dangling(seed_tables.edges, "edges", "from_node_id", seed_tables.nodes).explain("formatted")
    plan = capsys.readouterr().out
    assert "ObjectHashAggregate" not in plan and "SortAggregate" not in plan
    assert "LeftAnti" not in plan
    nodes = seed_tables.nodes.where("id <> 'C1'")
    assert dangling(seed_tables.edges, "edges", "from_node_id", nodes).count() == 1
    assert dangling(seed_tables.edges, "edges", "to_node_id", nodes).count() == 4


def test_edges_leave_with_their_graph_before_they_meet_nodes(two_graphs):
    left = cascade.delete_graphs(two_graphs, two_graphs.graphs.where("id = 2"))
    plan = left.edges._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.split("\n") if "LeftAnti" in line]
    assert len(joins) == 3 and "graph_id" in joins[-1]


def test_a_delete_asked_for_twice_is_followed_once(two_graphs):
    twice = two_graphs.graphs.where("id = 2")
    left = cascade.delete_graphs(two_graphs, twice.unionByName(twice))
    assert [r.id for r in left.graphs.collect()] == [1]


@pytest.mark.parametrize("name", ["cascade_delete_graphs", "cascade_delete_nodes"])
def test_deletes_store_no_table_that_is_read_once(spark, monkeypatch, name):
    from argweave.operators import lineage
    from argweave.plans import queries

    stored = []

    def write(df, path):
        stored.append(path.rsplit("/", 1)[1])
        return lineage.write_out(df, path)

    monkeypatch.setattr(queries, "write_out", write)
    queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert stored == ["nodes"]
