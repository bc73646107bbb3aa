from __future__ import annotations

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from argweave.operators import lookup
from tests.conftest import rows


def slugs(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "slug string")


def test_missing_slug_has_no_row_and_no_children(spark, seed_tables):
    found = lookup.graph_by_slug(seed_tables.graphs, "missing")
    assert rows(found) == []
    assert lookup.children(seed_tables.nodes, found).count() == 0
    assert lookup.children(seed_tables.edges, found).count() == 0


def test_slug_is_case_sensitive(seed_tables):
    assert rows(lookup.graph_by_slug(seed_tables.graphs, "Sample-Medium")) == []


def test_found_graph_and_its_children_in_id_order(seed_tables):
    found = lookup.graph_by_slug(seed_tables.graphs, "sample-medium")
    assert rows(found) == [(1, "sample-medium", "Sample", "A seed graph.")]
    nodes = lookup.node_rows(lookup.children(seed_tables.nodes, found))
    assert nodes.columns == ["graph_id", "id", "kind", "title", "bodyText"]
    ids = [r.id for r in nodes.collect()]
    assert ids == sorted(ids) and len(ids) == 27 and (ids[0], ids[-1]) == ("C1", "R1")
    edges = lookup.edge_rows(lookup.children(seed_tables.edges, found)).collect()
    assert len(edges) == 34
    assert tuple(edges[0]) == (1, "E-C1-E1", "E1", "C1", "support")


def test_two_graphs_with_one_slug_are_an_error(seed_tables):
    twice = seed_tables.graphs.unionByName(seed_tables.graphs)
    with pytest.raises(PySparkException, match="More than one graph has the slug sample-medium"):
        lookup.graph_by_slug(twice, "sample-medium").collect()
    assert lookup.at_most_one(seed_tables.graphs).count() == 1


def test_lookup_tells_found_from_missing(spark, seed_tables):
    requests = slugs(spark, "sample-medium", "missing", "sample-medium")
    got = lookup.lookup(seed_tables.graphs.select("slug", "title"), requests).orderBy("slug")
    assert rows(got, "slug", "title", "found") == [("missing", None, False), ("sample-medium", "Sample", True)]


def test_strict_lookup_raises(spark, seed_tables):
    catalog = seed_tables.graphs.select("slug", "title")
    assert rows(lookup.strict_lookup(catalog, slugs(spark, "sample-medium"))) == [("sample-medium", "Sample")]
    with pytest.raises(PySparkException, match="Fixture graph 'nope' was not found."):
        lookup.strict_lookup(catalog, slugs(spark, "sample-medium", "nope")).collect()


def test_pick_nodes(spark, seed_tables):
    selection = spark.createDataFrame([(1, "E1"), (1, "E99"), (2, "R1")], "graph_id int, node_id string")
    assert rows(lookup.pick_nodes(seed_tables.nodes, selection), "id", F.col("evidence.type")) == [
        ("E1", "observational")
    ]
