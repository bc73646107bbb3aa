"""Tables with known defects, one kind per remainder of the graph id, to exercise the integrity rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from argweave.schemas import GraphTables

CYCLE = 50


def with_defects(tables: GraphTables) -> GraphTables:
    return GraphTables(defective_graphs(tables.graphs), defective_nodes(tables.nodes), defective_edges(tables.edges))


def _hit(graph: str, remainder: int, where: Column | None = None) -> Column:
    hit = F.col(graph) % CYCLE == remainder
    return hit if where is None else hit & where


def _replace(rows: DataFrame, changes: list[tuple[str, Column, Column]]) -> DataFrame:
    """Apply (column, condition, value) changes, all judged on the original row."""
    columns: dict[str, Column] = {}
    for name, condition, value in changes:
        before = columns.get(name, F.col(name))
        columns[name] = F.when(condition, value.cast(rows.schema[name].dataType)).otherwise(before)
    return rows.withColumns(columns)


def _with_copies(rows: DataFrame, condition: Column) -> DataFrame:
    copies = F.when(condition, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.withColumn("_copy", F.explode(copies)).drop("_copy")


def defective_edges(edges: DataFrame) -> DataFrame:
    top = F.col("to_node_id").startswith("R")
    missing = F.concat(F.lit("missing-"), "id")
    null = F.lit(None)
    changes = [
        ("confidence", _hit("graph_id", 1, top), F.lit(1.5)),
        ("weight", _hit("graph_id", 2, top), F.lit(2)),
        ("kind", _hit("graph_id", 3, top), F.lit("unknown")),
        ("to_node_id", _hit("graph_id", 4, top), F.col("from_node_id")),
        ("polarity", _hit("graph_id", 5, top), F.lit(0)),
        ("from_node_id", _hit("graph_id", 6, top), missing),
        ("to_node_id", _hit("graph_id", 7, top), missing),
        ("graph_id", _hit("graph_id", 8, top), -1 - F.col("graph_id")),
        ("weight", _hit("graph_id", 10, top), null),
        ("polarity", _hit("graph_id", 10, top), null),
        ("kind", _hit("graph_id", 11, top), null),
    ]
    return _replace(_with_copies(edges, _hit("graph_id", 9, top)), changes)


def defective_nodes(nodes: DataFrame) -> DataFrame:
    claim = F.col("kind") == "claim"
    changes = [
        ("prior", _hit("graph_id", 12, claim), F.lit(1.2)),
        ("confidence", _hit("graph_id", 13, claim), F.lit(-0.1)),
        ("weight", _hit("graph_id", 14, claim), F.lit(3)),
        ("importance", _hit("graph_id", 15, claim), F.lit(1.5)),
        ("title", _hit("graph_id", 16, claim), F.lit(None)),
        ("kind", _hit("graph_id", 17, claim), F.lit("opinion")),
        ("graph_id", _hit("graph_id", 18, claim), -1 - F.col("graph_id")),
    ]
    return _replace(_with_copies(nodes, _hit("graph_id", 19, claim)), changes)


def defective_graphs(graphs: DataFrame) -> DataFrame:
    changes = [
        ("title", _hit("id", 20), F.lit(None)),
        ("slug", _hit("id", 21), F.lit("duplicate")),
    ]
    return _replace(_with_copies(graphs, _hit("id", 22)), changes)
