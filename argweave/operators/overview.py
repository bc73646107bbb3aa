"""Counts per graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from argweave.schemas import GraphTables


def count_rows(rows: DataFrame, into: str) -> DataFrame:
    """Nodes or edges per graph."""
    return rows.groupBy("graph_id").agg(F.count("*").alias(into))


def overview(tables: GraphTables) -> DataFrame:
    """Title, description, slug and the number of nodes and edges of every graph, 0 where there are none."""
    # Nodes and edges are counted in one aggregate, so their keys are shuffled once and already reduced.
    marks = tables.nodes.select("graph_id", F.lit(1).alias("node"), F.lit(0).alias("edge")).unionByName(
        tables.edges.select("graph_id", F.lit(0).alias("node"), F.lit(1).alias("edge"))
    )
    counts = marks.groupBy("graph_id").agg(F.sum("node").alias("node_count"), F.sum("edge").alias("edge_count"))
    return (
        tables.graphs.join(counts.withColumnRenamed("graph_id", "id"), "id", "left")
        .select(
            "title",
            "description",
            F.coalesce("node_count", F.lit(0)).alias("node_count"),
            F.coalesce("edge_count", F.lit(0)).alias("edge_count"),
            "slug",
        )
    )
