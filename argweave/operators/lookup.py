"""Finding graphs by slug, and their nodes and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CATALOG = ("id", "slug", "title", "description")


def graph_by_slug(graphs: DataFrame, slug: str) -> DataFrame:
    """The graph with exactly this slug, or no row. More than one is an error."""
    return at_most_one(graphs.where(F.col("slug") == slug))


def graphs_by_slug(graphs: DataFrame, requests: DataFrame) -> DataFrame:
    """The requested graphs; an unknown slug gives no row."""
    return graphs.join(requests.select("slug").distinct(), "slug", "left_semi").select(*CATALOG)


def at_most_one(graphs: DataFrame) -> DataFrame:
    """Catalog rows, one per slug; fails when a slug occurs more than once."""
    rows = graphs.groupBy("slug").agg(
        F.count("*").alias("_rows"), *(F.any_value(c).alias(c) for c in CATALOG if c != "slug")
    )
    message = F.concat(F.lit("More than one graph has the slug "), F.col("slug"))
    return rows.where(F.assert_true(F.col("_rows") == 1, message).isNull()).select(*CATALOG)


def children(rows: DataFrame, graphs: DataFrame) -> DataFrame:
    """Nodes or edges of the given graphs. Nothing is kept when there are no graphs."""
    return rows.join(graphs.select(F.col("id").alias("graph_id")), "graph_id", "left_semi")


def node_rows(nodes: DataFrame) -> DataFrame:
    """Nodes as the lookup returns them, in order."""
    return nodes.select("graph_id", "id", "kind", "title", F.col("body_text").alias("bodyText")).orderBy(
        "graph_id", "id"
    )


def edge_rows(edges: DataFrame) -> DataFrame:
    """Edges as the lookup returns them, in order."""
    return edges.select(
        "graph_id", "id", F.col("from_node_id").alias("from"), F.col("to_node_id").alias("to"), "kind"
    ).orderBy("graph_id", "id")


def lookup(rows: DataFrame, requests: DataFrame) -> DataFrame:
    """Each requested slug once, with the columns of its graph and whether it was found."""
    hit = rows.withColumn("found", F.lit(True))
    return requests.select("slug").distinct().join(hit, "slug", "left").withColumn(
        "found", F.coalesce("found", F.lit(False))
    )


def strict_lookup(rows: DataFrame, requests: DataFrame) -> DataFrame:
    """As `lookup`, but a slug that is not found is an error."""
    # Fixed value: the text of the message.
    message = F.concat(F.lit("Fixture graph '"), F.col("slug"), F.lit("' was not found."))
    return lookup(rows, requests).where(F.assert_true("found", message).isNull()).drop("found")


def by_id(rows: DataFrame, *ids: str) -> DataFrame:
    """The rows with these ids. Ids are literals, so that statistics and Bloom filters of stored files tell which to read."""
    return rows.where(F.col("id").isin(*ids))


def pick_nodes(nodes: DataFrame, selection: DataFrame) -> DataFrame:
    """The nodes named by a selection (graph_id, node_id); a selection without a node gives no row."""
    wanted = selection.select("graph_id", F.col("node_id").alias("id"))
    return nodes.join(wanted, ["graph_id", "id"], "left_semi")
