"""Table and document schemas, and the fixed values that belong to the data model."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Fixed values of the data model.
NODE_KINDS = ("root", "claim", "premise", "counter", "evidence")
EDGE_KINDS = ("support", "rebut")
POLARITIES = (-1, 1)

UNIT = T.DecimalType(6, 5)

EVIDENCE = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("rationale", T.StringType()),
    ]
)

GRAPHS = T.StructType(
    [
        T.StructField("id", T.IntegerType(), False),
        T.StructField("slug", T.StringType(), False),
        T.StructField("title", T.StringType(), False),
        T.StructField("description", T.StringType()),
    ]
)

NODES = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("graph_id", T.IntegerType(), False),
        T.StructField("kind", T.StringType(), False),
        T.StructField("title", T.StringType(), False),
        T.StructField("body_text", T.StringType(), False),
        T.StructField("category", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType()), False),
        T.StructField("prior", UNIT),
        T.StructField("weight", UNIT),
        T.StructField("confidence", UNIT),
        T.StructField("importance", UNIT),
        T.StructField("evidence", EVIDENCE),
    ]
)

EDGES = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("graph_id", T.IntegerType(), False),
        T.StructField("from_node_id", T.StringType(), False),
        T.StructField("to_node_id", T.StringType(), False),
        T.StructField("kind", T.StringType(), False),
        T.StructField("weight", UNIT),
        T.StructField("confidence", UNIT),
        T.StructField("polarity", T.ShortType()),
        T.StructField("rationale", T.StringType()),
    ]
)

# Columns that a load fills in when the input leaves them out.
ATTRIBUTES = T.StructField("attributes", T.VariantType(), False)
AUDIT = (
    T.StructField("created_at", T.TimestampType(), False),
    T.StructField("updated_at", T.TimestampType(), False),
)


def stored(schema: T.StructType) -> T.StructType:
    """The schema as written by a load: attributes (nodes and edges only) and audit timestamps included."""
    extra = AUDIT if schema is GRAPHS else (ATTRIBUTES, *AUDIT)
    return T.StructType([*schema.fields, *extra])


# A nested document: one graph with its node and edge lists.
DOCUMENT_NODE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("bodyText", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("prior", T.DoubleType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("weight", T.DoubleType()),
        T.StructField("importance", T.DoubleType()),
        T.StructField("evidence", EVIDENCE),
    ]
)

DOCUMENT_EDGE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("from", T.StringType()),
        T.StructField("to", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("weight", T.DoubleType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("rationale", T.StringType()),
    ]
)

DOCUMENT = T.StructType(
    [
        T.StructField("slug", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("nodes", T.ArrayType(DOCUMENT_NODE)),
        T.StructField("edges", T.ArrayType(DOCUMENT_EDGE)),
    ]
)


class GraphTables(NamedTuple):
    """The three tables of a set of argument graphs."""

    graphs: DataFrame
    nodes: DataFrame
    edges: DataFrame
