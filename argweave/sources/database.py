"""The three tables in a relational database."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Row, SparkSession

from argweave.schemas import GraphTables
from argweave.sources.tables import typed

# Fixed value: the error for a missing connection setting.
NOT_CONFIGURED = "Database:ConnectionString is not configured."


def options(url: str | None, **settings: str) -> dict[str, str]:
    """Reader options for a JDBC url; a blank one is an error."""
    if url is None or not url.strip():
        raise ValueError(NOT_CONFIGURED)
    return {"url": url, **settings}


# The key by whose ranges each table is read.
KEYS = {"graphs": ("id",), "nodes": ("graph_id", "id"), "edges": ("graph_id", "id")}


def read_database(
    spark: SparkSession, url: str | None, splits: int = 200, sample_percent: float | None = 1.0, **settings: str
) -> GraphTables:
    """The tables over JDBC, each in about `splits` queries of like size over ranges of its key.

    The bounds of the ranges come from `sample_percent` of the table's pages (PostgreSQL's TABLESAMPLE SYSTEM), so that
    no whole table is sorted for them; None takes all rows, as databases without that clause need it. The sample only
    decides how even the ranges are, never which rows are read. Every query is a transaction of its own: tables that
    change meanwhile may be read in several states, which `quality.violations` then shows.
    """
    base = options(url, **settings)
    return GraphTables(*(typed(_read_split(spark, base, name, splits, sample_percent), name) for name in KEYS))


def _read_split(spark: SparkSession, base: dict[str, str], table: str, splits: int, sample_percent: float | None) -> DataFrame:
    # At most `splits` rows come to the driver.
    query = bounds_query(table, splits, sample_percent)
    bounds = spark.read.format("jdbc").options(**base, query=query).load().collect()
    url, properties = base["url"], {key: value for key, value in base.items() if key != "url"}
    return spark.read.jdbc(url, table, predicates=range_predicates(bounds, KEYS[table]), properties=properties)


def bounds_query(table: str, splits: int, sample_percent: float | None = None) -> str:
    """Every n-th key in order. Ranges of graph and id together also cut through a very large graph."""
    key = ", ".join(KEYS[table])
    rows = table if sample_percent is None else f"{table} TABLESAMPLE SYSTEM ({sample_percent})"
    return (
        f"SELECT {key}, place FROM ("
        f"SELECT {key}, row_number() OVER (ORDER BY {key}) AS place, count(*) OVER () AS total FROM {rows}"
        f") ranked WHERE place % CAST(ceil(total / {splits}.0) AS bigint) = 0"
    )


def range_predicates(bounds: list[Row], key: Sequence[str] = ("graph_id", "id")) -> list[str]:
    """Conditions that together hold exactly once for every row."""
    columns = f"({', '.join(key)})"
    # In the order of the database, whose collation may differ from the order of strings here.
    ordered = sorted(bounds, key=lambda row: row["place"])
    ends = [f"({', '.join(_literal(row[column]) for column in key)})" for row in ordered]
    if not ends:
        return ["1 = 1"]
    inner = [f"{columns} > {low} AND {columns} <= {high}" for low, high in zip(ends, ends[1:])]
    return [f"{columns} <= {ends[0]}", *inner, f"{columns} > {ends[-1]}"]


def _literal(value: int | str) -> str:
    return str(value) if isinstance(value, int) else "'{}'".format(value.replace("'", "''"))
