"""Deleting rows together with everything that refers to them, by the declared foreign keys.

For each table that others refer to, the ids that go are written to the shared folder as a delete set. The set of a table is
what was asked for and the rows that refer to a row in the set of a parent, so following the keys from parents to children
fills all sets. What is left of a table are the rows outside its own set that refer to nothing in its parents' sets.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from argweave.operators.lineage import run_folder, write_out
from argweave.operators.quality import KEYS
from argweave.schemas import GraphTables


def delete(tables: GraphTables, doomed: dict[str, DataFrame]) -> GraphTables:
    """What is left after deleting the rows listed in `doomed`, by table (id). NULL refers to nothing and no NULL id goes.

    Tables that others refer to are read at most twice, others once, and every delete set once for each foreign key to its
    table. Rows that go with a small parent, as edges with their graph, are left out before they are dealt by a large one's keys.
    """
    folder = run_folder(tables.graphs.sparkSession)
    named = tables._asdict()
    parents = {parent for _, _, foreign in KEYS.values() for parent in foreign.values()}
    gone: dict[str, DataFrame] = {}
    for table, (_, _, foreign) in KEYS.items():  # parents stand before their children
        # What was asked for may name a row many times; rows that follow are one for each id already.
        sets = [doomed[table].select("id").distinct()] if table in doomed else []
        if table in parents:
            follow = {c: parent for c, parent in foreign.items() if parent in gone}
            sets += [_referring(named[table], c, gone[parent]) for c, parent in follow.items()]
        if sets:
            ids = reduce(DataFrame.unionByName, sets).where("id is not null")
            gone[table] = write_out(ids, f"{folder}/gone-{table}")
    left = {}
    for table, (_, _, foreign) in KEYS.items():
        rows = named[table]
        for column, parent in sorted(foreign.items(), key=lambda key: list(KEYS).index(key[1])):
            rows = _without(rows, column, gone.get(parent))
        if not _follows(foreign, gone, table, doomed):
            rows = _without(rows, "id", gone.get(table))
        left[table] = rows.select(*named[table].columns)
    return GraphTables(**left)


def _follows(foreign: dict[str, str], gone: dict[str, DataFrame], table: str, doomed: dict[str, DataFrame]) -> bool:
    """True if a table's own delete set holds nothing but what refers to its parents' sets."""
    return table not in doomed and any(parent in gone for parent in foreign.values())


def _referring(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    return rows.select("id", column).join(ids.withColumnRenamed("id", column), column, "left_semi").select("id")


def _without(rows: DataFrame, column: str, ids: DataFrame | None) -> DataFrame:
    return rows if ids is None else rows.join(ids.select(F.col("id").alias(column)), column, "left_anti")


def delete_graphs(tables: GraphTables, doomed: DataFrame) -> GraphTables:
    """What is left after deleting the graphs listed in `doomed` (id): their nodes and edges go, and so do edges of
    other graphs at either end of a deleted node."""
    return delete(tables, {"graphs": doomed})


def delete_nodes(tables: GraphTables, doomed: DataFrame) -> GraphTables:
    """What is left after deleting the nodes listed in `doomed` (id): edges at either end go."""
    return delete(tables, {"nodes": doomed})
