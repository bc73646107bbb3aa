"""Integrity rules as reports: rows (rule, table, key, detail), one per violation. NULL passes every check but NOT NULL."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from argweave.operators.lineage import run_folder, write_out
from argweave.schemas import EDGE_KINDS, EDGES, GRAPHS, NODE_KINDS, NODES, POLARITIES, GraphTables, stored

REPORT = ("rule", "table", "key", "detail")


def _outside(column: str) -> tuple[Column, Column]:
    value = F.col(column)
    return ~value.between(0, 1), value.cast("string")


def _not_in(column: str, domain: tuple) -> tuple[Column, Column]:
    value = F.col(column)
    return ~value.isin(*domain), value.cast("string")


# The names of the constraints are fixed values.


def _edge_checks() -> dict[str, tuple[Column, Column]]:
    source, target = F.col("from_node_id"), F.col("to_node_id")
    return {
        "ck_edges_confidence": _outside("confidence"),
        "ck_edges_kind": _not_in("kind", EDGE_KINDS),
        "ck_edges_not_self": (source == target, source),
        "ck_edges_polarity": _not_in("polarity", POLARITIES),
        "ck_edges_weight": _outside("weight"),
    }


def _node_checks() -> dict[str, tuple[Column, Column]]:
    return {
        "ck_nodes_confidence": _outside("confidence"),
        "ck_nodes_importance": _outside("importance"),
        "ck_nodes_kind": _not_in("kind", NODE_KINDS),
        "ck_nodes_prior": _outside("prior"),
        "ck_nodes_weight": _outside("weight"),
    }


# table -> (primary key, further unique columns, foreign keys: column -> table)
KEYS = {
    "graphs": ("id", ("slug",), {}),
    "nodes": ("id", (), {"graph_id": "graphs"}),
    "edges": ("id", (), {"from_node_id": "nodes", "to_node_id": "nodes", "graph_id": "graphs"}),
}


# Unique columns, by number, as the spaces that keys are counted in.
SPACES = [(table, column) for table, (primary, unique, _) in KEYS.items() for column in (primary, *unique)]


def _space(table: str, column: str) -> Column:
    return F.lit(SPACES.index((table, column)))


def check_rows(rows: DataFrame, table: str, only: Sequence[str] | None = None) -> DataFrame:
    """CHECK and NOT NULL rules of one table, all in one scan. With `only`, just the rules named, which reads just their
    columns."""
    schema = {"graphs": GRAPHS, "nodes": NODES, "edges": EDGES}[table]
    checks = {"graphs": dict, "nodes": _node_checks, "edges": _edge_checks}[table]()
    required = [f.name for f in stored(schema) if not f.nullable and f.name in rows.columns]
    rules = [(rule, broken, detail) for rule, (broken, detail) in checks.items()]
    rules += [(f"{table}_not_null", F.col(name).isNull(), F.lit(name)) for name in required]
    if only is not None:
        rules = [found for found in rules if found[0] in only]
    # Sound rows are filtered out before findings are put together.
    unsound = rows.where(reduce(Column.__or__, (broken for _, broken, _ in rules)))
    found = [
        F.when(broken, F.struct(F.lit(rule).alias("rule"), detail.alias("detail"))) for rule, broken, detail in rules
    ]
    return unsound.select(
        F.lit(table).alias("table"), F.col("id").cast("string").alias("key"), F.inline(F.array_compact(F.array(*found)))
    ).select(*REPORT)


def duplicate_keys(rows: DataFrame, table: str, column: str = "id") -> DataFrame:
    """Values of a key that occur more than once, with their number."""
    primary = column == KEYS[table][0]
    rule = f"{table}_pkey" if primary else f"{table}_{column}_key"
    return (
        _key_counts(rows, column)
        .where(F.col("rows") > 1)
        .select(
            F.lit(rule).alias("rule"),
            F.lit(table).alias("table"),
            F.col(column).cast("string").alias("key"),
            F.col("rows").cast("string").alias("detail"),
        )
    )


def _key_counts(rows: DataFrame, column: str) -> DataFrame:
    """Rows per key; references use the keys only, so their plan drops the count and has a shuffle of its own."""
    return rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("rows"))


def dangling(rows: DataFrame, table: str, column: str, parents: DataFrame) -> DataFrame:
    """Rows whose `column` names no parent.

    Keys and references meet in one aggregate, which sums them in each task before the shuffle, so a value that very many
    rows share is one row per task by then, and no side is sorted. What comes out is usually little, and small enough to be
    broadcast to the rows.
    """
    keys = rows.select(F.col(column).alias("_key"), F.lit(0).alias("_known"))
    keys = keys.unionByName(parents.select(F.col("id").alias("_key"), F.lit(1).alias("_known"))).where("_key is not null")
    missing = keys.groupBy("_key").agg(F.max("_known").alias("_known")).where("_known = 0").select("_key")
    return rows.join(missing, F.col(column) == F.col("_key"), "left_semi").select(
        F.lit(f"{table}_{column}_fkey").alias("rule"),
        F.lit(table).alias("table"),
        F.col("id").alias("key"),
        F.col(column).cast("string").alias("detail"),
    )


def entries(rows: DataFrame, table: str, references: bool = True) -> DataFrame:
    """(space, key, defines) of one table in one scan: each value of a unique column defines its key (1) in the
    column's space; each value of a foreign key refers (0) to a key of its parent's space."""
    primary, unique, foreign = KEYS[table]
    own = [(_space(table, c), c, F.lit(1)) for c in (primary, *unique)]
    if references:
        own += [(_space(parent, KEYS[parent][0]), c, F.lit(0)) for c, parent in foreign.items()]
    found = [
        F.struct(space.alias("space"), F.col(c).cast("string").alias("key"), defines.alias("defines"))
        for space, c, defines in own
    ]
    return rows.select(F.inline(F.array(*found))).where("key is not null")


def faulty(entries: DataFrame) -> DataFrame:
    """(space, key, rows) of the keys that are defined more than once, or not at all and so only referred to.

    Definitions and references of all tables meet in one aggregate, which sums them in each task before the shuffle, so
    neither a key that very many rows share nor the number of rules costs more than a row per key and task. The state is one
    number, which stays in a hash table; lists of rules would be sorted, and spilled, beyond a few keys.
    """
    return entries.groupBy("space", "key").agg(F.sum("defines").alias("rows")).where("rows <> 1")


def _repeated(faulty: DataFrame) -> DataFrame:
    """Reports of the keys that are defined more than once."""
    rule, owner = F.lit(None), F.lit(None)
    for table, (primary, unique, _) in KEYS.items():
        for column in (primary, *unique):
            here = F.col("space") == _space(table, column)
            rule = F.when(here, f"{table}_pkey" if column == primary else f"{table}_{column}_key").otherwise(rule)
            owner = F.when(here, table).otherwise(owner)
    repeated = faulty.where("rows > 1")
    return repeated.select(rule.alias("rule"), owner.alias("table"), "key", F.col("rows").cast("string").alias("detail"))


def _dangling_rows(rows: DataFrame, table: str, faulty: DataFrame) -> DataFrame:
    """Reports of the rows of one table that refer to a key that is not defined, for all its foreign keys at once."""
    foreign = KEYS[table][2]
    # References carry numbers where they are shuffled; the names of their rules come after.
    references = [
        F.struct(F.lit(at).alias("_at"), _space(parent, KEYS[parent][0]).alias("space"), F.col(c).cast("string").alias("detail"))
        for at, (c, parent) in enumerate(foreign.items())
    ]
    missing = faulty.where("rows = 0").select("space", F.col("key").alias("detail"))
    found = rows.select(F.col("id").cast("string").alias("key"), F.inline(F.array(*references)))
    found = found.join(missing, ["space", "detail"], "left_semi")
    rule = F.element_at(F.array(*(F.lit(f"{table}_{c}_fkey") for c in foreign)), F.col("_at") + 1)
    return found.select(rule.alias("rule"), F.lit(table).alias("table"), "key", "detail")


def violations(tables: GraphTables) -> DataFrame:
    """All rules over all tables. Each table is read once for its keys, once for its checks and, if it has foreign keys,
    once more for the rows of missing keys, so the tables should be stored or cheap. Faulty keys are stored on the way."""
    keys = reduce(DataFrame.unionByName, (entries(rows, name) for name, rows in tables._asdict().items()))
    return reports(tables, write_out(faulty(keys), fault_folder(tables)))


def fault_folder(tables: GraphTables) -> str:
    return f"{run_folder(tables.graphs.sparkSession)}/faulty"


def reports(tables: GraphTables, faulty: DataFrame) -> DataFrame:
    """The rows of the tables that break a rule, and the stored `faulty` keys that are defined more than once."""
    named = tables._asdict()
    found = [check_rows(rows, table) for table, rows in named.items()] + [_repeated(faulty)]
    found += [_dangling_rows(rows, table, faulty) for table, rows in named.items() if KEYS[table][2]]
    return reduce(DataFrame.unionByName, found)


def summary(violations: DataFrame) -> DataFrame:
    """Number of violations per rule."""
    return violations.groupBy("rule", "table").agg(F.count("*").alias("violations"))


def rules() -> list[tuple[str, str]]:
    """Every rule that `violations` applies, with its table."""
    named = [(rule, "nodes") for rule in _node_checks()] + [(rule, "edges") for rule in _edge_checks()]
    for table, (_, unique, foreign) in KEYS.items():
        named += [(f"{table}_not_null", table), (f"{table}_pkey", table)]
        named += [(f"{table}_{column}_key", table) for column in unique]
        named += [(f"{table}_{column}_fkey", table) for column in foreign]
    return named


def counts(violations: DataFrame) -> DataFrame:
    """Number of violations of every rule, zero included."""
    every = violations.sparkSession.createDataFrame(rules(), "rule string, `table` string")
    found = every.join(summary(violations), ["rule", "table"], "left")
    return found.select("rule", "table", F.coalesce("violations", F.lit(0)).cast("bigint").alias("violations"))
