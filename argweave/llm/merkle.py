"""Merkle manifest of a dataset: a digest per row, a tree per group, one root over the groups, and a proof per row.

A tree takes its leaves in order; while several nodes remain, every three consecutive ones become their digest, the last
run fewer, even one. The tree of a group is climbed in blocks of 3^`depth` nodes. All levels of a block are window
functions over the same partitioning and order: nodes of level l stand on the rows whose place is a multiple of 3^l, so a
lag or lead by 3^l, masked by the node's slot, supplies its siblings, and the row of a first child hashes the parent.
Blocks become the nodes of the next tier, which is 3^`depth` times smaller, until each tree is one block. A group of any
size is spread over many tasks; a row meets the path of its block in one join.

Rows of a group ascend by key, then by leaf, so repeated rows stand together and each has a proof of its own; a NULL key
comes first. The NULL group is a group of its own, before all others. Empty input gives no rows. A NULL field is hashed as
`-`, which no value gives. Columns other than those named take no part, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from argweave.llm.common import store
from argweave.operators.skew import number_rows

ARITY = 3
DEPTH = 7


def leaf_digest(fields: Sequence[Column]) -> Column:
    """sha256 over the fields in turn, each as byte count, colon and value, so that no two rows read alike."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def _climb(nodes: DataFrame, depth: int) -> DataFrame:
    """tree, block and the other columns of `nodes` (tree, idx, node, ...), with the block's top and the path up to it:
    per level the siblings to the left and right of the row's node, hex digests put together."""
    size = ARITY**depth
    rows = nodes.withColumn("block", F.floor(F.col("idx") / size).cast("long")).withColumn("at", F.pmod("idx", F.lit(size)))
    whole = W.partitionBy("tree", "block")
    along = whole.orderBy("at")
    so_far = along.rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("held", F.count("*").over(whole)).withColumn("n0", F.col("node"))
    kept = [*(c for c in nodes.columns if c not in ("idx", "node")), "block", "at", "held"]
    none = F.lit("")
    for level in range(depth):
        step = ARITY**level
        node = f"n{level}"
        before = [F.last(f"side{level - 1}", ignorenulls=True).over(so_far).alias(f"path{level - 1}")] if level else []
        paths = [f"path{k}" for k in range(level - 1)]
        near = [F.lag(node, 2 * step).over(along).alias("b2"), F.lag(node, step).over(along).alias("b1"), F.lead(node, step).over(along).alias("a1"), F.lead(node, 2 * step).over(along).alias("a2")]
        rows = rows.select(*kept, node, *paths, *before, *near)
        slot = F.pmod(F.floor(F.col("at") / step), F.lit(ARITY))
        left = F.when(slot == 1, F.col("b1")).when(slot == 2, F.concat("b2", "b1")).otherwise(none)
        right = F.when(slot == 0, F.concat(F.coalesce("a1", none), F.coalesce("a2", none))).when(slot == 1, F.coalesce("a1", none)).otherwise(none)
        # One node is left if the first block is the last one and holds no more rows than one node of this level.
        grows = (F.col("block") > 0) | (F.col("held") > step)
        here = F.col(node).isNotNull()
        parent = F.when(here & (slot == 0), F.when(grows, F.sha2(F.concat(F.col(node), right), 256)).otherwise(F.col(node)))
        side = F.when(here & grows, F.struct(left.alias("left"), right.alias("right")))
        rows = rows.select(*kept, *(f"path{k}" for k in range(level)), side.alias(f"side{level}"), parent.alias(f"n{level + 1}"))
    last = F.last(f"side{depth - 1}", ignorenulls=True).over(so_far).alias(f"path{depth - 1}")
    top = F.last(f"n{depth}", ignorenulls=True).over(so_far).alias("top")
    rows = rows.select(*kept, *(f"path{k}" for k in range(depth - 1)), last, top)
    path = F.array_compact(F.array(*(f"path{k}" for k in range(depth))))
    return rows.select(*(c for c in kept if c != "held"), path.alias("path"), "top")


def _above(climbed: DataFrame) -> DataFrame:
    return store(climbed.where("at = 0").select("tree", F.col("block").alias("idx"), F.col("top").alias("node")), "tier")


def _proofs(nodes: DataFrame, depth: int) -> DataFrame:
    """(tree, idx, path, root) of stored nodes (tree, idx, node): the path goes up to the root of the node's tree."""
    climbed = _climb(nodes.withColumn("own", F.col("idx")), depth)
    tops = _above(climbed)
    if tops.where("idx > 0").isEmpty():
        return climbed.select("tree", F.col("own").alias("idx"), "path", F.col("top").alias("root"))
    return _joined(climbed, _proofs(tops, depth)).select("tree", F.col("own").alias("idx"), "path", "root")


def _joined(climbed: DataFrame, upper: DataFrame) -> DataFrame:
    upper = upper.withColumnsRenamed({"tree": "t", "idx": "b", "path": "rest"})
    rows = climbed.join(upper, (F.col("tree") == F.col("t")) & (F.col("block") == F.col("b")))
    return rows.withColumn("path", F.concat("path", "rest"))


def manifest(rows: DataFrame, group: str, key: str, leaf: str, carried: Sequence[str] = (), depth: int = DEPTH) -> DataFrame:
    """key, leaf and the carried columns of every row, with `subroot` (of its group), `root` and `path`, an array of
    (left, right) from the row up to the root. `rows` is read twice."""
    taken = {f"c{k}": name for k, name in enumerate((key, leaf, *carried))}
    tree = F.coalesce(F.concat(F.lit("+"), F.col(group).cast("string")), F.lit(""))
    leaves = rows.select(tree.alias("tree"), *(F.col(name).alias(c) for c, name in taken.items()))
    leaves = number_rows(leaves, ["tree"], ["c0", "c1"], "idx").withColumn("node", F.col("c1"))
    climbed = _climb(leaves, depth)
    upper = store(_proofs(_above(climbed), depth), "upper")
    subroots = store(upper.where("idx = 0").select("tree", F.col("root").alias("node")), "subroots")
    ordered = store(number_rows(subroots, [], ["tree"], "idx"), "ordered")
    over = _proofs(ordered.select(F.lit("").alias("tree"), "idx", "node"), depth).select("idx", F.col("path").alias("over"), F.col("root").alias("top_root"))
    groups = store(ordered.select("tree", "idx").join(over, "idx").drop("idx"), "groups")
    # A group's path joins the few blocks of the group and not its rows.
    upper = upper.join(groups, "tree").select("tree", "idx", F.concat("path", "over").alias("path"), F.col("root").alias("subroot"), F.col("top_root").alias("root"))
    return _joined(climbed, upper).select(*(F.col(c).alias(name) for c, name in taken.items()), "subroot", "root", "path")


def proof_digest(path: Column) -> Column:
    """sha256 of all siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf leads to by its path."""
    return F.aggregate(path, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))
