"""The order of the nodes within their layers, chosen by crossings, for all graphs at once.

An edge over several layers gets a placeholder in each layer between its ends, so every segment joins neighbouring
layers. From the order by id on, nodes move to the mean position of their neighbours: towards layer 0 in one sweep, away
from it in the next. A step moves every other layer of all graphs while the layers between stay, so the number of jobs
does not go with the depth; a sweep of s steps carries an order over s layers. Every graph keeps the best of all orders
met, the first of equal ones, hence never one with more crossings than the order by id.

Means take the place of medians, as they come from partial sums: a node may have a third of all edges. Crossings are
counted without pairs: two segments cross if the one that starts earlier ends later, so for every bit of the end's
position, segments that agree in the bits above are counted, those with the bit set before those without it.

Graphs of at most `WHOLE` nodes and segments are dealt by graph once and numbered there. From then on a task takes many
whole graphs at a time as arrays of numbers, for all steps and counts, without shuffles or stores: a count goes over the bits
in place, where rows for each order, bit and segment would be sixty times the segments. Only larger graphs go through a
join and a store for each step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from argweave.operators.lineage import run_folder, write_out
from argweave.operators.skew import number_rows

# A point is a node, with an empty `via`, or the placeholder of an edge: its source, and '>' and its target.
POINT = ["graph_id", "layer", "id", "via"]
# So many starting points go into one window when crossings are counted.
BLOCK = 4096
# Nodes and segments, together, of a graph that is ordered in one task.
WHOLE = 100_000
# About so many nodes and segments are dealt to one task.
DEAL = 250_000


def order_layers(layers: DataFrame, edges: DataFrame, sweeps: int = 2, steps: int = 3) -> tuple[DataFrame, DataFrame]:
    """Nodes with their `rank` within the layer, and the crossings of every graph.

    The first has graph_id, id, layer and rank, which orders a layer's nodes but has gaps for placeholders. The second
    has graph_id and `crossings`: by id first, then after every step; graphs without segments are left out. Edges that
    are parallel count once; edges between graphs, within a layer or without both ends not at all. Nodes with no
    neighbour on the side that is looked at stay where they are; ties are by id. Node ids are unique.
    """
    folder = f"{run_folder(layers.sparkSession)}/order"
    nodes = write_out(layers.select("graph_id", "id", "layer"), f"{folder}/nodes")
    segments = write_out(_segments(nodes, edges), f"{folder}/segments")
    rows = nodes.select("graph_id").unionByName(segments.select("graph_id")).where("graph_id is not null")
    sizes = rows.groupBy("graph_id").agg(F.count("*").alias("rows"))
    seen = Observation()
    large = sizes.observe(seen, F.sum("rows").alias("rows")).where(F.col("rows") > WHOLE).select("graph_id")
    large = write_out(large, f"{folder}/large")
    tasks = 1 + (seen.get["rows"] or 0) // DEAL
    if large.isEmpty():
        return _at_once(nodes, segments, sweeps, steps, tasks)
    of_small, of_large = ([rows.join(large, "graph_id", how) for rows in (nodes, segments)] for how in ("left_anti", "left_semi"))
    both = _at_once(*of_small, sweeps, steps, tasks), _by_steps(*of_large, sweeps, steps, folder)
    return tuple(a.unionByName(b) for a, b in zip(*both, strict=True))


def _at_once(nodes: DataFrame, segments: DataFrame, sweeps: int, steps: int, tasks: int) -> tuple[DataFrame, DataFrame]:
    """As `order_layers`, with each graph in one task. A row is a point, whose ends are itself, or a segment."""
    ends = ("up", "low")
    points = [
        nodes.select("graph_id", "layer", "id", F.lit("").alias("via"), F.lit(True).alias("real")),
        segments.where("low_via <> ''").select("graph_id", "layer", F.col("low_id").alias("id"), F.col("low_via").alias("via"), F.lit(False).alias("real")),
    ]
    points = points[0].unionByName(points[1]).where("graph_id is not null")
    named = [F.col(name).alias(f"{end}_{name}") for end in ends for name in ("id", "via")]
    rows = points.select("graph_id", "layer", F.lit(True).alias("point"), "real", *named).unionByName(
        segments.select("graph_id", "layer", F.lit(False).alias("point"), F.lit(False).alias("real"), *(f"{end}_{name}" for end in ends for name in ("id", "via")))
    )
    wanted = max(tasks, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.repartition(wanted, "graph_id")
    point, within = F.col("point"), lambda *keys: W.partitionBy("graph_id", *keys)
    rows = rows.withColumn("n", F.when(point, F.row_number().over(within("point").orderBy("layer", "up_id", "up_via"))))
    for end, layer in (("up", F.col("layer") + F.when(point, 0).otherwise(1)), ("low", F.col("layer"))):
        rows = rows.withColumn(end, F.max("n").over(within(layer, f"{end}_id", f"{end}_via")))
    rows = rows.select("graph_id", "layer", "point", "real", F.when(F.col("real"), F.col("up_id")).alias("id"), "n", *ends)
    rows = rows.sortWithinPartitions("graph_id", F.col("n").asc_nulls_last())
    kind, layer = (rows.schema[name].dataType.simpleString() for name in ("graph_id", "layer"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for graphs in _whole_graphs(batches):
            yield from _ordered(graphs, sweeps, steps)

    done = rows.mapInArrow(run, f"graph_id {kind}, id string, layer {layer}, rank bigint, crossings array<bigint>")
    counts = done.where("crossings is not null").select("graph_id", "crossings")
    return done.where("crossings is null").drop("crossings"), counts


def _whole_graphs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of a partition that is sorted by graph, in tables of whole graphs of about `DEAL` rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= DEAL:
            rows = pa.Table.from_batches(held)
            graph = _graphs_of(rows)
            whole = int(np.searchsorted(graph, graph[-1]))  # the last one may go on
            held = rows.slice(whole).to_batches()
            if whole:
                yield rows.slice(0, whole)
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held)


def _graphs_of(rows: pa.Table) -> np.ndarray:
    """The number of each row's graph, from 0 in the order of the rows."""
    return rows.column("graph_id").combine_chunks().dictionary_encode().indices.to_numpy()


def _ordered(rows: pa.Table, sweeps: int, steps: int) -> Iterator[pa.RecordBatch]:
    """The nodes of whole graphs with their rank, and for each graph with segments a row of its crossings."""
    graph, point = _graphs_of(rows), rows.column("point").to_numpy()
    points, parts = np.flatnonzero(point), np.flatnonzero(~point)
    own, of_parts = graph[points], graph[parts]
    first = np.searchsorted(own, np.arange(graph[-1] + 1)) - 1  # points are numbered from 1 in each graph
    at = lambda rows_, end: first[graph[rows_]] + rows.column(end).take(pa.array(rows_)).to_numpy()
    same, ends = at(points, "up"), {end: at(parts, end) for end in ("up", "low")}
    layer = rows.column("layer").take(pa.array(points)).to_numpy()
    fresh = np.ones(len(points), bool)
    fresh[1:] = (own[1:] != own[:-1]) | (layer[1:] != layer[:-1])
    begin = np.maximum.accumulate(np.where(fresh, np.arange(len(points)), 0))
    slot = np.arange(len(points)) - begin
    slots = [slot]
    for step in range(sweeps * steps):
        near, far = ("low", "up") if step // steps % 2 == 0 else ("up", "low")
        top = np.zeros(len(points), np.int64)
        np.maximum.at(top, same, slot)
        many = np.bincount(ends[far], minlength=len(points))
        mean = np.bincount(ends[far], top[ends[near]], len(points)) / np.maximum(many, 1)
        moves = (layer % 2 == (step + 1) % 2) & (many[same] > 0)
        order = np.lexsort((np.where(moves, mean[same], slot), begin))
        slot = np.empty_like(slot)
        slot[order] = np.arange(len(points)) - begin
        slots.append(slot)
    found = np.stack([_crossed(of_parts, begin[ends["low"]], s[ends["up"]], s[ends["low"]], len(first)) for s in slots], axis=1)
    real = np.flatnonzero(rows.column("real").take(pa.array(points)).to_numpy())
    rank = np.stack(slots, axis=1)[real, found.argmin(axis=1)[own[real]]]
    nodes = rows.select(["graph_id", "id", "layer"]).take(pa.array(points[real])).combine_chunks()
    for n, values in (("rank", pa.array(rank)), ("crossings", pa.nulls(len(real), pa.list_(pa.int64())))):
        nodes = nodes.append_column(n, values)
    yield from nodes.to_batches()
    linked, one = np.unique(of_parts, return_index=True)
    counts = rows.select(["graph_id", "id", "layer"]).take(pa.array(parts[one])).combine_chunks()
    counts = counts.append_column("rank", pa.nulls(len(one), pa.int64()))
    yield from counts.append_column("crossings", pa.array(list(found[linked]), pa.list_(pa.int64()))).to_batches()


def _crossed(graph: np.ndarray, layer: np.ndarray, up: np.ndarray, low: np.ndarray, graphs: int) -> np.ndarray:
    """The crossings of each graph, of segments between the positions `up` and `low` of a layer. From the highest bit on,
    segments that agree in the bits above stand together, by `up`, and are dealt by the bit."""
    order = np.lexsort((low, up, layer))
    graph, layer, low = graph[order], layer[order], low[order].astype(np.int64)
    place, total = np.arange(len(low)), np.zeros(graphs)
    begin = np.searchsorted(layer, layer)
    for bit in range(int(low.max(initial=0)).bit_length() - 1, -1, -1):
        one = low >> bit & 1
        before = np.cumsum(one) - one
        before -= before[begin]
        total += np.bincount(graph, np.where(one, 0, before), graphs)
        ones = np.bincount(begin, one, len(low)).astype(np.int64)[begin]
        middle = begin + np.bincount(begin, minlength=len(low))[begin] - ones
        to = np.where(one, middle + before, place - before)
        low[to], begin[to] = low.copy(), np.where(one, middle, begin)
    return total.astype(np.int64)


def _by_steps(nodes: DataFrame, segments: DataFrame, sweeps: int, steps: int, folder: str) -> tuple[DataFrame, DataFrame]:
    """As `order_layers`, with a store for each step and graphs of any size."""
    points = write_out(_points(nodes, segments), f"{folder}/points")
    points = number_rows(points, ["graph_id", "layer"], ["id", "via"], "slot").withColumn("slots", F.array("slot"))
    for step in range(sweeps * steps):
        near, far = ("low", "up") if step // steps % 2 == 0 else ("up", "low")
        moves = F.col("layer") % 2 == (step + 1) % 2
        keyed = points.join(_means(segments, points, near, far), POINT, "left")
        keyed = keyed.withColumn("key", F.when(moves, F.col("mean")))
        keyed = keyed.withColumn("key", F.coalesce("key", F.col("slot").cast("double"))).drop("mean", "slot")
        keyed = write_out(keyed, f"{folder}/step-{step}")
        points = number_rows(keyed, ["graph_id", "layer"], ["key", "id", "via"], "slot").drop("key")
        points = points.withColumn("slots", F.concat("slots", F.array("slot")))
    points = write_out(points, f"{folder}/ordered")
    counts = write_out(_counts(segments, points, 1 + sweeps * steps), f"{folder}/counts")
    return _best(points.where("via = ''"), counts), counts


def _best(points: DataFrame, counts: DataFrame) -> DataFrame:
    """graph_id, id, layer and, as rank, the slot of the order with the fewest crossings."""
    best = counts.select("graph_id", (F.array_position("crossings", F.array_min("crossings"))).cast("int").alias("best"))
    rank = F.element_at("slots", F.coalesce("best", F.lit(1))).cast("bigint")
    return points.join(best, "graph_id", "left").select("graph_id", "id", "layer", rank.alias("rank"))


def _segments(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Parts of edges between one layer, `layer`, and the next: the points at the `up` and `low` end."""
    links = edges.select(F.col("from_node_id").alias("source"), F.col("to_node_id").alias("target"))
    source = nodes.select("graph_id", F.col("id").alias("source"), F.col("layer").alias("top"))
    target = nodes.select(F.col("graph_id").alias("other"), F.col("id").alias("target"), F.col("layer").alias("bottom"))
    spans = links.distinct().join(source, "source").join(target, "target").where("graph_id = other and top > bottom")
    spans = spans.withColumn("layer", F.explode(F.sequence("bottom", F.col("top") - 1)))
    starts, ends = F.col("layer") + 1 == F.col("top"), F.col("layer") == F.col("bottom")
    via = F.concat(F.lit(">"), "target")
    return spans.select(
        "graph_id",
        "layer",
        F.col("source").alias("up_id"),
        F.when(starts, "").otherwise(via).alias("up_via"),
        F.when(ends, F.col("target")).otherwise(F.col("source")).alias("low_id"),
        F.when(ends, "").otherwise(via).alias("low_via"),
    )


def _points(nodes: DataFrame, segments: DataFrame) -> DataFrame:
    """All points, with the number of points of their layer as `width`."""
    between = segments.where("low_via <> ''").select("graph_id", "layer", F.col("low_id").alias("id"), F.col("low_via").alias("via"))
    points = nodes.select("graph_id", "layer", "id", F.lit("").alias("via")).unionByName(between)
    return points.join(points.groupBy("graph_id", "layer").agg(F.count("*").alias("width")), ["graph_id", "layer"])


def _ends(points: DataFrame, end: str, *columns: Column) -> DataFrame:
    """Points named like the `up` or `low` end of segments, whose layer is that of the low end."""
    layer = F.col("layer") - (1 if end == "up" else 0)
    return points.select("graph_id", layer.alias("layer"), F.col("id").alias(f"{end}_id"), F.col("via").alias(f"{end}_via"), *columns)


def _means(segments: DataFrame, points: DataFrame, near: str, far: str) -> DataFrame:
    """The mean position of the `near` ends for every point that is a `far` end."""
    joined = segments.join(_ends(points, near, F.col("slot")), ["graph_id", "layer", f"{near}_id", f"{near}_via"])
    means = joined.groupBy("graph_id", "layer", f"{far}_id", f"{far}_via").agg((F.sum("slot").cast("double") / F.count("*")).alias("mean"))
    layer = F.col("layer") + (1 if far == "up" else 0)
    return means.select("graph_id", layer.alias("layer"), F.col(f"{far}_id").alias("id"), F.col(f"{far}_via").alias("via"), "mean")


def _counts(segments: DataFrame, points: DataFrame, orders: int) -> DataFrame:
    """graph_id and the crossings of its segments in each order."""
    for end, columns in (("up", [F.col("slots").alias("u")]), ("low", [F.col("slots").alias("l"), "width"])):
        segments = segments.join(_ends(points, end, *columns), ["graph_id", "layer", f"{end}_id", f"{end}_via"])
    sums, group = _sums(segments)
    sums = sums.withColumn("block", F.expr(f"u div {BLOCK}"))
    # Ones that start earlier: in earlier blocks, and earlier in the own one.
    blocks = sums.groupBy(*group, "block").agg(F.sum("ones").alias("ones"))
    blocks = blocks.select(*group, "block", F.sum("ones").over(_earlier(*group, "block")).alias("before"))
    sums = sums.withColumn("within", F.sum("ones").over(_earlier(*group, "block", "u"))).join(blocks, [*group, "block"])
    crossed = F.col("zeros") * (F.coalesce("before", F.lit(0)) + F.coalesce("within", F.lit(0)))
    return _by_graph(sums, crossed, orders)


def _earlier(*keys: str) -> W:
    return W.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(W.unboundedPreceding, -1)


def _sums(segments: DataFrame) -> tuple[DataFrame, list[str]]:
    """`ones` and `zeros` among the ends `l` of the segments that start at `u`, for each order and bit, and their group."""
    both = segments.select("graph_id", "layer", "width", F.posexplode(F.arrays_zip("u", "l")).alias("number", "at"))
    # So many bits tell the points of a layer; one bit for layers of one point, so that each graph has a row.
    bits = F.length(F.bin(F.col("width") - 1))
    ends = both.select("number", "graph_id", "layer", "at.u", "at.l", F.explode(F.sequence(F.lit(0), bits - 1)).alias("bit"))
    group = ["number", "graph_id", "layer", "bit", "above"]
    set_ = F.expr("shiftright(l, bit) & 1")
    sums = ends.groupBy("number", "graph_id", "layer", "bit", F.expr("shiftright(l, bit + 1)").alias("above"), "u").agg(
        F.sum(set_).alias("ones"), F.sum(1 - set_).alias("zeros")
    )
    return sums, group


def _by_graph(sums: DataFrame, crossed: Column, orders: int) -> DataFrame:
    """graph_id and the sums of `crossed` for each order."""
    of = [F.coalesce(F.sum(F.when(F.col("number") == n, crossed)), F.lit(0)).cast("bigint") for n in range(orders)]
    return sums.groupBy("graph_id").agg(F.array(*of).alias("crossings"))
