from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from argweave.operators import ordering
from argweave.operators.layout import assign_layers, place
from argweave.operators.ordering import order_layers
from tests.test_layout import graph


def ordered(spark, nodes, links, **settings):
    frames = graph(spark, nodes, links)
    ranked, counts = order_layers(assign_layers(*frames), frames[1], **settings)
    return ranked, {r.graph_id: r.crossings for r in counts.collect()}


def by_rank(ranked, layer):
    return "".join(r.id for r in ranked.where(F.col("layer") == layer).orderBy("rank").collect())


def plain(layer, links, sweeps, steps):
    """Crossings of one graph by id and after every step, from all pairs of segments."""
    points, segments = {(layer[n], n, "") for n in layer}, []
    for a, b in sorted(set(links)):
        at = {layer[a]: (layer[a], a, ""), layer[b]: (layer[b], b, "")}
        at.update({k: (k, a, f">{b}") for k in range(layer[b] + 1, layer[a])})
        points |= set(at.values())
        segments += [(at[k + 1], at[k]) for k in range(layer[b], layer[a])]

    def slots(key):
        rows = {}
        for point in sorted(points, key=lambda p: (key[p], *p[1:])):
            rows.setdefault(point[0], []).append(point)
        return {point: k for row in rows.values() for k, point in enumerate(row)}

    def crossings(slot):
        pairs = (p for p in combinations(segments, 2) if p[0][1][0] == p[1][1][0])
        return sum((slot[a[0]] - slot[b[0]]) * (slot[a[1]] - slot[b[1]]) < 0 for a, b in pairs)

    slot = slots(dict.fromkeys(points, 0))
    found = [crossings(slot)]
    for step in range(sweeps * steps):
        low = step // steps % 2 == 0
        key = dict(slot)
        for point in points:
            near = [slot[l if low else u] for u, l in segments if (u if low else l) == point]
            if near and point[0] % 2 == (step + 1) % 2:
                key[point] = sum(near) / len(near)
        slot = slots(key)
        found.append(crossings(slot))
    return found


def test_two_crossed_edges_are_uncrossed(spark):
    ranked, counts = ordered(spark, "1:a 1:b 1:c 1:d 1:r", "a>r b>r c>b d>a")
    assert counts[1][0] == 1 and min(counts[1]) == 0
    assert (by_rank(ranked, 1), by_rank(ranked, 2)) in {("ab", "dc"), ("ba", "cd")}


def test_boxes_follow_the_order(spark):
    ranked, _ = ordered(spark, "1:a 1:b 1:c 1:d 1:r", "a>r b>r c>b d>a")
    y = {r.id: r.y for r in place(ranked, "rank").collect()}
    assert (y["a"] < y["b"]) == (y["d"] < y["c"]) and sorted(y.values()) == [24, 24, 24, 166, 166]


@pytest.mark.parametrize(("seed_", "block"), [(1, 2), (2, 4096)])
def test_random_graphs_equal_plain_loops(spark, monkeypatch, seed_, block):
    monkeypatch.setattr(ordering, "BLOCK", block)
    chance = random.Random(seed_)
    names = [f"n{k:02}" for k in chance.sample(range(40), 24)]
    links = [(names[b], names[a]) for a, b in (sorted(chance.sample(range(24), 2)) for _ in range(45))]
    nodes, edges = " ".join(f"1:{n}" for n in names), " ".join(f"{a}>{b}" for a, b in links)
    frames = graph(spark, nodes, edges)
    layers = assign_layers(*frames)
    layer = {r.id: r.layer for r in layers.collect()}
    ranked, counts = order_layers(layers, frames[1], sweeps=2, steps=3)
    got = counts.collect()[0].crossings
    assert got == plain(layer, links, 2, 3)
    assert min(got) < got[0]
    assert ranked.count() == 24


def test_long_edges_keep_their_lane(spark):
    # a>r passes layers 1 and 2 beside the chain z>y>x>r, and is told from b>r.
    ranked, counts = ordered(spark, "1:r 1:x 1:y 1:z 1:a 1:b", "x>r y>x z>y a>z a>r b>z b>r")
    assert counts[1][0] == plain({"r": 0, "x": 1, "y": 2, "z": 3, "a": 4, "b": 4}, [("x", "r"), ("y", "x"), ("z", "y"), ("a", "z"), ("a", "r"), ("b", "z"), ("b", "r")], 0, 1)[0]
    assert ranked.count() == 6


def test_graphs_do_not_mix_and_odd_edges_are_left_out(spark):
    # Between graphs, to nowhere, from NULL, within a cycle's layer, to itself, and twice.
    nodes, links = graph(spark, "1:a 1:b 2:c 2:d 2:e 3:f", "b>a b>a b>c d>c c>d a>zz e>c f>f")
    links = links.unionByName(spark.createDataFrame([(None, "a")], "from_node_id string, to_node_id string"))
    ranked, counts = order_layers(assign_layers(nodes, links), links)
    assert {r.graph_id: set(r.crossings) for r in counts.collect()} == {1: {0}, 2: {0}}
    assert sorted((r.graph_id, r.id) for r in ranked.collect()) == [(1, "a"), (1, "b"), (2, "c"), (2, "d"), (2, "e"), (3, "f")]


def test_no_rows(spark):
    nodes, links = graph(spark, "1:a", "")
    ranked, counts = order_layers(assign_layers(nodes.where("false"), links), links)
    assert ranked.collect() == [] and counts.collect() == []


def test_a_node_with_most_edges_makes_no_pairs(spark):
    # 3,000 nodes hang on one of two nodes each, dealt so that half of all pairs across cross.
    name = F.format_string("n%05d", "id")
    nodes = spark.range(3000).select(F.lit(1).alias("graph_id"), name.alias("id"))
    nodes = nodes.unionByName(spark.createDataFrame([(1, "a"), (1, "b")], "graph_id int, id string"))
    links = spark.range(3000).select(name.alias("from_node_id"), F.when(F.col("id") % 3 == 0, "b").otherwise("a").alias("to_node_id"))
    layers = assign_layers(nodes, links)
    ranked, counts = order_layers(layers, links, sweeps=1, steps=1)
    # Every third goes to b; it crosses the edges to a that start later.
    assert counts.collect()[0].crossings == [sum(2000 - 2 * k for k in range(1000)), 0]
    assert [r.id for r in ranked.where("layer = 1").orderBy("rank").limit(2).collect()] == ["n00001", "n00002"]


@pytest.mark.parametrize("whole", [0, 50, 100_000])
def test_large_graphs_are_ordered_as_small_ones(spark, monkeypatch, whole):
    stored = []
    write = ordering.write_out
    monkeypatch.setattr(ordering, "write_out", lambda df, path: stored.append(path.rsplit("/", 1)[1]) or write(df, path))
    monkeypatch.setattr(ordering, "WHOLE", whole)
    chance = random.Random(3)
    nodes, edges, plainly, rows = [], [], {}, {1: 12, 2: 30}
    for g, size in rows.items():
        names = [f"{'xy'[g - 1]}{k:02}" for k in range(size)]
        links = [(names[b], names[a]) for a, b in (sorted(chance.sample(range(size), 2)) for _ in range(2 * size))]
        nodes += [f"{g}:{n}" for n in names]
        edges += [f"{a}>{b}" for a, b in links]
        plainly[g] = links
    frames = graph(spark, " ".join(nodes), " ".join(edges))
    layers = assign_layers(*frames)
    layer = {r.id: r.layer for r in layers.collect()}
    ranked, counts = order_layers(layers, frames[1])
    got = {r.graph_id: r.crossings for r in counts.collect()}
    assert got == {g: plain({n: k for n, k in layer.items() if n[0] == "xy"[g - 1]}, links, 2, 3) for g, links in plainly.items()}
    assert ranked.count() == sum(rows.values())
    # A store for each step is for large graphs only.
    assert any(name.startswith("step") for name in stored) == (whole < 100_000)


def test_small_graphs_are_counted_in_place(spark, monkeypatch):
    """No row for each order, bit and segment, and no store of steps or counts; whole graphs in tables of any size."""
    stored = []
    write = ordering.write_out
    monkeypatch.setattr(ordering, "write_out", lambda df, path: stored.append(path.rsplit("/", 1)[1]) or write(df, path))
    monkeypatch.setattr(ordering, "DEAL", 10)
    chance, nodes, edges, plainly = random.Random(9), [], [], {}
    for g in range(6):
        names = [f"g{g}n{k:02}" for k in range(8)]
        plainly[g] = [(names[b], names[a]) for a, b in (sorted(chance.sample(range(8), 2)) for _ in range(14))]
        nodes += [f"{g}:{n}" for n in names]
        edges += [f"{a}>{b}" for a, b in plainly[g]]
    frames = graph(spark, " ".join(nodes), " ".join(edges))
    layers = assign_layers(*frames)
    ranked, counts = order_layers(layers, frames[1])
    assert stored == ["nodes", "segments", "large"]
    assert "Generate" not in counts._jdf.queryExecution().executedPlan().toString()
    layer = {r.id: r.layer for r in layers.collect()}
    got = {r.graph_id: r.crossings for r in counts.collect()}
    assert got == {g: plain({n: k for n, k in layer.items() if n.startswith(f"g{g}n")}, links, 2, 3) for g, links in plainly.items()}
    assert ranked.count() == 48


def test_crossings_are_those_of_all_pairs():
    chance = np.random.default_rng(4)
    layer = np.sort(chance.integers(0, 5, 300)) * 7
    up, low = chance.integers(0, 20, 300), chance.integers(0, 37, 300)
    pairs = (layer[:, None] == layer) & (up[:, None] < up) & (low[:, None] > low)
    graph = layer // 14
    order = chance.permutation(300)
    got = ordering._crossed(graph[order], layer[order], up[order], low[order], 4)
    assert got.tolist() == [int(pairs[graph == g].sum()) for g in range(4)]
