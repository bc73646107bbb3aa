from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from argweave.operators import layout
from argweave.operators.layout import assign_layers, place
from argweave.operators.lineage import write_out
from tests import seed
from tests.conftest import rows


def graph(spark, nodes, links):
    """Nodes as 'g:id', links as 'a>b'."""
    node_rows = [(int(n.split(":")[0]), n.split(":")[1]) for n in nodes.split()]
    link_rows = [tuple(link.split(">")) for link in links.split()]
    return (
        spark.createDataFrame(node_rows, "graph_id int, id string"),
        spark.createDataFrame(link_rows, "from_node_id string, to_node_id string"),
    )


def layers(spark, nodes, links):
    return {r.id: r.layer for r in assign_layers(*graph(spark, nodes, links)).collect()}


def test_seed_layers(seed_tables):
    got = {}
    for row in assign_layers(seed_tables.nodes, seed_tables.edges).collect():
        got.setdefault(row.layer, []).append(row.id)
    assert {layer: sorted(ids) for layer, ids in got.items()} == seed.LAYERS


def test_longest_path_decides(spark):
    assert layers(spark, "1:a 1:b 1:c 1:d", "b>a c>b c>a d>c d>a") == {"a": 0, "b": 1, "c": 2, "d": 3}


def test_parallel_links_count_once(spark):
    assert layers(spark, "1:a 1:b", "b>a b>a") == {"a": 0, "b": 1}


def test_nodes_without_links(spark):
    assert layers(spark, "1:a 2:b", "") == {"a": 0, "b": 0}


def test_nodes_of_a_cycle_share_a_layer_and_count_once(spark):
    got = layers(spark, "1:r 1:a 1:b 1:c 1:d 1:e", "a>r b>c c>b d>b d>r e>a")
    assert got == {"r": 0, "a": 1, "e": 2, "b": 0, "c": 0, "d": 1}


def test_only_cycles(spark):
    assert layers(spark, "1:a 1:b 1:x", "a>b b>a x>x") == {"a": 0, "b": 0, "x": 0}


def expected_layers(names, links):
    """Components by reachability, then the longest paths over them, by plain loops."""
    reach = {n: {n} for n in names}
    grown = True
    while grown:
        grown = False
        for a, b in links:
            if not reach[b] <= reach[a]:
                reach[a] |= reach[b]
                grown = True
    head = {n: min(m for m in reach[n] if n in reach[m]) for n in names}
    layer = dict.fromkeys(names, 0)
    for _ in names:
        for a, b in links:
            if head[a] != head[b]:
                high = max(layer[a], layer[b] + 1)
                layer.update({n: high for n in names if head[n] == head[a]})
    return layer


@pytest.mark.parametrize("seed_", [1, 2, 3])
def test_layers_of_random_graphs_with_cycles(spark, seed_):
    chance = random.Random(seed_)
    names = [f"n{k:02}" for k in range(26)]
    links = [tuple(chance.sample(names, 2)) for _ in range(30)]
    got = layers(spark, " ".join(f"1:{n}" for n in names), " ".join(f"{a}>{b}" for a, b in links))
    assert got == expected_layers(names, links)


@pytest.mark.parametrize("whole", [100_000, 10])
def test_layers_dealt_by_graph_equal_those_in_rounds(spark, monkeypatch, whole):
    """Flat and deep graphs, cycles, links into other graphs, of other graphs and to no node, and one id in two graphs."""
    monkeypatch.setattr(layout, "WHOLE", whole)
    chance, nodes, links = random.Random(5), [], []
    for g in range(1, 13):
        names = [f"{g}-{k}" for k in range(3 * g % 11 + 3)]
        nodes += [(g, n) for n in names]
        pairs = zip(names[1:], names) if g == 3 else (sorted(chance.sample(names, 2), reverse=g != 4) for _ in names)
        links += [(g, a, b) for a, b in pairs]
    nodes += [(5, "both"), (6, "both"), (7, "7-0"), (None, "none")]
    links += [(5, "both", "5-0"), (8, "8-0", "9-2"), (10, "11-0", "11-1"), (2, "2-0", "gone"), (12, "gone", "12-1"), (None, "1-0", "1-1"), (7, "7-1", "7-1")]
    rows_ = spark.createDataFrame(nodes, "graph_id int, id string")
    edges = spark.createDataFrame(links, "graph_id int, from_node_id string, to_node_id string")
    names = sorted({n for _, n in nodes} | {n for _, a, b in links for n in (a, b)})
    want = expected_layers(names, [(a, b) for _, a, b in links if a != b])
    got = rows(assign_layers(rows_, edges))
    assert sorted(got, key=str) == sorted([(g, n, want[n]) for g, n in nodes], key=str)
    placed = rows(layout.positions(rows_, edges), "graph_id", "layer", "id", "slot")
    order = sorted((g or 0, want[n], n) for g, n in nodes)
    slots = [sum(o[:2] == other[:2] for other in order[:i]) for i, o in enumerate(order)]
    assert sorted((g or 0, layer, n, slot) for g, layer, n, slot in placed) == [(*o, slot) for o, slot in zip(order, slots)]


def test_flat_graphs_take_no_rounds(spark, seed_tables, monkeypatch):
    written = []
    monkeypatch.setattr(layout, "write_out", lambda df, path: (written.append(path), write_out(df, path))[1])
    assert layout.positions(seed_tables.nodes, seed_tables.edges).count() == 27
    assert not [p for p in written if "/settle" in p or "/ranged" in p]


def test_wide_layers_are_numbered_over_many_tasks(spark, seed_tables, monkeypatch):
    layers = assign_layers(seed_tables.nodes, seed_tables.edges)
    want = sorted(rows(place(layers)))
    monkeypatch.setattr(layout, "WHOLE", 6)
    assert sorted(rows(place(layers))) == want


def test_two_cycles_with_a_bridge(spark):
    got = layers(spark, "1:a 1:b 1:m 1:n 1:x 1:y 1:t", "a>b b>a a>m m>n n>x x>y y>x y>t")
    assert got == {"t": 0, "x": 1, "y": 1, "n": 2, "m": 3, "a": 4, "b": 4}


def test_a_chain_of_2000_nodes_takes_few_rounds(spark, monkeypatch):
    written = []
    monkeypatch.setattr(layout, "write_out", lambda df, path: (written.append(path), write_out(df, path))[1])
    name = F.format_string("n%05d", "id")
    nodes = spark.range(2000).select(F.lit(1).alias("graph_id"), name.alias("id"))
    links = spark.range(1, 2000).select(name.alias("from_node_id"), F.format_string("n%05d", F.col("id") - 1).alias("to_node_id"))
    got = {r.id: r.layer for r in assign_layers(nodes, links).collect()}
    assert got == {f"n{k:05}": k for k in range(2000)}
    assert len([p for p in written if "/nodes-" in p]) <= 15


def test_long_chain(spark):
    names = [f"n{i}" for i in range(12)]
    links = " ".join(f"{b}>{a}" for a, b in zip(names, names[1:]))
    assert layers(spark, " ".join(f"1:{n}" for n in names), links) == {n: i for i, n in enumerate(names)}


def test_links_between_graphs_are_followed(spark):
    nodes, links = graph(spark, "1:a 2:b", "b>a")
    assert sorted(rows(assign_layers(nodes, links))) == [(1, "a", 0), (2, "b", 1)]


def test_positions(seed_tables):
    got = {r.id: r for r in place(assign_layers(seed_tables.nodes, seed_tables.edges)).collect()}
    assert (got["R1"].x, got["R1"].y) == (24, 24)
    assert (got["C1"].x, got["C1"].y) == (354, 24)
    assert (got["C2"].x, got["C2"].y) == (354, 166)
    assert (got["E1"].slot, got["O8"].slot, got["P6"].slot) == (0, 6, 13)
    assert (got["O7"].x, got["O7"].y) == (24 + 3 * 330, 24 + 6 * 142)
    assert len({(r.x, r.y) for r in got.values()}) == 27


def test_boxes_of_a_very_wide_layer(spark):
    layers = spark.range(5000).select(F.lit(1).alias("graph_id"), F.format_string("n%05d", "id").alias("id"), F.lit(2).alias("layer"))
    got = place(layers.repartition(7)).orderBy("id")
    assert [r.slot for r in got.collect()] == list(range(5000))
    assert [dict(got.dtypes)[c] for c in ("layer", "slot", "x", "y")] == ["int", "bigint", "int", "bigint"]


def test_nodes_of_a_cycle_stand_in_one_layer(spark):
    nodes, links = graph(spark, "1:a 1:b 1:x 1:y 2:c 2:d", "a>b b>a y>x a>x c>d d>c")
    got = place(assign_layers(nodes, links))
    assert sorted(rows(got, "graph_id", "id", "layer", "slot", "x", "y")) == [
        (1, "a", 1, 0, 354, 24), (1, "b", 1, 1, 354, 166), (1, "x", 0, 0, 24, 24), (1, "y", 1, 2, 354, 308),
        (2, "c", 0, 0, 24, 24), (2, "d", 0, 1, 24, 166),
    ]
