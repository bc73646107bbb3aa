"""Every operator as a query over the whole of the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from argweave.functions import display, fields
from argweave.operators import cascade, details, layout, lookup, ordering, overview, quality, views
from argweave.operators import documents as docs
from argweave.operators.lineage import run_folder, write_out
from argweave.plans.defects import defective_edges, defective_graphs, defective_nodes, with_defects
from argweave.schemas import DOCUMENT, GraphTables
from argweave.sources import documents as document_files
from argweave.sources import tables as stores
from argweave.sources import versions
from argweave.sources.corpus import (
    commerce,
    commerce_edges,
    commerce_graphs,
    commerce_nodes,
    dialogue,
    dialogue_edges,
    dialogue_graphs,
    dialogue_nodes,
    table,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _stored(tables: GraphTables) -> GraphTables:
    """Tables written once to the shared folder, for queries that read them several times."""
    spark = tables.graphs.sparkSession
    path, frames = run_folder(spark), []
    for name, rows in tables._asdict().items():
        frames.append(write_out(rows, f"{path}/{name}"))
    return GraphTables(*frames)


def _doubles(rows: DataFrame) -> DataFrame:
    """Decimals as doubles, for comparison outside Spark."""
    decimals = [f.name for f in rows.schema.fields if f.dataType.typeName() == "decimal"]
    return rows.withColumns({name: F.col(name).cast("double") for name in decimals})


def _flat_nodes(nodes: DataFrame, *extra: str) -> DataFrame:
    evidence = F.col("evidence")
    return _doubles(nodes).select(
        "id",
        "graph_id",
        "kind",
        "title",
        "body_text",
        "category",
        F.array_join("tags", "|").alias("tags"),
        "prior",
        "weight",
        "confidence",
        "importance",
        evidence["type"].alias("evidence_type"),
        evidence["score"].alias("evidence_score"),
        evidence["rationale"].alias("evidence_rationale"),
        *extra,
    )


# Scans


@query
def graphs_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commerce_graphs(spark, sf_dir).select(*lookup.CATALOG)


@query
def nodes_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.node_rows(commerce_nodes(spark, sf_dir))


@query
def edges_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.edge_rows(commerce_edges(spark, sf_dir))


@query
def nodes_full_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat_nodes(commerce_nodes(spark, sf_dir))


@query
def edges_full_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doubles(commerce_edges(spark, sf_dir))


@query
def dialogue_graphs_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue_graphs(spark, sf_dir).select(*lookup.CATALOG)


@query
def dialogue_nodes_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat_nodes(dialogue_nodes(spark, sf_dir))


@query
def dialogue_edges_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doubles(dialogue_edges(spark, sf_dir))


# Lookup


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per order for its customer's graph, and one per supplier, for which there is no graph."""
    customers = table(spark, sf_dir, "orders").select(F.concat(F.lit("customer-"), "o_custkey").alias("slug"))
    suppliers = table(spark, sf_dir, "supplier").select(F.concat(F.lit("supplier-"), "s_suppkey").alias("slug"))
    return customers.unionByName(suppliers)


def _selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's latest order, and for each supplier a node that does not exist."""
    latest = (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_custkey").cast("int").alias("graph_id"))
        .agg(F.concat(F.lit("C"), F.max("o_orderkey")).alias("node_id"))
    )
    unknown = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").cast("int").alias("graph_id"), F.concat(F.lit("S"), "s_suppkey").alias("node_id")
    )
    return latest.unionByName(unknown)


@query
def graph_by_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.graphs_by_slug(commerce_graphs(spark, sf_dir), _requests(spark, sf_dir))


@query
def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lookup.graphs_by_slug(commerce_graphs(spark, sf_dir), _requests(spark, sf_dir))
    return lookup.node_rows(lookup.children(commerce_nodes(spark, sf_dir), found))


@query
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lookup.graphs_by_slug(commerce_graphs(spark, sf_dir), _requests(spark, sf_dir))
    return lookup.edge_rows(lookup.children(commerce_edges(spark, sf_dir), found))


@query
def single_graph_per_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.at_most_one(commerce_graphs(spark, sf_dir))


@query
def batch_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = commerce(spark, sf_dir)
    return lookup.lookup(overview.overview(tables), _requests(spark, sf_dir))


@query
def strict_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "orders").select(F.concat(F.lit("customer-"), "o_custkey").alias("slug"))
    return lookup.strict_lookup(commerce_graphs(spark, sf_dir).select("slug", "title", "description"), known)


@query
def node_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    picked = lookup.pick_nodes(commerce_nodes(spark, sf_dir), _selection(spark, sf_dir))
    return picked.select("graph_id", "id", "kind", "title")


# Documents


def _listing(
    documents: DataFrame, node: Callable[[Column], list], edge: Callable[[Column], list], *extra: str
) -> DataFrame:
    """Documents as flat text: every list as one string, in list order."""

    def text(items: str, parts: Callable[[Column], list]) -> Column:
        return F.array_join(F.transform(items, lambda item: F.concat_ws(":", *parts(item))), "|")

    return documents.select(
        "slug",
        "part",
        "title",
        "description",
        F.size("nodes").alias("node_count"),
        F.size("edges").alias("edge_count"),
        text("nodes", node).alias("node_list"),
        text("edges", edge).alias("edge_list"),
        *extra,
    )


def _narrow_listing(documents: DataFrame, *extra: str) -> DataFrame:
    return _listing(
        documents,
        lambda n: [n["id"], n["kind"], n["title"], n["bodyText"]],
        lambda e: [e["id"], e["from"], e["to"], e["kind"]],
        *extra,
    )


def _full_listing(documents: DataFrame) -> DataFrame:
    def metric(value: Column) -> Column:
        return F.coalesce(display.format_metric(value), F.lit("-"))

    return _listing(
        documents,
        lambda n: [
            n["id"],
            F.coalesce(n["category"], F.lit("-")),
            F.array_join(n["tags"], ","),
            metric(n["prior"]),
            metric(n["confidence"]),
            metric(n["importance"]),
            metric(n["evidence"]["score"]),
        ],
        lambda e: [e["id"], e["from"], e["to"], F.round(e["weight"] * 100000).cast("bigint")],
    )


@query
def graph_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _narrow_listing(docs.documents(_stored(docs.narrow_tables(commerce(spark, sf_dir)))))


@query
def document_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in pages of 16 nodes and 16 edges."""
    return _narrow_listing(docs.documents(_stored(docs.narrow_tables(commerce(spark, sf_dir))), page=16))


@query
def requested_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slug in, document or not-found out."""
    tables = _stored(docs.narrow_tables(commerce(spark, sf_dir)))
    return _narrow_listing(docs.get_documents(tables, _requests(spark, sf_dir)), "found")


@query
def graph_documents_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _full_listing(docs.stored_documents(_stored(commerce(spark, sf_dir)), full=True))


@query
def dialogue_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _narrow_listing(docs.narrow(docs.documents(_stored(dialogue(spark, sf_dir)), full=True)))


def _reloaded(spark: SparkSession, sf_dir: str) -> GraphTables:
    """Documents written as JSON files, and read back into tables."""
    path = run_folder(spark)
    document_files.write_graphs(_stored(commerce(spark, sf_dir)), path, compression="gzip")
    return document_files.load(spark, path, use_documents=True)


@query
def document_nodes_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat_nodes(_reloaded(spark, sf_dir).nodes, "pos")


@query
def document_edges_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doubles(_reloaded(spark, sf_dir).edges).select(
        "id", "graph_id", "from_node_id", "to_node_id", "kind", "weight", "pos"
    )


@query
def document_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document written twice and once cut off: the lines left out, and the keys that occur twice."""
    path = run_folder(spark)
    text = docs.to_json(docs.documents(_stored(dialogue(spark, sf_dir)))).select("document")
    cut = text.select(F.expr("substr(document, 1, length(document) - 1)").alias("document"))
    text.unionByName(text).unionByName(cut).write.text(path)
    tables = document_files.load(spark, path, use_documents=True)
    slugs = quality.duplicate_keys(tables.graphs, "graphs", "slug")
    ids = quality.duplicate_keys(tables.nodes, "nodes")
    return quality.summary(document_files.document_misfits(spark, path).unionByName(slugs).unionByName(ids))


@query
def document_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as JSON text and parsed again."""
    text = docs.to_json(docs.documents(_stored(dialogue(spark, sf_dir))))
    parsed = text.select("slug", "part", F.from_json("document", DOCUMENT).alias("d"))
    return _narrow_listing(parsed.select("slug", "part", "d.title", "d.description", "d.nodes", "d.edges"))


# Counts


@query
def node_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overview.count_rows(commerce_nodes(spark, sf_dir), "node_count")


@query
def edge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overview.count_rows(commerce_edges(spark, sf_dir), "edge_count")


@query
def graph_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overview.overview(commerce(spark, sf_dir))


@query
def dialogue_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overview.overview(dialogue(spark, sf_dir))


# Scalar functions


@query
def kind_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = commerce(spark, sf_dir)
    both = tables.nodes.select("id", "kind").unionByName(tables.edges.select("id", "kind"))
    return both.select("id", display.format_kind(F.col("kind")).alias("label"))


@query
def node_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commerce_nodes(spark, sf_dir).select("id", display.node_symbol(F.col("kind")).alias("symbol"))


@query
def display_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = commerce_nodes(spark, sf_dir).unionByName(dialogue_nodes(spark, sf_dir))
    return nodes.select("id", display.display_title(F.col("title")).alias("display_title"))


@query
def node_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("kind")
    value = display.metric_value(kind, F.col("importance"), F.col("confidence"), F.col("evidence"))
    return commerce_nodes(spark, sf_dir).select(
        "id", display.metric_label(kind).alias("metric_label"), value.alias("metric_value")
    )


@query
def price_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed-decimal text of three-decimal values, where the exact binary value decides the rounding."""
    lines = table(spark, sf_dir, "lineitem")
    value = F.col("l_extendedprice") / 10
    return lines.groupBy(display.format_metric(value).alias("metric")).agg(F.count("*").alias("lines"))


@query
def class_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = commerce(spark, sf_dir)
    kind = F.col("kind")
    nodes = tables.nodes.select("id", display.class_name("node", kind).alias("class_name"))
    return nodes.unionByName(tables.edges.select("id", display.class_name("edge", kind).alias("class_name")))


@query
def evidence_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence as JSON text, and its fields read from the text."""
    parsed = fields.parse_evidence(F.to_json("evidence"))
    nodes = commerce_nodes(spark, sf_dir)
    return nodes.select("id", parsed.alias("e")).select(
        "id", F.col("e.type").alias("type"), F.col("e.score").alias("score"), F.col("e.rationale").alias("rationale")
    )


@query
def column_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a load fills in."""
    nodes = fields.with_defaults(commerce_nodes(spark, sf_dir))
    return nodes.select(
        "id",
        F.size("tags").alias("tag_count"),
        F.to_json("attributes").alias("attributes"),
        (F.col("created_at") == F.current_timestamp()).alias("created_now"),
        (F.col("updated_at") == F.current_timestamp()).alias("updated_now"),
    )


@query
def offset_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates written with an offset of -04, read as instants."""
    text = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("-04"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.unix_micros(fields.parse_timestamp(text)).alias("epoch_us")
    )


# Views


@query
def flow_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.flow_nodes(commerce_nodes(spark, sf_dir))


@query
def flow_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.flow_edges(commerce_edges(spark, sf_dir))


@query
def dialogue_flow_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.flow_nodes(dialogue_nodes(spark, sf_dir))


@query
def selected_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = commerce_nodes(spark, sf_dir).select("graph_id", "id")
    return views.mark_selected(nodes, _selection(spark, sf_dir))


@query
def node_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.node_cards(views.flow_nodes(commerce_nodes(spark, sf_dir)))


@query
def node_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return details.node_headers(commerce_nodes(spark, sf_dir))


@query
def node_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return details.node_tags(commerce_nodes(spark, sf_dir))


@query
def node_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return details.node_details(commerce_nodes(spark, sf_dir))


@query
def dialogue_node_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return details.node_details(dialogue_nodes(spark, sf_dir))


@query
def attribute_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many nodes of each graph show each attribute."""
    shown = details.node_details(commerce_nodes(spark, sf_dir))
    return shown.groupBy("graph_id", "label").agg(F.count("*").alias("nodes"))


# Integrity rules


def _defective(spark: SparkSession, sf_dir: str) -> GraphTables:
    return with_defects(commerce(spark, sf_dir))


def _edge_rule(spark: SparkSession, sf_dir: str, rule: str) -> DataFrame:
    edges = defective_edges(commerce_edges(spark, sf_dir))
    return quality.check_rows(edges, "edges", only=[rule])


def _node_rules(spark: SparkSession, sf_dir: str, *rules: str) -> DataFrame:
    return quality.check_rows(defective_nodes(commerce_nodes(spark, sf_dir)), "nodes", only=rules)


@query
def violations_edge_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edge_rule(spark, sf_dir, "ck_edges_confidence")


@query
def violations_edge_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edge_rule(spark, sf_dir, "ck_edges_weight")


@query
def violations_edge_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edge_rule(spark, sf_dir, "ck_edges_kind")


@query
def violations_self_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edge_rule(spark, sf_dir, "ck_edges_not_self")


@query
def violations_polarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edge_rule(spark, sf_dir, "ck_edges_polarity")


@query
def violations_node_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = (f"ck_nodes_{name}" for name in ("prior", "weight", "confidence", "importance"))
    return _node_rules(spark, sf_dir, *ranges)


@query
def violations_node_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _node_rules(spark, sf_dir, "ck_nodes_kind")


@query
def violations_not_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = _defective(spark, sf_dir)
    rows = [quality.check_rows(rows, name, only=[f"{name}_not_null"]) for name, rows in tables._asdict().items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query
def violations_primary_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = _defective(spark, sf_dir)
    rows = [quality.duplicate_keys(rows, name) for name, rows in tables._asdict().items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query
def violations_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.duplicate_keys(defective_graphs(commerce_graphs(spark, sf_dir)), "graphs", "slug")


@query
def violations_edge_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = _defective(spark, sf_dir)
    return quality.dangling(tables.edges, "edges", "from_node_id", tables.nodes)


@query
def violations_edge_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = _defective(spark, sf_dir)
    return quality.dangling(tables.edges, "edges", "to_node_id", tables.nodes)


@query
def violations_edge_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = defective_edges(commerce_edges(spark, sf_dir))
    return quality.dangling(edges, "edges", "graph_id", defective_graphs(commerce_graphs(spark, sf_dir)))


@query
def violations_node_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = defective_nodes(commerce_nodes(spark, sf_dir))
    return quality.dangling(nodes, "nodes", "graph_id", defective_graphs(commerce_graphs(spark, sf_dir)))


def _ruled(tables: GraphTables) -> GraphTables:
    """The tables as far as rules look at them: of texts that no key or domain is in, whether they are there."""
    texts = {"graphs": ["title", "description"], "nodes": ["title", "body_text", "category"], "edges": ["rationale"]}
    present = lambda names: {name: F.when(F.col(name).isNotNull(), "") for name in names}
    return GraphTables(*(rows.withColumns(present(texts[name])) for name, rows in tables._asdict().items()))


@query
def violations_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.summary(quality.violations(_stored(_ruled(_defective(spark, sf_dir)))))


@query
def violations_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sound tables give no row."""
    return quality.violations(_stored(dialogue(spark, sf_dir)))


@query
def violations_clean_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each rule, with zero where sound tables break none."""
    return quality.counts(quality.violations(_stored(dialogue(spark, sf_dir))))


@query
def violations_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.counts(quality.violations(_stored(_ruled(_defective(spark, sf_dir)))))


# Deletes


def _survivors(tables: GraphTables) -> DataFrame:
    rows = [
        rows.select(F.lit(name).alias("table"), F.col("id").cast("string").alias("id"))
        for name, rows in tables._asdict().items()
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def _keys_of(tables: GraphTables) -> GraphTables:
    """The columns that a delete is decided on. Nodes are stored, as a delete reads them twice; edges it reads once."""
    nodes = write_out(tables.nodes.select("id", "graph_id", "kind"), f"{run_folder(tables.nodes.sparkSession)}/nodes")
    return GraphTables(
        tables.graphs.select("id", "description"), nodes, tables.edges.select("id", "graph_id", "from_node_id", "to_node_id")
    )


@query
def cascade_delete_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = _keys_of(commerce(spark, sf_dir))
    doomed = tables.graphs.where(F.col("description") == "BUILDING")
    return _survivors(cascade.delete_graphs(tables, doomed))


@query
def cascade_delete_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = _keys_of(commerce(spark, sf_dir))
    doomed = tables.nodes.where(F.col("kind") == "counter")
    return _survivors(cascade.delete_nodes(tables, doomed))


# Loads


@query
def bulk_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load first, apply the rules afterwards."""
    return quality.summary(stores.bulk_load(_defective(spark, sf_dir), run_folder(spark)))


@query
def loaded_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = run_folder(spark)
    tables = dialogue(spark, sf_dir)
    stores.bulk_load(tables, path)
    return overview.overview(document_files.load(spark, path))


@query
def typed_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loosely typed node rows in their types: tags as text arrays, evidence as JSON, metrics as text."""
    return _flat_nodes(stores.typed(_loose_nodes(spark, sf_dir), "nodes"))


@query
def typed_misfits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root rows with a value that does not fit in every column of another type than text."""
    loose = _loose_nodes(spark, sf_dir)
    bad = {
        "graph_id": "one",
        "tags": "abc",
        "prior": "high",
        "weight": "-10.5",
        "confidence": "?",
        "importance": "10.5",
        "evidence": '{"type": "video", "score": "high"}',
        "attributes": "not json",
        "created_at": "garbage",
        "updated_at": "2024-13-01",
    }
    root = F.col("kind") == "root"
    given = {n: F.when(root, v).otherwise(F.col(n) if n in loose.columns else None) for n, v in bad.items()}
    return stores.misfits(loose.withColumns(given), "nodes")


def _loose_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = commerce_nodes(spark, sf_dir)
    text = {name: F.col(name).cast("string") for name in ("graph_id", "prior", "weight", "confidence", "importance")}
    tags = F.concat(F.lit("{"), F.array_join("tags", ","), F.lit("}"))
    return nodes.withColumns({**text, "tags": tags, "evidence": F.to_json("evidence")})


# Layout


def _layers(tables: GraphTables) -> DataFrame:
    return layout.assign_layers(tables.nodes, tables.edges)


def _positions(tables: GraphTables) -> DataFrame:
    return layout.positions(tables.nodes, tables.edges)


@query
def layer_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _layers(commerce(spark, sf_dir))


@query
def layout_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _positions(commerce(spark, sf_dir))


@query
def dialogue_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _positions(dialogue(spark, sf_dir))


@query
def flow_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drawn nodes of all conversations, placed."""
    tables = dialogue(spark, sf_dir)
    positions = _positions(tables)
    return layout.place_flow_nodes(views.flow_nodes(tables.nodes), positions)


@query
def drawn_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document files to drawn graphs: placed nodes and edges, told apart by `element`."""
    tables = _reloaded(spark, sf_dir)
    nodes = layout.place_flow_nodes(views.flow_nodes(tables.nodes), _positions(tables))
    drawn = [rows.withColumn("element", F.lit(name)) for name, rows in (("node", nodes), ("edge", views.flow_edges(tables.edges)))]
    return drawn[0].unionByName(drawn[1], allowMissingColumns=True)


@query
def cyclic_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations whose first turn answers the last one: all turns are on one cycle and share a layer."""
    return _ring_layers(spark, sf_dir)


@query
def cyclic_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node has a place, on the ring too."""
    return layout.place(_ring_layers(spark, sf_dir), store=False)


def _ring_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = dialogue(spark, sf_dir)
    last = tables.nodes.groupBy("graph_id").agg(F.count("*").alias("turns")).where("turns > 1")
    back = last.select(
        F.concat_ws("-", F.concat(F.lit("T"), "graph_id"), F.lit(0)).alias("from_node_id"),
        F.concat_ws("-", F.concat(F.lit("T"), "graph_id"), F.col("turns") - 1).alias("to_node_id"),
    )
    ends = tables.edges.select("from_node_id", "to_node_id")
    return layout.assign_layers(tables.nodes, ends.unionByName(back))


@query
def tangled_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations whose turn 2 also answers turn 4: later turns lead into that cycle, earlier ones follow from it."""
    tables = dialogue(spark, sf_dir)
    fourth = tables.nodes.where(F.col("id").endswith("-4"))
    turn = F.concat_ws("-", F.concat(F.lit("T"), "graph_id"), F.lit(2))
    back = fourth.select(turn.alias("from_node_id"), F.col("id").alias("to_node_id"))
    ends = tables.edges.select("from_node_id", "to_node_id")
    return layout.assign_layers(tables.nodes, ends.unionByName(back))


@query
def layer_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crossings of every graph with its layers by id and as ordered, and the step that brought the fewest."""
    tables = commerce(spark, sf_dir)
    return _crossings(ordering.order_layers(_layers(tables), tables.edges)[1])


@query
def ordered_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = commerce(spark, sf_dir)
    return layout.place(ordering.order_layers(_layers(tables), tables.edges)[0], "rank")


@query
def answer_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for conversations whose turns also answer the turn of half their number, over many layers."""
    tables = dialogue(spark, sf_dir)
    turn, conv = F.col("turn"), F.col("conv_id")
    named = lambda number: F.concat_ws("-", F.concat(F.lit("T"), conv), number)
    far = table(spark, sf_dir, "conversations").where(turn > 0)
    far = far.select(named(turn).alias("from_node_id"), named(F.expr("turn div 2")).alias("to_node_id"))
    links = tables.edges.select("from_node_id", "to_node_id").unionByName(far)
    return _crossings(ordering.order_layers(layout.assign_layers(tables.nodes, links), links)[1])


def _crossings(counts: DataFrame) -> DataFrame:
    fewest = F.array_min("crossings")
    step = F.array_position("crossings", fewest) - 1
    return counts.select("graph_id", F.col("crossings")[0].alias("by_id"), fewest.alias("ordered"), step.alias("step"))


# Stores that grow, files over many lines, tables in buckets


def _conversations(tables: GraphTables, condition: Column) -> GraphTables:
    """The graphs of a condition on `graph_id`, with their nodes and edges."""
    graphs = tables.graphs.withColumn("graph_id", F.col("id")).where(condition).drop("graph_id")
    return GraphTables(graphs, tables.nodes.where(condition), tables.edges.where(condition))


@query
def appended_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sound batches and two unsound ones: the rows of each table after every batch, and the violations of refused ones."""
    tables, path = _stored(dialogue(spark, sf_dir)), run_folder(spark)
    versions.create(spark, path)
    odd = F.col("graph_id") % 2 == 1
    fifth = _conversations(tables, F.col("graph_id") % 5 == 0)
    none = GraphTables(*(rows.where(F.lit(False)) for rows in tables))
    lost = tables.edges.where((F.col("graph_id") % 5 == 0) & F.col("id").endswith("-1"))
    lost = lost.withColumns({"id": F.concat(F.lit("X"), "id"), "to_node_id": F.concat("to_node_id", F.lit("-gone"))})
    batches = {
        "1 odd": _conversations(tables, odd),
        "2 again": fifth,  # some of its keys are stored
        "3 lost": GraphTables(none.graphs, none.nodes, lost),
        "4 even": _conversations(tables, ~odd),
    }
    told = []
    for name, batch in batches.items():
        version, report = versions.append(batch, path)
        now = versions.read(spark, path)
        said = quality.summary(report).select("rule", F.col("violations").alias("rows"))
        for table, rows in now._asdict().items():
            said = said.unionByName(rows.agg(F.count("*").alias("rows")).select(F.lit(table).alias("rule"), "rows"))
        told.append(said.select(F.lit(name).alias("batch"), F.lit(version is not None).alias("accepted"), "rule", "rows"))
    return told[0].unionByName(told[1]).unionByName(told[2]).unionByName(told[3])


@query
def multiline_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full documents as pretty-printed files, and read back as tables: the nodes."""
    path = run_folder(spark)
    document_files.write_document_files(docs.documents(_stored(dialogue(spark, sf_dir)), full=True), path, 10)
    tables = docs.to_tables(document_files.read_document_files(spark, path))
    slugs = tables.graphs.select(F.col("id").alias("graph_id"), "slug")
    return tables.nodes.join(slugs, "graph_id").select("slug", "id", "kind", "title", F.col("body_text").alias("bodyText"), F.col("pos").cast("int").alias("pos"))


@query
def bucketed_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graph overview over bucketed tables: rows are counted and joined where they are stored."""
    prefix = f"b{uuid.uuid4().hex}"
    stores.write_buckets(_keys_of_counts(commerce(spark, sf_dir)), prefix, 8)
    return overview.overview(GraphTables(*(spark.table(f"{prefix}_{name}") for name in GraphTables._fields)))


def _keys_of_counts(tables: GraphTables) -> GraphTables:
    """The columns that an overview needs."""
    return GraphTables(tables.graphs, tables.nodes.select("id", "graph_id"), tables.edges.select("id", "graph_id"))


@query
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single rows of stored tables by their unique keys: a graph by slug, nodes and edges by id."""
    path = run_folder(spark)
    stores.write_tables(GraphTables(*(stores.typed(rows, name) for name, rows in commerce(spark, sf_dir)._asdict().items())), path)
    tables = stores.read_tables(spark, path)
    found = {
        "graphs": lookup.graph_by_slug(tables.graphs, "customer-7").withColumn("id", F.col("id").cast("string")),
        "nodes": lookup.by_id(tables.nodes, "R7", "C7", "P7-1", "none"),
        "edges": lookup.by_id(tables.edges, "E-7", "E-7-1"),
    }
    rows = [df.select(F.lit(name).alias("table"), "id") for name, df in found.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])
