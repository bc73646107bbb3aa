"""Argument graphs derived from the order and conversation tables.

commerce: one graph per customer. The customer is the root, orders are claims, order lines are premises, and the
suppliers that delivered to the customer are evidence, or counters where goods came back.
dialogue: one graph per conversation, one node per turn, each turn answering the one before it.

Lines are dealt by order once, reduced there to what nodes and edges are made of, and meet the orders, whose rows are narrow,
without another shuffle. What belongs to a customer is dealt by its own key, so a hot customer is spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from argweave.schemas import EDGES, GRAPHS, NODES, GraphTables


# Columns used of each table. Given here, so that no job has to look for them.
COLUMNS = {
    "customer": "c_custkey bigint, c_name string, c_mktsegment string",
    "supplier": "s_suppkey bigint",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderdate timestamp_ntz, "
    "o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_suppkey bigint, l_linenumber int, l_extendedprice double, l_returnflag string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(COLUMNS[name]).parquet(f"{sf_dir}/{name}.parquet")


def commerce(spark: SparkSession, sf_dir: str) -> GraphTables:
    """Graphs per customer."""
    return GraphTables(
        commerce_graphs(spark, sf_dir), commerce_nodes(spark, sf_dir), commerce_edges(spark, sf_dir)
    )


def dialogue(spark: SparkSession, sf_dir: str) -> GraphTables:
    """Graphs per conversation."""
    return GraphTables(
        dialogue_graphs(spark, sf_dir), dialogue_nodes(spark, sf_dir), dialogue_edges(spark, sf_dir)
    )


def dialogue_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.col("conv_id")
    return _typed(
        table(spark, sf_dir, "conversations").select("conv_id").distinct(),
        GRAPHS,
        id=conv,
        slug=F.concat(F.lit("conv-"), conv),
        title=F.concat(F.lit("Conversation "), conv),
    )


def dialogue_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv, turn = F.col("conv_id"), F.col("turn")
    return _typed(
        table(spark, sf_dir, "conversations"),
        NODES,
        id=_dashed("T", conv, turn),
        graph_id=conv,
        kind=F.when(turn == 0, "root").when(F.col("role") == "user", "counter").otherwise("premise"),
        title=F.col("text"),
        body_text=F.col("text"),
        tags=F.array("role"),
    )


def dialogue_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv, turn = F.col("conv_id"), F.col("turn")
    user = F.col("role") == "user"
    return _typed(
        table(spark, sf_dir, "conversations").where(turn > 0),
        EDGES,
        id=_dashed("E-", conv, turn),
        graph_id=conv,
        from_node_id=_dashed("T", conv, turn),
        to_node_id=_dashed("T", conv, turn - 1),
        kind=F.when(user, "rebut").otherwise("support"),
        weight=F.lit(1),
        polarity=F.when(user, -1).otherwise(1),
    )


def _typed(df: DataFrame, schema: T.StructType, **values: Column) -> DataFrame:
    """Select the schema's columns: the given expressions cast to type, NULL (or an empty list) for the rest."""

    def column(field: T.StructField) -> Column:
        empty = F.array() if field.name == "tags" else F.lit(None)
        return values.get(field.name, empty).cast(field.dataType).alias(field.name)

    return df.select(*map(column, schema.fields))


def _dashed(prefix: str | Column, *parts: Column) -> Column:
    head = F.lit(prefix) if isinstance(prefix, str) else prefix
    return F.concat(head, F.concat_ws("-", *parts))


def _share(key: Column, base: int = 101) -> Column:
    """key mod base as hundredths, exactly."""
    return (key % base).cast("decimal(5,0)") / F.lit(100).cast("decimal(3,0)")


def _side() -> Column:
    """Id prefix of a supplier's node: counters carry O, evidence E."""
    return F.when(F.col("returned"), "O").otherwise("E")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("okey"),
        F.col("l_linenumber").alias("line"),
        F.col("l_suppkey").alias("supp"),
        (F.col("l_returnflag") == "R").alias("returned"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"),
    )


def _owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(okey, cust) once, with how often it occurs, and how often the order does."""
    owners = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("okey"), F.col("o_custkey").alias("cust"))
    owners = owners.repartition("okey").groupBy("okey", "cust").agg(F.count("*").alias("times"))
    return owners.withColumn("all_times", F.sum("times").over(W.partitionBy("okey")))


def _deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(okey, line, supp, returned) once, with the sum of its lines, dealt by order once for all levels and for the orders."""
    lines = _lines(spark, sf_dir).repartition("okey").groupBy("okey", "line", "supp", "returned")
    # True of every group. Without it each level would have the columns of its own shuffled, and read the lines for that.
    return lines.agg(F.sum("cents").alias("part"), F.count("*").alias("rows")).where("rows > 0").drop("rows")


def commerce_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return _typed(
        table(spark, sf_dir, "customer"),
        GRAPHS,
        id=key,
        slug=F.concat(F.lit("customer-"), key),
        title=F.col("c_name"),
        description=F.col("c_mktsegment"),
    )


def commerce_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    cust, order = F.col("c_custkey"), F.col("o_orderkey")
    roots = _typed(
        table(spark, sf_dir, "customer"),
        NODES,
        id=F.concat(F.lit("R"), cust),
        graph_id=cust,
        kind=F.lit("root"),
        title=F.col("c_name"),
        body_text=F.col("c_mktsegment"),
        tags=F.array(F.col("c_mktsegment"), F.lit("root")),
        prior=_share(cust),
        importance=F.lit(1),
    )
    claims = _typed(
        table(spark, sf_dir, "orders"),
        NODES,
        id=F.concat(F.lit("C"), order),
        graph_id=F.col("o_custkey"),
        kind=F.lit("claim"),
        title=F.concat(F.lit("Order "), order),
        body_text=F.col("o_orderpriority"),
        category=F.col("o_orderpriority"),
        tags=F.array("o_orderstatus"),
        prior=_share(order),
        importance=_share(order, 97),
    )

    # (order, line) rows are premises, (customer, supplier, returned) rows are evidence or counters. Both come from the
    # deliveries that edges come from, so that a job over nodes and edges shuffles the lines once.
    okey, line, cust, supp, returned = map(F.col, ("okey", "line", "cust", "supp", "returned"))
    owners = _owners(spark, sf_dir).select("okey", "cust")
    per_delivery = _deliveries(spark, sf_dir)
    premises = per_delivery.select("okey", "line").distinct().join(owners, "okey")
    dealings = per_delivery.select("okey", "supp", "returned").join(owners, "okey")
    dealings = dealings.select("cust", "supp", "returned").distinct()
    by_line = F.concat_ws(" of order ", F.concat(F.lit("Line "), line), okey)
    premises = _typed(
        premises,
        NODES,
        id=_dashed("P", okey, line),
        graph_id=cust,
        kind=F.lit("premise"),
        title=by_line,
        body_text=by_line,
        prior=_share(okey + line),
        confidence=_share(okey * 7 + line),
    )
    by_supplier = F.concat(F.lit("Deliveries by supplier "), supp, F.lit(" to customer "), cust)
    is_evidence = ~returned
    deliveries = _typed(
        dealings,
        NODES,
        id=_dashed(_side(), cust, supp),
        graph_id=cust,
        kind=F.when(is_evidence, "evidence").otherwise("counter"),
        title=by_supplier,
        body_text=by_supplier,
        prior=_share(supp),
        confidence=F.when(~is_evidence, _share(supp)),
        evidence=F.when(
            is_evidence,
            F.struct(
                F.lit("observational").alias("type"),
                _share(supp).cast("double").alias("score"),
                F.lit(None).cast("string").alias("rationale"),
            ),
        ),
    )
    return roots.unionByName(claims).unionByName(premises).unionByName(deliveries)


def commerce_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries to order lines, order lines to orders, and orders to customers.

    A weight is an edge's share of the sum of its target. Lines are dealt by order once; there they are summed level by
    level, and meet their order. Sums of lines and orders are windows where their rows lie together anyway, those of
    customers are pre-aggregated and joined from the left, so that a customer with very many orders does not end up in one
    task. Catalyst leaves windows, join, sums and prices out of queries that use no weights.
    """
    okey, line, supp, returned, cust = map(F.col, ("okey", "line", "supp", "returned", "cust"))
    owners = _owners(spark, sf_dir)
    per_delivery = _deliveries(spark, sf_dir)
    per_line = per_delivery.groupBy("okey", "line").agg(F.sum("part").alias("part"))
    per_order = per_line.groupBy("okey").agg(F.sum("part").alias("part"))
    owned = per_order.join(owners, "okey").withColumn("part", F.col("part") * F.col("times"))
    per_customer = owned.groupBy("cust").agg(F.sum("part").alias("whole"))

    # An order that is listed several times counts as often, in parts and wholes.
    whole = lambda *target: F.sum("part").over(W.partitionBy(*target))
    deliveries = per_delivery.withColumn("whole", whole("okey", "line")).join(owners, "okey")
    steps = per_line.withColumn("whole", whole("okey")).join(owners, "okey")
    part, total = F.col("part") * F.col("times"), F.col("whole") * F.col("all_times")

    rebut = F.when(returned, True).otherwise(False)
    levels = [
        _typed(
            deliveries,
            EDGES,
            id=_dashed("E-", okey, line, F.concat(_side(), supp)),
            graph_id=cust,
            from_node_id=_dashed(_side(), cust, supp),
            to_node_id=_dashed("P", okey, line),
            kind=F.when(rebut, "rebut").otherwise("support"),
            weight=_ratio(part, total),
            polarity=F.when(rebut, -1).otherwise(1),
        ),
        _typed(
            steps,
            EDGES,
            id=_dashed("E-", okey, line),
            graph_id=cust,
            from_node_id=_dashed("P", okey, line),
            to_node_id=F.concat(F.lit("C"), okey),
            kind=F.lit("support"),
            weight=_ratio(part, total),
            polarity=F.lit(1),
        ),
        _typed(
            owned.join(per_customer, "cust", "left"),
            EDGES,
            id=F.concat(F.lit("E-"), okey),
            graph_id=cust,
            from_node_id=F.concat(F.lit("C"), okey),
            to_node_id=F.concat(F.lit("R"), cust),
            kind=F.lit("support"),
            weight=_ratio(F.col("part"), F.col("whole")),
            polarity=F.lit(1),
        ),
    ]
    return levels[0].unionByName(levels[1]).unionByName(levels[2])


def _ratio(part: Column, whole: Column) -> Column:
    """part / whole with five decimals, rounded down, exactly."""
    scaled = part.cast("decimal(20,0)") * F.lit(100000).cast("decimal(6,0)")
    return F.call_function("div", scaled, whole).cast("decimal(10,0)") / F.lit(100000).cast("decimal(6,0)")
