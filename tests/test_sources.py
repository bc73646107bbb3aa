from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from argweave.operators import lineage
from argweave.operators.quality import violations
from argweave.schemas import GraphTables
from argweave.sources import database, tables
from argweave.sources.documents import load
from tests.conftest import rows


@pytest.mark.parametrize("url", [None, "", "   "])
def test_blank_connection(spark, url):
    with pytest.raises(ValueError, match="^Database:ConnectionString is not configured.$"):
        database.read_database(spark, url)


def test_connection_options():
    assert database.options("jdbc:postgresql://db/x", user="u") == {"url": "jdbc:postgresql://db/x", "user": "u"}


@pytest.mark.parametrize("splits", [1, 3, 7, 27, 100])
def test_database_splits_hold_every_row_once(spark, seed_tables, splits):
    """The split conditions are plain SQL; here they run on the same rows in Spark, one graph holding them all."""
    seed_tables.nodes.select("graph_id", "id").createOrReplaceTempView("nodes")
    bounds = spark.sql(database.bounds_query("nodes", splits)).collect()
    predicates = database.range_predicates(bounds)
    assert len(bounds) <= splits
    counts = [spark.table("nodes").where(p).count() for p in predicates]
    assert sum(counts) == 27
    assert max(counts) <= -(-27 // splits)
    assert database.range_predicates([]) == ["1 = 1"]


def test_split_conditions_quote_ids(spark):
    assert database.range_predicates([{"graph_id": 1, "id": "it's", "place": 1}]) == [
        "(graph_id, id) <= (1, 'it''s')",
        "(graph_id, id) > (1, 'it''s')",
    ]


@pytest.mark.parametrize("table", ["graphs", "nodes", "edges"])
def test_bounds_of_a_sample_hold_every_row_once(spark, table):
    """Any few keys make ranges that cover all rows, those beyond the sampled ones too."""
    keys = [f"{graph}, 'n{graph}-{k}'" for graph in range(5) for k in range(4)] if table != "graphs" else map(str, range(20))
    columns = "(graph_id, id)" if table != "graphs" else "(id)"
    spark.sql(f"SELECT * FROM VALUES {', '.join(f'({k})' for k in keys)} AS t{columns}").createOrReplaceTempView(table)
    every_third = [row for row in spark.sql(database.bounds_query(table, 20)).collect() if row["place"] % 3 == 0]
    predicates = database.range_predicates(every_third, database.KEYS[table])
    assert [spark.table(table).where(p).count() for p in predicates] == [3, 3, 3, 3, 3, 3, 2]


def test_bounds_sort_only_a_sample():
    assert "FROM edges TABLESAMPLE SYSTEM (0.5)) ranked" in database.bounds_query("edges", 10, 0.5)
    assert "TABLESAMPLE" not in database.bounds_query("edges", 10)


def test_bulk_load_then_read(spark, tmp_path, seed_tables):
    path = str(tmp_path / "store")
    assert tables.bulk_load(seed_tables, path).count() == 0
    back = load(spark, path)
    assert [t.count() for t in back] == [1, 27, 34]
    assert rows(back.nodes.where("id = 'R1'"), "tags", "prior", F.to_json("attributes")) == [
        (["topic", "root"], rows(seed_tables.nodes.where("id = 'R1'"), "prior")[0][0], "{}")
    ]
    assert rows(back.nodes.where("id = 'E1'"), "evidence.type", "evidence.score") == [("observational", 0.52)]


def test_bulk_load_writes_first_and_reports_afterwards(spark, tmp_path, seed_tables):
    path = str(tmp_path / "store")
    broken = seed_tables._replace(nodes=seed_tables.nodes.where("id <> 'C5'"))
    report = tables.bulk_load(broken, path)
    assert sorted(rows(report, "rule", "key")) == [
        ("edges_from_node_id_fkey", "E-R-C5"),
        ("edges_to_node_id_fkey", "E-C5-O8"),
    ]
    assert load(spark, path).nodes.count() == 26


def test_stored_lookup_is_pushed_to_the_scan(spark, tmp_path, seed_tables, capsys):
    path = str(tmp_path / "store")
    tables.bulk_load(seed_tables, path)
    load(spark, path).nodes.where("graph_id = 1 and id = 'E1'").select("title").explain("formatted")
    plan = capsys.readouterr().out
    assert "EqualTo(graph_id,1), EqualTo(id,E1)" in plan
    assert "ReadSchema: struct<id:string,graph_id:int,title:string>" in plan


def test_buckets_join_without_a_shuffle(spark, seed_tables, capsys):
    tables.write_buckets(seed_tables, "sample", 4, mode="overwrite")
    nodes, edges = spark.table("sample_nodes"), spark.table("sample_edges")
    counted = nodes.groupBy("graph_id").count().hint("merge")
    counted.join(edges.groupBy("graph_id").agg(F.count("*").alias("m")), "graph_id").explain()
    assert "Exchange" not in capsys.readouterr().out


def test_a_bucket_is_written_by_several_tasks(spark):
    keys = GraphTables(spark.range(200), spark.range(200).toDF("graph_id"), spark.range(200).toDF("graph_id"))
    tables.write_buckets(keys, "spread", 2, mode="overwrite")
    files = [f.split("/")[-1] for f in spark.table("spread_nodes").inputFiles()]
    buckets = [f.split("_")[1][:5] for f in files]
    assert len(files) == 4 and sorted(set(buckets)) == ["00000", "00001"]
    assert spark.table("spread_nodes").distinct().count() == 200


def test_typed_reads_loose_values_without_failing(spark):
    loose = spark.createDataFrame(
        [
            ("a", "1", "claim", "t", "b", "{x,y}", "0.5", '{"type": "video", "score": 0.46}', '{"k": 1}'),
            ("b", "one", "claim", "t", "b", "abc", "10.5", '{"type": "video", "score": "high"}', "not json"),
            ("c", "1", "claim", "t", "b", None, None, "not json", None),
        ],
        "id string, graph_id string, kind string, title string, body_text string, tags string, prior string, "
        "evidence string, attributes string",
    )
    got = tables.typed(loose, "nodes").orderBy("id")
    assert rows(got, "id", "graph_id", "tags", F.col("prior").cast("string"), "evidence.score") == [
        ("a", 1, ["x", "y"], "0.50000", 0.46),
        ("b", None, None, None, None),
        ("c", 1, [], None, None),
    ]
    assert rows(got, "evidence.type", F.col("evidence").isNull()) == [("video", False), ("video", False), (None, True)]
    assert rows(got, F.to_json("attributes")) == [('{"k":1}',), (None,), ("{}",)]
    assert sorted(rows(tables.misfits(loose, "nodes"))) == [
        ("nodes_type", "nodes", "b", "attributes: not json"),
        ("nodes_type", "nodes", "b", 'evidence: {"type": "video", "score": "high"}'),
        ("nodes_type", "nodes", "b", "graph_id: one"),
        ("nodes_type", "nodes", "b", "prior: 10.5"),
        ("nodes_type", "nodes", "b", "tags: abc"),
        ("nodes_type", "nodes", "c", "evidence: not json"),
    ]


def test_bulk_load_reports_loose_values_with_the_violations(spark, tmp_path):
    graphs = spark.createDataFrame([("1", "s", "t", None, "garbage")], "id string, slug string, title string, description string, created_at string")
    nodes = spark.createDataFrame([("a", 1, "claim", "t", "b", "abc")], "id string, graph_id int, kind string, title string, body_text string, tags string")
    edges = spark.createDataFrame([], "id string, graph_id int, from_node_id string, to_node_id string, kind string")
    report = tables.bulk_load(GraphTables(graphs, nodes, edges), str(tmp_path / "store"))
    assert sorted(rows(report, "rule", "key", "detail")) == [
        ("graphs_not_null", "1", "created_at"),
        ("graphs_type", "1", "created_at: garbage"),
        ("nodes_not_null", "a", "tags"),
        ("nodes_type", "a", "tags: abc"),
    ]


def test_shared_folder_comes_from_the_session(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert lineage.shared_folder(spark) == folder
    assert lineage.run_folder(spark).startswith(f"{folder}/argweave/{spark.sparkContext.applicationId}/")
    assert lineage.run_folder(spark) != lineage.run_folder(spark)


class Unset:
    """A session without a checkpoint folder."""

    def __init__(self, master):
        self.master, self.folder = master, None
        self.conf, self.sparkContext = self, self

    def get(self, key, default):
        return default

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def test_only_a_local_session_gets_its_own_folder():
    session = Unset("local[2]")
    assert lineage.shared_folder(session) == session.folder
    with pytest.raises(ValueError, match="spark.checkpoint.dir must name a folder"):
        lineage.shared_folder(Unset("spark://cluster:7077"))


def test_typed_keeps_typed_tables(seed_tables):
    again = GraphTables(*(tables.typed(getattr(seed_tables, name), name) for name in ("graphs", "nodes", "edges")))
    assert rows(again.edges.orderBy("id"), "id", "weight") == rows(seed_tables.edges.orderBy("id"), "id", "weight")
    assert violations(again).count() == 0
