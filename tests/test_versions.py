"""Batches under the rules, snapshots of a version, files over many lines, and plans that read little."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from argweave.operators import cascade, documents, lookup, overview, quality
from argweave.schemas import GraphTables
from argweave.sources import documents as files
from argweave.sources import tables as stores
from argweave.sources import versions
from tests import seed
from tests.conftest import rows


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored_seed(spark, seed_tables, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("seed") / "store")
    stores.write_tables(seed_tables, path)
    return stores.read_tables(spark, path)


def counts(tables: GraphTables) -> list[int]:
    return [t.count() for t in tables]


def test_a_refused_batch_leaves_the_version_as_it_was(spark, seed_tables, tmp_path):
    path = str(tmp_path / "store")
    assert versions.create(spark, path) == 0
    version, report = versions.append(seed_tables, path)
    assert version == 1 and report.count() == 0
    sound = counts(seed_tables)
    again, report = versions.append(seed_tables, path)
    assert again is None
    assert {(r.rule, r.violations) for r in quality.summary(report).collect()} == {
        ("graphs_pkey", sound[0]), ("graphs_slug_key", sound[0]), ("nodes_pkey", sound[1]), ("edges_pkey", sound[2]),
    }
    assert versions.latest(spark, path) == 1 and counts(versions.read(spark, path)) == sound
    assert counts(versions.read(spark, path, 0)) == [0, 0, 0]


def test_a_batch_may_refer_to_stored_rows_and_must_refer_to_some(spark, seed_tables, tmp_path):
    path = str(tmp_path / "store")
    versions.create(spark, path)
    versions.append(seed_tables, path)
    before = versions.read(spark, path)
    none = GraphTables(*(t.where(F.lit(False)) for t in seed_tables))
    edge = seed_tables.edges.orderBy("id").limit(1)
    good = edge.withColumn("id", F.lit("later"))
    assert versions.append(none._replace(edges=good), path)[0] == 2
    for column in ("from_node_id", "to_node_id"):
        version, report = versions.append(none._replace(edges=good.withColumns({"id": F.lit("bad"), column: F.lit("nowhere")})), path)
        assert version is None and rows(report, "rule", "key", "detail") == [(f"edges_{column}_fkey", "bad", "nowhere")]
    version, report = versions.append(none._replace(edges=good.withColumns({"id": F.lit("x"), "weight": F.lit(2).cast("decimal(6,5)")})), path)
    assert version is None and rows(report, "rule", "key") == [("ck_edges_weight", "x")]
    assert counts(versions.read(spark, path))[2] == counts(before)[2] + 1
    # A reader of an earlier version does not see the batch.
    assert counts(before) == counts(seed_tables) == counts(versions.read(spark, path, 1))


def test_unknown_versions_and_second_stores_are_errors(spark, tmp_path):
    path = str(tmp_path / "store")
    versions.create(spark, path)
    with pytest.raises(ValueError, match="not published"):
        versions.read(spark, path, 7)
    with pytest.raises(Exception, match="(?i)exist"):
        versions.create(spark, path)


def test_lines_and_pretty_files_give_the_same_tables(spark, stored_seed, tmp_path):
    found = documents.documents(stored_seed, full=True)
    files.write_documents(found, str(tmp_path / "lines"))
    files.write_document_files(found, str(tmp_path / "files"), per_file=1)
    text = "".join(p.read_text() for p in (tmp_path / "files").rglob("*.txt"))
    assert text.count("\n") > 100 and json.loads(text)[0]["slug"] == seed.tables()["graphs"][0]["slug"]
    one = documents.to_tables(files.read_documents(spark, str(tmp_path / "lines")))
    two = documents.to_tables(files.read_document_files(spark, str(tmp_path / "files")))
    for a, b in zip(one, two, strict=True):
        assert sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))


def test_files_that_are_no_documents_are_reported(spark, tmp_path):
    (tmp_path / "good.json").write_text('{\n "slug": "a",\n "title": "A",\n "nodes": [],\n "edges": []\n}\n')
    (tmp_path / "two.json").write_text('[{"slug": "b",\n "title": "B"},\n {"slug": "c", "title": "C"}]')
    (tmp_path / "bad.json").write_text('{\n "slug": "d",\n "title": \n}')
    assert sorted(r.slug for r in files.read_document_files(spark, str(tmp_path)).collect()) == ["a", "b", "c"]
    found = files.document_file_misfits(spark, str(tmp_path)).collect()
    assert [(r.rule, r.key.rsplit("/", 1)[1]) for r in found] == [("document_json", "bad.json")]


def test_rules_read_each_table_a_few_times(spark, stored_seed, monkeypatch):
    plans = []
    write = quality.write_out
    monkeypatch.setattr(quality, "write_out", lambda df, path: (plans.append(plan(df)), write(df, path))[1])
    plans.append(plan(quality.violations(stored_seed)))
    scans = [line for p in plans for line in p.splitlines() if "FileScan" in line and "parquet [space#" not in line]
    assert len(scans) <= 8
    assert 0 < sum("from_node_id" in line for line in scans) <= 4


def test_a_delete_reads_each_table_a_few_times(spark, stored_seed, monkeypatch):
    left = cascade.delete_graphs(stored_seed, stored_seed.graphs.where("id = 1"))
    assert sum(plan(t).count("FileScan") for t in left) <= 8
    assert counts(left) == [0, 0, 0]


def test_deletes_keep_rows_without_ids_or_references(spark, seed_tables):
    edge = seed_tables.edges.orderBy("id").limit(1)
    loose = edge.withColumns({"id": F.lit(None).cast("string"), "from_node_id": F.lit(None).cast("string"), "to_node_id": F.lit(None).cast("string"), "graph_id": F.lit(None).cast("int")})
    tables = seed_tables._replace(edges=seed_tables.edges.unionByName(loose))
    left = cascade.delete_graphs(tables, seed_tables.graphs.select("id").unionByName(spark.createDataFrame([(None,)], "id int")))
    assert counts(left) == [0, 0, 1]


def test_documents_need_no_window_over_the_rows(spark, stored_seed):
    found = documents.documents(stored_seed)
    assert "Window" not in plan(found)
    paged = documents.documents(stored_seed, page=5)
    assert "WindowGroup" not in plan(paged)
    assert sorted(r.part for r in paged.collect()) == list(range(7))


def test_overview_of_buckets_has_no_exchange(spark, seed_tables):
    stores.write_buckets(seed_tables, "overviewed", 4, mode="overwrite")
    tables = GraphTables(*(spark.table(f"overviewed_{name}") for name in GraphTables._fields))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = overview.overview(tables)
        assert "Exchange" not in plan(found)
        assert found.head().node_count == seed_tables.nodes.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def scanned(df) -> int:
    """Rows that the scan of an executed plan put out: whole row groups, unless they were skipped."""
    df.collect()
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    return leaf.metrics().apply("numOutputRows").value()


def test_a_lookup_by_id_skips_files_by_their_filters(spark, seed_tables, tmp_path):
    hashed = F.sha2(F.col("n").cast("string"), 256).alias("id")  # every file has ids from all over the range
    many = spark.range(40_000).withColumnRenamed("id", "n").select("n", hashed, (F.col("n") % 8).cast("int").alias("graph_id"))
    node = seed_tables.nodes.limit(1).drop("id", "graph_id")
    nodes = many.join(node, F.lit(True)).drop("n").select(*seed_tables.nodes.columns)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small data would be one file
    try:
        stores.write_tables(GraphTables(seed_tables.graphs, nodes, seed_tables.edges), str(tmp_path / "store"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    stored = stores.read_tables(spark, str(tmp_path / "store")).nodes
    groups = len(list((tmp_path / "store" / "nodes").glob("*.parquet")))
    one = many.where("n = 4321").head().id
    found = lookup.by_id(stored, one)
    assert groups > 2 and scanned(found) < 20_000
    assert [r.id for r in found.collect()] == [one]
    assert scanned(lookup.by_id(stored, "5" * 64)) < 20_000
