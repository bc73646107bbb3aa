"""Stored tables that grow by checked batches, with one snapshot of all three tables for each reader.

A version is a small manifest: for each table the folders that belong to it. Batches are written below `batches/` first,
checked, and become visible only with the manifest of the next version, so a reader of a version sees the same rows in all
three tables however often it reads, and a refused batch leaves the published version as it was. The rules that the seed
declares for later writes hold for every batch: its rows are checked by themselves, its keys against the stored keys.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from argweave.operators import quality
from argweave.operators.lineage import write_out
from argweave.schemas import GraphTables, stored
from argweave.sources.tables import SCHEMAS, typed, write_tables

MANIFEST = "version bigint, folders array<string>"


def create(spark: SparkSession, path: str) -> int:
    """An empty store; its version 0. Fails if there is one already."""
    _publish(spark, path, 0, [])
    return 0


def versions(spark: SparkSession, path: str) -> DataFrame:
    """(version, folders) of every published version."""
    return spark.read.schema(MANIFEST).json(f"{path}/versions/*")


def latest(spark: SparkSession, path: str) -> int:
    """The number of the version that was published last."""
    last = versions(spark, path).agg(F.max("version")).head()[0]
    if last is None:
        raise ValueError(f"No version is published below {path}.")
    return last


def read(spark: SparkSession, path: str, version: int | None = None) -> GraphTables:
    """The three tables as of one version, the latest one unless it is named."""
    version = latest(spark, path) if version is None else version
    try:
        row = spark.read.schema(MANIFEST).json(_manifest(path, version)).head()
    except AnalysisException:
        row = None
    if row is None:
        raise ValueError(f"Version {version} is not published below {path}.")
    frames = []
    for name, schema in SCHEMAS.items():
        folders = [f"{path}/{folder}/{name}" for folder in row.folders]
        frames.append(spark.read.schema(stored(schema)).parquet(*folders) if folders else spark.createDataFrame([], stored(schema)))
    return GraphTables(*frames)


def append(batch: GraphTables, path: str) -> tuple[int | None, DataFrame]:
    """Add a batch: its version if it keeps all rules, else None, and the violations, stored as (rule, table, key, detail).

    Row rules are for the batch alone; a key counts with its stored rows, and a reference may lead to a stored row or to
    one of the batch. Of the stored tables only key columns are read, and of these only keys that the batch names are
    counted. Two writers that publish the same version at once cannot both succeed: the second finds it there.
    """
    spark = batch.graphs.sparkSession
    base = latest(spark, path)
    row = spark.read.schema(MANIFEST).json(_manifest(path, base)).head()
    folder = f"batches/{uuid.uuid4().hex}"
    write_tables(GraphTables(*(typed(rows, name) for name, rows in batch._asdict().items())), f"{path}/{folder}")
    staged = GraphTables(*(spark.read.schema(stored(s)).parquet(f"{path}/{folder}/{name}") for name, s in SCHEMAS.items()))
    report = write_out(_check(staged, read(spark, path, base)), f"{path}/reports/{folder.split('/')[1]}")
    if not report.isEmpty():
        return None, report
    _publish(spark, path, base + 1, [*row.folders, folder])
    return base + 1, report


def _check(batch: GraphTables, known: GraphTables) -> DataFrame:
    named, old = batch._asdict(), known._asdict()
    entries = reduce(DataFrame.unionByName, (quality.entries(rows, name) for name, rows in named.items()))
    before = reduce(DataFrame.unionByName, (quality.entries(rows, name, references=False) for name, rows in old.items()))
    asked = entries.select("space", "key").distinct()
    faulty = quality.faulty(entries.unionByName(before.join(asked, ["space", "key"], "left_semi")))
    return quality.reports(batch, write_out(faulty, quality.fault_folder(batch)))


def _manifest(path: str, version: int) -> str:
    return f"{path}/versions/{version:010d}"


def _publish(spark: SparkSession, path: str, version: int, folders: list[str]) -> None:
    spark.createDataFrame([(version, folders)], MANIFEST).coalesce(1).write.mode("errorifexists").json(_manifest(path, version))
