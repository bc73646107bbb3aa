"""Cutting lineage with tables written to the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, or set on the context. Only a local session may do without either."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share.")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def run_folder(spark: SparkSession) -> str:
    """A fresh folder for the tables of one run, below one folder per application that may go when it ends."""
    return f"{shared_folder(spark)}/argweave/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


#: Shuffle files of a query go when it ends, not when its plan is collected as garbage some time later.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def short_shuffles(spark: SparkSession) -> Iterator[None]:
    """Writes in here leave no shuffle files behind, so that those of one write do not add to those of the next."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def write_out(df: DataFrame, path: str) -> DataFrame:
    """Write `df` to `path` as Parquet and read it back: lineage ends here and survives lost executors."""
    with short_shuffles(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
