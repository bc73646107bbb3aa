"""A Spark session with the settings that the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # Partition sizes, broadcast joins and skewed joins are decided on measured sizes.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Instants compare and print alike everywhere.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
}


def builder(app: str = "argweave", **settings: str) -> SparkSession.Builder:
    """A session builder; master, memory, shuffle partitions and spark.checkpoint.dir are up to the cluster."""
    builder = SparkSession.builder.appName(app)
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder
