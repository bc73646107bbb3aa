from __future__ import annotations

import pytest
from pyspark.sql import SparkSession

from argweave.session import builder
from argweave.sources.tables import from_rows
from tests import seed


@pytest.fixture(scope="session")
def spark(tmp_path_factory) -> SparkSession:
    session = (
        builder("tests")
        .master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    return session


@pytest.fixture(scope="session")
def seed_tables(spark):
    return from_rows(spark, seed.tables())


def rows(df, *columns):
    """Rows as plain tuples, in their own order."""
    return [tuple(row) for row in (df.select(*columns) if columns else df).collect()]
