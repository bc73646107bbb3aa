"""Ranks and pages of groups of any size, whatever the partitions of the input."""

from __future__ import annotations

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from argweave.operators.skew import list_groups, number_rows
from tests.conftest import rows


@pytest.fixture(scope="module")
def skewed(spark):
    """30 groups, one of which has two thirds of all rows, and one is NULL."""
    n = F.col("id")
    group = F.when(n % 3 < 2, 7).when(n % 30 != 29, n % 30)
    return spark.range(3000).select(
        group.cast("int").alias("g"), F.concat(F.lit("k"), F.xxhash64("id")).alias("id"), n.alias("payload")
    )


def ordered(found):
    return sorted(found, key=lambda row: [(value is not None, value) for value in row])


@pytest.mark.parametrize("partitions", [1, 3, 7])
def test_number_rows(skewed, partitions):
    got = number_rows(skewed.repartition(partitions), ["g"], ["id"], "slot")
    want = skewed.withColumn("slot", F.row_number().over(W.partitionBy("g").orderBy("id")) - 1)
    assert ordered(rows(got, "g", "id", "slot")) == ordered(rows(want, "g", "id", "slot"))
    assert dict(got.dtypes)["slot"] == "bigint"


@pytest.mark.parametrize("partitions", [1, 3, 7])
def test_number_all_rows(skewed, partitions):
    got = number_rows(skewed.repartition(partitions), [], ["id"], "n")
    assert [r.n for r in got.orderBy("id").collect()] == list(range(3000))
    assert set(got.columns) == {"g", "id", "payload", "n"}


def test_no_rows(skewed):
    none = skewed.where("false")
    assert number_rows(none, ["g"], ["id"], "n").count() == 0
    assert list_groups(none.select("g", "id", F.struct("id").alias("item")), "g", "item", "items", 5).count() == 0


@pytest.mark.parametrize("page", [7, 100, 5000])
def test_pages_do_not_depend_on_partitions(skewed, page):
    items = skewed.select("g", "id", F.struct("id", "payload").alias("item"))
    found = []
    for partitions in (1, 3, 7):
        lists = list_groups(items.repartition(partitions), "g", "item", "items", page)
        found.append({(r.g, r.part): [item.id for item in r["items"]] for r in lists.collect()})
        assert dict(lists.dtypes)["part"] == "int"
    assert found[0] == found[1] == found[2]
    by_group = {}
    for row in skewed.collect():
        by_group.setdefault(row.g, []).append(row.id)
    want = {
        (g, at // page): sorted(ids)[at : at + page] for g, ids in by_group.items() for at in range(0, len(ids), page)
    }
    assert found[0] == want
