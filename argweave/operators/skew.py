"""Ranks and lists per group that hold when one group has a large share of all rows.

Rows are range-partitioned on (group, key), whatever the sizes of the groups, sorted within their range and written out
with their position. A row's rank is its position less that of its group's first row in the range, plus the rows of the
group in earlier ranges; both come from one small aggregate, so no window reads the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from argweave.operators.lineage import run_folder, write_out

# Positions count from 0 in each range; the number of the range is in the bits above.
RANGE_BITS = 33


def number_rows(df: DataFrame, group: Sequence[str], key: Sequence[str], into: str) -> DataFrame:
    """Number the rows of each group from 0 in key order, as bigint. An empty `group` numbers all rows.

    NULL is a group like any other. Rows that tie in group and key are numbered in any order. The input is read twice,
    once for the bounds of the ranges, so it should be stored or cheap.
    """
    if not group:
        return number_rows(df.withColumn("_all", F.lit(0)), ["_all"], key, into).drop("_all")
    ranged = df.repartitionByRange(*group, *key).sortWithinPartitions(*group, *key)
    ranged = ranged.withColumn("_at", F.monotonically_increasing_id())
    ranged = write_out(ranged, f"{run_folder(df.sparkSession)}/ranged")
    # A range starts inside at most one group, so the window gets one row for each group and one for each range.
    earlier = W.partitionBy(*group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        ranged.groupBy(*group, F.shiftright("_at", RANGE_BITS).alias("_range"))
        .agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
        .withColumn("_shift", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first"))
        .select(*(F.col(g).alias(f"_start_{g}") for g in group), "_range", "_shift")
    )
    same = [F.col(g).eqNullSafe(F.col(f"_start_{g}")) for g in group]
    ranked = ranged.join(starts, [*same, F.shiftright("_at", RANGE_BITS) == F.col("_range")])
    return ranked.select(*df.columns, (F.col("_at") + F.col("_shift")).alias(into))


def list_groups(df: DataFrame, group: str, item: str, into: str, page: int) -> DataFrame:
    """Collect `item`, a struct starting with the order key `id`, into ordered lists of `page` elements.

    Pages are numbered by `part`: element n of a group is in part n div `page`. Only a group's last page may be shorter.
    Rows of groups of more than a page are ranked first and each page is a list of its own; the rows of all others need
    no rank. The input is read up to four times, the first time for its `group` only.
    """
    lists = F.sort_array(F.collect_list(item)).alias(into)
    large = df.groupBy(group).agg(F.count("*").alias("_rows")).where(F.col("_rows") > page)
    large = write_out(large.select(F.col(group).alias("_large")), f"{run_folder(df.sparkSession)}/large")
    is_large = F.col(group).eqNullSafe(F.col("_large"))
    small = df.join(large, is_large, "left_anti").groupBy(group).agg(lists)
    small = small.select(group, F.lit(0).alias("part"), into)
    if large.isEmpty():
        return small
    ranked = number_rows(df.join(large, is_large, "left_semi"), [group], ["id"], "_rank")
    paged = ranked.withColumn("part", F.floor(F.col("_rank") / page).cast("int"))
    return small.unionByName(paged.groupBy(group, "part").agg(lists))
