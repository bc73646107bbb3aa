"""What the details of a node show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from argweave.functions.display import format_metric
from argweave.functions.fields import has_text


def node_headers(nodes: DataFrame) -> DataFrame:
    """Title, kind, id and body."""
    return nodes.select("graph_id", "id", "title", "kind", F.col("body_text").alias("bodyText"))


def node_tags(nodes: DataFrame) -> DataFrame:
    """One row per tag, in order."""
    return nodes.select("graph_id", "id", F.posexplode("tags").alias("pos", "tag"))


def node_details(nodes: DataFrame) -> DataFrame:
    """The attributes a node has, as one row each, in display order.

    Empty text and empty lists are left out; a metric of 0 is shown. Tags are joined with commas; `node_tags` has them
    one by one.
    """
    evidence = F.col("evidence")
    # The labels are fixed values.
    values = {
        "Category": _shown(F.col("category")),
        "Tags": F.when(F.size("tags") > 0, F.array_join("tags", ", ")),
        "Prior": format_metric(F.col("prior")),
        "Confidence": format_metric(F.col("confidence")),
        "Weight": format_metric(F.col("weight")),
        "Importance": format_metric(F.col("importance")),
        "Evidence": F.when(evidence.isNotNull(), F.coalesce(evidence["type"], F.lit(""))),
        "Score": format_metric(evidence["score"]),
        "Rationale": _shown(evidence["rationale"]),
    }
    # Texts are made in a projection of their own, which evaluates shared parts once; a generator would not.
    texts = nodes.select("graph_id", "id", *(value.alias(label) for label, value in values.items()))
    rows = F.array(
        *(
            F.struct(F.lit(ord).alias("ord"), F.lit(label).alias("label"), F.col(label).alias("value"))
            for ord, label in enumerate(values, start=1)
        )
    )
    return texts.select("graph_id", "id", F.inline(rows)).where(F.col("value").isNotNull())


def _shown(text: Column) -> Column:
    return F.when(has_text(text), text)
