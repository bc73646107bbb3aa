"""Scalar display functions, Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the card view.
SYMBOLS = {"root": "🌍", "claim": "🌿", "premise": "🌱", "evidence": "🔬"}
OTHER_SYMBOL = "⚠️"
METRIC_LABELS = {
    "root": "Importance",
    "claim": "Importance",
    "premise": "Confidence",
    "counter": "Confidence",
    "evidence": "Score",
}
FULL_TITLE_LENGTH = 33
SHORT_TITLE_LENGTH = 30
ELLIPSIS = "..."

_ASTRAL = r"[\x{10000}-\x{10FFFF}]"


def format_kind(kind: Column) -> Column:
    """First character in upper case, the rest as it is."""
    return F.concat(F.upper(F.substring(kind, 1, 1)), F.substring(kind, F.lit(2), F.length(kind)))


def node_symbol(kind: Column) -> Column:
    """Symbol of a node kind; unknown kinds and counters share one."""
    symbol = F.lit(OTHER_SYMBOL)
    for name, value in SYMBOLS.items():
        symbol = F.when(kind == name, value).otherwise(symbol)
    return symbol


def display_title(title: Column) -> Column:
    """Titles up to 33 UTF-16 units stay, longer ones are cut to 30 and get an ellipsis.

    Without characters outside the basic plane, units are characters. Otherwise the cut is found among the characters
    by their units; half of a surrogate pair cannot be stored and becomes the replacement character.
    """
    plain = F.when(F.length(title) <= FULL_TITLE_LENGTH, title).otherwise(
        F.concat(F.substring(title, 1, SHORT_TITLE_LENGTH), F.lit(ELLIPSIS))
    )
    # A title that needs the slow path has a wide character among its first 33 characters.
    head = F.substring(title, 1, FULL_TITLE_LENGTH)
    wide = (F.octet_length(head) > F.length(head)) & head.rlike(_ASTRAL)
    return F.when(wide, _cut_wide(title)).otherwise(plain)


def _cut_wide(title: Column) -> Column:
    head = F.split(F.substring(title, 1, FULL_TITLE_LENGTH + 1), "")
    width = lambda char: F.when(char.rlike(_ASTRAL), 2).otherwise(1)
    units = F.aggregate(head, F.lit(0), lambda total, char: total + width(char))

    def add(kept: Column, char: Column) -> Column:
        room = F.lit(SHORT_TITLE_LENGTH) - kept["units"]
        text = F.when(room >= width(char), char).when(room == 1, F.lit("�")).otherwise(F.lit(""))
        return F.struct(
            F.concat(kept["text"], text).alias("text"),
            F.least(kept["units"] + width(char), F.lit(SHORT_TITLE_LENGTH)).alias("units"),
        )

    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("units"))
    short = F.aggregate(head, start, add, lambda kept: F.concat(kept["text"], F.lit(ELLIPSIS)))
    return F.when(units <= FULL_TITLE_LENGTH, title).otherwise(short)


def format_metric(value: Column) -> Column:
    """Two fixed decimals of the exact binary value, ties away from zero; NULL stays NULL.

    0.615 is slightly below its decimal notation and gives 0.61; 0.125 is an exact tie and gives 0.13. The distance to
    the tie is taken in two halves of the mantissa, so that no product is rounded.
    """
    exact = F.abs(value.cast("double"))
    below = F.floor(exact * 100)
    tie = below * 2 + 1  # in two-hundredths
    shifted = exact * 134217729.0
    high = shifted - (shifted - exact)
    low = exact - high
    distance = (high * 200 - tie) + low * 200
    cents = below + F.when(distance >= 0, 1).otherwise(0)
    text = F.concat((cents / 100).cast("bigint"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))
    return F.when(value < 0, F.concat(F.lit("-"), text)).otherwise(text)


def metric_label(kind: Column) -> Column:
    """Which metric a card shows for a node kind; NULL for unknown kinds. Set even if the value is missing."""
    label = F.lit(None).cast("string")
    for name, value in METRIC_LABELS.items():
        label = F.when(kind == name, value).otherwise(label)
    return label


def metric_value(kind: Column, importance: Column, confidence: Column, evidence: Column) -> Column:
    """The metric named by `metric_label`, formatted."""
    label = metric_label(kind)
    value = (
        F.when(label == "Importance", importance.cast("double"))
        .when(label == "Confidence", confidence.cast("double"))
        .when(label == "Score", evidence["score"])
    )
    return format_metric(value)


def class_name(element: str, kind: Column) -> Column:
    """Style class of a node or an edge, with its raw kind."""
    base = f"graph-{element}"  # fixed value
    return F.concat(F.lit(f"{base} {base}--"), kind)
