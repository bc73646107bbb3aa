from __future__ import annotations

import random
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from argweave.functions.display import (
    class_name,
    display_title,
    format_kind,
    format_metric,
    metric_label,
    metric_value,
    node_symbol,
)
from argweave.functions.fields import has_text, parse_evidence, parse_tags, parse_timestamp, with_defaults
from tests.conftest import rows
from tests.seed import LONG_TITLE, SHORT_TITLE


def values(spark, data, type_, column):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(data)], f"i int, v {type_}")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_format_kind(spark):
    got = values(spark, ["root", "rOOT node", "", None], "string", format_kind(F.col("v")))
    assert got == ["Root", "ROOT node", "", None]


def test_node_symbol(spark):
    kinds = ["root", "claim", "premise", "evidence", "counter", "unheard-of"]
    assert values(spark, kinds, "string", node_symbol(F.col("v"))) == ["🌍", "🌿", "🌱", "🔬", "⚠️", "⚠️"]


def utf16_cut(title):
    units = title.encode("utf-16-le")
    return title if len(units) <= 66 else units[:60].decode("utf-16-le", "replace") + "..."


def test_display_title(spark):
    titles = [LONG_TITLE, "x" * 33, "x" * 34, "", "éàç" * 12]
    titles += ["🌍" * 16, "🌍" * 17, "a" + "🌍" * 20, "a" * 33 + "🌍", "a" * 31 + "🌍", "a" * 32 + "🌍", "a" * 29 + "🌍🌍🌍"]
    got = values(spark, titles, "string", display_title(F.col("v")))
    assert got[0] == SHORT_TITLE
    assert got == [utf16_cut(t) for t in titles]


def test_format_metric_examples(spark):
    data = [0.615, 0.125, 0.5, 1.0, 0.0, -0.001, -0.125, 0.29, 1.005, None]
    expected = ["0.61", "0.13", "0.50", "1.00", "0.00", "-0.00", "-0.13", "0.29", "1.00", None]
    assert values(spark, data, "double", format_metric(F.col("v"))) == expected


def test_format_metric_rounds_the_exact_binary_value(spark):
    draw = random.Random(7)
    data = [draw.random() for _ in range(2000)] + [draw.randint(0, 10**7) / 1000 for _ in range(5000)]
    expected = [str(Decimal(v).quantize(Decimal("0.01"), ROUND_HALF_UP)) for v in data]
    assert values(spark, data, "double", format_metric(F.col("v"))) == expected


def test_metric_of_each_kind(spark):
    data = [
        ("root", Decimal("1"), None, None),
        ("claim", Decimal("0.74"), Decimal("0.1"), None),
        ("premise", Decimal("0.1"), Decimal("0.58"), None),
        ("counter", None, Decimal("0"), None),
        ("evidence", None, None, ("video", 0.46, None)),
        ("evidence", None, None, None),
        ("other", Decimal("1"), Decimal("1"), ("video", 0.46, None)),
    ]
    schema = (
        "kind string, importance decimal(6,5), confidence decimal(6,5), "
        "evidence struct<type string, score double, rationale string>"
    )
    kind, importance, confidence, evidence = (F.col(c) for c in ("kind", "importance", "confidence", "evidence"))
    df = spark.createDataFrame(data, schema).coalesce(1)
    assert rows(df, metric_label(kind), metric_value(kind, importance, confidence, evidence)) == [
        ("Importance", "1.00"),
        ("Importance", "0.74"),
        ("Confidence", "0.58"),
        ("Confidence", "0.00"),
        ("Score", "0.46"),
        ("Score", None),
        (None, None),
    ]


def test_class_name(spark):
    assert values(spark, ["root"], "string", class_name("node", F.col("v"))) == ["graph-node graph-node--root"]
    assert values(spark, ["rebut"], "string", class_name("edge", F.col("v"))) == ["graph-edge graph-edge--rebut"]


def test_parse_evidence(spark):
    texts = ['{"type": "video", "score": 0.46}', '{"type": "x", "score": 0.5, "rationale": "r"}', "{}", None]
    got = values(spark, texts, "string", parse_evidence(F.col("v")))
    assert [tuple(e) if e else e for e in got] == [("video", 0.46, None), ("x", 0.5, "r"), (None, None, None), None]


@pytest.mark.parametrize(
    ("text", "tags"),
    [("{}", []), ("{a,b}", ["a", "b"]), ('{"a,b",c}', ["a,b", "c"]), (r'{"q\"x"}', ['q"x']), (None, None)],
)
def test_parse_tags(spark, text, tags):
    assert values(spark, [text], "string", parse_tags(F.col("v"))) == [tags]


def test_parse_timestamp_is_an_instant(spark):
    column = F.unix_micros(parse_timestamp(F.col("v")))
    assert values(spark, ["2026-04-13 11:42:53.694065-04"], "string", column) == [1776094973694065]


def test_has_text(spark):
    assert values(spark, ["x", "", None], "string", has_text(F.col("v"))) == [True, False, False]


def test_defaults_fill_missing_columns_and_nulls_only(spark):
    df = spark.createDataFrame([("a", ["t"]), ("b", None)], "id string, tags array<string>")
    got = with_defaults(df).orderBy("id")
    assert rows(got, "tags", F.to_json("attributes"), F.col("created_at").isNotNull()) == [
        (["t"], "{}", True),
        ([], "{}", True),
    ]
    graphs = with_defaults(spark.createDataFrame([("a",)], "slug string"))
    assert graphs.columns == ["slug", "created_at", "updated_at"]


def test_evidence_is_parsed_once(spark):
    texts = ['{"type": "a", "score": 1}', ' \n{"score": "high", "rationale": {"b": 1}}', "{}", "[1]", "null", "{", "7", "", None]
    parsed = spark.createDataFrame([(t,) for t in texts], "t string").select(parse_evidence(F.col("t")).alias("e"))
    plan = parsed.select("e.type", "e.score", "e.rationale")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("parsejson") + plan.lower().count("parse_json") == 1
    found = [None if r.e is None else tuple(r.e) for r in parsed.collect()]
    assert found[:3] == [("a", 1.0, None), (None, None, '{"b":1}'), (None, None, None)] and found[3:] == [None] * 6


def test_empty_tags(spark):
    tags = spark.createDataFrame([("{}",), ("{a}",), ("{ }",), ("",), (None,)], "t string")
    assert [r[0] for r in tags.select(parse_tags(F.col("t"))).collect()] == [[], ["a"], [" "], None, None]
