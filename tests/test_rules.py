"""Rules over fields, and JSON objects by key: hand-made rows."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions import objects
from tidemark.operators import rules

LONG = "x " * 1999


@pytest.mark.parametrize("title,source,body,verdict,reason", [
    ("Monetary policy decisions", "Press", None, "policy", "layer1:policy"), ("Digital euro report", "Press", "inflation fell", "operational", "layer1:operational (digital euro|digital dollar|)"),
    ("Digital euro and inflation", "Press", "", "policy", "layer1:policy"), ("A lecture", None, "on r-star", "policy", "layer1:policy"), ("A lecture", "Podcast", "on bank lending", "macro-adjacent", "layer1:macro-adjacent"),
    ("A lecture", "x", LONG + "inflation", "operational", "layer1:no-policy-content"), ("A lecture", "x", LONG[:-10] + "inflation", "policy", "layer1:policy"), (None, None, None, "operational", "layer1:no-policy-content"),
    ("MINUTES", "", "", "policy", "layer1:policy"), ("Award and banknotes", "", "debt", "operational", "layer1:operational (banknote|coin|counterfeit|cu)"),
])
def test_relevance(spark, title, source, body, verdict, reason):
    lit = lambda x: F.lit(x).cast("string")
    got = spark.range(1).select(rules.relevance(lit(title), lit(source), lit(body)).alias("r")).first().r
    assert (got.verdict, got.reason) == (verdict, reason)


#: bank, address, source, title, statistical, expected.
STATEMENTS = [
    ("FED", "https://www.federalreserve.gov/x", "FOMC Statement", "Statement", False, True), ("FED", "https://federalreserve.gov/x", "FOMC Statement", "Statement", False, False), ("FED", "https://www.federalreserve.gov/x", "FOMC Statement", "Minutes", False, False),
    ("FED", "https://www.federalreserve.gov/x", "FOMC Statement", "S", True, False), ("ECB", "https://www.ecb.europa.eu/press/pr/x", "ECB", "Monetary policy decisions", False, True), ("ECB", "https://www.ecb.europa.eu/press/press_conference/monetary-policy-statement/2024/x", "ECB", "Opening", False, True),
    ("ECB", "https://WWW.ecb.europa.eu/y", "ECB", "Monetary policy statement", False, True), ("ECB", "https://www.federalreserve.gov/x", "FOMC Statement", "S", False, False), ("ECB", None, "ECB", "Monetary policy decisions", False, False), ("ECB", "no address", "ECB", "Monetary policy decisions", False, False),
    ("BOE", "https://www.ecb.europa.eu/y", "ECB", "Monetary policy statement", False, False), ("FED", "https://www.federalreserve.gov/press_conference/monetary-policy-statement/", "x", "y", False, False),
]


def test_official_statements(spark):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(STATEMENTS)], "i int, bank string, url string, source string, title string, stat boolean, want boolean")
    wrong = df.where(rules.is_statement(F.col("bank"), F.col("url"), F.col("title"), F.col("source"), F.col("stat")) != F.col("want"))
    assert wrong.collect() == []


#: source, title, decision, projections, policy document, survey.
DOCUMENTS = [
    ("FOMC Statement", "Federal Reserve issues FOMC statement", True, False, True, False), ("ECB Press", "Monetary policy decisions", True, False, True, False), ("ECB Press Conf", "Monetary policy decisions", False, False, True, False),
    ("FOMC SEP", "June", False, True, True, False), ("X", "Summary of Economic Projections", False, True, False, False), ("Speech", "A speech", False, False, False, False), ("FOMC", "Statement", True, False, True, False), ("meeting", "of", False, False, False, False),
    ("ECB", "Survey of  Professional Forecasters", False, False, False, True), ("Interview", "On the bank lending survey", False, False, False, False), ("Fed", "Survey shows easier lending", False, False, False, True), ("Fed", "Credit in the latest survey", False, False, False, True),
    ("Fed", "Survey. Then lending", False, False, False, False), ("Fed", "Surveys of lending", False, False, False, False),
]


def test_document_classes(spark):
    df = spark.createDataFrame(DOCUMENTS, "source string, title string, decision boolean, sep boolean, policy boolean, survey boolean")
    t, s = F.col("title"), F.col("source")
    got = df.select("source", "title", rules.is_decision(t, s), rules.is_projection(t, s), rules.is_policy_document(t, s), rules.is_survey(t, s)).collect()
    assert [tuple(r) for r in got] == DOCUMENTS


def test_the_first_rule_wins_and_null_fields_are_empty(spark):
    some = [rules.Rule("a", "x", ("one",), "r1", unless=("not",), unless_field="y"), rules.Rule("b", "y", ("two", "one"), "r2"), rules.Rule("c", "x", (), "rest", only=(("y", "z"),))]
    df = spark.createDataFrame([("ONE", None), ("one", "not two"), (None, "z"), ("q", None), ("one", "one")], "x string, y string")
    got = df.select(rules.classify(some, {"x": F.col("x"), "y": F.col("y")}, ("d", "none")).alias("r")).collect()
    assert [tuple(r.r) for r in got] == [("a", "r1", 0), ("b", "r2", 1), ("c", "rest", 2), ("d", "none", -1), ("a", "r1", 0)]


def patched(old, new, depth):
    """A merge by plain dictionaries."""
    out = {k: v for k, v in old.items() if k not in new}
    for k, v in new.items():
        if v is not None:
            out[k] = patched(old[k], v, depth - 1) if depth and isinstance(v, dict) and isinstance(old.get(k), dict) else v
    return out


@pytest.mark.parametrize("depth", [0, 1, 3])
def test_merge_of_objects(spark, depth):
    pairs = [
        ({"a": 1, "unknown": [1, {"x": None}], "o": {"p": 1, "q": {"r": 1, "s": 2}}}, {"b": "two", "o": {"q": {"s": None, "t": 3}}, "a": None}), ({}, {"a": 1}), ({"a": {"b": 1}}, {}), ({"a": {"b": 1}}, {"a": 5}), ({"a": 5}, {"a": {"b": 1}}),
        ({"k": "é'", "n": 1.5, "t": True}, {"z": None, "n": {"deep": {"deeper": 1}}}),
    ]
    df = spark.createDataFrame([(json.dumps(a), json.dumps(b)) for a, b in pairs], "a string, b string")
    got = [json.loads(r.m) for r in df.select(objects.merge(F.col("a"), F.col("b"), depth).alias("m")).collect()]
    assert got == [patched(a, b, depth) for a, b in pairs]


def test_no_objects_and_moves(spark):
    one = lambda c: json.loads(spark.range(1).select(c.alias("v")).first().v)
    assert one(objects.merge(F.lit(None).cast("string"), F.lit('{"a":1}'))) == {"a": 1} == one(objects.merge(F.lit("[1]"), F.lit('{"a":1}')))
    assert one(objects.move(F.lit('{"a":1,"b":2,"old":{"c":3,"a":0}}'), ("a", "z"), "old")) == {"b": 2, "old": {"c": 3, "a": 1}}
    assert one(objects.move(F.lit('{"b":2}'), ("a",), "old")) == {"b": 2} and one(objects.without(F.lit('{"a":1,"b":{"c":null}}'), ("a",))) == {"b": {"c": None}}
    assert one(objects.move(F.lit('{"a":1,"old":7}'), ("a",), "old")) == {"old": {"a": 1}}
