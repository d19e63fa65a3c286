"""Groups of copies: hand-made speeches, and components against a plain union-find."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import evidence

BIS = ("FED", "2026-09-29", "Member Speech (BIS)", "John C Williams: Unwavering dedication", "https://www.bis.org/speeches/x", False)
FED = ("FED", "2026-09-29", "Member Speech (Fed site)", "John C. Williams: Unwavering Dedication", "https://www.newyorkfed.org/newsevents/x", False)
COLUMNS = "bank string, day string, source string, title string, url string, stat boolean"


def grouped(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + COLUMNS)
    key = evidence.speech_of(F.col("bank"), F.col("day"), F.col("source"), F.col("title"), F.col("stat"))
    df = df.withColumn("key", key).withColumn("g", F.coalesce("key", F.concat(F.lit("#"), F.col("i").cast("string"))))
    found = evidence.with_primary(df, "g", "i", evidence.is_original(F.col("bank"), F.col("url"))).collect()
    return sorted((r.copies, r.primary, r.is_original) for r in found)


def changed(row, **to):
    names = ["bank", "day", "source", "title", "url", "stat"]
    return tuple(to.get(n, v) for n, v in zip(names, row))


def test_two_copies_are_one_and_the_publisher_is_first(spark):
    assert grouped(spark, [BIS, FED]) == [(2, 1, True)] and grouped(spark, [FED, BIS]) == [(2, 0, True)]
    assert grouped(spark, [BIS, BIS]) == [(2, 0, False)]


def test_others_stay_apart(spark):
    others = [BIS, changed(FED, title="Christopher Waller: Unwavering dedication"), changed(FED, day="2026-09-30"), changed(FED, bank="ECB"), changed(FED, title="John C. Williams: Do You Remember?")]
    assert len(grouped(spark, others)) == 5
    for to in ({"source": "FOMC Minutes"}, {"source": "FOMC Statement"}, {"stat": True}, {"title": "Unwavering dedication"}, {"title": "J: x"}, {"title": "A" * 61 + ": x"}, {"title": "Jane Roe: ?!"}):
        row = changed(BIS, **to)
        assert len(grouped(spark, [row, changed(row, url=FED[4])])) == 2


def test_compatibility_forms_and_blanks(spark):
    assert len(grouped(spark, [changed(BIS, title="Jane Roe: The ﬁrst  ½ of it"), changed(BIS, title="jane roe:the first 1⁄2 of it!"), changed(BIS, title=" Jane  Roe : THE FIRST 1⁄2 OF IT")])) == 1


@pytest.mark.parametrize("bank,url,want", [("FED", "https://federalreserve.gov/a", True), ("FED", "https://www.FederalReserve.gov/a", True), ("FED", "https://notfederalreserve.gov", False), ("FED", "https://x.frbsf.org/", True), ("FED", "https://www.ecb.europa.eu", False), ("ECB", "https://www.ecb.europa.eu/x", True), ("ECB", "nothing", False), ("ECB", None, False), ("BOE", "https://ecb.europa.eu", False)])
def test_original_publishers(spark, bank, url, want):
    assert spark.range(1).select(evidence.is_original(F.lit(bank), F.lit(url).cast("string")).alias("v")).first().v is want


def test_groups_are_components(spark):
    r = random.Random(3)
    rows = [(i, [f"a{r.randrange(150)}", None if i % 3 else f"b{r.randrange(90)}"] if i % 5 else []) for i in range(200)]
    rows += [(1000 + i, [f"chain{i}", f"chain{i + 1}"]) for i in range(60)] + [(2000 + i, ["hot"]) for i in range(80)]
    r.shuffle(rows)
    up = {i: i for i, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    seen = {}
    for i, keys in rows:
        for k in keys:
            if k is not None:
                a, b = find(i), find(seen.setdefault(k, i))
                up[max(a, b)] = min(a, b)
    got = {x.i: x.group for x in evidence.groups(spark.createDataFrame(rows, "i long, keys array<string>"), "i", "keys").collect()}
    assert got == {i: find(i) for i, _ in rows}
    assert evidence.groups(spark.createDataFrame([], "i long, keys array<string>"), "i", "keys").collect() == []
