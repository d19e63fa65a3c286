"""Verification and resolution of remarks: hand-made articles."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark.operators import remarks

FILL = "This filler sentence has nothing of any interest in it. " * 18
GOOD = FILL + "Jane Roe spoke about inflation on Monday in Vienna today. She said that interest rates will stay high for long. Roe then left for the airport and home."
WEAK = FILL + "Jane Roe spoke about flowers on Monday in Vienna today. Roe then left for the airport and home again."
DAY = dt.date(2024, 3, 1)


def test_attributed_sentences(spark):
    text = "Roe spoke to us about the new rules. He added that much more was to come soon. Nobody else was there at the time. She said this is not from the speaker. ROE was named here in capital letters again. “A quotation that goes on for six words” he said. They left the room after the long talk. Others said the same in the other room. Roesler is another person with another name here."
    got = spark.createDataFrame([(text,)], "t string").select(remarks.attributed(F.col("t"), F.lit("Roe")).alias("a")).first().a
    assert [s.split()[0] for s in got] == ["Roe", "He", "ROE", "“A", "They"]


def test_the_first_failing_test_is_the_reason(spark):
    rows = [
        (1, GOOD, "Roe", ["inflation", "vienna"]), (2, "Roe Roe Roe", "Roe", ["a"]), (3, FILL, "Roe", ["a"]), (4, GOOD, "Roe", ["budget", "tulip", "vienna"]), (5, GOOD, "Roe", ["budget"]), (6, WEAK, "Roe", ["vienna", "flowers"]), (7, None, "Roe", []),
        (8, GOOD.replace("Jane Roe", "Jane Roe, Roe"), "Roe", []), (9, GOOD, "R.e", ["vienna"]), (10, GOOD, "ROE", ["vienna", "tulip"]),
    ]
    got = {r.i: r.reason for r in remarks.verified(spark.createDataFrame(rows, "i int, text string, name string, keywords array<string>")).collect()}
    assert got == {1: "verified", 2: "too short", 3: "speaker not named", 4: "headline words missing", 5: "headline words missing", 6: "nothing on policy", 7: "too short", 8: "verified", 9: "speaker not named", 10: "verified"}


def test_stages(spark):
    key = ["inflation", "vienna"]
    base = [
        (1, DAY, "Roe", key, "https://a/good"), (2, DAY, "Roe", key, "https://a/weak"), (3, dt.date(2023, 1, 1), "Roe", key, "https://a/weak"), (4, dt.date(2023, 1, 1), "Roe", key, None), (5, DAY, "Poe", key, None), (6, DAY, None, key, "https://a/good"),
        (7, dt.date(2024, 2, 20), "Roe", key, "no address"), (8, DAY, "Noe", key, "https://a/gone"),
    ]
    found = [("Roe", dt.date(2024, 3, 3), m, a) for m, a in ((5, "https://s/1"), (4, "https://s/2"), (4, "https://s/2"), (3, "https://s/3"), (2, "https://a/good"))] + [("Roe", dt.date(2024, 2, 22), 1, "https://s/late")]
    pages = [("https://a/good", GOOD), ("https://a/weak", WEAK), ("https://s/1", WEAK), ("https://s/2", None), ("https://s/3", GOOD), ("https://s/late", GOOD)]
    df = spark.createDataFrame(base, "id int, day date, name string, keywords array<string>, url string")
    hits = spark.createDataFrame(found, "name string, seen date, merit int, address string")
    got = {r.id: (r.via, r.url, r.reason) for r in remarks.resolve(df, spark.createDataFrame(pages, "address string, text string"), hits, F.lit(dt.date(2024, 4, 1))).collect()}
    assert got == {
        1: ("own address", "https://a/good", "verified"), 2: ("search", "https://s/3", "verified"), 3: (None, None, "nothing on policy"), 4: (None, None, "too old to search"), 5: (None, None, "no articles found"), 6: (None, None, "no speaker"),
        7: ("search", "https://s/late", "verified"), 8: (None, None, "no articles found"),
    }
