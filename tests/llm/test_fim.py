import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.llm import fim


def brute(key, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    lo, hi = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    pre, mid, suf = ("".join(units[a:b]) for a, b in ((0, lo), (lo, hi), (hi, None)))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text, text
    if h[3] % 100 < 20:
        return len(units), "spm", pre, mid, f"<S>{suf}<P>{pre}<M>{mid}", text
    return len(units), "psm", pre, mid, f"<P>{pre}<S>{suf}<M>{mid}", text


def run(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], "doc_id long, text string, units string, form string, lo int")
    out = fim.rearrange(docs)
    out = out.withColumn("restored", fim.restore(F.col("output"), F.col("form")))
    return [(r.doc_id, (r.n, r.form, r.prefix, r.middle, r.output, r.restored)) for r in out.collect()]


def test_arrangements_are_brute_force(spark):
    r = random.Random(5)
    pieces = ["a", "Bc", " ", "\n", "é", "😀", "<", "P", ">", "S>", "<M", "<P>", "1", " ", "$1", "\\", "\0"]
    rows = [(i, "".join(r.choice(pieces) for _ in range(r.randrange(12)))) for i in range(1500)]
    rows += [(None, "no id here"), (7, None), (8, ""), (9, "one"), (9, "one"), (10, " "), (11, "<S"), (12, "x" * 100_000), (13, "ab 😀" * 50_000)]
    got = run(spark, rows)
    key = lambda x: (x[0] is None, x[0], x[1][0], x[1][1], x[1][4])
    want = [(i, brute(i, t)) for i, t in rows]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert {x[1][1] for x in got} == {"plain", "psm", "spm"}


def test_nothing(spark):
    assert run(spark, []) == []


@pytest.mark.parametrize("form", ["psm", "spm"])
def test_other_sentinels_and_shares(spark, form):
    docs = spark.createDataFrame([(i, f"some words, number {i}.") for i in range(50)], "doc_id long, text string")
    marks = ("[pre|", "[suf|", "[mid|")
    out = fim.rearrange(docs, seed=3, plain_from=100, spm_below=100 if form == "spm" else 0, sentinels=marks)
    back = out.select("text", "form", fim.restore(F.col("output"), F.col("form"), marks).alias("back")).collect()
    assert all(r.form == form and r.text == r.back for r in back)


def test_no_python_on_the_way(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    plan = fim.rearrange(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
