import random

import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import fingerprints as fp


def signed(h):
    return h - 2**64 if h >= 2**63 else h


def hashed(text, code="utf-8"):
    return signed(xxhash.xxh64(text.encode(code), seed=42).intdigest())


def joined(a, b):
    """Spark's hash of two numbers: the second's with the first's as seed."""
    one = xxhash.xxh64((a % 2**64).to_bytes(8, "little"), seed=42).intdigest()
    return xxhash.xxh64((b % 2**64).to_bytes(8, "little"), seed=one).intdigest()


def brute(text, k, s, size):
    text = text or ""
    if not text:
        return []
    if len(text) < k:
        return [(hashed(text), 0)]
    h = [hashed(text[i : i + s], "utf-32-be") for i in range(len(text) - s + 1)]
    first = {}
    for i in range(len(text) - k + 1):
        inner = h[i : i + k - s + 1]
        if min(inner) in (inner[0], inner[-1]):
            first.setdefault(signed((min(inner) % 2**64 >> 32 << 32) | joined(inner[0], inner[-1]) % 2**32), i)
    return sorted(first.items())[:size]


def alike(a, b, size):
    a, b = {h for h, _ in a}, {h for h, _ in b}
    if not a or not b:
        return float(not a and not b)
    both = sorted(a | b)[:size]
    return len(set(both) & a & b) / len(both)


def texts(r, many):
    some = ["word", "some", " ", "\n", "é", "😀", "the same passage of some length. ", "x", "1"]
    return ["".join(r.choice(some) for _ in range(r.randrange(60))) for _ in range(many)]


@pytest.mark.parametrize("k,s,size,low,piece", [(16, 9, 64, 96, 16_384), (6, 3, 5, 3, 7), (4, 2, 1000, 20, 20), (2, 1, 8, 1, 1), (16, 9, 8, 1, 60)])
def test_anchors_are_brute_force(spark, k, s, size, low, piece):
    r = random.Random(k)
    some = [None, "", "a", "a" * k, "a" * 200, "ab" * (k // 2), "😀" * 40, *texts(r, 150)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(some)], "doc_id long, text string")
    got = dict(docs.select("doc_id", fp.anchors(F.col("text"), k, s, size, low, piece).alias("a")).collect())
    for i, t in enumerate(some):
        assert [tuple(x) for x in got[i]] == brute(t, k, s, size), t


def expected(rows):
    turn = sorted(rows, key=lambda x: (x[0] is None, -(x[0] or 0), hashed(x[1] or "")))
    out = []
    for i, (doc, text) in enumerate(turn):
        text, after = text or "", turn[(i + 1) % len(turn)][1] or ""
        half = len(text) // 2
        changed = text[: len(text) - half] + after[:half]
        a, b, c = (brute(t, fp.K, fp.S, fp.SIZE) for t in (text, changed, after))
        show = lambda x: " ".join(f"{h % 2**64:016X}:{at:X}" for h, at in x)
        out.append((doc, len(text), changed, show(a), show(b), round(alike(a, b, fp.SIZE), 9), round(alike(a, c, fp.SIZE), 9)))
    return sorted(out, key=str)


@pytest.mark.parametrize("buckets", [1, 4, 150])
def test_comparison_is_brute_force(spark, buckets):
    r = random.Random(buckets)
    rows = [(r.randrange(10**6) if i % 9 else i % 27 // 9, t) for i, t in enumerate(texts(r, 150))] + [(None, "no id"), (None, None), (None, "no id, too"), (-5, "z" * 40_000), (7, ""), (10**12, None), (8, "same same same same"), (8, "same same same same")]
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id long, text string, keys string, h int, bucket int")
    got = [(x.doc_id, x.n_chars, x.edited, x.fingerprint, x.edited_fingerprint, round(x.near_edited, 9), round(x.near_next, 9)) for x in fp.compare(docs, buckets).collect()]
    assert sorted(got, key=str) == expected(rows)


@pytest.mark.parametrize("many", [0, 1, 63, 64, 65, 130, 1000])
def test_places_among_limits(spark, many):
    limits = sorted(random.Random(many).sample(range(5000), many), reverse=True)
    got = spark.range(0, 5000, 7).select("id", F.col("id").alias("doc_id")).select("id", fp.later(limits).alias("n")).collect()
    assert all(r.n == sum(r.id < x for x in limits) for r in got)


def test_one_document_and_none(spark):
    docs = spark.createDataFrame([(3, "abcdefg")], "doc_id long, text string")
    (only,) = fp.compare(docs).collect()
    assert only.edited == "abcdabc" and only.near_next == 1
    assert fp.compare(docs.where("false")).collect() == []


def test_places_tell_the_shift(spark):
    r = random.Random(4)
    body = "".join(r.choice("abcdefghijklm ") for _ in range(900))
    one = spark.createDataFrame([(body, "inserted: " + body), (body, body), (body, "nothing of it")], "a string, b string")
    found = [r.m for r in one.select(fp.shift(fp.anchors(F.col("a")), fp.anchors(F.col("b"))).alias("m")).collect()]
    assert found[0].shift == 10 and found[0].aligned > 50 and tuple(found[1]) == (0, 64) and found[2] is None


def test_no_python_on_the_way(spark):
    plan = fp.compare(spark.createDataFrame([(1, "a b")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
