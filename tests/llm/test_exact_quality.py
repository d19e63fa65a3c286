import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from collisions import thue_morse
from tidemark.llm import exact, quality
from tidemark.llm.support import text_bytes

ROWS = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "b"), (6, "a"), (6, "a"), (7, "A")]


@pytest.mark.parametrize("keep,fan,rounds", [("min", 2, 3), ("max", 8, 2), ("max", 1, 1), ("max", 8, None)])
def test_exact_duplicates(spark, keep, fan, rounds):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in ROWS], "doc_id long, text string, digest string, run int")
    got = sorted(tuple(r) for r in exact.exact_duplicates(docs, keep=keep, fan=fan, rounds=rounds).collect())
    best, want = (max if keep == "max" else min), []
    for i, t in ROWS:
        same = [a for a, b in ROWS if (b or "") == (t or "")]
        want.append((i, best(same), len(same), i == best(same), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)


def test_exact_duplicates_of_nothing(spark):
    assert exact.exact_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_runs_grow_with_the_rows():
    assert exact.rounds_for(0) == exact.rounds_for(64 * exact.RUN_ROWS) == 2 and exact.rounds_for(10**10) == 5


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    inside = {j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(inside)]


def test_counts_are_brute_force():
    r = random.Random(3)
    some = ["", "  \n ", None, "a", "\n", "\na"] + ["".join(r.choice(["a", "b", " ", "\n", "é#", " a b a b a b a b a b ", " \n\n", " "]) for _ in range(r.randrange(60))) for _ in range(2000)]
    found = quality.text_counts(*text_bytes(pa.array(some)))
    for i, t in enumerate(some):
        assert brute(t) == [int(found[x][i]) for x in quality.COUNTS[:5]]


def test_equal_hashes_are_told_apart(monkeypatch):
    """With a hash that knows nothing, counts stay those of the words."""
    monkeypatch.setattr(quality, "ngram_hashes", lambda hashes, n: np.zeros(max(0, len(hashes) - n + 1), np.uint64))
    some = [" ".join("abcdefghijkl"), " ".join("abcdefgh" * 2), None, "x"]
    found = quality.text_counts(*text_bytes(pa.array(some)))
    assert [brute(t) for t in some] == [[int(found[x][i]) for x in quality.COUNTS[:5]] for i in range(4)]


def test_words_that_polynomial_hashes_confuse():
    found = quality.text_counts(*text_bytes(pa.array(["\n".join(thue_morse(n)) for n in (1024, 2048, 65_536, 131_072)])))
    assert found["n_dup_lines"].tolist() == [0] * 4 and found["n_distinct"].tolist() == [2] * 4


def brute_posterior(patterns, rounds):
    """The same model by plain loops: share of good and posterior of each pattern."""
    rules, total = len(patterns[0][0]), sum(c for _, c in patterns)
    p = [[0.95 if k == r + 1 else 0.002 for r in range(rules)] for k in range(rules + 1)]
    prior = [list(x) for x in p]
    even = 0.001 * total / (rules + 1)
    defects = [sum(c for v, c in patterns if v[r] < 0) + even for r in range(rules)]
    shares = [max(total - sum(defects), 0.1 * total), *defects]
    shares = [x / sum(shares) for x in shares]
    post = []
    for i in range(rounds + 1):
        post = []
        for v, _ in patterns:
            w = [shares[k] * math.prod(p[k][r] if v[r] < 0 else 1 - p[k][r] for r in range(rules) if v[r]) for k in range(rules + 1)]
            post.append([x / sum(w) for x in w])
        if i == rounds:
            break
        mass = [sum(c * q[k] for (_, c), q in zip(patterns, post)) + even for k in range(rules + 1)]
        for k in range(rules + 1):
            for r in range(rules):
                bad = sum(c * q[k] for (v, c), q in zip(patterns, post) if v[r] < 0) + 0.002 * total * prior[k][r]
                good = sum(c * q[k] for (v, c), q in zip(patterns, post) if v[r] > 0) + 0.002 * total * (1 - prior[k][r])
                p[k][r] = bad / (bad + good)
                if k == 0:
                    p[k][r] = min(p[k][r], 0.01)
                if k == r + 1:
                    p[k][r] = max(p[k][r], 0.8)
        shares = [x / sum(mass) for x in mass]
    return [q[0] for q in post]


def test_fit_is_brute_force_and_rises(spark):
    r = random.Random(5)
    patterns = {}
    for _ in range(3000):
        kind = r.choice([0, 0, 0, 0, 1, 2])
        vote = tuple(r.choice([0, 1]) if r.random() < 0.97 and kind != k + 1 else -1 for k in range(4))
        patterns[vote] = patterns.get(vote, 0) + 1
    patterns = sorted(patterns.items())
    shares, p, history = quality.fit(patterns, rounds=7)
    assert len(history) == 7 and all(b >= a - 1e-12 for a, b in zip(history, history[1:]))
    good = lambda v: 1 / (1 + sum(shares[k + 1] / shares[0] * math.prod(p[k + 1][j] / p[0][j] if v[j] < 0 else (1 - p[k + 1][j]) / (1 - p[0][j]) for j in range(4) if v[j]) for k in range(4)))
    assert np.allclose([good(v) for v, _ in patterns], brute_posterior(patterns, 7))
    many = quality.fit(patterns)
    rows = [(i, *v) for i, (v, c) in enumerate(patterns) for _ in range(c)]
    counts = spark.createDataFrame(rows, "doc_id long, a int, b int, c int, d int").withColumns({x: F.lit(20).cast("long") if x == "n_words" else F.lit(0).cast("long") for x in quality.COUNTS})
    got = {x.doc_id: x.quality for x in quality.judge(counts, {x: F.col(x) for x in "abcd"}).collect()}
    assert np.allclose([got[i] for i in range(len(patterns))], brute_posterior(patterns, len(many[2]) - (len(many[2]) < 500)), atol=1e-9)


def test_verdicts(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 8)))
    clean = [" ".join(word() for _ in range(60)) + "." for _ in range(80)]
    marked = [" ".join(word() + "###" for _ in range(60)) for _ in range(6)]
    loud = [" ".join(word().upper() + "!!" for _ in range(60)) for _ in range(6)]
    rows = list(enumerate([*clean, *marked, *loud, None, "", "one two"]))
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_words int")
    kept = {x.doc_id: x.kept for x in quality.judge(quality.count_texts(docs)).collect()}
    assert all(kept[i] for i in range(80)) and not any(kept[i] for i in range(80, len(rows)))


def test_verdicts_on_nothing(spark):
    assert quality.judge(quality.count_texts(spark.createDataFrame([], "doc_id long, text string"))).count() == 0
