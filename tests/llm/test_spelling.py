import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm import registry, spelling
from tidemark.llm.wavelet import WaveletTree


def test_reports_are_brute_force():
    r = np.random.default_rng(1)
    for n in (1, 2, 7, 64, 500):
        values = r.permutation(n) if n % 2 else r.integers(0, n, n)
        lo, low = r.integers(0, n, 200), r.integers(0, n, 200)
        hi, high = lo + r.integers(0, n, 200), low + r.integers(0, n, 200)
        hi = np.minimum(hi, n)
        query, found = WaveletTree(values).report(lo, hi, low, high)
        got = sorted(zip(query.tolist(), found.tolist()))
        assert got == sorted((q, int(v)) for q in range(200) for v in values[lo[q] : hi[q]] if low[q] <= v < high[q])


def brute(counts, factor=10):
    wild, less = defaultdict(set), defaultdict(set)
    for w in counts:
        for i in range(len(w)):
            wild[w[:i], w[i + 1 :]].add(w)
            less[w[:i] + w[i + 1 :]].add(w)
    near = {}
    for w in counts:
        some = set().union(*(wild[w[:i], w[i + 1 :]] for i in range(len(w)))) | less[w] | {w[:i] + w[i + 1 :] for i in range(len(w))} & set(counts)
        near[w] = some - {w}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= factor * n else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), counts.get(form[w])))
    return sorted(out)


def run(spark, counts, **terms):
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    return sorted(tuple(r) for r in spelling.variants(words, **terms).select("word", "form", "root", "n", "n_near", "form_n").collect())


@pytest.mark.parametrize("cells", [60, 400_000])
def test_variants_are_brute_force(spark, cells, monkeypatch):
    """Small groups, so that hot beginnings and endings are cut down to single places, and large ones."""
    r = random.Random(cells)
    monkeypatch.setattr(spelling, "CELLS", cells)
    monkeypatch.setattr(spelling, "RECTANGLES", 50)
    words = {"".join(r.choice("aab") for _ in range(r.randrange(7, 10))) for _ in range(250)}
    words |= {"samebeginning" + "".join(r.choice("abcdefé") for _ in range(3)) for _ in range(120)}
    words |= {"".join(r.choice("abcdefé") for _ in range(3)) + "sameending" for _ in range(120)}
    words |= {"ab" * 60 + x + "ba" * 60 for x in ("", "a", "b", "c", "ab")}
    counts = {w: r.choice([2, 3, 20, 200, 2000, 20000]) for w in words}
    assert run(spark, counts, cells=cells) == brute(counts)


def test_chains_lead_to_the_last_form(spark):
    counts = {"a" * (7 + i): 10**i for i in range(9)}
    got = run(spark, counts)
    assert got == brute(counts) and {x[2] for x in got} == {"a" * 15}


def brute_words(rows):
    found = Counter()
    for i, text in rows:
        for run_ in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m.group().lower(), run_)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 7:
                found[w] += 1
    return {w: n for w, n in found.items() if n >= 2}


def test_words_are_brute_force(spark):
    r = random.Random(2)
    some = ["Ärztliche", "ÀÉPreuve", "straße×mitte", "ordinary", "Ordinary", "short", "o'clockwise", "naïvement", "x" * 3000, "sixsix"]
    rows = [(i, " ".join(r.choice(some) for _ in range(r.randrange(30)))) for i in range(400)] + [(None, "ordinary ordinary"), (3, None), (4, ""), (5, "again again-again"), (5, "again again-again")]
    docs = spark.createDataFrame([(i, t, "w", 1, 2) for i, t in rows], "doc_id long, text string, word string, n int, run int")
    assert {r.word: r.n for r in spelling.lexicon(docs).collect()} == brute_words(rows)


def test_no_words(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(spelling.lexicon(docs)).collect() == []
    assert run(spark, {"onlyone": 2}) == [("onlyone", None, "onlyone", 2, 0, None)]


def test_query_is_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in registry.op12_spelling(spark, folder).select("word", "form", "root", "n", "n_near", "form_n").collect())
    assert got == brute(brute_words(rows))
