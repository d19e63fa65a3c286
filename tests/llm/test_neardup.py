import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from collisions import thue_morse
from tidemark.llm import graph, neardup, support, toxicity


def brute(rows, n=3, percent=85):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, _) in enumerate(rows):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                x, y = find(a), find(rows[j][0])
                root[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i), i == find(i)) for (i, _), s in zip(rows, sets))


def near_rows(seed, groups=6, copies=25, words=60):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeF") for _ in range(5))
    out = []
    for _ in range(groups):
        base = [word() for _ in range(words + r.randrange(40))]
        for _ in range(copies):
            mine = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5])):
                mine[r.randrange(len(mine))] = word()
            if r.random() < 0.2:
                mine = mine[: len(mine) - r.randrange(8)]
            out.append(" ".join(mine))
    out += ["", None, " \n", "one two", "One\ttwo", "a", "a", "x y z", "x y z w"] + [" ".join(word() for _ in range(30)) for _ in range(20)]
    r.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("seed,small,rare", [(1, 32, 64), (2, 4, 64), (3, 4, 1), (4, 4, 3)])
def test_components_are_brute_force(spark, monkeypatch, seed, small, rare):
    monkeypatch.setattr(neardup, "SMALL", small)
    monkeypatch.setattr(neardup, "RARE", rare)
    rows = near_rows(seed)
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, size int, node string")
    got = sorted(tuple(x) for x in neardup.near_duplicates(docs).collect())
    assert got == brute(rows)


def test_words_that_polynomial_hashes_confuse(spark):
    rows = list(enumerate([*thue_morse(1024), *thue_morse(2048), *thue_morse(70_000)]))
    got = sorted(tuple(x) for x in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(i, 1, i, True) for i in range(6)]


def test_pairs_are_checked_on_words(monkeypatch):
    """Whatever hashes say, common_grams() compares words."""
    monkeypatch.setattr(support, "string_hashes", lambda strings: [0] * len(strings))
    one, two = pa.array(["a b c d", "a A a a a", "p q r"]), pa.array(["x B C D e", "A a a", "r q p"])
    assert [x.tolist() for x in neardup.common_grams(one, two, 3)] == [[2, 1, 1], [3, 1, 1], [1, 1, 0]]


@pytest.mark.parametrize("how", ["inner", "left"])
def test_spread_joins(spark, monkeypatch, how):
    monkeypatch.setattr(support, "LEAST_HEAVY", 5)
    rows = spark.createDataFrame([(7, i) for i in range(40)] + [(i, i) for i in range(20)] + [(None, 1)], "k long, v long")
    lookup = spark.createDataFrame([(i, f"t{i}") for i in range(15)], "k long, t string")
    heavy = support.heavy_keys(rows, "k")
    assert [x.k for x in heavy.collect()] == [7]
    order = lambda df: sorted((tuple(x) for x in df.select("k", "v", "t").collect()), key=str)
    assert order(support.join_spread(rows, lookup, ["k"], heavy, how)) == order(rows.join(lookup, "k", how))


def test_odd_rows(spark):
    rows = [(1, "a b c d"), (1, "p q r s"), (2, "A B c d"), (3, "p q r s"), (None, "a b c d"), (4, None)]
    got = sorted(tuple(x) for x in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id is not null").collect())
    assert got == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (4, 0, 4, True)]
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_stage_of_the_pipeline_is_brute_force(spark):
    """A block of 22 words behind 100 (five-word similarity 0.814, three-word 0.817) is a copy; 5
    scattered words of 200 (0.774 and 0.859) make another document."""
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdef") for _ in range(8))
    texts = []
    for _ in range(5):
        base, other = [word() for _ in range(100)], [word() for _ in range(200)]
        scattered = [word() if i in (20, 60, 100, 140, 180) else w for i, w in enumerate(other)]
        texts += [" ".join(x) for x in (base, base + [word() for _ in range(22)], other, scattered)]
    rows = list(enumerate(texts))
    left = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    got = {x.doc_id for x in left.collect()}
    assert got == {i for i, _, _, kept in brute(rows, 5, 80) if kept} == {i for i, _ in rows if i % 4 != 1}


def test_least_matches_lose_little():
    least = neardup.least_matches(0.85, 96, 16, 1e-6)
    r = random.Random(0)
    lost = 0
    for _ in range(20_000):
        equal = [r.random() < 0.85 for _ in range(96)]
        lost += any(sum(equal[: 16 * (i + 1)]) < m for i, m in enumerate(least))
    assert lost == 0 and least[0] > 0


def test_contraction(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(r.randrange(200, 300), r.randrange(200, 300)) for _ in range(70)]
    got = {x.node: x.root for x in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[find(a)] = find(b)
    pairs = {(find(x), got[x]) for x in got}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


@pytest.mark.parametrize("most", [1024, 1 << 24])
def test_texts_are_sifted_before_they_are_shuffled(spark, monkeypatch, most):
    """Of texts that no candidate has few are shuffled, whatever their number; none of a candidate is lost."""
    monkeypatch.setattr(support, "SIEVE", most)
    rows = spark.range(20_000).selectExpr("IF(id % 7 = 0, NULL, id) AS id", "id * 3 AS mark", "repeat('x', 9) AS text")
    wanted = spark.range(0, 20_000, 50).selectExpr("id", "id * 3 AS mark")
    got = support.sift(rows, wanted, ["id", "mark"])
    kept = {x.id for x in got.collect()}
    assert got.columns == rows.columns and kept >= {i for i in range(0, 20_000, 50) if i % 7} and len(kept) < (10_000 if most == 1024 else 2_500)
    plan = got.join(wanted, ["id", "mark"])._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert next(i for i, x in enumerate(plan) if "Join" in x) < next(i for i, x in enumerate(plan) if "__word" in x and "Join" in x)  # the exact join is outside
    assert support.sift(rows, wanted.limit(0), ["id", "mark"]).count() == 0


def test_near_dedup_sifts_texts(spark, monkeypatch):
    calls = []
    real = support.sift
    monkeypatch.setattr(neardup, "sift", lambda *a: calls.append(1) or real(*a))
    rows = [(i, " ".join(f"w{(i // 2 * 100 + j)}" for j in range(40))) for i in range(60)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert calls and {x.doc_id: x.component_id for x in got} == {i: i - i % 2 for i in range(60)}


def test_small_tables_are_dealt_anew(spark):
    """Each partition of what is cut has a task of its own, which gives its memory back; a coalesced one would go through several."""

    def task(batches):
        from pyspark import TaskContext

        for _ in batches:
            yield pa.RecordBatch.from_pydict({"task": pa.array([TaskContext.get().partitionId()], pa.int64())})

    got = support.cut_small(spark.range(0, 40, 1, 40).mapInArrow(task, "task long"))
    assert sorted(x.task for x in got.collect()) == list(range(40)) and len(got.inputFiles()) <= 8


def test_small_tables_have_few_files(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 211)
    try:
        got = support.cut_small(spark.range(0, 1000, 1, 40))
        assert len(got.inputFiles()) <= 8 and got.count() == 1000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_texts_are_handled_in_small_slices():
    """The memory of a worker that tags 4 MB of texts; all of them are tagged."""
    batch = pa.RecordBatch.from_pydict({"text": ["some Plain words, and a few more. " * 60] * 2000})
    lexicon = toxicity.Lexicon(np.zeros(0, np.uint64), np.zeros(0, np.int64))
    model = toxicity.Model(lexicon, np.zeros(sum(lexicon.blocks())), (0.0, 0.0, 0.0))
    tracemalloc.start()
    tagged = sum(len(model.tag(*support.text_bytes(part.column("text")))[3]) for part in support.slices(iter([batch])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert tagged == 2000 * 60 * 7 and most < 110e6


def test_pairs_meet_nodes_with_candidates_only(spark, monkeypatch):
    met = []
    real = neardup._two
    monkeypatch.setattr(neardup, "_two", lambda nodes, *a, **b: met.append({x.node for x in nodes.select("node").collect()}) or real(nodes, *a, **b))
    same = " ".join(f"s{j}" for j in range(40))
    rows = [(i, " ".join(f"w{i * 100 + j}" for j in range(40))) for i in range(60)] + [(60, same), (61, f"{same} end"), (62, same.upper())]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert met and all(x == {60, 61} for x in met)
    assert {x.doc_id: x.component_id for x in got} == {i: min(i, 60) for i in range(63)}
