import datetime as dt
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import numerics, text
from tidemark.operators import changepoint, dedup, drift, index, joins, regression, scoring, weights
from tidemark.sources import documents, feeds, sinks
from tidemark.streaming import events as streams

DAY = dt.date(2024, 1, 31)


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_rounding_is_towards_plus_infinity(spark):
    assert [one(spark, numerics.round_up(F.lit(x), 0)) for x in (2.5, -2.5, -2.51)] == [3.0, -2.0, -3.0]
    assert one(spark, numerics.round_up(F.lit(0.0005), 3)) == 0.001


def test_band_jumps_at_one(spark):
    score = lambda v: one(spark, numerics.band_score(F.lit(v), F.lit(30.0), F.lit(70.0)))
    assert score(50.0) == 0 and score(90.0) == 1.0 and score(90.4) == pytest.approx(1 - 0.05 / 1.01) and score(-1e9) == pytest.approx(-1.0)


def test_labels(spark):
    got = [one(spark, numerics.five_levels(F.lit(x))) for x in (-0.5, -0.1, 0.1, 0.11, 0.5)]
    assert got == ["very dovish", "neutral", "neutral", "hawkish", "very hawkish"]


@pytest.mark.parametrize("days,want", [((0,), 7), ((5,), 7), ((6,), 10), ((14,), 10), ((15, -5), 8), ((15, -6), 21), ((-1,), 8)])
def test_half_life(spark, days, want):
    rows = [("X", DAY + dt.timedelta(d), 0) for d in days]
    assert weights.half_lives(spark.createDataFrame(rows, "bank string, meeting date, bps int"), F.lit(DAY)).first()["half_life"] == want


def brute_cap(rows, exempt, share=0.10):
    w = [r[3] for r in rows]
    for _ in range(5):
        total, sums = sum(w), {}
        for r, x in zip(rows, w):
            if not r[1] and r[2] != exempt:
                sums[r[2]] = sums.get(r[2], 0) + x
        limit = share * total
        w = [x * limit / sums[r[2]] if total > 0 and sums.get(r[2], 0) > limit + 1e-9 and not r[1] and r[2] != exempt else x for r, x in zip(rows, w)]
    return w


def test_cap_is_the_row_method(spark):
    r = np.random.default_rng(3)
    rows = [(i, bool(r.random() < 0.2), int(r.integers(0, 6)), float(r.random())) for i in range(60)] + [(99, False, 1, 30.0)]
    df = spark.createDataFrame([("X", *x) for x in rows], "bank string, id int, is_statistical boolean, speaker int, weight double")
    got = {x.id: x.weight for x in weights.cap_speakers(df, ["bank"], exempt=5).collect()}
    assert [got[x[0]] for x in rows] == pytest.approx(brute_cap(rows, 5))


def test_alpha(spark):
    value = lambda t, s, h: one(spark, index.alpha(F.lit(t).cast("double"), F.lit(s).cast("double"), F.lit(h)))
    assert value(None, 1, 21) == 0 and value(1, None, 21) == 1 and value(0, 14, 21) == 0.8 and value(0, 14, 10) == 0.85 and value(30, 0, 21) == 0.4


def test_anchor_is_limited(spark):
    rows = [("X", DAY - dt.timedelta(d), 75) for d in (0, 1, 2)] + [("Y", DAY - dt.timedelta(181), 75), ("Y", DAY, 25)]
    got = {x.bank: x.anchor for x in index.anchors(spark.createDataFrame(rows, "bank string, meeting date, bps int"), DAY).collect()}
    assert got == {"X": 0.7, "Y": 0.45}


def test_asof_is_a_scan(spark):
    r = np.random.default_rng(1)
    left = [(int(k), int(t)) for k, t in zip(r.integers(0, 3, 50), r.integers(0, 40, 50))]
    right = sorted({(int(k), int(t)) for k, t in zip(r.integers(0, 3, 20), r.integers(0, 40, 20))})
    a = spark.createDataFrame([(i, *x) for i, x in enumerate(left)], "id int, k int, t int")
    b = spark.createDataFrame([(k, t, t * 10) for k, t in right], "k int, m int, v int")
    for strict in (False, True):
        got = {x.id: x.v for x in joins.asof(a, b, ["k"], "t", "m", ["v"], strict).collect()}
        for i, (k, t) in enumerate(left):
            want = [m * 10 for kk, m in right if kk == k and (m < t if strict else m <= t)]
            assert got[i] == (max(want) if want else None)


def test_similar_sets_are_brute_force(spark):
    r = np.random.default_rng(2)
    sets = [sorted({int(x) for x in r.integers(0, 12, r.integers(1, 10))}) for _ in range(80)]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "id int, s array<int>")
    got = {(x.a, x.b) for x in joins.similar_sets(df, "id", "s", 0.8).collect()}
    assert got == {(i, j) for i in range(80) for j in range(i + 1, 80) if len(set(sets[i]) & set(sets[j])) >= 0.8 * len(set(sets[i]) | set(sets[j]))}


def test_regressions_by_regime(spark):
    r = np.random.default_rng(4)
    x, z = r.normal(size=40), r.normal(size=40)
    y = 0.6 + 0.5 * x - 0.3 * z + 0.1 * r.normal(size=40)

    def fit(some):
        a = np.stack([np.ones(some.sum()), x[some], z[some]], axis=1)
        b, *_ = np.linalg.lstsq(a, y[some], rcond=None)
        rest = y[some] - a @ b
        return [some.sum(), *b, np.sqrt((rest**2).sum() / (some.sum() - 3)), 1 - (rest**2).sum() / ((y[some] - y[some].mean()) ** 2).sum()]

    df = spark.createDataFrame([tuple(map(float, v)) for v in zip(y, x, z)], "y double, x double, z double")
    for least, normal in ((12, y >= 0.5), (41, y > -9)):
        got = {v.regime: list(v)[1:] for v in regression.two_regimes(df, "y", "x", "z", 0.5, least).collect()}
        assert got["normal"] == pytest.approx(fit(normal)) and got["low"] == pytest.approx(fit(y < 0.5))
    same = regression.ols_two(spark.createDataFrame([(1.0, 1.0, 2.0), (2.0, 2.0, 4.0)], "y double, x double, z double"), [], "y", "x", "z").first()
    assert same.b_x is None and same.n == 2


def test_the_preferred_item_of_an_address(spark):
    day = dt.date(2024, 1, 2)
    rows = [(1, "https://a.org/de/x", "T", "Press", 9), (2, "https://www.a.org/en/x", "T", "Press Conf", 1), (3, "https://a.org/en/x?y", "T", "Press", 1), (4, None, "Hello (with Q&A)", "A", 5), (5, "", "hello ", "B", 7), (6, None, "Hello", "B", 7)]
    df = spark.createDataFrame([("X", day, *r) for r in rows], "bank string, item_date date, id int, url string, title string, source string, word_count int")
    assert sorted(x.id for x in dedup.dedup_items(df, "id").collect()) == [3, 4]


def test_drift_of_three_or_more(spark):
    rows = [("a", i, v) for i, v in enumerate([0.5, 0.5, -0.5, -0.5, -0.5, -0.5])] + [("b", 0, 1.0), ("b", 1, 0.0)]
    got = {x.g: x for x in drift.narrative(spark.createDataFrame(rows, "g string, t int, s double"), ["g"], "s", ["t"]).collect()}
    assert got["a"].pivot == pytest.approx(0.9 - 0.0) and got["a"].latest == pytest.approx(-0.3) and got["b"].slope is None and got["b"].pivot is None


def test_change_points():
    days = [DAY + dt.timedelta(i) for i in range(40)]
    flat, count = np.zeros(40), np.full(40, 3)
    assert changepoint.change_points(days, flat, count) == []
    step = np.where(np.arange(40) < 20, -0.5, 0.5)
    found = changepoint.change_points(days, step, count)
    assert found and all(k in ("regime_shift", "tone_reversal", "guidance_change") for _, k, *_ in found)
    assert all((b[0] - a[0]).days >= 7 for a, b in zip(found, found[1:]))
    assert changepoint.change_points(days[:4], step[:4], count[:4]) == []


#: Sentences of the kind the decision reader must understand: direction and basis points.
DECISIONS = [
    ("The Committee decided to raise the target range for the federal funds rate by 1/2 percentage point.", 1, 50.0),
    ("The Committee decided to lower the target range for the federal funds rate to 4 to 4-1/4 percent.", -1, 25.0),
    ("The Governing Council decided to raise the key ECB interest rates by 75 basis points.", 1, 75.0),
    ("The Governing Council decided to cut the three key ECB interest rates by 50 basis points.", -1, 50.0),
    ("The Committee decided to maintain the target range for the federal funds rate.", 0, 0.0),
    ("The Governing Council decided to keep the key ECB interest rates unchanged.", 0, 0.0),
    ("The weather was fine and rates of rain fell.", 0, 0.0),
    ("Interest rates on the main refinancing operations will be increased by 75 basis points, the Council decided.", 1, 75.0),
    ("The Committee decided to establish a target range for the federal funds rate of 0 to 1/4 percent.", -1, 75.0),
    ("Members voted not to raise the federal funds rate.", 0, 0.0),
    ("It decided to leave the policy rate and to raise the deposit facility later.", 0, 0.0),
]


def test_decisions(spark):
    rows = [(i, 0, "Some words come first.") for i in range(len(DECISIONS))] + [(i, 1, s) for i, (s, _, _) in enumerate(DECISIONS)]
    df = spark.createDataFrame(rows, "doc_id int, pos int, sentence string")
    got = {x.doc_id: (x.direction, x.points) for x in scoring.decisions(df, text.basis_points(F.col("sentence"))).collect()}
    assert [got[i] for i in range(len(DECISIONS))] == [(d, p) for _, d, p in DECISIONS]
    assert one(spark, scoring.combine(F.lit(0.6), F.lit(-0.5))) == pytest.approx(0.4)
    assert [one(spark, scoring.action_base(F.lit(-1), F.lit(p))) for p in (25.0, 50.0, 75.0)] == [-0.6, -0.8, -1.0]


def test_sizes_of_moves_in_every_form(spark):
    said = {
        "by 1 percentage point": 100, "a half percentage point": 50, "12.5 basis points": 12.5, "three quarters of a percentage point": 75, "one-quarter of a percentage point": 25, "One Half percentage point": 50,
        "1/4 percentage point": 25, "3/4percentage point": 75, "0.25 percentage points": 25, "2 percentage points": 200, "10basis point": 10, "half a percentage point": None, "0 basis points": 0, "25 bps": None, "nothing": None,
        "2 percentage points, or 50 basis points": 50, "1 percentage point and one quarter percentage point": 25,
    }
    df = spark.createDataFrame(list(said), "string")
    assert {r.value: r.p for r in df.select("value", text.stated_points(F.col("value")).alias("p")).collect()} == said
    assert {r.value: r.p for r in df.select("value", text.basis_points(F.col("value")).alias("p")).collect()} == {k: v or 25.0 for k, v in said.items()}


@pytest.mark.parametrize("same", [
    ("https://x.org/nl/a", "http://www.x.org/en/a/", "x.org/pt/a?q=1", "X.org//de//a#t"), ("x.org/a.en.pdf", "x.org/a.de.pdf", "x.org/a.pdf"), ("x.org/presse/reden/a-12345", "x.org/press/speeches/a-9999"),
    ("x.org/presse/gastbeitraege/b", "x.org/press/contributions/b"), ("x.org/presse/interviews/b.pt.htm", "x.org/press/interviews/b.htm"), ("x.org/presse/c", "x.org/press/c"),
])
def test_addresses_of_one_page_are_one(spark, same):
    assert len({one(spark, text.canonical_url(F.lit(u))) for u in same}) == 1


def test_addresses_of_other_pages_stay_apart(spark):
    other = ["x.org/presse", "x.org/press", "x.org/reden/a", "x.org/speeches/a", "x.org/a-123", "x.org/a", "x.org/a.xx.pdf", "x.org/en", "x.org/de", "y.org/a", "x.org", "ftp://x.org", ""]
    assert len({one(spark, text.canonical_url(F.lit(u))) for u in other}) == len(other)


def test_titles_lose_their_additions(spark):
    said = {"Speech (with Q&amp;A) &#x27;x&#39;": "speech x", "A title | Site | More": "a title", "Title\u2014 06/11/2026": "title", "On 1/2/24 it was": "on it was", "Caf\u00e9_1 - b": "caf _1 b", "a|b": "a b", "": ""}
    df = spark.createDataFrame(list(said), "string")
    assert {r.value: r.t for r in df.select("value", text.normal_title(F.col("value")).alias("t")).collect()} == said


def test_the_deciding_sentence_counts_once(spark):
    said = [(1, 0, "Hello.", 0.5), (1, 1, DECISIONS[0][0], -1.0), (1, 2, "More.", 0.1), (2, 0, "Nothing.", None), (3, 0, "Words.", 0.2)]
    df = spark.createDataFrame(said, "doc_id int, pos int, sentence string, value double")
    got = {x.doc_id: (x.base, x.score) for x in scoring.decision_scores(scoring.decisions(df, text.basis_points(F.col("sentence"))), df).collect()}
    assert got == {1: (0.8, 0.86), 2: (0.0, 0.0), 3: (0.0, 0.2)}


def test_tiers_are_tested_in_order(spark):
    f = lambda s, t, **k: one(spark, weights.tier(F.lit(s), F.lit(t), **k))
    assert [f("FOMC Statement", "Policy"), f("ECB", "Account of the meeting"), f("Speech", None), f(None, "Payments: monetary policy statement"), f("x", "y")] == [1, 2, 3, 4, 3]
    assert f("a", "click here", rules=((1, "CLICK"), (4, "here"))) == 1


def test_history_has_all_months_of_both_banks(spark):
    rows = [("FED", "2020-01-29"), ("ECB", "2023-06-15"), ("FED", "2026-10-01")]
    df = spark.createDataFrame([(i, b, dt.date.fromisoformat(d), "FOMC Statement", "Policy statement", False, 0.4, 0, 3) for i, (b, d) in enumerate(rows)], "item_id int, bank string, item_date date, source string, title string, is_statistical boolean, net_score double, stat_weight int, speaker int")
    meetings = spark.createDataFrame([("FED", dt.date(2026, 9, 20), 25), ("ECB", dt.date(2026, 9, 20), 25)], "bank string, meeting date, bps int")
    got = [tuple(x) for x in index.history(index.monthly(df, meetings, exempt=19), "FED", "ECB").orderBy("month").collect()]
    assert [(str(m), n, k) for m, _, n, _, k in got] == [("2020-01-01", 1, 0), ("2023-06-01", 0, 1), ("2026-10-01", 1, 0)]
    assert got[0][1] == got[1][3] == 0.26 and got[0][3] is None and got[2][1] == pytest.approx(0.26 + 0.35 * 0.353, abs=2e-3)


def lexed(spark, lexicon, lines):
    df = spark.createDataFrame([(1, i, s.split()) for i, s in enumerate(lines)], "doc_id int, pos int, words array<string>")
    found = scoring.lexicon_points(df, spark.createDataFrame(lexicon, scoring.LEXICON)).collect()
    return {(x.pos, x.dim): (x.hawk, x.dove) for x in found}


def test_lexicon_window_and_negation(spark):
    lexicon = [("prices", "target", 1, 0, 0, "p"), ("rise", "direction", 1, 0, 0, None), ("fall", "direction", -1, 0, 0, None), ("not", "negation", 0, 0, 0, None)]
    lines = ["prices rise", "prices do not rise", "prices a b c d e f rise", "prices fall", "not a b c prices rise", "rise", ""]
    assert lexed(spark, lexicon, lines) == {(0, "p"): (1, 0), (1, "p"): (0, 1), (2, "p"): (0, 0), (3, "p"): (0, 1), (4, "p"): (1, 0)}


def test_lexicon_phrases(spark):
    lexicon = [
        ("rate", "target", 1, 0, 0, "r"), ("federal funds rate", "target", 1, 0, 0, "f"), ("price*", "target", 1, 0, 0, "p"), ("price stab*", "target", -1, 0, 0, "s"), ("rise", "direction", 1, 0, 0, None), ("no longer", "negation", 0, 0, 0, None),
        ("pick* up", "direction", 1, 0, 0, None), ("tight*", "target", 1, 0, 0, "t"), ("tight*", "direction", 1, 0, 0, None), ("asset purchase*", "points", 0, 0, 2, "q"), ("raise", "opens", 0, 2, 0, "o"), ("range", "closes", 0, 0, 0, "o"), ("a b c d", "points", 0, 1, 0, "four"),
    ]
    lines = [
        "federal funds rate rise", "federal rate rise", "prices rise", "price stability rise", "price stability price rise", "prices no longer rise", "prices picked up", "picked prices", "tight tightening", "asset purchases and asset purchase",
        "raise the target range", "range raise x", "raise a x c d e f range", "a b c d a b c", "asset",
    ]
    assert lexed(spark, lexicon, lines) == {
        (0, "f"): (1, 0), (1, "r"): (1, 0), (2, "p"): (1, 0), (3, "s"): (0, 1), (4, "s"): (0, 1), (4, "p"): (1, 0), (5, "p"): (0, 1), (6, "p"): (1, 0), (7, "p"): (0, 0), (8, "t"): (2, 0), (9, "q"): (0, 4),
        (10, "o"): (2, 0), (13, "four"): (1, 0),
    }


def plain_softmax(words, vocabulary, intercept):
    """The linear scorer by plain loops."""
    counts = {}
    for n in (1, 2, 3):
        for i in range(len(words) - n + 1):
            term = " ".join(words[i : i + n])
            if term in vocabulary:
                counts[term] = counts.get(term, 0) + 1
    x = {t: (1 + np.log(c)) * vocabulary[t][0] for t, c in counts.items()}
    norm = np.sqrt(sum(v * v for v in x.values())) or 1.0
    z = np.array([b + sum(v / norm * vocabulary[t][1 + k] for t, v in x.items()) for k, b in enumerate(intercept)])
    return np.exp(z - z.max()) / np.exp(z - z.max()).sum()


def test_linear_classes(spark):
    vocabulary = {"a": (1.5, 2.0, -1.0, 0.0), "a b": (2.0, -1.0, 3.0, 0.1), "b c a": (1.0, 0.0, 1.0, -2.0), "c": (0.0, 5.0, 5.0, 5.0)}
    lines = ["a", "a b c a", "a a a b", "c", "x", "", "b c a b"]
    df = spark.createDataFrame([(1, i, s.split()) for i, s in enumerate(lines)], "doc_id int, pos int, words array<string>")
    v = spark.createDataFrame([(t, *x) for t, x in vocabulary.items()], "term string, idf double, dove double, hawk double, neutral double")
    got = {x.pos: x for x in scoring.linear_probabilities(df, v, (0.1, -0.2, 0.3)).collect()}
    for i, s in enumerate(lines):
        assert list(got[i])[2:] == pytest.approx(list(plain_softmax(s.split(), vocabulary, (0.1, -0.2, 0.3))))
    label = lambda *p: one(spark, scoring.linear_label(*map(F.lit, p)))
    assert [label(0.2, 0.5, 0.3), label(0.5, 0.2, 0.3), label(0.4, 0.4, 0.2), label(0.2, 0.4, 0.4), label(0.2, 0.3, 0.5)] == [1, -1, 0, 0, 0]


def test_document_score_in_full(spark):
    """Two sentences lean to hawkish, one to dovish, one is neutral; by hand."""
    linear = spark.createDataFrame([(1, 0, 0.1, 0.8, 0.1), (1, 1, 0.1, 0.8, 0.1), (1, 2, 0.7, 0.1, 0.2), (1, 5, 0.3, 0.3, 0.4), (2, 0, 0.2, 0.2, 0.6)], "doc_id int, pos int, p_dove double, p_hawk double, p_neutral double")
    points = spark.createDataFrame([(1, 0, "g", 2, 0), (1, 0, "p", 0, 1), (1, 1, "g", 1, 1), (1, 2, "p", 0, 3)], "doc_id int, pos int, dim string, hawk long, dove long")
    norm = scoring.Norm(k=2.0, lex=(0.1, 0.5), lin=(0.0, 0.2), z_to_net=2.0)
    got = {x.doc_id: x for x in scoring.document_scores(scoring.sentence_values(points, linear), norm).collect()}
    x = got[1]
    z = ((0 + 0.2) / 6 - 0.1) / 0.5 / 2 + (0.7 + 0.7 - 0.6) / 6 / 0.2 / 2
    up = lambda v: np.floor(v * 1000 + 0.5) / 1000
    assert (x.n, x.z, x.score, x.label) == (4, up(z), up(z / 2), "hawkish") and (x.lexicon_measure, x.linear_measure, x.agreement) == (0.0, 0.2, 0.75)
    assert (x.hawkish, x.dovish) == ([0, 1], [2])
    g, p = 0.5 * (1 + 0) + 0.5 * 1.4, 0.5 * -2 + 0.5 * (0.7 - 0.6)
    assert [tuple(d) for d in x.dims] == [("g", 2, up(g / 5 / 0.257), 0), ("p", 2, up(max(-1, p / 5 / 0.257)), 2)]
    assert (got[2].n, got[2].label, got[2].agreement, got[2].hawkish, got[2].dims) == (1, "neutral", 1.0, [], [])


def test_addresses(spark):
    f = lambda u: one(spark, text.canonical_url(F.lit(u)))
    assert f("HTTPS://www.A.org//en/x-20240101/?q=1#z") == "a.org/__lang__/x"
    assert f("http://a.org/de/x/") == f("https://www.a.org/fr/x")


def test_sentences(spark):
    got = one(spark, text.sentences(F.lit('One two three four five six. "Seven eight nine ten eleven twelve". Too short. No split e.g. here at all')))
    assert got == ["One two three four five six.", '"Seven eight nine ten eleven twelve".', "No split e.g. here at all"]


def test_html_container():
    page = "<html><nav>menu</nav><article>a <article>b</article> &amp; c</article><p>rest</p><script>x</script></html>"
    assert documents.container(page) == "a b & c" and documents.container("<p>x") == "x" and documents.container(None) is None


def test_pdf():
    prose = "Hello big world this is prose and there is far more of it to read today"
    body = rb"BT (Hello big) Tj T* (world this is\nprose and ) ' [(there is f) (ar more of it)] TJ Td (to read \164oday) Tj ET"
    raw = zlib.compressobj(wbits=-15)
    raw = raw.compress(body) + raw.flush()
    odd = zlib.compress(b"(12 34) Tj")
    pack = lambda *streams: b"%PDF\n1 0 obj\n" + b"".join(b"stream\r\n" + x + b"\nendstream\n" for x in streams)
    assert documents.pdf_pages(pack(zlib.compress(body), odd)) == prose
    assert documents.pdf_pages(pack(raw, zlib.compress(body))) == f"{prose}\f{prose}"
    assert documents.pdf_pages(pack(odd)) == "12 34" and documents.pdf_pages(pack(b"\x00\x01 rubbish")) == ""
    assert documents.pdf_pages(rb"(no \(stream\)) Tj T* (here)") == "no (stream) here" and documents.pdf_pages(None) is None
    broken = zlib.compress(body * 40)
    assert documents.pdf_pages(pack(broken[: len(broken) // 2])).startswith("Hello big")  # as far as it is sound


def test_locate_and_keys(spark):
    row = spark.createDataFrame([("Page one\fLine a\nThe quick, brown fox", "quick brown")], "t string, n string")
    p = row.select(documents.locate(F.col("t"), F.col("n")).alias("p")).first()["p"]
    assert (p.page, p.line) == (2, 2)
    assert row.select(documents.title_key(F.lit("Ann Lee: Éa, b")).alias("k")).first()["k"] == "eab"
    assert row.select(documents.speech_key(F.lit("A"), F.lit("ﬁne!")).alias("k")).first()["k"] == "a|fine"
    assert one(spark, documents.attributed(F.lit('Roe spoke. She said "no". Rain fell. More "x".'), "Roe")) == ["Roe spoke.", 'She said "no".']


def test_feeds(spark, tmp_path):
    (tmp_path / "s.csv").write_text("date,value\n2024-01-01,1.5\n2024-01-02,.\n")
    assert [tuple(r) for r in feeds.csv_series(spark, str(tmp_path / "s.csv")).collect()] == [(dt.date(2024, 1, 1), 1.5)]
    assert [tuple(r) for r in feeds.csv_columns(spark, str(tmp_path / "s.csv"), 0, 1).collect()] == [("2024-01-01", 1.5)]
    rows = spark.createDataFrame([(dt.date(2024, 1, 1), dt.date(1776, 7, 4), 1.0), (dt.date(2024, 1, 1), dt.date(2024, 2, 1), 2.0)], "period date, released date, value double")
    assert tuple(feeds.first_release(rows).first()) == (dt.date(2024, 1, 1), dt.date(2024, 1, 1), 1.0)


def test_csv_quotes_only_where_needed(spark, tmp_path):
    rows = spark.createDataFrame([("a,b", 1), ('q"q', 2), ("plain", 3), (None, 4)], "x string, n int").coalesce(1)
    sinks.csv(rows, str(tmp_path / "c"))
    lines = next((tmp_path / "c").glob("part*")).read_text().splitlines()
    assert lines == ["x,n", '"a,b",1', '"q""q",2', "plain,3", ",4"]


def events(spark, folder):
    base = dt.datetime(2024, 1, 1)
    rows = [(i, base + dt.timedelta(hours=i), i % 3, "view", float(i)) for i in range(48)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double")
    df.coalesce(1).write.parquet(folder)
    return df


def test_streams(spark, tmp_path):
    df = events(spark, str(tmp_path / "e"))
    stream = lambda: streams.event_stream(spark, str(tmp_path / "e"), df.schema)
    got = streams.drain(streams.tumbling(stream()), "tumbling", "complete")
    assert sorted((r.n, r.total) for r in got.collect()) == [(24, sum(range(24))), (24, sum(range(24, 48)))]
    assert streams.drain(streams.without_repeats(stream(), ["user_id"]), "unique").count() == 3


def test_every_document_has_its_class_of_titles(spark, tmp_path):
    from tidemark.plans import catalogue

    titles = ["one two three four five", "Five four three two one", "one two three four five six", "alone here", "alone, here", "", None, "a b", "one two three seven eight"]
    spark.createDataFrame([(i, t) for i, t in enumerate(titles)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sets = [{w.strip(",") for w in (t or "").lower().split() if len(w) > 2} for t in titles]
    near = lambda a, b: bool(a) and len(a & b) >= 0.8 * len(a | b)
    want = [(i, min(j for j, b in enumerate(sets) if j == i or a and a == b), sum(near(a, b) for j, b in enumerate(sets) if j != i)) for i, a in enumerate(sets)]
    assert sorted(tuple(x) for x in catalogue.QUERIES["set_jaccard_members"](spark, str(tmp_path)).collect()) == want


def test_newest_first_has_all_rows_in_order(spark, tmp_path):
    from tidemark.plans import catalogue

    spark.createDataFrame([(i, i * 7919 % 5000, i % 300) for i in range(5000)], "n int, event_id long, day int").selectExpr(
        "event_id", "timestamp'2024-01-01' + make_dt_interval(day) AS ts", "event_id AS user_id", "'click' AS event_type", "0.5D AS value", """'{"k": 1}' AS props""",
    ).write.parquet(f"{tmp_path}/events.parquet")
    got = [(x.item_date, x.item_id) for x in catalogue.QUERIES["sort_date_desc"](spark, str(tmp_path)).collect()]
    assert len(got) == 5000 and got == sorted(got, key=lambda x: (-x[0].toordinal(), x[1]))
