"""Reaction models and the network against plain loops."""

import datetime as dt
import math
import random

import pytest

from tidemark.operators import network, reaction

COLUMNS = (*reaction.NEEDED, *reaction.OPTIONAL)


def made(seed, missing):
    r = random.Random(seed)
    rows = {}
    for i in range(160):
        if r.random() < missing:
            continue
        values = {c: r.uniform(1, 9) for c in COLUMNS}
        for c in COLUMNS:
            if r.random() < missing:
                values[c] = None
        if i % 31 == 5:
            values["oil"] = 0.0
        rows[i] = values
    return rows


def brute(rows):
    bases = {}
    for i, v in rows.items():
        p, y = rows.get(i - 1), rows.get(i - 12)
        needed = [v[c] for c in reaction.NEEDED] + ([p["policy_rate"], p["oil"]] if p else [None]) + ([y["prices"]] if y else [None])
        if None in needed or p["oil"] == 0 or y["prices"] == 0 or v["oil"] == 0:
            continue
        past = [rows[j]["unemployment"] for j in range(i - 120, i + 1) if j in rows and rows[j]["unemployment"] is not None]
        natural = v["natural_rate"] if v["natural_rate"] is not None else sum(past) / len(past)
        fall = max(-(math.log(v["equity"]) - math.log(p["equity"])), 0) if v["equity"] is not None and p["equity"] else 0.0
        bases[i] = {
            "policy_rate": v["policy_rate"], "policy_rate_lag": p["policy_rate"], "inflation_gap": (v["prices"] / y["prices"] - 1) * 100 - 2, "unemployment_gap": natural - v["unemployment"], "y2y": v["short_rate"],
            "slope": v["long_rate"] - v["short_rate"], "oil_log_change": math.log(v["oil"]) - math.log(p["oil"]), "r_neg_equity": fall, **{c: d if v[c] is None else v[c] for c, d in reaction.MISSING.items()},
        }
    out = {}
    for i, b in bases.items():
        b1, b2, b3, b6 = (bases.get(i - k) for k in (1, 2, 3, 6))
        if b1 and b3 and b6:
            out[i] = b | {
                "unemployment_gap_l1": b1["unemployment_gap"], "unemployment_gap_l6": b6["unemployment_gap"], "y2y_l1": b1["y2y"], "y2y_l3": b3["y2y"], "slope_l6": b6["slope"], "credit_spread_l1": b1["credit_spread"], "fci_l1": b1["fci"],
                "fci_l3": b3["fci"], "inflation_gap_l1": b1["inflation_gap"], "rate_change_l1": b1["policy_rate"] - (b2 or b1)["policy_rate"], "stress_score": (b["credit_spread"] + b["hy_spread"] / 5 + b["vix"] / 20 + b["fci"]) / 4,
            }
    return out


def frame(spark, series):
    month = lambda i: dt.date(2000 + i // 12, i % 12 + 1, 1)
    rows = [(k, month(i), *(v[c] for c in COLUMNS)) for k, some in series.items() for i, v in some.items() if v["oil"] != 0 or True]
    return spark.createDataFrame(rows, "k string, month date, " + ", ".join(f"{c} double" for c in COLUMNS))


def test_features_by_month_position(spark):
    series = {"a": made(1, 0.0), "b": made(2, 0.03), "c": made(3, 0.01)}
    for some in series.values():  # a logarithm of zero oil is no base: such months are missing here and there
        for i in [i for i, v in some.items() if v["oil"] == 0.0]:
            some[i]["oil"] = None
    got = {(x.k, (x.month.year - 2000) * 12 + x.month.month - 1): x.asDict() for x in reaction.features(frame(spark, series), "k").collect()}
    want = {(k, i): v for k, some in series.items() for i, v in brute(some).items()}
    assert len(want) > 100 and set(got) == set(want)
    for at, v in want.items():
        assert {c: got[at][c] for c in v} == pytest.approx(v)


@pytest.mark.parametrize("model", [reaction.FED, reaction.ECB])
def test_contributions_sum_to_the_prediction(spark, model):
    rows = reaction.with_terms(reaction.features(frame(spark, {"a": made(4, 0.0), "b": made(5, 0.0)}), "k"), "k").cache()
    parts = reaction.contributions(rows, model, "k")
    got = {(x.k, x.month): x for x in reaction.predictions(parts, "k").collect()}
    quartile = {}
    for k in "ab":
        hy = sorted(x.hy_spread for x in rows.where(f"k = '{k}'").collect() if x.hy_spread > 0)
        at = 0.75 * (len(hy) - 1)
        quartile[k] = hy[int(at)] + (hy[math.ceil(at)] - hy[int(at)]) * (at - int(at))
    for x in rows.collect():
        v, name = x.asDict(), f"{x.month:%Y-%m}"
        v |= {"const": 1.0, "d_hy_q75": float(x.hy_spread >= quartile[x.k]), "d_neg_rate": float(x.policy_rate_lag <= 0), "d_pre_gfc": float(name < "2008-09"), "d_gfc": float("2008-09" <= name <= "2010-06"), "d_sov_crisis": float("2010-04" <= name <= "2012-09")}
        v |= {t: v[a] * v[b] for t, (a, b) in reaction.PRODUCTS.items()}
        implied = sum(w * v[t] for t, w in model.items())
        assert (got[x.k, x.month].implied, got[x.k, x.month].gap) == pytest.approx((implied, implied - x.policy_rate))
    assert parts.count() == rows.count() * len(model)


def test_sums_of_nodes_are_those_of_all_pairs(spark):
    r = random.Random(6)
    nodes = [(i, r.choice([-0.14, 0.0, 0.14, 0.28, 0.1400001, r.uniform(-1, 1)])) for i in range(400)]
    df = spark.createDataFrame(nodes, "name long, mean double")
    apart = lambda a, b: abs(round(a * 1e9) - round(b * 1e9))
    pairs = {(a, b): 1 - 5 * apart(x, y) / 1e9 for a, x in nodes for b, y in nodes if a < b and apart(x, y) < 140_000_000}
    assert {(x.a, x.b): x.similarity for x in network.edges(df).collect()} == pytest.approx(pairs)
    got = {x.name: (x.degree, x.strength) for x in network.nodes_with_sums(df).collect()}
    for i, _ in nodes:
        own = [s for p, s in pairs.items() if i in p]
        assert got[i][0] == len(own) and got[i][1] == pytest.approx(sum(own), abs=1e-6)


def test_ten_thousand_nodes_without_pairs(spark):
    df = spark.range(10_000).selectExpr("id AS name", "(id * 7919 % 10007) / 5000.0D - 1 AS mean")
    found = network.nodes_with_sums(df)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Join" not in plan
    x = found.where("name = 5000").first()
    means = [(i * 7919 % 10007) / 5000 - 1 for i in range(10_000)]
    own = [1 - 5 * abs(m - means[5000]) for i, m in enumerate(means) if i != 5000 and abs(round(m * 1e9) - round(means[5000] * 1e9)) < 140_000_000]
    assert x.degree == len(own) and x.strength == pytest.approx(sum(own), abs=1e-4)
