"""Policy-reaction models: features by month position, and predictions as sums of terms.

Lags are taken by position on the calendar: a range of month numbers with one month in it, so a month that is missing, or whose
base values are, breaks the lags that point to it instead of moving them. Series of any number of keys are handled side by side, each key's
months in one window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numerics import log_or_minus

#: What features() reads of each key and month; all but the first seven may be missing.
NEEDED = ("policy_rate", "prices", "unemployment", "short_rate", "long_rate", "oil")
OPTIONAL = ("natural_rate", "equity", "credit_spread", "hy_spread", "vix", "fci")
#: The inflation target, what missing spreads and volatility count as, the months of the natural rate's mean, and of stress the divisors.
TARGET, MISSING, NATURAL_MONTHS, STRESS = 2.0, {"credit_spread": 0.0, "hy_spread": 0.0, "vix": 20.0, "fci": 0.0}, 120, {"credit_spread": 1.0, "hy_spread": 5.0, "vix": 20.0, "fci": 1.0}

#: The coefficients of the two models.
FED = {
    "const": -0.265457, "policy_rate_lag": 0.854363, "inflation_gap": -0.003450, "unemployment_gap": 0.056217, "slope": -0.033699, "r_neg_equity": 0.384390, "vix": 0.017163, "unemployment_gap_l1": -0.044029, "vix_sq": -0.000455,
    "unemployment_gap_l6": -0.013982, "y2y_l1": 0.150443, "credit_spread_l1": 0.064071, "slope_l6": 0.012575, "y2y_x_d_hy_q75": -0.068016, "p_next_restrictive": -0.053076, "p_next_expansionary": -0.089751, "env_bias": 0.036675,
    "infl_x_p_restrictive": 0.066622, "unemp_x_p_expansionary": -0.015312,
}
ECB = {
    "const": 0.0, "y2y": 0.474432, "policy_rate_lag": 0.571832, "inflation_gap_l1": 0.010221, "fci_l1": -0.239780, "slope_x_d_gfc": 0.111782, "slope": -0.141431, "y2y_l3": -0.169863, "infl_gap_x_neg_rate": -0.001809,
    "rate_change_l1": -0.214750, "y2y_x_d_sov_crisis": -0.101180, "hy_spread": 0.025882, "slope_x_d_neg_rate": 0.104035, "vix": -0.003046, "slope_x_d_pre_gfc": 0.150675, "fci_l3": 0.064801,
}
#: Terms that are products, and what the regime probabilities were estimated at.
PRODUCTS = {
    "vix_sq": ("vix", "vix"), "y2y_x_d_hy_q75": ("y2y", "d_hy_q75"), "infl_x_p_restrictive": ("inflation_gap", "p_next_restrictive"), "unemp_x_p_expansionary": ("unemployment_gap", "p_next_expansionary"),
    "slope_x_d_gfc": ("slope", "d_gfc"), "infl_gap_x_neg_rate": ("inflation_gap", "d_neg_rate"), "y2y_x_d_sov_crisis": ("y2y", "d_sov_crisis"), "slope_x_d_neg_rate": ("slope", "d_neg_rate"), "slope_x_d_pre_gfc": ("slope", "d_pre_gfc"),
}
REGIME = {"p_next_restrictive": 0.1345, "p_next_expansionary": 0.011, "env_bias": 0.1236}
SPELLS = {"d_pre_gfc": (None, "2008-08"), "d_gfc": ("2008-09", "2010-06"), "d_sov_crisis": ("2010-04", "2012-09")}

LAGS = {"unemployment_gap": (1, 6), "y2y": (1, 3), "slope": (6,), "credit_spread": (1,), "fci": (1, 3), "inflation_gap": (1,)}


def month_number(month: Column) -> Column:
    return F.year(month) * 12 + F.month(month)


def months_ago(column: Column | str, k: int, *key: str, at: str = "__m") -> Column:
    """The value ``k`` months before by the calendar, null where that month has no row. One row a key and month is meant."""
    return F.max(column).over(Window.partitionBy(*key).orderBy(at).rangeBetween(-k, -k))


def features(series: DataFrame, *key: str) -> DataFrame:
    """(key, month, features) of ``series`` (key, month, NEEDED, OPTIONAL), for the months that have all of their own values and those one,
    three and six months before."""
    rows = series.withColumn("__m", month_number(F.col("month")))
    ago = lambda c, k: months_ago(c, k, *key)
    past = rows.withColumns({"policy_rate_lag": ago("policy_rate", 1), "__oil": ago("oil", 1), "__prices": ago("prices", 12), "__equity": ago("equity", 1)})
    mean = F.avg("unemployment").over(Window.partitionBy(*key).orderBy("__m").rangeBetween(-NATURAL_MONTHS, 0))
    past = past.withColumn("__natural", F.coalesce("natural_rate", mean, "unemployment"))
    whole = F.lit(True)
    for c in (*NEEDED, "policy_rate_lag", "__oil", "__prices"):
        whole = whole & F.col(c).isNotNull()
    whole = whole & (F.col("__oil") != 0) & (F.col("__prices") != 0)
    fall = F.when((F.col("__equity") > 0) & F.col("equity").isNotNull(), F.greatest(F.ln("__equity") - log_or_minus("equity"), F.lit(0.0)))
    base = {
        "policy_rate": F.col("policy_rate"), "policy_rate_lag": F.col("policy_rate_lag"), "inflation_gap": (F.col("prices") / F.col("__prices") - 1) * 100 - TARGET, "unemployment_gap": F.col("__natural") - F.col("unemployment"),
        "y2y": F.col("short_rate"), "slope": F.col("long_rate") - F.col("short_rate"), "oil_log_change": F.ln("oil") - F.ln("__oil"), "r_neg_equity": F.coalesce(fall, F.lit(0.0)),
        **{c: F.coalesce(c, F.lit(v)) for c, v in MISSING.items()},
    }
    own = past.select(*key, "month", "__m", F.coalesce(whole, F.lit(False)).alias("__whole"), *(F.when(whole, v).alias(c) for c, v in base.items()))
    lagged = {f"{c}_l{k}": ago(c, k) for c, ks in LAGS.items() for k in ks}
    before = {f"__ok{k}": ago(F.col("__whole").cast("int"), k) for k in (1, 3, 6)}
    change = {"__rate1": ago("policy_rate", 1), "__rate2": ago("policy_rate", 2)}
    out = own.withColumns(lagged | before | change).where("__whole AND __ok1 = 1 AND __ok3 = 1 AND __ok6 = 1")
    stress = sum((F.col(c) / by for c, by in STRESS.items()), F.lit(0.0)) / len(STRESS)
    out = out.withColumns({"rate_change_l1": F.col("__rate1") - F.coalesce("__rate2", "__rate1"), "stress_score": stress})
    return out.drop("__m", "__whole", *before, *change)


def with_terms(rows: DataFrame, *key: str) -> DataFrame:
    """features() with the indicators, products and regime probabilities that models are made of. A high-yield spread is high from the interpolated third quartile of
    a key's positive ones (6 where it has none)."""
    high = F.coalesce(F.expr("percentile(if(hy_spread > 0, hy_spread, null), 0.75)").over(Window.partitionBy(*key)), F.lit(6.0))
    name = F.date_format("month", "yyyy-MM")
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    spells = {d: flag((F.lit(True) if a is None else name >= a) & (name <= b)) for d, (a, b) in SPELLS.items()}
    out = rows.withColumns({"const": F.lit(1.0), "d_hy_q75": flag(F.col("hy_spread") >= high), "d_neg_rate": flag(F.col("policy_rate_lag") <= 0), **{c: F.lit(v) for c, v in REGIME.items()}, **spells})
    return out.withColumns({t: F.col(a) * F.col(b) for t, (a, b) in PRODUCTS.items()})


def contributions(rows: DataFrame, model: dict[str, float], *key: str) -> DataFrame:
    """(key, month, policy_rate, term, x, contribution) of with_terms(): one row a term, the model joined as a table."""
    table = rows.sparkSession.createDataFrame(list(model.items()), "term string, weight double")
    long = rows.unpivot([*key, "month", "policy_rate"], list(model), "term", "x")
    return long.join(F.broadcast(table), "term").select(*key, "month", "policy_rate", "term", "x", (F.col("weight") * F.col("x")).alias("contribution"))


def predictions(parts: DataFrame, *key: str) -> DataFrame:
    """(key, month, implied, gap): the sum of a month's contributions, and how far it is above the rate itself."""
    total = parts.groupBy(*key, "month").agg(F.sum("contribution").alias("implied"), F.first("policy_rate").alias("rate"))
    return total.select(*key, "month", "implied", (F.col("implied") - F.col("rate")).alias("gap"))
