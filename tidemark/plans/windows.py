"""Window functions and joins over items, the calendar and the TPC-like tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.numerics import six
from tidemark.operators.joins import asof, intervals, without_similar
from tidemark.plans.base import AS_OF, AS_OF_SQL, CALENDAR_SQL, ITEMS_SQL, SERIES_SQL, calendar, items, query, scored, series, with_sql
from tidemark.operators.reaction import month_number, months_ago
from tidemark.plans.basics import top_rows
from tidemark.session import table

I = with_sql(ITEMS_SQL)  # noqa: E741
S = with_sql(SERIES_SQL)
IC = with_sql(ITEMS_SQL, CALENDAR_SQL)
W = Window.partitionBy
PAST = (Window.unboundedPreceding, 0)


DUP = lambda: W("source", "speaker", "value")


@query("win_row_number_dedup", I + "SELECT item_id, CASE WHEN row_number() OVER (PARTITION BY source, speaker, value ORDER BY item_date, item_id) = 1 THEN net_score ELSE 0 END AS net_score FROM items")
def win_row_number_dedup(spark, sf_dir):
    first = F.row_number().over(DUP().orderBy("item_date", "item_id")) == 1
    return items(spark, sf_dir).select("item_id", F.when(first, F.col("net_score")).otherwise(0.0).alias("net_score"))


@query("win_first_value", I + "SELECT item_id, first_value(item_date) OVER (PARTITION BY source, speaker, value ORDER BY item_date, item_id) AS first_date FROM items")
def win_first_value(spark, sf_dir):
    return items(spark, sf_dir).select("item_id", F.first("item_date").over(DUP().orderBy("item_date", "item_id")).alias("first_date"))


@query("win_rank_dedup_url", I + "SELECT item_id FROM (SELECT item_id, row_number() OVER (PARTITION BY title, bank ORDER BY (source = 'view')::INT * 1000 + (k > 50)::INT * 100 + word_count DESC, item_id) AS rn FROM items) WHERE rn = 1")
def win_rank_dedup_url(spark, sf_dir):
    """The best row of each key is a maximum, summed up before the shuffle; no sort is needed."""
    merit = (F.col("source") == "view").cast("int") * 1000 + (F.col("k") > 50).cast("int") * 100 + F.col("word_count")
    return items(spark, sf_dir).groupBy("title", "bank").agg(F.max(F.struct(merit.alias("m"), (-F.col("item_id")).alias("i")))["i"].alias("i")).select((-F.col("i")).alias("item_id"))


@query("win_rank_dedup_cross_source", I + "SELECT item_id FROM (SELECT item_id, row_number() OVER (PARTITION BY bank, item_date, k ORDER BY (source = 'error') DESC, word_count DESC, item_id) AS rn FROM items) WHERE rn = 1")
def win_rank_dedup_cross_source(spark, sf_dir):
    return top_rows(items(spark, sf_dir), ["bank", "item_date", "k"], [(F.col("source") == "error").desc(), F.desc("word_count"), "item_id"], 1).select("item_id")


@query("win_lag_sep_delta", I + "SELECT item_id, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY item_date, item_id), 6) AS delta FROM items WHERE is_statistical")
def win_lag_sep_delta(spark, sf_dir):
    before = F.lag("value").over(W("user_id").orderBy("item_date", "item_id"))
    return items(spark, sf_dir).where("is_statistical").select("item_id", six(F.col("value") - before).alias("delta"))


@query("join_window_max_delta", I + "SELECT item_id, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY item_date, item_id), 6) AS delta FROM items WHERE is_statistical")
def join_window_max_delta(spark, sf_dir):
    return win_lag_sep_delta(spark, sf_dir)


ORDERED = lambda: Window.orderBy("month")  # monthly series are short


HOLES = "holes AS (SELECT * FROM series WHERE (year(month) * 12 + month(month)) % 7 <> 3)"


@query("win_lag_features", with_sql(SERIES_SQL, HOLES) + "SELECT h.month, " + ", ".join(f"round(l{k}.mean, 6) AS lag_{k}" for k in (1, 2, 3, 6)) + " FROM holes h " + " ".join(f"LEFT JOIN holes l{k} ON l{k}.month = (h.month - INTERVAL {k} MONTH)::DATE" for k in (1, 2, 3, 6)))
def win_lag_features(spark, sf_dir):
    """Lags by the calendar, over a series with missing months."""
    holes = series(spark, sf_dir).withColumn("m", month_number(F.col("month"))).where("m % 7 <> 3")
    return holes.select("month", *(six(months_ago("mean", k, at="m")).alias(f"lag_{k}") for k in (1, 2, 3, 6)))


def _changes(expr):
    def run(spark, sf_dir):
        return series(spark, sf_dir).select("month", six(expr()).alias("change"))

    return run


_ago = lambda k: F.lag("mean", k).over(ORDERED())
query("win_pct_change_12", S + "SELECT month, round(100 * (mean - p) / nullif(abs(p), 0), 6) AS change FROM (SELECT *, lag(mean, 12) OVER (ORDER BY month) AS p FROM series)")(_changes(lambda: 100 * (F.col("mean") - _ago(12)) / F.nullif(F.abs(_ago(12)), F.lit(0.0))))
query("win_pct_change_1", S + "SELECT month, round(100 * (mean - p) / nullif(abs(p), 0), 6) AS change FROM (SELECT *, lag(mean, 1) OVER (ORDER BY month) AS p FROM series)")(_changes(lambda: 100 * (F.col("mean") - _ago(1)) / F.nullif(F.abs(_ago(1)), F.lit(0.0))))
query("win_diff_1", S + "SELECT month, round(mean - lag(mean) OVER (ORDER BY month), 6) AS change FROM series")(_changes(lambda: F.col("mean") - _ago(1)))


@query("win_ffill", S + """SELECT m AS month, round(last_value(mean IGNORE NULLS) OVER (ORDER BY m ROWS UNBOUNDED PRECEDING), 6) AS filled
  FROM (SELECT unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH))::DATE AS m FROM series) LEFT JOIN (SELECT * FROM series WHERE month(month) % 3 = 1) s ON s.month = m""")
def win_ffill(spark, sf_dir):
    """Carry the last value over a dense spine of months."""
    s = series(spark, sf_dir)
    spine = s.agg(F.explode(F.sequence(F.min("month"), F.max("month"), F.expr("interval 1 month"))).alias("month"))
    some = s.where(F.month("month") % 3 == 1).select("month", "mean")
    return spine.join(some, "month", "left").select("month", six(F.last("mean", ignorenulls=True).over(ORDERED().rowsBetween(*PAST))).alias("filled"))


@query("win_rolling_mean_120", S + "SELECT month, round(avg(mean) OVER (ORDER BY month ROWS BETWEEN 120 PRECEDING AND CURRENT ROW), 6) AS rolling FROM series")
def win_rolling_mean_120(spark, sf_dir):
    return series(spark, sf_dir).select("month", six(F.avg("mean").over(ORDERED().rowsBetween(-120, 0))).alias("rolling"))


DAILY = "d AS (SELECT bank, item_date, avg(net_score) AS mean, count(*) AS n FROM items WHERE abs(net_score) > 0.001 GROUP BY ALL)"


def daily(spark, sf_dir):
    return scored(items(spark, sf_dir)).groupBy("bank", "item_date").agg(F.avg("net_score").alias("mean"), F.count("*").alias("n"))


SHORT = "e AS (SELECT bank || '/' || speaker AS bank, item_date, avg(net_score) AS mean, count(*) AS n, row_number() OVER (PARTITION BY bank, speaker ORDER BY item_date) AS i, count(*) OVER (PARTITION BY bank, speaker) AS days FROM items WHERE abs(net_score) > 0.001 GROUP BY bank, speaker, item_date)"


def short_series(spark, sf_dir):
    """Days of each bank and speaker, numbered, with how many there are: series of different lengths."""
    rows = scored(items(spark, sf_dir)).groupBy(F.concat_ws("/", "bank", "speaker").alias("bank"), "item_date").agg(F.avg("net_score").alias("mean"), F.count("*").alias("n"))
    return rows.withColumns({"i": F.row_number().over(W("bank").orderBy("item_date")), "days": F.count("*").over(W("bank"))})


@query("win_rolling_weighted", with_sql(ITEMS_SQL, SHORT) + """SELECT a.bank, a.item_date, round(sum(b.mean * b.n) / sum(b.n), 6) AS smooth FROM e a JOIN e b ON b.bank = a.bank AND b.i <= a.i AND b.i > a.i - least(5, a.days // 3) GROUP BY a.bank, a.item_date""")
def win_rolling_weighted(spark, sf_dir):
    """The last min(5, n // 3) days, n being the days of the series: one frame for each of the five widths, chosen by n. Days are added
    newest first, as the SQL does: in the other order means that lie between two sixth places fall to the other side."""
    total, n = F.col("mean") * F.col("n"), F.col("n")
    frame = lambda k: W("bank").orderBy(F.desc("item_date")).rowsBetween(0, k - 1)
    width = F.least(F.lit(5), F.floor(F.col("days") / 3))
    smooth = F.lit(None).cast("double")
    for k in range(1, 6):
        smooth = F.when(width == k, F.sum(total).over(frame(k)) / F.sum(n).over(frame(k))).otherwise(smooth)
    return short_series(spark, sf_dir).select("bank", "item_date", six(smooth).alias("smooth")).where("smooth IS NOT NULL")


@query("win_rolling_5", I + "SELECT item_id, round(avg(net_score) OVER (PARTITION BY user_id ORDER BY item_date, item_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS rolling FROM items")
def win_rolling_5(spark, sf_dir):
    return items(spark, sf_dir).select("item_id", six(F.avg("net_score").over(W("user_id").orderBy("item_date", "item_id").rowsBetween(-4, 0))).alias("rolling"))


@query("win_running_mean", with_sql(ITEMS_SQL, DAILY) + "SELECT bank, item_date, round(sum(mean * n) OVER w / sum(n) OVER w, 6) AS running FROM d WINDOW w AS (PARTITION BY bank ORDER BY item_date ROWS UNBOUNDED PRECEDING)")
def win_running_mean(spark, sf_dir):
    w = W("bank").orderBy("item_date").rowsBetween(*PAST)
    return daily(spark, sf_dir).select("bank", "item_date", six(F.sum(F.col("mean") * F.col("n")).over(w) / F.sum("n").over(w)).alias("running"))


@query("win_share_of_total", I + "SELECT source, round(sum(abs(net_score)) / sum(sum(abs(net_score))) OVER (), 6) AS share FROM items GROUP BY source")
def win_share_of_total(spark, sf_dir):
    sums = items(spark, sf_dir).groupBy("source").agg(F.sum(F.abs("net_score")).alias("s"))  # one row per source
    return sums.select("source", six(F.col("s") / F.sum("s").over(Window.partitionBy())).alias("share"))


@query("win_sign_flip", I + "SELECT user_id, count(*) FILTER (sign(net_score) <> sign(p) AND abs(net_score) > 0.01 AND abs(p) > 0.01) AS flips, count(*) AS n FROM (SELECT *, lag(net_score) OVER (PARTITION BY user_id ORDER BY item_date, item_id) AS p FROM items) GROUP BY user_id")
def win_sign_flip(spark, sf_dir):
    rows = items(spark, sf_dir).withColumn("p", F.lag("net_score").over(W("user_id").orderBy("item_date", "item_id")))
    flip = (F.signum("net_score") != F.signum("p")) & (F.abs("net_score") > 0.01) & (F.abs("p") > 0.01)
    return rows.groupBy("user_id").agg(F.count_if(flip).alias("flips"), F.count("*").alias("n"))


PLACED = "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY item_date, item_id) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM items"


def placed(spark, sf_dir):
    return items(spark, sf_dir).withColumn("rn", F.row_number().over(W("user_id").orderBy("item_date", "item_id"))).withColumn("n", F.count("*").over(W("user_id")))


@query("win_half_split", I + f"SELECT user_id, round(avg(net_score) FILTER (rn <= n // 2), 6) AS first, round(avg(net_score) FILTER (rn > n // 2), 6) AS second FROM ({PLACED}) GROUP BY user_id")
def win_half_split(spark, sf_dir):
    early = F.col("rn") <= F.floor(F.col("n") / 2)
    mean = lambda c: six(F.avg(F.when(c, F.col("net_score"))))
    return placed(spark, sf_dir).groupBy("user_id").agg(mean(early).alias("first"), mean(~early).alias("second"))


@query("win_last3_vs_rest", I + f"SELECT user_id, round(avg(net_score) FILTER (rn > n - 3), 6) AS late, round(avg(net_score) FILTER (rn <= n - 3), 6) AS rest FROM ({PLACED}) GROUP BY user_id")
def win_last3_vs_rest(spark, sf_dir):
    late = F.col("rn") > F.col("n") - 3
    mean = lambda c: six(F.avg(F.when(c, F.col("net_score"))))
    return placed(spark, sf_dir).groupBy("user_id").agg(mean(late).alias("late"), mean(~late).alias("rest"))


@query("win_lookaround", with_sql(ITEMS_SQL, DAILY) + "SELECT bank, item_date, round(avg(mean) OVER (PARTITION BY bank ORDER BY item_date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), 6) AS before, round(avg(mean) OVER (PARTITION BY bank ORDER BY item_date ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING), 6) AS after FROM d")
def win_lookaround(spark, sf_dir):
    w = W("bank").orderBy("item_date")
    return daily(spark, sf_dir).select("bank", "item_date", six(F.avg("mean").over(w.rowsBetween(-7, -1))).alias("before"), six(F.avg("mean").over(w.rowsBetween(0, 6))).alias("after"))


@query("win_latest_two", I + "SELECT bank, item_id FROM (SELECT *, row_number() OVER (PARTITION BY bank ORDER BY item_date DESC, item_id DESC) AS rn FROM items WHERE source = 'error') WHERE rn <= 2")
def win_latest_two(spark, sf_dir):
    return top_rows(items(spark, sf_dir).where("source = 'error'"), "bank", [F.desc("item_date"), F.desc("item_id")], 2).select("bank", "item_id")


@query("win_first_seen_per_source", I + "SELECT source, item_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN k % 10 = 0 THEN NULL ELSE item_date END DESC NULLS LAST, item_id) AS rn FROM items) WHERE rn <= 12")
def win_first_seen_per_source(spark, sf_dir):
    dated = items(spark, sf_dir).withColumn("day", F.when(F.col("k") % 10 != 0, F.col("item_date")))
    return top_rows(dated, "source", [F.col("day").desc_nulls_last(), "item_id"], 12).select("source", "item_id")


@query("win_top_per_group", I + "SELECT bank, is_statistical, item_id FROM (SELECT *, row_number() OVER (PARTITION BY bank, is_statistical ORDER BY item_date DESC, item_id) AS rn FROM items) WHERE rn <= CASE WHEN is_statistical THEN 15 ELSE 30 END")
def win_top_per_group(spark, sf_dir):
    top = top_rows(items(spark, sf_dir), ["bank", "is_statistical"], [F.desc("item_date"), "item_id"], 30)
    rank = F.row_number().over(W("bank", "is_statistical").orderBy(F.desc("item_date"), "item_id"))
    return top.withColumn("rn", rank).where(~F.col("is_statistical") | (F.col("rn") <= 15)).select("bank", "is_statistical", "item_id")


# joins


@query("join_inner_month", """SELECT a.m AS month, round(a.x, 6) AS orders, round(b.x, 6) AS shipped, c.x AS lines FROM (SELECT strftime(o_orderdate, '%Y-%m') AS m, avg(o_totalprice) AS x FROM orders GROUP BY 1) a
  JOIN (SELECT strftime(l_shipdate, '%Y-%m') AS m, avg(l_extendedprice) AS x FROM lineitem GROUP BY 1) b ON a.m = b.m JOIN (SELECT strftime(l_shipdate, '%Y-%m') AS m, count(*) AS x FROM lineitem WHERE l_quantity < 10 GROUP BY 1) c ON c.m = a.m""")
def join_inner_month(spark, sf_dir):
    by = lambda t, d, f, name: t.groupBy(F.date_format(d, "yyyy-MM").alias("month")).agg(f.alias(name))
    lines = table(spark, sf_dir, "lineitem")
    out = by(table(spark, sf_dir, "orders"), "o_orderdate", six(F.avg("o_totalprice")), "orders").join(by(lines, "l_shipdate", six(F.avg("l_extendedprice")), "shipped"), "month")
    return out.join(by(lines.where("l_quantity < 10"), "l_shipdate", F.count("*"), "lines"), "month")


@query("join_full_outer_month", """SELECT coalesce(a.m, b.m) AS month, a.x AS urgent, coalesce(a.n, 0) AS urgent_n, b.x AS low, coalesce(b.n, 0) AS low_n FROM
  (SELECT strftime(o_orderdate, '%Y-%m') AS m, round(avg(o_totalprice), 2) AS x, count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT' AND month(o_orderdate) > 2 GROUP BY 1) a
  FULL JOIN (SELECT strftime(o_orderdate, '%Y-%m') AS m, round(avg(o_totalprice), 2) AS x, count(*) AS n FROM orders WHERE o_orderpriority = '5-LOW' AND month(o_orderdate) < 11 GROUP BY 1) b ON a.m = b.m""")
def join_full_outer_month(spark, sf_dir):
    o = table(spark, sf_dir, "orders")

    def side(cond, name):
        return o.where(cond).groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.round(F.avg("o_totalprice"), 2).alias(name), F.count("*").alias(f"{name}_n"))

    both = side("o_orderpriority = '1-URGENT' AND month(o_orderdate) > 2", "urgent").join(side("o_orderpriority = '5-LOW' AND month(o_orderdate) < 11", "low"), "month", "full_outer")
    return both.select("month", "urgent", F.coalesce("urgent_n", F.lit(0)).alias("urgent_n"), "low", F.coalesce("low_n", F.lit(0)).alias("low_n"))


@query("join_left_lookup_default", "SELECT c_custkey, coalesce(n, 0) AS orders, coalesce(x, 20.0) AS largest FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, max(o_totalprice) AS x FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def join_left_lookup_default(spark, sf_dir):
    per = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.max("o_totalprice").alias("x"))
    return table(spark, sf_dir, "customer").join(per, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("orders"), F.coalesce("x", F.lit(20.0)).alias("largest"))


@query("join_broadcast_dim", "SELECT n_name, r_name, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def join_broadcast_dim(spark, sf_dir):
    """Nations and regions are of fixed size."""
    dims = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    per = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.sum("c_acctbal").alias("balance"))
    return per.join(F.broadcast(dims), F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "r_name", "n", F.round("balance", 2).alias("balance"))


BASE = "base AS (SELECT speaker, avg(net_score) AS mean, greatest(stddev_pop(net_score), 0.05::DOUBLE) AS sd FROM items WHERE NOT is_statistical GROUP BY 1 HAVING count(*) >= 4)"


def baselines(spark, sf_dir):
    out = items(spark, sf_dir).where("NOT is_statistical").groupBy("speaker").agg(F.avg("net_score").alias("mean"), F.greatest(F.stddev_pop("net_score"), F.lit(0.05)).alias("sd"), F.count("*").alias("n"))
    return out.where("n >= 4").drop("n")


@query("join_baseline_enrich", with_sql(ITEMS_SQL, BASE) + "SELECT item_id, round(coalesce((net_score - mean) / sd, net_score), 6) AS z FROM items LEFT JOIN (SELECT * FROM base WHERE speaker <> 3) USING (speaker)")
def join_baseline_enrich(spark, sf_dir):
    return items(spark, sf_dir).join(baselines(spark, sf_dir).where("speaker <> 3"), "speaker", "left").select("item_id", six(F.coalesce((F.col("net_score") - F.col("mean")) / F.col("sd"), "net_score")).alias("z"))


@query("join_asof_prev_meeting", IC + "SELECT i.item_id, c.meeting, c.bps FROM items i ASOF LEFT JOIN calendar c ON i.bank = c.bank AND i.item_date > c.meeting")
def join_asof_prev_meeting(spark, sf_dir):
    """Meetings are few per bank, so their intervals are joined on the bank; ``asof`` is for many marks."""
    spans = intervals(calendar(spark), ["bank"], "meeting").select("bank", "meeting", "bps", "next")
    rows = items(spark, sf_dir)
    inside = (rows.item_date > spans.meeting) & (spans.next.isNull() | (rows.item_date <= spans.next))
    return rows.join(F.broadcast(spans), (rows.bank == spans.bank) & inside, "left").select("item_id", "meeting", "bps")


@query("join_asof_orders", "SELECT l_orderkey, l_linenumber, o_orderkey AS last_order FROM (SELECT l_orderkey, l_linenumber, l_shipdate, o_custkey AS cust FROM lineitem JOIN orders ON l_orderkey = o_orderkey) l ASOF LEFT JOIN (SELECT o_custkey, o_orderdate, max(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL) o ON o.o_custkey = l.cust AND l.l_shipdate >= o.o_orderdate")
def join_asof_orders(spark, sf_dir):
    """The customer's latest order when a line was shipped: an as-of join with many marks."""
    o = table(spark, sf_dir, "orders")
    lines = table(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "l_shipdate", "o_custkey")
    marks = o.groupBy("o_custkey", "o_orderdate").agg(F.max("o_orderkey").alias("last_order"))
    return asof(lines, marks, ["o_custkey"], "l_shipdate", "o_orderdate", ["last_order"]).select("l_orderkey", "l_linenumber", "last_order")


@query("join_asof_next_meeting", IC + "SELECT i.item_id, coalesce(strftime(c.meeting, '%Y-%m-%d'), 'Future') AS cycle FROM items i ASOF LEFT JOIN (SELECT * FROM calendar WHERE meeting < DATE '2024-02-01') c ON i.bank = c.bank AND i.item_date <= c.meeting")
def join_asof_next_meeting(spark, sf_dir):
    marks = intervals(calendar(spark).where("meeting < DATE '2024-02-01'"), ["bank"], "meeting").select("bank", "meeting", "previous")
    rows = items(spark, sf_dir)
    inside = (rows.item_date <= marks.meeting) & (marks.previous.isNull() | (rows.item_date > marks.previous))
    return rows.join(F.broadcast(marks), (rows.bank == marks.bank) & inside, "left").select("item_id", F.coalesce(F.date_format("meeting", "yyyy-MM-dd"), F.lit("Future")).alias("cycle"))


SPANS = "spans AS (SELECT *, coalesce(lag(meeting) OVER (PARTITION BY bank ORDER BY meeting), DATE '1900-01-01') AS p, coalesce(lead(meeting) OVER (PARTITION BY bank ORDER BY meeting), DATE '2999-01-01') AS x FROM calendar)"


def cycles(spark, sf_dir):
    """Items within (previous, next) of each meeting; an item is in two windows."""
    spans = intervals(calendar(spark), ["bank"], "meeting").select("bank", "meeting", F.coalesce("previous", F.lit("1900-01-01").cast("date")).alias("p"), F.coalesce("next", F.lit("2999-01-01").cast("date")).alias("x"))
    return items(spark, sf_dir).join(F.broadcast(spans), "bank").where((F.col("item_date") > F.col("p")) & (F.col("item_date") < F.col("x")))


@query("join_interval_cycle", with_sql(ITEMS_SQL, CALENDAR_SQL, SPANS) + "SELECT i.bank, meeting, count(*) AS n, count(*) FILTER (item_date <= meeting) AS pre FROM items i JOIN spans s ON i.bank = s.bank AND item_date > p AND item_date < x GROUP BY ALL")
def join_interval_cycle(spark, sf_dir):
    return cycles(spark, sf_dir).groupBy("bank", "meeting").agg(F.count("*").alias("n"), F.count_if(F.col("item_date") <= F.col("meeting")).alias("pre"))


ROSTER = [(1, "report 1$", "FED", "2024-01-15"), (2, "report [12]$", "FED", None), (3, "^Error", "ECB", "2024-01-20"), (4, "report", "ECB", None)]
ROSTER_SQL = "roster(ord, pattern, bank, until) AS (VALUES " + ", ".join(f"({o}, '{p}', '{b}', " + (f"DATE '{u}'" if u else "NULL") + ")" for o, p, b, u in ROSTER) + ")"


@query("join_validity_interval", with_sql(ITEMS_SQL, ROSTER_SQL) + "SELECT item_id, min(ord) AS member FROM items i JOIN roster r ON i.bank = r.bank AND item_date < coalesce(until, DATE '9999-01-01') AND regexp_matches(title, pattern) GROUP BY item_id")
def join_validity_interval(spark, sf_dir):
    """The first member of a fixed roster whose pattern and term fit: one expression, no join."""
    member = F.lit(None).cast("int")
    for o, p, b, u in reversed(ROSTER):
        fits = (F.col("bank") == b) & F.col("title").rlike(p) & (F.lit(True) if u is None else F.col("item_date") < u)
        member = F.when(fits, o).otherwise(member)
    return items(spark, sf_dir).select("item_id", member.alias("member")).where("member IS NOT NULL")


CHAIRS = [(7, "2024-01-01", "2024-01-12"), (11, "2024-01-12", "2024-03-01")]


@query("join_chair_asof", I + "SELECT item_id FROM items JOIN (VALUES (7, DATE '2024-01-01', DATE '2024-01-12'), (11, DATE '2024-01-12', DATE '2024-03-01')) c(s, a, b) ON speaker = s AND item_date >= a AND item_date < b")
def join_chair_asof(spark, sf_dir):
    chairs = spark.createDataFrame(CHAIRS, "speaker int, a string, b string")
    return items(spark, sf_dir).join(F.broadcast(chairs), "speaker").where((F.col("item_date") >= F.to_date("a")) & (F.col("item_date") < F.to_date("b"))).select("item_id")


MEANS = "m AS (SELECT speaker, avg(net_score) AS mean FROM items GROUP BY 1)"


@query("join_nested_loop_pairs", with_sql(ITEMS_SQL, MEANS) + "SELECT a.speaker AS a, b.speaker AS b, round(greatest(0, 1 - 5 * abs(a.mean - b.mean)), 6) AS similarity FROM m a JOIN m b ON a.speaker < b.speaker WHERE greatest(0, 1 - 5 * abs(a.mean - b.mean)) > 0.3")
def join_nested_loop_pairs(spark, sf_dir):
    """Pairs of speakers with close means. Only means within 0.14 pass, so each is met with its own
    and the next bucket of that width instead of with all."""
    wide = 0.7 / 5
    m = items(spark, sf_dir).groupBy("speaker").agg(F.avg("net_score").alias("mean")).withColumn("bucket", F.floor(F.col("mean") / wide))
    near = m.select(F.col("speaker").alias("other"), F.col("mean").alias("its"), F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)).alias("bucket"))
    alike = F.greatest(F.lit(0.0), 1 - 5 * F.abs(F.col("mean") - F.col("its")))
    pairs = m.join(near, "bucket").where(F.col("speaker") < F.col("other")).withColumn("s", alike).where("s > 0.3")
    return pairs.select(F.col("speaker").alias("a"), F.col("other").alias("b"), six("s").alias("similarity"))


@query("join_nested_loop_regex", I + "SELECT pattern, count(*) AS n, round(avg(net_score), 6) AS mean FROM items JOIN (VALUES ('(?i)click'), ('[13579]$'), ('^S'), ('zzz')) p(pattern) ON regexp_matches(title, pattern) GROUP BY pattern")
def join_nested_loop_regex(spark, sf_dir):
    """A fixed lexicon against all items in one pass: the hits of a row as an array."""
    patterns = ["(?i)click", "[13579]$", "^S", "zzz"]
    hits = F.array_compact(F.array(*(F.when(F.col("title").rlike(p), F.lit(p)) for p in patterns)))
    return items(spark, sf_dir).select(F.explode(hits).alias("pattern"), "net_score").groupBy("pattern").agg(F.count("*").alias("n"), six(F.avg("net_score")).alias("mean"))


RULES = [(1, "tone", "gt", 0.0), (2, "tone", "lt", -0.5), (3, "n", "gte", 100.0), (4, "latest", "eq", 0.5), (5, "gone", "gt", 0.0)]


@query("join_cross_rules", I + """, m AS (SELECT bank, unnest([{'metric': 'tone', 'v': avg(net_score)}, {'metric': 'n', 'v': count(*)::DOUBLE}, {'metric': 'latest', 'v': max_by(net_score, item_id)}], recursive := true) FROM items GROUP BY bank)
  SELECT r.id, bank, m.metric, round(v, 6) AS v FROM m JOIN (VALUES (1, 'tone', 'gt', 0.0), (2, 'tone', 'lt', -0.5), (3, 'n', 'gte', 100.0), (4, 'latest', 'eq', 0.5), (5, 'gone', 'gt', 0.0)) r(id, metric, op, t) USING (metric)
  WHERE CASE op WHEN 'gt' THEN v > t WHEN 'lt' THEN v < t WHEN 'gte' THEN v >= t WHEN 'lte' THEN v <= t ELSE abs(v - t) < 0.01 END""")
def join_cross_rules(spark, sf_dir):
    from tidemark.operators.alerts import evaluate

    metrics = items(spark, sf_dir).groupBy("bank").agg(F.avg("net_score").alias("tone"), F.count("*").cast("double").alias("n"), F.max_by("net_score", "item_id").alias("latest"))
    long = metrics.unpivot("bank", ["tone", "n", "latest"], "metric", "v")
    return evaluate(long, spark.createDataFrame(RULES, "id int, metric string, op string, t double")).select("id", "bank", "metric", six("v").alias("v"))


@query("join_semi_in_subquery", I + "SELECT item_id FROM items WHERE item_id IN (SELECT item_id FROM (SELECT item_id, row_number() OVER (PARTITION BY source, speaker, value ORDER BY item_id) AS rn FROM items) WHERE rn > 1)")
def join_semi_in_subquery(spark, sf_dir):
    rows = items(spark, sf_dir)
    ranked = rows.select("item_id", F.row_number().over(DUP().orderBy("item_id")).alias("rn")).where("rn > 1")
    return rows.join(ranked, "item_id", "left_semi").select("item_id")


@query("join_self_older", I + "SELECT item_id FROM items a WHERE NOT EXISTS (SELECT 1 FROM items b WHERE a.user_id = b.user_id AND a.item_date < b.item_date)")
def join_self_older(spark, sf_dir):
    """What is left when every older row of the same key is deleted: rows on the key's last day."""
    rows = items(spark, sf_dir)
    last = rows.groupBy("user_id").agg(F.max("item_date").alias("item_date"))
    return rows.join(last, ["user_id", "item_date"], "left_semi").select("item_id")


@query("join_anti_same_row", I + f"SELECT item_id FROM items o WHERE item_date >= {AS_OF_SQL} - 20 AND NOT EXISTS (SELECT 1 FROM items r WHERE r.item_date >= {AS_OF_SQL} - 10 AND r.item_date = o.item_date AND r.title = o.title)")
def join_anti_same_row(spark, sf_dir):
    rows = items(spark, sf_dir)
    recent = rows.where(F.col("item_date") >= F.date_sub(F.lit(AS_OF), 10)).select("item_date", "title").distinct()
    return rows.where(F.col("item_date") >= F.date_sub(F.lit(AS_OF), 20)).join(recent, ["item_date", "title"], "left_anti").select("item_id")


FUZZY = "['the', 'long', 'report', 'on', 'how', 'it', 'went', 'by' || (k // 10 % 5), (k % 10)::VARCHAR, 'at' || (user_id % 7)]"


@query("join_fuzzy_interval_anti", with_sql(ITEMS_SQL, f"w AS (SELECT *, {FUZZY} AS words FROM items)") + """SELECT item_id FROM w a WHERE source = 'click' AND NOT EXISTS (SELECT 1 FROM w b WHERE b.source = 'view' AND a.speaker = b.speaker AND a.bank = b.bank AND abs(a.item_date - b.item_date) <= 7
  AND len(list_intersect(a.words, b.words)) >= 0.8 * len(list_distinct(list_concat(a.words, b.words))))""")
def join_fuzzy_interval_anti(spark, sf_dir):
    """Drop what another source has within seven days under nearly the same title: of its ten words one may differ."""
    title = F.array(
        *map(F.lit, "the long report on how it went".split()), F.concat(F.lit("by"), (F.floor(F.col("k") / 10) % 5).cast("string")), (F.col("k") % 10).cast("string"), F.concat(F.lit("at"), (F.col("user_id") % 7).cast("string"))
    )
    rows = items(spark, sf_dir).withColumn("words", title)
    return without_similar(rows.where("source = 'click'"), rows.where("source = 'view'"), ["speaker", "bank"], "item_id", "item_date", "words").select("item_id")


@query("join_related_rows", I + "SELECT item_id, count(*) OVER (PARTITION BY speaker, item_date) - 1 AS related FROM items")
def join_related_rows(spark, sf_dir):
    """How many rows share speaker and day; the pairs themselves needn't be formed."""
    return items(spark, sf_dir).select("item_id", (F.count("*").over(W("speaker", "item_date")) - 1).alias("related"))


@query("join_voter_year", "SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN (VALUES (1996, 1), (1996, 4), (1997, 2), (1998, 7)) v(y, nation) ON year(o_orderdate) = y AND c_nationkey = nation")
def join_voter_year(spark, sf_dir):
    rotation = spark.createDataFrame([(1996, 1), (1996, 4), (1997, 2), (1998, 7)], "y int, c_nationkey int")
    o = table(spark, sf_dir, "orders").where(F.year("o_orderdate").between(1996, 1998)).withColumn("y", F.year("o_orderdate"))
    c = table(spark, sf_dir, "customer").join(F.broadcast(rotation.select("c_nationkey").distinct()), "c_nationkey", "left_semi")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(rotation), ["y", "c_nationkey"], "left_semi").select("o_orderkey")
