"""The published index and its parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.numerics import round_up, six
from tidemark.operators import index, weights
from tidemark.plans.base import AS_OF, AS_OF_SQL, CALENDAR_SQL, CHAIR, ITEMS_SQL, MEETINGS_SQL, calendar, items, meetings, query, scored, with_sql

HALF_SQL = f"""half AS (
  SELECT bank, CASE WHEN min(gap) FILTER (gap >= 0) <= 5 THEN 7.0 WHEN min(gap) FILTER (gap >= 0) <= 14 THEN 10.0
    WHEN min(-gap) FILTER (gap < 0) <= 5 THEN 8.0 ELSE 21.0 END::DOUBLE AS half_life
  FROM (SELECT bank, meeting - {AS_OF_SQL} AS gap FROM calendar) GROUP BY bank)"""

TIER_SQL = "CASE WHEN lower(title) LIKE '%click%' THEN 4 WHEN lower(title) LIKE '%error%' THEN 1 WHEN lower(title) LIKE '%view%' THEN 2 ELSE 3 END"

WEIGHTED_SQL = f"""weighted AS (
  SELECT *, greatest(0.01::DOUBLE, pow(0.5::DOUBLE, age / half_life)) * CASE WHEN is_statistical THEN
      CASE WHEN coalesce(stat_weight, 0) > 0 THEN least(3.0::DOUBLE, stat_weight) / 2 ELSE 0.5::DOUBLE END
      ELSE CASE tier WHEN 1 THEN 1.0::DOUBLE WHEN 2 THEN 0.7::DOUBLE WHEN 4 THEN 0.1::DOUBLE ELSE 0.4::DOUBLE END END AS weight
  FROM (SELECT i.*, {TIER_SQL} AS tier, greatest({AS_OF_SQL} - item_date, 0) AS age, coalesce(half_life, 21.0::DOUBLE) AS half_life
        FROM items i LEFT JOIN half USING (bank) WHERE abs(net_score) > 0.001))"""


def capped_sql(source: str, group: str) -> str:
    """The cap as five chained steps over rows."""
    steps = [f"c0 AS (SELECT *, CASE WHEN NOT is_statistical AND speaker <> {CHAIR} THEN speaker ELSE -1 END AS sp FROM {source})"]
    for i in range(5):
        steps.append(f"""c{i + 1} AS (SELECT * EXCLUDE (weight, t, s), CASE WHEN sp >= 0 AND t > 0 AND s > 0.10 * t + 1e-9 THEN weight * 0.10 * t / s ELSE weight END AS weight
          FROM (SELECT *, sum(weight) OVER (PARTITION BY {group}) AS t, sum(weight) OVER (PARTITION BY {group}, sp) AS s FROM c{i}))""")
    return ", ".join(steps)


BASE_SQL = with_sql(CALENDAR_SQL, ITEMS_SQL, HALF_SQL, WEIGHTED_SQL)
R3 = "floor({} * 1000.0::DOUBLE + 0.5) / 1000.0::DOUBLE"
LEVELS = "CASE WHEN {0} <= -0.5 THEN 'very dovish' WHEN {0} < -0.1 THEN 'dovish' WHEN {0} >= 0.5 THEN 'very hawkish' WHEN {0} > 0.1 THEN 'hawkish' ELSE 'neutral' END"


#: The tiers of the test items, whose titles are made of event types.
RULES = ((4, "click"), (1, "error"), (2, "view"))


def ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weights.weighted(scored(items(spark, sf_dir)), calendar(spark), AS_OF, RULES)


@query("dom_dynamic_half_life", with_sql(MEETINGS_SQL, HALF_SQL) + "SELECT * FROM half")
def dynamic_half_life(spark, sf_dir):
    return weights.half_lives(meetings(spark, sf_dir), AS_OF)


@query("dom_item_weight", BASE_SQL + "SELECT item_id, tier, age, round(weight, 6) AS weight FROM weighted")
def item_weight(spark, sf_dir):
    return ready(spark, sf_dir).select("item_id", "tier", "age", six("weight").alias("weight"))


@query("dom_speaker_cap", BASE_SQL + ", " + capped_sql("weighted", "bank, is_statistical") + " SELECT bank, is_statistical, sp AS speaker, round(sum(weight), 6) AS weight, count(*) AS n FROM c5 GROUP BY ALL")
def speaker_cap(spark, sf_dir):
    group = ["bank", "is_statistical"]
    sums = weights.speaker_factors(weights.speaker_sums(ready(spark, sf_dir), group, CHAIR), group)
    return sums.select(*group, "speaker", six(F.col("w") * F.col("factor")).alias("weight"), "n")


AGG_SQL = f"""SELECT *, {LEVELS.format("score")} AS label FROM (
  SELECT bank, is_statistical, {R3.format("(sum(net_score * weight) / sum(weight))")} AS score, count(*) AS n, min(age) AS freshest,
    count(*) FILTER (net_score > 0.1) AS n_hawkish, count(*) FILTER (net_score < -0.1) AS n_dovish, count(*) FILTER (net_score BETWEEN -0.1 AND 0.1) AS n_neutral,
    count(*) FILTER (tier = 1) AS tier_1, count(*) FILTER (tier = 2) AS tier_2, count(*) FILTER (tier = 3) AS tier_3, count(*) FILTER (tier = 4) AS tier_4
  FROM c5 GROUP BY bank, is_statistical)"""


@query("dom_weighted_aggregate", BASE_SQL + ", " + capped_sql("weighted", "bank, is_statistical") + AGG_SQL)
def weighted_aggregate(spark, sf_dir):
    return index.aggregate(ready(spark, sf_dir), ["bank", "is_statistical"], CHAIR)


@query("agg_weighted_simple", BASE_SQL + f"SELECT bank, {R3.format('(sum(net_score * weight) / sum(weight))')} AS score, count(*) AS n FROM weighted GROUP BY bank")
def weighted_simple(spark, sf_dir):
    return ready(spark, sf_dir).groupBy("bank").agg(round_up(F.sum(F.col("net_score") * F.col("weight")) / F.sum("weight")).alias("score"), F.count("*").alias("n"))


ANCHOR_SQL = f"""anchors AS (
  SELECT bank, {R3.format(f"greatest(-0.7::DOUBLE, least(0.7::DOUBLE, sum(bps / 25.0::DOUBLE * 0.45::DOUBLE * pow(0.5::DOUBLE, ({AS_OF_SQL} - meeting) / 120.0::DOUBLE))))")} AS anchor
  FROM calendar WHERE {AS_OF_SQL} - meeting BETWEEN 0 AND 180 GROUP BY bank)"""


@query("dom_action_anchor", with_sql(MEETINGS_SQL, ANCHOR_SQL) + "SELECT * FROM anchors")
def action_anchor(spark, sf_dir):
    return index.anchors(meetings(spark, sf_dir), AS_OF)


INDEX_SQL = (
    with_sql(CALENDAR_SQL, ITEMS_SQL, HALF_SQL, WEIGHTED_SQL)
    + f""", last AS (SELECT bank, max(meeting) AS last_meeting FROM calendar WHERE meeting <= {AS_OF_SQL} GROUP BY bank),
  windowed AS (SELECT w.* FROM weighted w LEFT JOIN last USING (bank) WHERE item_date <= {AS_OF_SQL} AND (
      (NOT is_statistical AND (item_date >= {AS_OF_SQL} - 45 OR (tier = 1 AND item_date >= last_meeting))) OR (is_statistical AND item_date >= {AS_OF_SQL} - 60))), """
    + capped_sql("windowed", "bank, is_statistical")
    + f""", sides AS (SELECT bank, {R3.format("(sum(net_score * weight) FILTER (NOT is_statistical) / sum(weight) FILTER (NOT is_statistical))")} AS text_score, count(*) FILTER (NOT is_statistical) AS text_n,
      min(age) FILTER (NOT is_statistical) AS text_age, {R3.format("(sum(net_score * weight) FILTER (is_statistical) / sum(weight) FILTER (is_statistical))")} AS stat_score,
      count(*) FILTER (is_statistical) AS stat_n, min(age) FILTER (is_statistical) AS stat_age, min(half_life) AS half_life FROM c5 GROUP BY bank),
  {ANCHOR_SQL},
  mixed AS (SELECT s.*, coalesce(anchor, 0.0) AS anchor, CASE WHEN text_age IS NULL THEN 0.0 WHEN stat_age IS NULL THEN 1.0 ELSE
      floor(greatest(0.35::DOUBLE, least(0.85::DOUBLE, 0.6::DOUBLE + greatest(-14.0::DOUBLE, least(14.0::DOUBLE, stat_age - text_age)) / 14 * 0.2::DOUBLE + CASE WHEN half_life <= 10 THEN 0.05::DOUBLE ELSE 0.0 END)) * 100 + 0.5) / 100 END AS alpha
    FROM sides s LEFT JOIN anchors USING (bank)),
  told AS (SELECT *, {R3.format("(alpha * coalesce(text_score, 0.0) + (1 - alpha) * coalesce(stat_score, 0.0))")} AS narrative FROM mixed),
  final AS (SELECT *, {R3.format("(0.65::DOUBLE * narrative + 0.35::DOUBLE * anchor)")} AS index FROM told)
  SELECT bank, text_score, text_n, stat_score, stat_n, alpha, anchor, narrative, index, {LEVELS.format("index")} AS label FROM final"""
)


@query("dom_published_index", INDEX_SQL)
def published_index(spark, sf_dir):
    return index.published(scored(items(spark, sf_dir)), calendar(spark), AS_OF, CHAIR, RULES)


@query("dom_blended_aggregate", INDEX_SQL.rpartition("SELECT bank, text_score")[0] + "SELECT bank, narrative, anchor, index FROM final")
def blended_aggregate(spark, sf_dir):
    return published_index(spark, sf_dir).select("bank", "narrative", "anchor", "index")


@query("dom_dynamic_alpha", INDEX_SQL.rpartition("SELECT bank, text_score")[0] + "SELECT bank, alpha FROM final")
def dynamic_alpha(spark, sf_dir):
    return published_index(spark, sf_dir).select("bank", "alpha")


@query("agg_comms_45d", INDEX_SQL.rpartition("SELECT bank, text_score")[0] + "SELECT bank, text_score AS score, text_n AS n FROM final")
def comms_45d(spark, sf_dir):
    return published_index(spark, sf_dir).select("bank", F.col("text_score").alias("score"), F.col("text_n").alias("n"))


@query("dom_score_attribution", INDEX_SQL.rpartition("SELECT bank, text_score")[0] + f""", t AS (SELECT bank, item_id, is_statistical, net_score * weight AS p, sum(weight) OVER c AS w, sum(abs(net_score * weight)) OVER c AS a FROM c5 WINDOW c AS (PARTITION BY bank, is_statistical))
  SELECT bank, item_id, is_statistical, {R3.format("(p / w * CASE WHEN is_statistical THEN 1 - alpha ELSE alpha END)")} + 0.0 AS contribution, round(abs(p) / a, 6) AS share FROM t JOIN final USING (bank)""")
def score_attribution(spark, sf_dir):
    found = index.attribution(scored(items(spark, sf_dir)), calendar(spark), AS_OF, CHAIR, RULES)
    return found.withColumns({"contribution": F.col("contribution") + F.lit(0.0), "share": six("share")})


def dated_items(spark, sf_dir):
    """The items, spread over a year, with a month that one bank lacks and one that the other lacks."""
    back = F.floor(F.col("user_id") / 2) % 12
    rows = items(spark, sf_dir).withColumn("back", back).where((F.col("back") != 3) | (F.col("bank") != "ECB")).where((F.col("back") != 5) | (F.col("bank") != "FED"))
    return scored(rows.withColumn("item_date", F.add_months("item_date", -F.col("back").cast("int"))))


MONTHLY_SQL = (
    with_sql(CALENDAR_SQL, ITEMS_SQL)
    + f""", dated AS (SELECT * REPLACE ((item_date - to_months(back))::DATE AS item_date) FROM (SELECT *, (user_id // 2 % 12)::INT AS back FROM items)
    WHERE abs(net_score) > 0.001 AND NOT (back = 3 AND bank = 'ECB') AND NOT (back = 5 AND bank = 'FED')),
  monthly AS (SELECT *, (date_trunc('month', item_date) + INTERVAL 1 MONTH)::DATE AS as_of FROM dated),
  groups AS (SELECT DISTINCT bank, as_of FROM monthly),
  half AS (SELECT bank, as_of, CASE WHEN min(gap) FILTER (gap >= 0) <= 5 THEN 7.0 WHEN min(gap) FILTER (gap >= 0) <= 14 THEN 10.0
    WHEN min(-gap) FILTER (gap < 0) <= 5 THEN 8.0 ELSE 21.0 END::DOUBLE AS half_life FROM (SELECT bank, as_of, meeting - as_of AS gap FROM groups JOIN calendar USING (bank)) GROUP BY ALL),
  weighted AS (
    SELECT *, greatest(0.01::DOUBLE, pow(0.5::DOUBLE, age / half_life)) * CASE WHEN is_statistical THEN
      CASE WHEN coalesce(stat_weight, 0) > 0 THEN least(3.0::DOUBLE, stat_weight) / 2 ELSE 0.5::DOUBLE END
      ELSE CASE tier WHEN 1 THEN 1.0::DOUBLE WHEN 2 THEN 0.7::DOUBLE WHEN 4 THEN 0.1::DOUBLE ELSE 0.4::DOUBLE END END AS weight
    FROM (SELECT m.*, {TIER_SQL} AS tier, as_of - item_date AS age, half_life FROM monthly m JOIN half USING (bank, as_of))), """
    + capped_sql("weighted", "bank, as_of, is_statistical")
    + f""", sides AS (SELECT bank, as_of, {R3.format("(sum(net_score * weight) FILTER (NOT is_statistical) / sum(weight) FILTER (NOT is_statistical))")} AS text_score, count(*) FILTER (NOT is_statistical) AS text_n,
      min(age) FILTER (NOT is_statistical) AS text_age, {R3.format("(sum(net_score * weight) FILTER (is_statistical) / sum(weight) FILTER (is_statistical))")} AS stat_score,
      count(*) FILTER (is_statistical) AS stat_n, min(age) FILTER (is_statistical) AS stat_age, min(half_life) AS half_life FROM c5 GROUP BY bank, as_of),
  anchored AS (SELECT g.bank, g.as_of, coalesce({R3.format("greatest(-0.7::DOUBLE, least(0.7::DOUBLE, coalesce(sum(bps / 25.0::DOUBLE * 0.45::DOUBLE * pow(0.5::DOUBLE, (as_of - meeting) / 120.0::DOUBLE)) FILTER (as_of - meeting BETWEEN 0 AND 180), 0)))")}, 0.0) AS anchor
    FROM groups g JOIN calendar USING (bank) GROUP BY ALL),
  mixed AS (SELECT s.*, anchor, CASE WHEN text_age IS NULL THEN 0.0 WHEN stat_age IS NULL THEN 1.0 ELSE
      floor(greatest(0.35::DOUBLE, least(0.85::DOUBLE, 0.6::DOUBLE + greatest(-14.0::DOUBLE, least(14.0::DOUBLE, stat_age - text_age)) / 14 * 0.2::DOUBLE + CASE WHEN half_life <= 10 THEN 0.05::DOUBLE ELSE 0.0 END)) * 100 + 0.5) / 100 END AS alpha
    FROM sides s JOIN anchored USING (bank, as_of)),
  told AS (SELECT *, {R3.format("(alpha * coalesce(text_score, 0.0) + (1 - alpha) * coalesce(stat_score, 0.0))")} AS narrative FROM mixed),
  m AS (SELECT bank, (as_of - INTERVAL 1 MONTH)::DATE AS month, text_score, text_n, stat_score, stat_n, alpha, anchor, narrative, {R3.format("(0.65::DOUBLE * narrative + 0.35::DOUBLE * anchor)")} AS index FROM told) """
)


@query("dom_monthly_index", MONTHLY_SQL + "SELECT * FROM m")
def monthly_index(spark, sf_dir):
    return index.monthly(dated_items(spark, sf_dir), calendar(spark), CHAIR, RULES).drop("as_of", "label")


@query("dom_index_history", MONTHLY_SQL + """SELECT coalesce(a.month, b.month) AS month, a.index AS fed, coalesce(a.text_n + a.stat_n, 0) AS fed_n, b.index AS ecb, coalesce(b.text_n + b.stat_n, 0) AS ecb_n
  FROM (SELECT * FROM m WHERE bank = 'FED') a FULL JOIN (SELECT * FROM m WHERE bank = 'ECB') b ON a.month = b.month""")
def index_history(spark, sf_dir):
    return index.history(monthly_index(spark, sf_dir), "FED", "ECB")


@query("dom_current_rate", with_sql(MEETINGS_SQL) + f"SELECT bank, round(5.25::DOUBLE + sum(bps) / 100.0::DOUBLE, 2) AS rate FROM calendar WHERE meeting <= {AS_OF_SQL} GROUP BY bank")
def current_rate(spark, sf_dir):
    return meetings(spark, sf_dir).where(F.col("meeting") <= F.lit(AS_OF)).groupBy("bank").agg(F.round(5.25 + F.sum("bps") / 100.0, 2).alias("rate"))


@query("agg_freshest_age", with_sql(ITEMS_SQL) + f"SELECT bank, is_statistical, min(greatest({AS_OF_SQL} - item_date, 0)) AS age FROM items GROUP BY ALL")
def freshest_age(spark, sf_dir):
    return items(spark, sf_dir).groupBy("bank", "is_statistical").agg(F.min(F.greatest(F.datediff(F.lit(AS_OF), "item_date"), F.lit(0))).alias("age"))


@query("win_cumulative_waterfall", BASE_SQL + """, f AS (SELECT bank, source, sum(net_score * weight) AS c FROM weighted GROUP BY ALL)
  SELECT bank, source, round(c, 6) AS part, round(sum(c) OVER (PARTITION BY bank ORDER BY abs(c) DESC, source), 6) AS running FROM f
  UNION ALL SELECT bank, 'total', round(sum(c), 6), round(sum(c), 6) FROM f GROUP BY bank""")
def cumulative_waterfall(spark, sf_dir):
    parts = ready(spark, sf_dir).groupBy("bank", "source").agg(F.sum(F.col("net_score") * F.col("weight")).alias("c"))
    order = Window.partitionBy("bank").orderBy(F.desc(F.abs("c")), "source").rowsBetween(Window.unboundedPreceding, 0)
    rows = parts.select("bank", "source", six("c").alias("part"), six(F.sum("c").over(order)).alias("running"))
    total = parts.groupBy("bank").agg(six(F.sum("c")).alias("part")).select("bank", F.lit("total").alias("source"), "part", F.col("part").alias("running"))
    return rows.unionByName(total)
