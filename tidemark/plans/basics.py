"""Filters, case cascades, aggregations, sorting and set operations over the items."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.numerics import five_levels, points, ratio, round_up, six, three_levels
from tidemark.operators import rules
from tidemark.plans.base import AS_OF, AS_OF_SQL, CALENDAR_SQL, ITEMS_SQL, SERIES_SQL, calendar, items, query, scored, series, with_sql
from tidemark.session import table

I = with_sql(ITEMS_SQL)  # noqa: E741
R3 = "floor({} * 1000.0::DOUBLE + 0.5) / 1000.0::DOUBLE"
TONE = "CASE WHEN net_score > 0.1 THEN 'hawkish' WHEN net_score < -0.1 THEN 'dovish' ELSE 'neutral' END"
at = lambda days: F.date_sub(F.lit(AS_OF), days)


@query("scan_rest_filter", I + "SELECT item_id, net_score FROM items WHERE bank = 'FED' AND is_statistical = false ORDER BY item_date DESC, item_id LIMIT 50")
def scan_rest_filter(spark, sf_dir):
    return items(spark, sf_dir).where("bank = 'FED' AND NOT is_statistical").orderBy(F.desc("item_date"), "item_id").limit(50).select("item_id", "net_score")


@query("scan_paged", I + "SELECT item_id, bank FROM items ORDER BY item_id LIMIT 100 OFFSET 200")
def scan_paged(spark, sf_dir):
    return items(spark, sf_dir).orderBy("item_id").offset(200).limit(100).select("item_id", "bank")


@query("filter_scored", I + "SELECT item_id FROM items WHERE abs(net_score) > 0.001")
def filter_scored(spark, sf_dir):
    return scored(items(spark, sf_dir)).select("item_id")


@query("filter_window_days", I + f"SELECT days, count(*) AS n FROM items, (VALUES (7), (14), (30), (45), (60), (90)) w(days) WHERE item_date >= {AS_OF_SQL} - days GROUP BY days")
def filter_window_days(spark, sf_dir):
    days = [7, 14, 30, 45, 60, 90]
    one = items(spark, sf_dir).agg(*(F.count_if(F.col("item_date") >= at(d)).alias(str(d)) for d in days))
    return one.select(F.explode(F.map_from_entries(F.array(*(F.struct(F.lit(d).alias("days"), F.col(str(d)).alias("n")) for d in days)))).alias("days", "n")).where("n > 0")


@query("filter_exclusive_range", I + "SELECT count(*) FILTER (item_date > DATE '2024-01-08' AND item_date <= DATE '2024-01-17') AS before, count(*) FILTER (item_date > DATE '2024-01-17' AND item_date < DATE '2024-01-25') AS after FROM items")
def filter_exclusive_range(spark, sf_dir):
    d = F.col("item_date")
    return items(spark, sf_dir).agg(F.count_if((d > "2024-01-08") & (d <= "2024-01-17")).alias("before"), F.count_if((d > "2024-01-17") & (d < "2024-01-25")).alias("after"))


@query("filter_comms_window", with_sql(ITEMS_SQL, CALENDAR_SQL) + f"""SELECT i.bank, count(*) AS n FROM items i JOIN (SELECT bank, max(meeting) AS m FROM calendar WHERE meeting <= {AS_OF_SQL} GROUP BY bank) USING (bank)
  WHERE item_date >= {AS_OF_SQL} - 5 OR (source = 'error' AND item_date >= m) GROUP BY i.bank""")
def filter_comms_window(spark, sf_dir):
    last = calendar(spark).where(F.col("meeting") <= F.lit(AS_OF)).groupBy("bank").agg(F.max("meeting").alias("m"))
    return items(spark, sf_dir).join(F.broadcast(last), "bank").where((F.col("item_date") >= at(5)) | ((F.col("source") == "error") & (F.col("item_date") >= F.col("m")))).groupBy("bank").agg(F.count("*").alias("n"))


@query("filter_ilike", I + "SELECT item_id FROM items WHERE title ILIKE '%REPORT 3%'")
def filter_ilike(spark, sf_dir):
    return items(spark, sf_dir).where(F.col("title").ilike("%REPORT 3%")).select("item_id")


@query("filter_regex_case_insensitive", I + "SELECT item_id FROM items WHERE regexp_matches(title, '(?i)^(click|error) report [0-4]$') AND NOT regexp_matches(title, '2$')")
def filter_regex(spark, sf_dir):
    t = F.col("title")
    return items(spark, sf_dir).where(t.rlike("(?i)^(click|error) report [0-4]$") & ~t.rlike("2$")).select("item_id")


@query("filter_is_null", I + "SELECT count(*) FILTER (x IS NULL) AS untagged, count(*) FILTER (x = '') AS empty, count(*) AS n FROM (SELECT CASE WHEN k = 0 THEN NULL WHEN k = 1 THEN '' ELSE source END AS x FROM items)")
def filter_is_null(spark, sf_dir):
    x = F.when(F.col("k") == 0, None).when(F.col("k") == 1, "").otherwise(F.col("source"))
    return items(spark, sf_dir).select(x.alias("x")).agg(F.count_if(F.col("x").isNull()).alias("untagged"), F.count_if(F.col("x") == "").alias("empty"), F.count("*").alias("n"))


@query("filter_text_search", I + "SELECT item_id FROM items WHERE (contains(lower(title), 'port 7') OR contains(lower(source), 'sign')) AND bank IN ('FED') AND net_score > 0.1")
def filter_text_search(spark, sf_dir):
    hit = F.lower("title").contains("port 7") | F.lower("source").contains("sign")
    return items(spark, sf_dir).where(hit & F.col("bank").isin("FED") & (F.col("net_score") > 0.1)).select("item_id")


EXISTS = I + "SELECT item_id FROM items n WHERE item_date >= DATE '2024-01-20' AND NOT EXISTS (SELECT 1 FROM items o WHERE o.title = n.title AND o.bank = n.bank AND o.item_date < DATE '2024-01-03' AND NOT (o.source = 'error' AND abs(o.net_score) <= 0.3))"


@query("filter_exists_in_set", EXISTS)
def filter_exists_in_set(spark, sf_dir):
    """New rows whose title is not stored; policy documents near zero don't count as stored."""
    rows = items(spark, sf_dir)
    stored = rows.where(F.col("item_date") < "2024-01-03").where(~((F.col("source") == "error") & (F.abs("net_score") <= 0.3))).select("bank", "title").distinct()
    return rows.where(F.col("item_date") >= "2024-01-20").join(stored, ["bank", "title"], "left_anti").select("item_id")


@query("except_existing", EXISTS)
def except_existing(spark, sf_dir):
    return filter_exists_in_set(spark, sf_dir)


@query("join_anti_existing", EXISTS)
def join_anti_existing(spark, sf_dir):
    return filter_exists_in_set(spark, sf_dir)


@query("filter_feed_rules", I + "SELECT source, item_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY item_id) AS rn FROM items WHERE NOT (source = 'view' OR regexp_matches(title, '9$') OR net_score = 1)) WHERE rn <= 50")
def filter_feed_rules(spark, sf_dir):
    kept = items(spark, sf_dir).where(~((F.col("source") == "view") | F.col("title").rlike("9$") | (F.col("net_score") == 1)))
    return top_rows(kept, "source", ["item_id"], 50).select("source", "item_id")


def top_rows(rows, group, order, n):
    """First n rows of each group; Spark limits every partition's groups before the shuffle."""
    return rows.withColumn("__rn", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("__rn") <= n).drop("__rn")


#: Headlines and bodies that meet every rule, each with the class that its words alone have.
HEADLINES = [
    ("Monetary policy decisions", "policy"), ("Digital euro report", "operational"), ("Digital euro and inflation", "policy"), ("A lecture", ""), ("TARGET2 holidays", "operational"), ("Unemployment in June", "policy"), ("Housing market developments", "macro"),
    ("Governor appointed", "operational"), ("Annual dinner", ""), ("Trade and tariffs", "macro"), ("An open day", "operational"), ("Neutral rate revisited", "policy"), ("R star", ""),
]
BODIES = [("", ""), ("We saw inflation fall.", "policy"), ("Bank lending grew.", "macro"), (None, ""), ("Nothing of note.", ""), ("x " * 2000 + "inflation", ""), ("x " * 1900 + "inflation", "policy")]
_values = lambda name, rows: f"{name}(i, words, class) AS (VALUES " + ", ".join("({}, {}, '{}')".format(i, "NULL" if w is None else f"'{w}'", c) for i, (w, c) in enumerate(rows)) + ")"
RELEVANCE_SQL = with_sql(ITEMS_SQL, f"""{_values('heads', HEADLINES)}, {_values('bodies', BODIES)}, classed AS (SELECT item_id, h.class AS h, b.class AS b FROM items JOIN heads h ON h.i = item_id % {len(HEADLINES)} JOIN bodies b ON b.i = k % {len(BODIES)}),
  verdicts AS (SELECT item_id, CASE WHEN h = 'policy' THEN 'policy' WHEN h = 'operational' THEN 'operational' WHEN b = 'policy' THEN 'policy' WHEN h = 'macro' OR b = 'macro' THEN 'macro-adjacent' ELSE 'operational' END AS verdict, h = 'operational' AS named FROM classed)""")


def headlines(spark, sf_dir):
    """Items under these headlines and with these bodies."""
    pick = lambda rows, i: F.get(F.array(*(F.lit(w).cast("string") for w, _ in rows)), (i % len(rows)).cast("int"))
    return items(spark, sf_dir).withColumns({"title": pick(HEADLINES, F.col("item_id")), "body": pick(BODIES, F.col("k"))})


@query("partition_scorable_noise", RELEVANCE_SQL + "SELECT item_id, CASE WHEN verdict = 'operational' THEN 'noise' ELSE 'scorable' END AS side FROM verdicts")
def partition_scorable_noise(spark, sf_dir):
    """Every row is read and judged once, and the side is its verdict."""
    noise = rules.relevance(F.col("title"), F.col("source"), F.col("body"))["verdict"] == "operational"
    return headlines(spark, sf_dir).select("item_id", F.when(noise, "noise").otherwise("scorable").alias("side"))


@query("case_document_tier", I + "SELECT item_id, CASE WHEN lower(title) LIKE '%click%' THEN 4 WHEN lower(title) LIKE '%error%' THEN 1 WHEN lower(title) LIKE '%view%' THEN 2 ELSE 3 END AS tier FROM items")
def case_document_tier(spark, sf_dir):
    from tidemark.operators.weights import tier
    from tidemark.plans.core import RULES

    return items(spark, sf_dir).select("item_id", tier(F.col("source"), F.col("title"), RULES).alias("tier"))


@query("case_relevance", RELEVANCE_SQL + "SELECT item_id, verdict, CASE WHEN verdict = 'policy' THEN 'layer1:policy' WHEN verdict = 'macro-adjacent' THEN 'layer1:macro-adjacent' WHEN named THEN 'layer1:operational' ELSE 'layer1:no-policy-content' END AS reason FROM verdicts")
def case_relevance(spark, sf_dir):
    """Headline before body, and of the body the first 4000 characters; a pattern in the reason is left out here."""
    found = headlines(spark, sf_dir).select("item_id", rules.relevance(F.col("title"), F.col("source"), F.col("body")).alias("r"))
    return found.select("item_id", "r.verdict", F.split_part("r.reason", F.lit(" ("), F.lit(1)).alias("reason"))


#: Sources and titles of documents, and which are decisions, projections, policy documents and surveys.
CLASSES = [
    ("FOMC Statement", "Federal Reserve issues FOMC statement", True, False, True, False), ("ECB Press", "Monetary policy decisions", True, False, True, False), ("ECB Press Conf", "Monetary policy decisions", False, False, True, False),
    ("FOMC SEP", "June", False, True, True, False), ("X", "Summary of Economic Projections", False, True, False, False), ("Speech", "A speech", False, False, False, False), ("meeting", "of", False, False, False, False),
    ("ECB", "Survey of Professional Forecasters", False, False, False, True), ("Interview", "On the bank lending survey", False, False, False, False), ("Fed", "Survey shows easier lending", False, False, False, True), ("Fed", "Survey. Then lending", False, False, False, False),
]
CLASSES_SQL = with_sql(ITEMS_SQL, "classes(i, decision, sep, policy, survey) AS (VALUES " + ", ".join(f"({i}, {', '.join(str(x) for x in r[2:])})" for i, r in enumerate(CLASSES)) + ")")


def classed(spark, sf_dir):
    pick = lambda c: F.get(F.array(*(F.lit(r[c]) for r in CLASSES)), (F.col("item_id") % len(CLASSES)).cast("int"))
    return items(spark, sf_dir).withColumns({"source": pick(0), "title": pick(1)})


@query("case_reclassify_stat", CLASSES_SQL + f"SELECT item_id, is_statistical OR survey AS is_statistical FROM items JOIN classes ON i = item_id % {len(CLASSES)}")
def case_reclassify_stat(spark, sf_dir):
    return classed(spark, sf_dir).select("item_id", (F.col("is_statistical") | rules.is_survey(F.col("title"), F.col("source"))).alias("is_statistical"))


for _name, _class, _test in (("case_decision_doc", "decision", rules.is_decision), ("case_sep_doc", "sep", rules.is_projection), ("case_policy_doc", "policy", rules.is_policy_document)):

    def _case(spark, sf_dir, test=_test):
        return classed(spark, sf_dir).select("item_id", test(F.col("title"), F.col("source")).alias("is_class"))

    query(_name, CLASSES_SQL + f"SELECT item_id, {_class} AS is_class FROM items JOIN classes ON i = item_id % {len(CLASSES)}")(_case)


@query("case_stat_rule_first_match", I + """, rules(ord, needle, metric) AS (VALUES (1, 'report 1', 'cpi'), (2, 'signup', 'jobs'), (3, 'report', 'other'))
  SELECT item_id, min_by(metric, ord) AS metric FROM items JOIN rules ON contains(lower(title), needle) WHERE is_statistical GROUP BY item_id""")
def case_stat_rule_first_match(spark, sf_dir):
    """The first rule of an ordered table; the table is small, so it becomes one expression."""
    rule = F.lit(None).cast("string")
    for needle, metric in reversed([("report 1", "cpi"), ("signup", "jobs"), ("report", "other")]):
        rule = F.when(F.lower("title").contains(needle), metric).otherwise(rule)
    return items(spark, sf_dir).where("is_statistical").select("item_id", rule.alias("metric"))


#: Addresses and titles of both banks, and whether they are official statements of either.
PLACES = [
    ("https://www.federalreserve.gov/x", "FOMC Statement", "FED"), ("https://federalreserve.gov/x", "FOMC Statement", ""), ("https://www.federalreserve.gov/x", "FOMC statement minutes", ""), ("https://www.ecb.europa.eu/press/pr/x", "Monetary policy decisions", "ECB"),
    ("https://www.ecb.europa.eu/press/press_conference/monetary-policy-statement/2024/x", "Opening", "ECB"), (None, "FOMC statement", ""), ("no address", "Monetary policy decisions", ""), ("https://www.ecb.europa.eu/a", "Fed statement", ""), ("https://WWW.ecb.europa.eu/press/pr/x/", "Monetary policy statement", "ECB"),
]
PLACES_SQL = "places(i, url, official) AS (VALUES " + ", ".join("({}, {}, '{}')".format(i, "NULL" if u is None else f"'{u}'", o) for i, (u, _, o) in enumerate(PLACES)) + ")"


def published(spark, sf_dir):
    """Items at these addresses under these titles."""
    pick = lambda c: F.get(F.array(*(F.lit(r[c]).cast("string") for r in PLACES)), (F.col("item_id") % len(PLACES)).cast("int"))
    return items(spark, sf_dir).withColumns({"url": pick(0), "title": pick(1)})


@query("case_official_statement", with_sql(ITEMS_SQL, PLACES_SQL) + f"SELECT item_id, NOT is_statistical AND official = bank AS is_class FROM items JOIN places ON i = item_id % {len(PLACES)}")
def case_official_statement(spark, sf_dir):
    test = rules.is_statement(F.col("bank"), F.col("url"), F.col("title"), F.col("source"), F.col("is_statistical"))
    return published(spark, sf_dir).select("item_id", test.alias("is_class"))


#: Sources, addresses and records of scores; what kind of score and of text each is.
RECORDS = [
    ("FOMC SEP", None, None, "sep", "primary"), ("Member Speech (BIS)", "u", '{"scoring_audit":{"model":"frozen lexicon + linear ensemble (no LLM)"}}', "frozen", "bis"), ("Member Speech (Fed site)", "u", '{"scoring_audit":{"model":"other"}}', "legacy", "fed_site"),
    ("GC Member Remark", "u", '{"source_resolution":{"verified":true}}', "legacy", "ai_verified"), ("GC Member Remark", "", '{"source_resolution":{"verified":true}}', "legacy", "ai_discovered"), ("Fed Official Remark", "u", '{"source_resolution":{"verified":"yes"}}', "legacy", "ai_discovered"),
    ("Fed Official Remark", "u", "no json", "legacy", "ai_discovered"), ("Press", "u", '{"scoring_audit":{"model":"frozen lexicon + linear ensemble (no LLM)"},"source_resolution":{"verified":true}}', "frozen", "primary"),
]
RECORDS_SQL = with_sql(ITEMS_SQL, "records(i, score_kind, text_kind) AS (VALUES " + ", ".join(f"({i}, '{r[3]}', '{r[4]}')" for i, r in enumerate(RECORDS)) + ")")


def recorded(spark, sf_dir):
    pick = lambda c: F.get(F.array(*(F.lit(r[c]).cast("string") for r in RECORDS)), (F.col("item_id") % len(RECORDS)).cast("int"))
    return items(spark, sf_dir).withColumns({"source": pick(0), "url": pick(1), "record": pick(2)})


@query("case_score_kind", RECORDS_SQL + f"SELECT item_id, score_kind AS kind FROM items JOIN records ON i = item_id % {len(RECORDS)}")
def case_score_kind(spark, sf_dir):
    return recorded(spark, sf_dir).select("item_id", rules.score_kind(F.col("title"), F.col("source"), F.col("record")).alias("kind"))


@query("case_text_kind", RECORDS_SQL + f"SELECT item_id, text_kind AS kind FROM items JOIN records ON i = item_id % {len(RECORDS)}")
def case_text_kind(spark, sf_dir):
    return recorded(spark, sf_dir).select("item_id", rules.text_kind(F.col("source"), F.col("url"), F.col("record")).alias("kind"))


@query("case_guidance_strength", I + "SELECT item_id, CASE source WHEN 'error' THEN 0.9 WHEN 'view' THEN 0.5 WHEN 'click' THEN 0.2 ELSE 0.5 END::DOUBLE AS strength FROM items")
def case_guidance_strength(spark, sf_dir):
    s = F.col("source")
    return items(spark, sf_dir).select("item_id", F.when(s == "error", 0.9).when(s == "view", 0.5).when(s == "click", 0.2).otherwise(0.5).alias("strength"))


@query("case_dominant_topic", I + "SELECT source, CASE source WHEN 'error' THEN 'inflation' WHEN 'view' THEN 'growth' WHEN 'signup' THEN 'labour' ELSE 'balanced' END AS topic, count(*) AS n FROM items GROUP BY ALL")
def case_dominant_topic(spark, sf_dir):
    s = F.col("source")
    topic = F.when(s == "error", "inflation").when(s == "view", "growth").when(s == "signup", "labour").otherwise("balanced")
    return items(spark, sf_dir).groupBy("source", topic.alias("topic")).agg(F.count("*").alias("n"))


@query("project_hawk_dove_pts", I + "SELECT item_id, CASE WHEN net_score > 0 THEN floor(net_score * 10 + 0.5) ELSE 0 END::INT AS hawk, CASE WHEN net_score < 0 THEN floor(-net_score * 10 + 0.5) ELSE 0 END::INT AS dove FROM items")
def project_points(spark, sf_dir):
    return items(spark, sf_dir).select("item_id", points("net_score", 1).alias("hawk"), points("net_score", -1).alias("dove"))


@query("project_waterfall_label", I + "SELECT item_id, CASE WHEN net_score > 0 THEN '+' WHEN net_score < 0 THEN '-' ELSE '' END || source AS label FROM items")
def project_waterfall_label(spark, sf_dir):
    s = F.col("net_score")
    return items(spark, sf_dir).select("item_id", F.concat(F.when(s > 0, "+").when(s < 0, "-").otherwise(""), "source").alias("label"))


# aggregations


@query("agg_mean_scored", I + f"SELECT bank, {R3.format('avg(net_score)')} AS score FROM items WHERE abs(net_score) > 0.001 GROUP BY bank")
def agg_mean_scored(spark, sf_dir):
    return scored(items(spark, sf_dir)).groupBy("bank").agg(round_up(F.avg("net_score")).alias("score"))


@query("agg_weighted_mean", I + "SELECT source, round(sum(net_score * k) / nullif(sum(k), 0), 6) AS mean, count(*) AS n FROM items GROUP BY source")
def agg_weighted_mean(spark, sf_dir):
    return items(spark, sf_dir).groupBy("source").agg(six(ratio(F.sum(F.col("net_score") * F.col("k")), F.sum("k"))).alias("mean"), F.count("*").alias("n"))


@query("agg_label_dist", I + f"SELECT bank, {TONE} AS label, count(*) AS n FROM items GROUP BY ALL")
def agg_label_dist(spark, sf_dir):
    return items(spark, sf_dir).groupBy("bank", three_levels("net_score").alias("label")).agg(F.count("*").alias("n"))


@query("agg_speaker_baseline", I + """SELECT speaker, round(avg(net_score), 6) AS mean, round(greatest(stddev_pop(net_score), 0.05), 6) AS sd, count(*) AS n
  FROM (SELECT * FROM items WHERE NOT is_statistical ORDER BY item_date DESC, item_id LIMIT 1500) GROUP BY speaker HAVING count(*) >= 4""")
def agg_speaker_baseline(spark, sf_dir):
    newest = items(spark, sf_dir).where("NOT is_statistical").orderBy(F.desc("item_date"), "item_id").limit(1500)
    out = newest.groupBy("speaker").agg(six(F.avg("net_score")).alias("mean"), six(F.greatest(F.stddev_pop("net_score"), F.lit(0.05))).alias("sd"), F.count("*").alias("n"))
    return out.where("n >= 4")


WEEKS = ["2024-01-01", "2024-01-08", "2024-01-15", "2024-01-22", "2024-01-29"]


@query("agg_group_speaker_month", I + "SELECT speaker, " + ", ".join(f"round(avg(net_score) FILTER (w = '{w}'), 6) AS avg_{i}, count(*) FILTER (w = '{w}') AS n_{i}" for i, w in enumerate(WEEKS)) + " FROM (SELECT *, strftime(date_trunc('week', item_date), '%Y-%m-%d') AS w FROM items) GROUP BY speaker HAVING count(*) >= 2")
def agg_group_speaker_month(spark, sf_dir):
    rows = items(spark, sf_dir).withColumn("w", F.date_format(F.trunc("item_date", "week"), "yyyy-MM-dd"))
    wide = rows.groupBy("speaker").pivot("w", WEEKS).agg(six(F.avg("net_score")).alias("avg"), F.count("item_id").alias("n"))
    many = F.expr("+".join(f"coalesce(`{w}_n`, 0)" for w in WEEKS)) >= 2
    return wide.where(many).select("speaker", *(x for i, w in enumerate(WEEKS) for x in (F.col(f"{w}_avg").alias(f"avg_{i}"), F.coalesce(f"{w}_n", F.lit(0)).alias(f"n_{i}"))))


@query("agg_month_pivot_bank", I + "SELECT date_trunc('week', item_date)::DATE AS week, round(coalesce(avg(net_score) FILTER (bank = 'FED'), 0), 6) AS fed, round(coalesce(avg(net_score) FILTER (bank = 'ECB'), 0), 6) AS ecb, round(coalesce(avg(net_score) FILTER (bank = 'FED'), 0) - coalesce(avg(net_score) FILTER (bank = 'ECB'), 0), 6) AS spread FROM items WHERE abs(net_score) > 0.001 GROUP BY 1")
def agg_month_pivot_bank(spark, sf_dir):
    mean = lambda b: F.coalesce(F.avg(F.when(F.col("bank") == b, F.col("net_score"))), F.lit(0.0))
    rows = scored(items(spark, sf_dir)).groupBy(F.trunc("item_date", "week").alias("week")).agg(mean("FED").alias("fed"), mean("ECB").alias("ecb"))
    return rows.select("week", six("fed").alias("fed"), six("ecb").alias("ecb"), six(F.col("fed") - F.col("ecb")).alias("spread"))


TOPICS = ["click", "error", "view", "purchase", "signup", "unseen"]


@query("agg_topic_count", I + "SELECT t.topic, count(i.topic) AS n FROM (SELECT unnest(" + str(TOPICS) + ") AS topic) t LEFT JOIN (SELECT unnest([source, CASE WHEN k > 50 THEN 'view' ELSE 'error' END]) AS topic FROM items) i USING (topic) GROUP BY t.topic")
def agg_topic_count(spark, sf_dir):
    domain = spark.createDataFrame([(t,) for t in TOPICS], "topic string")
    tags = items(spark, sf_dir).select(F.explode(F.array("source", F.when(F.col("k") > 50, "view").otherwise("error"))).alias("topic"))
    return domain.join(tags.groupBy("topic").agg(F.count("*").alias("n")), "topic", "left").select("topic", F.coalesce("n", F.lit(0)).alias("n"))


@query("agg_taxonomy_distribution", I + """SELECT dim, v, count(*) AS n, sum(count(*)) OVER (PARTITION BY dim)::BIGINT AS total FROM (SELECT unnest([{'dim': 'source', 'v': source}, {'dim': 'side', 'v': CASE WHEN k < 30 THEN 'low' WHEN k < 60 THEN 'high' ELSE 'unknown' END}], recursive := true) FROM items) WHERE v <> 'unknown' GROUP BY dim, v""")
def agg_taxonomy_distribution(spark, sf_dir):
    side = F.when(F.col("k") < 30, "low").when(F.col("k") < 60, "high").otherwise("unknown")
    dims = items(spark, sf_dir).select(F.explode(F.create_map(F.lit("source"), "source", F.lit("side"), side)).alias("dim", "v")).where("v <> 'unknown'")
    counts = dims.groupBy("dim", "v").agg(F.count("*").alias("n"))
    return counts.withColumn("total", F.sum("n").over(Window.partitionBy("dim")))


@query("agg_profile_member", I + "SELECT speaker, bank, count(*) AS total, count(*) FILTER (net_score > 0.1) AS hawkish, count(*) FILTER (net_score < -0.1) AS dovish, max(item_date) AS last FROM items GROUP BY ALL")
def agg_profile_member(spark, sf_dir):
    s = F.col("net_score")
    return items(spark, sf_dir).groupBy("speaker", "bank").agg(F.count("*").alias("total"), F.count_if(s > 0.1).alias("hawkish"), F.count_if(s < -0.1).alias("dovish"), F.max("item_date").alias("last"))


@query("agg_by_year", "SELECT year(o_orderdate)::INT AS year, count(*) AS n FROM orders GROUP BY 1")
def agg_by_year(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n")).orderBy(F.desc("year"))


@query("agg_pct", I + "SELECT speaker, CASE WHEN count(*) FILTER (abs(net_score) > 0.1) > 0 THEN floor(100.0::DOUBLE * count(*) FILTER (net_score > 0.1) / count(*) FILTER (abs(net_score) > 0.1) + 0.5) ELSE 0 END::BIGINT AS pct FROM items GROUP BY speaker")
def agg_pct(spark, sf_dir):
    up, any_ = F.count_if(F.col("net_score") > 0.1), F.count_if(F.abs("net_score") > 0.1)
    return items(spark, sf_dir).groupBy("speaker").agg(F.when(any_ > 0, F.floor(100.0 * up / any_ + 0.5)).otherwise(0).cast("long").alias("pct"))


@query("agg_ratio", I + "SELECT bank, round(count(*) FILTER (net_score > 0.1) / greatest(count(*) FILTER (net_score < -0.1), 1), 6) AS ratio FROM items GROUP BY bank")
def agg_ratio(spark, sf_dir):
    s = F.col("net_score")
    return items(spark, sf_dir).groupBy("bank").agg(six(F.count_if(s > 0.1) / F.greatest(F.count_if(s < -0.1), F.lit(1))).alias("ratio"))


@query("agg_sample_sd", I + "SELECT speaker, item_date, round(coalesce(stddev_samp(net_score), 0), 6) AS sd FROM items GROUP BY ALL")
def agg_sample_sd(spark, sf_dir):
    return items(spark, sf_dir).groupBy("speaker", "item_date").agg(six(F.coalesce(F.stddev_samp("net_score"), F.lit(0.0))).alias("sd"))


@query("agg_rate_where", I + "SELECT bank, round(avg((k % 3 = 0)::INT), 6) AS multiple, round(avg(contains(lower(title), 'error')::INT), 6) AS errors FROM items GROUP BY bank")
def agg_rate_where(spark, sf_dir):
    rate = lambda c: six(F.avg(c.cast("int")))
    return items(spark, sf_dir).groupBy("bank").agg(rate(F.col("k") % 3 == 0).alias("multiple"), rate(F.lower("title").contains("error")).alias("errors"))


@query("agg_pearson", I + "SELECT speaker, CASE WHEN count(*) >= 3 AND stddev_pop(k) > 0 AND stddev_pop(net_score) > 0 THEN round(corr(net_score, k), 6) END AS r FROM items GROUP BY speaker")
def agg_pearson(spark, sf_dir):
    fine = (F.count("*") >= 3) & (F.stddev_pop("k") > 0) & (F.stddev_pop("net_score") > 0)
    return items(spark, sf_dir).groupBy("speaker").agg(F.when(fine, six(F.corr("net_score", "k"))).alias("r"))


@query("agg_mae", I + "SELECT bank, round(avg(abs(net_score - k / 100.0::DOUBLE)), 6) AS mae FROM items GROUP BY bank")
def agg_mae(spark, sf_dir):
    return items(spark, sf_dir).groupBy("bank").agg(six(F.avg(F.abs(F.col("net_score") - F.col("k") / 100.0))).alias("mae"))


@query("agg_disagreement_rate", I + "SELECT bank, round(avg((sign(net_score) <> sign(k - 50) AND abs(net_score) > 0.2 AND abs(k - 50) > 20)::INT), 6) AS rate FROM items GROUP BY bank")
def agg_disagreement_rate(spark, sf_dir):
    gap = (F.signum("net_score") != F.signum(F.col("k") - 50)) & (F.abs("net_score") > 0.2) & (F.abs(F.col("k") - 50) > 20)
    return items(spark, sf_dir).groupBy("bank").agg(six(F.avg(gap.cast("int"))).alias("rate"))


@query("agg_mode_recent20", I + "SELECT source AS model FROM (SELECT source FROM items ORDER BY item_date DESC, item_id DESC LIMIT 20) GROUP BY source ORDER BY count(*) DESC, source LIMIT 1")
def agg_mode_recent20(spark, sf_dir):
    """Ties go to the first by name."""
    newest = items(spark, sf_dir).orderBy(F.desc("item_date"), F.desc("item_id")).limit(20)
    return newest.groupBy(F.col("source").alias("model")).count().orderBy(F.desc("count"), "model").limit(1).select("model")


@query("agg_quadrants", I + "SELECT count(*) FILTER (net_score >= 0 AND k >= 50) AS a, count(*) FILTER (net_score < 0 AND k >= 50) AS b, count(*) FILTER (net_score < 0 AND k < 50) AS c, count(*) FILTER (net_score >= 0 AND k < 50) AS d FROM items")
def agg_quadrants(spark, sf_dir):
    s, k = F.col("net_score") >= 0, F.col("k") >= 50
    return items(spark, sf_dir).agg(F.count_if(s & k).alias("a"), F.count_if(~s & k).alias("b"), F.count_if(~s & ~k).alias("c"), F.count_if(s & ~k).alias("d"))


@query("agg_quantile_interp", I + "SELECT bank, round(quantile_cont(value, 0.2), 6) AS q20, round(quantile_cont(value, 0.8), 6) AS q80 FROM items GROUP BY bank")
def agg_quantile_interp(spark, sf_dir):
    return items(spark, sf_dir).groupBy("bank").agg(six(F.percentile("value", 0.2)).alias("q20"), six(F.percentile("value", 0.8)).alias("q80"))


@query("agg_quantile_floor", with_sql(SERIES_SQL) + "SELECT round(list_sort(list(total))[floor(count(*) * 0.2)::INT + 1], 6) AS q20, round(list_sort(list(total))[floor(count(*) * 0.8)::INT + 1], 6) AS q80 FROM series")
def agg_quantile_floor(spark, sf_dir):
    """One of the monthly values itself, of which there are few."""
    place = lambda q: six(F.element_at(F.array_sort(F.collect_list("total")), (F.floor(F.count("*") * q) + 1).cast("int")))
    return series(spark, sf_dir).agg(place(0.2).alias("q20"), place(0.8).alias("q80"))


@query("agg_monthly_last", "SELECT strftime(o_orderdate, '%Y-%m') AS month, max_by(o_totalprice, (o_orderdate, o_orderkey)) AS price FROM orders GROUP BY 1")
def agg_monthly_last(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.max_by("o_totalprice", F.struct("o_orderdate", "o_orderkey")).alias("price"))


@query("agg_monthly_mean", with_sql(SERIES_SQL) + "SELECT month, round(mean, 6) AS mean FROM series")
def agg_monthly_mean(spark, sf_dir):
    return series(spark, sf_dir).select("month", six("mean").alias("mean"))


@query("agg_daily", I + "SELECT item_date, round(avg(net_score), 6) AS mean, count(*) AS n FROM items WHERE abs(net_score) > 0.001 GROUP BY 1")
def agg_daily(spark, sf_dir):
    return scored(items(spark, sf_dir)).groupBy("item_date").agg(six(F.avg("net_score")).alias("mean"), F.count("*").alias("n"))


@query("agg_min_max_dated", I + "SELECT source, min(item_date) AS first, max(item_date) AS last, count(item_date) AS dated FROM items GROUP BY 1")
def agg_min_max_dated(spark, sf_dir):
    return items(spark, sf_dir).groupBy("source").agg(F.min("item_date").alias("first"), F.max("item_date").alias("last"), F.count("item_date").alias("dated"))


@query("agg_stat_60d", I + f"""SELECT bank, {R3.format('m')} AS score, n, CASE WHEN m <= -0.5 THEN 'very dovish' WHEN m < -0.1 THEN 'dovish' WHEN m >= 0.5 THEN 'very hawkish' WHEN m > 0.1 THEN 'hawkish' ELSE 'neutral' END AS label
  FROM (SELECT bank, avg(net_score) AS m, count(*) AS n FROM items WHERE is_statistical AND item_date >= {AS_OF_SQL} - 60 GROUP BY bank)""")
def agg_stat_60d(spark, sf_dir):
    rows = items(spark, sf_dir).where(F.col("is_statistical") & (F.col("item_date") >= at(60))).groupBy("bank").agg(F.avg("net_score").alias("m"), F.count("*").alias("n"))
    return rows.select("bank", round_up("m").alias("score"), "n", five_levels("m").alias("label"))


@query("agg_roster_counts", "SELECT n_regionkey AS region, count(*) FILTER (list_contains([n_nationkey % 3, n_nationkey % 5], 2) OR n_nationkey < 3) AS voters, count(*) FILTER (NOT (list_contains([n_nationkey % 3, n_nationkey % 5], 2) OR n_nationkey < 3)) AS others FROM nation GROUP BY 1")
def agg_roster_counts(spark, sf_dir):
    votes = F.array_contains(F.array(F.col("n_nationkey") % 3, F.col("n_nationkey") % 5), 2) | (F.col("n_nationkey") < 3)
    return table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.count_if(votes).alias("voters"), F.count_if(~votes).alias("others"))


PACK = f"SELECT speaker, count(*) FILTER (new) AS recent_n, round(avg(net_score) FILTER (new), 6) AS recent, round(avg(net_score) FILTER (NOT new), 6) AS baseline, round(avg(net_score) FILTER (new) - avg(net_score) FILTER (NOT new), 6) AS shift, count(*) FILTER (new AND net_score > 0.1) AS hawkish, count(*) FILTER (new AND net_score < -0.1) AS dovish, count(*) FILTER (new AND abs(net_score) <= 0.1) AS neutral FROM (SELECT *, item_date > DATE '2024-01-17' AND item_date <= DATE '2024-01-25' AS new FROM items WHERE item_date <= DATE '2024-01-25') GROUP BY speaker"


@query("agg_pack", I + PACK)
def agg_pack(spark, sf_dir):
    new, s = F.col("item_date") > "2024-01-17", F.col("net_score")
    mean = lambda c: F.avg(F.when(c, s))
    return items(spark, sf_dir).where("item_date <= DATE '2024-01-25'").groupBy("speaker").agg(
        F.count_if(new).alias("recent_n"), six(mean(new)).alias("recent"), six(mean(~new)).alias("baseline"), six(mean(new) - mean(~new)).alias("shift"),
        F.count_if(new & (s > 0.1)).alias("hawkish"), F.count_if(new & (s < -0.1)).alias("dovish"), F.count_if(new & (F.abs(s) <= 0.1)).alias("neutral"),
    )


@query("dom_meeting_pack", I + PACK)
def dom_meeting_pack(spark, sf_dir):
    return agg_pack(spark, sf_dir)


@query("agg_speaker_profile", I + f"SELECT speaker, count(*) AS n, round(avg(net_score), 6) AS tone, count(*) FILTER (item_date >= {AS_OF_SQL} - 10) AS n_new, round(avg(net_score) FILTER (item_date >= {AS_OF_SQL} - 10), 6) AS new_tone, round(avg(net_score) FILTER (item_date >= {AS_OF_SQL} - 10) - avg(net_score), 6) AS change, max(item_date) AS latest FROM items GROUP BY 1")
def agg_speaker_profile(spark, sf_dir):
    new, s = F.col("item_date") >= at(10), F.col("net_score")
    now = F.avg(F.when(new, s))
    return items(spark, sf_dir).groupBy("speaker").agg(F.count("*").alias("n"), six(F.avg(s)).alias("tone"), F.count_if(new).alias("n_new"), six(now).alias("new_tone"), six(now - F.avg(s)).alias("change"), F.max("item_date").alias("latest"))


CHECKS = {"scored": "abs(net_score) > 0.001", "stat": "is_statistical", "high": "net_score >= 0.5", "low": "net_score <= -0.3", "long": "word_count >= 500", "weightless": "stat_weight = 0", "recent": "item_date >= DATE '2024-01-20'"}


@query("agg_admin_stats", I + "SELECT bank, count(*) AS total, " + ", ".join(f"count(*) FILTER ({v}) AS n_{k}" for k, v in CHECKS.items()) + " FROM items GROUP BY bank")
def agg_admin_stats(spark, sf_dir):
    return items(spark, sf_dir).groupBy("bank").agg(F.count("*").alias("total"), *(F.count_if(F.expr(v)).alias(f"n_{k}") for k, v in CHECKS.items()))


@query("agg_count_distinct", I + "SELECT bank, count(DISTINCT source) AS sources, count(DISTINCT item_date) AS days, count(DISTINCT speaker) AS speakers FROM items GROUP BY bank")
def agg_count_distinct(spark, sf_dir):
    return items(spark, sf_dir).groupBy("bank").agg(*(F.count_distinct(c).alias(n) for n, c in (("sources", "source"), ("days", "item_date"), ("speakers", "speaker"))))


@query("agg_argmax3", I + "SELECT item_id, ['hike', 'hold', 'cut'][list_position([k % 7, k % 5, k % 3], list_max([k % 7, k % 5, k % 3]))] AS decision FROM items")
def agg_argmax3(spark, sf_dir):
    parts = F.array(F.col("k") % 7, F.col("k") % 5, F.col("k") % 3)
    names = F.array(F.lit("hike"), F.lit("hold"), F.lit("cut"))
    return items(spark, sf_dir).select("item_id", F.element_at(names, F.array_position(parts, F.array_max(parts)).cast("int")).alias("decision"))


# sort and limit


@query("sort_date_desc", I + "SELECT item_id, item_date FROM items ORDER BY item_date DESC, item_id")
def sort_date_desc(spark, sf_dir):
    """All rows, newest first: a sort by ranges."""
    return items(spark, sf_dir).orderBy(F.desc("item_date"), "item_id").select("item_id", "item_date")


@query("sort_multi_key", "SELECT o_orderdate::DATE AS day, o_orderpriority AS bank, o_orderkey FROM orders ORDER BY 1, 2, 3")
def sort_multi_key(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day"), F.col("o_orderpriority").alias("bank"), "o_orderkey")
    return rows.orderBy("day", "bank", "o_orderkey")


@query("topk_abs", I + "SELECT item_id, net_score FROM items ORDER BY abs(net_score) DESC, item_id LIMIT 8")
def topk_abs(spark, sf_dir):
    return items(spark, sf_dir).orderBy(F.desc(F.abs("net_score")), "item_id").limit(8).select("item_id", "net_score")


@query("sort_contributions", I + "SELECT speaker, round(sum(net_score), 6) AS c, row_number() OVER (ORDER BY abs(round(sum(net_score), 6)) DESC, speaker) AS place FROM items GROUP BY speaker")
def sort_contributions(spark, sf_dir):
    sums = items(spark, sf_dir).groupBy("speaker").agg(six(F.sum("net_score")).alias("c"))  # one row per speaker
    return sums.withColumn("place", F.row_number().over(Window.orderBy(F.desc(F.abs("c")), "speaker")))


@query("limit_offset", I + "SELECT item_id, 150 AS next_offset FROM items ORDER BY item_id LIMIT 50 OFFSET 100")
def limit_offset(spark, sf_dir):
    return items(spark, sf_dir).orderBy("item_id").offset(100).limit(50).select("item_id", F.lit(150).alias("next_offset"))


@query("rank_candidates", I + """SELECT title, item_id, score FROM (SELECT title, item_id, (CASE WHEN k > 50 THEN 2 ELSE 0 END) - (CASE WHEN source = 'error' THEN 3 ELSE 0 END) AS score, row_number() OVER (PARTITION BY title ORDER BY item_id) AS rn FROM items) WHERE rn = 1""")
def rank_candidates(spark, sf_dir):
    """Distinct by title at its first place, best score first."""
    score = F.when(F.col("k") > 50, 2).otherwise(0) - F.when(F.col("source") == "error", 3).otherwise(0)
    first = items(spark, sf_dir).groupBy("title").agg(F.min_by(score, "item_id").alias("score"), F.min("item_id").alias("item_id"))
    return first.orderBy(F.desc("score"), "item_id").select("title", "item_id", "score")


# set operations


@query("union_all_sources", I + "SELECT source, count(*) AS n, count(mark) AS marked FROM (SELECT source, NULL AS mark FROM items WHERE source = 'click' UNION ALL SELECT source, k AS mark FROM items WHERE source = 'view') GROUP BY source")
def union_all_sources(spark, sf_dir):
    one = items(spark, sf_dir).where("source = 'click'").select("source")
    two = items(spark, sf_dir).where("source = 'view'").select("source", F.col("k").alias("mark"))
    return one.unionByName(two, allowMissingColumns=True).groupBy("source").agg(F.count("*").alias("n"), F.count("mark").alias("marked"))


@query("union_channels", I + "SELECT is_statistical, count(*) AS n FROM items GROUP BY 1")
def union_channels(spark, sf_dir):
    rows = items(spark, sf_dir)
    return rows.where("NOT is_statistical").unionByName(rows.where("is_statistical")).groupBy("is_statistical").agg(F.count("*").alias("n"))


@query("union_distinct_months", "SELECT strftime(o_orderdate, '%Y-%m') AS month FROM orders UNION SELECT strftime(l_shipdate, '%Y-%m') FROM lineitem")
def union_distinct_months(spark, sf_dir):
    months = lambda t, c: table(spark, sf_dir, t).select(F.date_format(c, "yyyy-MM").alias("month"))
    return months("orders", "o_orderdate").union(months("lineitem", "l_shipdate")).distinct()


@query("dedup_distinct_url", I + "SELECT title, min(item_id) AS item_id FROM items GROUP BY title")
def dedup_distinct_url(spark, sf_dir):
    """The first row of each, which dropDuplicates would leave open."""
    return items(spark, sf_dir).groupBy("title").agg(F.min("item_id").alias("item_id"))


@query("set_jaccard_title", r"""WITH t AS (SELECT min(doc_id) AS doc_id, w FROM (SELECT doc_id, list_sort(list_distinct(list_filter(regexp_extract_all(lower(split_part(text, E'\n', 1)), '[a-z]+'), lambda x: length(x) >= 3))) AS w FROM documents) GROUP BY w)
  SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.doc_id < b.doc_id WHERE length(a.w) > 0 AND length(b.w) > 0 AND length(list_intersect(a.w, b.w)) >= 0.8 * (length(a.w) + length(b.w) - length(list_intersect(a.w, b.w)))""")
def set_jaccard_title(spark, sf_dir):
    """Pairs of different word sets of titles (first lines) with a similarity of 0.8 or more, over all
    documents; a set stands under its first document. Candidates share one of their rarest words
    (prefix filter)."""
    from tidemark.operators.joins import similar_sets

    words = F.array_sort(F.array_distinct(F.filter(F.regexp_extract_all(F.lower(F.split_part("text", F.lit("\n"), F.lit(1))), F.lit("[a-z]+"), F.lit(0)), lambda x: F.length(x) >= 3)))
    sets = table(spark, sf_dir, "documents").groupBy(words.alias("words")).agg(F.min("doc_id").alias("doc_id"))
    return similar_sets(sets, "doc_id", "words", 0.8)


@query("set_jaccard_members", r"""WITH d AS (SELECT doc_id, list_sort(list_distinct(list_filter(regexp_extract_all(lower(split_part(text, E'\n', 1)), '[a-z]+'), lambda x: length(x) >= 3))) AS w FROM documents),
  t AS (SELECT min(doc_id) AS class_id, count(*) AS n, w FROM d WHERE length(w) > 0 GROUP BY w),
  l AS (SELECT a.class_id, sum(b.n) AS n FROM t a JOIN t b ON a.class_id <> b.class_id AND length(list_intersect(a.w, b.w)) >= 0.8 * (length(a.w) + length(b.w) - length(list_intersect(a.w, b.w))) GROUP BY a.class_id)
  SELECT d.doc_id, coalesce(t.class_id, d.doc_id) AS class_id, coalesce(t.n - 1 + coalesce(l.n, 0), 0) AS n_links FROM d LEFT JOIN t ON d.w = t.w LEFT JOIN l ON t.class_id = l.class_id""")
def set_jaccard_members(spark, sf_dir):
    """Of every document the class of equal word sets of titles, named by its first document, and how
    many other documents have a similarity of 0.8 or more, those of its own class among them. Titles
    without words are alone. ``set_jaccard_title`` has the links between the classes."""
    from tidemark.operators.joins import similar_sets

    words = F.array_sort(F.array_distinct(F.filter(F.regexp_extract_all(F.lower(F.split_part("text", F.lit("\n"), F.lit(1))), F.lit("[a-z]+"), F.lit(0)), lambda x: F.length(x) >= 3)))
    docs = table(spark, sf_dir, "documents").select("doc_id", words.alias("words"))
    classes = docs.where(F.size("words") > 0).groupBy("words").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n"))
    pairs = similar_sets(classes, "class_id", "words", 0.8)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = both.join(classes.select(F.col("class_id").alias("b"), "n"), "b").groupBy(F.col("a").alias("class_id")).agg(F.sum("n").alias("others"))
    known = classes.join(links, "class_id", "left").select("words", "class_id", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    return docs.join(known, "words", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


@query("added_removed_phrases", """WITH w AS (SELECT doc_id, list_distinct(string_split(text, ' ')) AS w FROM documents)
  SELECT b.doc_id, length(b.w) - length(list_intersect(a.w, b.w)) AS added, length(a.w) - length(list_intersect(a.w, b.w)) AS removed FROM w a JOIN w b ON b.doc_id = a.doc_id + 1""")
def added_removed_phrases(spark, sf_dir):
    """Words that a document has and the one before hasn't, and the other way round."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.array_distinct(F.split("text", " ")).alias("w"))
    old = docs.select((F.col("doc_id") + 1).alias("doc_id"), F.col("w").alias("old"))
    return docs.join(old, "doc_id").select("doc_id", F.size(F.array_except("w", "old")).alias("added"), F.size(F.array_except("old", "w")).alias("removed"))
