"""Composite queries: de-duplication, calibration, cycles, series, models, alerts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.numerics import clamp, round_up, six
from tidemark.functions.text import basis_points, canonical_url, guidance_sentences, sentences
from tidemark.operators import changepoint, dedup, drift, evidence, network, reaction, regression, remarks, rules, scoring
from tidemark.operators.alerts import evaluate
from tidemark.plans.base import AS_OF, AS_OF_SQL, CALENDAR_SQL, ITEMS_SQL, SERIES_SQL, calendar, items, query, scored, series, with_sql
from tidemark.plans.basics import PLACES, PLACES_SQL, R3, published, top_rows
from tidemark.plans.windows import BASE, DAILY, MEANS, SPANS, baselines, cycles, daily, placed
from tidemark.session import table

I = with_sql(ITEMS_SQL)  # noqa: E741
S = with_sql(SERIES_SQL)
W = Window.partitionBy
C = "greatest(-1.0::DOUBLE, least(1.0::DOUBLE, {}))"


@query("dom_speaker_calibration", with_sql(ITEMS_SQL, BASE) + f"SELECT item_id, {R3.format('CASE WHEN b.speaker IS NULL THEN net_score ELSE (CASE WHEN i.speaker = 19 THEN 0.75::DOUBLE ELSE 0.6::DOUBLE END) * net_score + (CASE WHEN i.speaker = 19 THEN 0.25::DOUBLE ELSE 0.4::DOUBLE END) * tanh((net_score - mean) / sd / 2) END')} AS score FROM items i LEFT JOIN base b ON i.speaker = b.speaker WHERE NOT is_statistical")
def speaker_calibration(spark, sf_dir):
    rows = items(spark, sf_dir).where("NOT is_statistical").join(baselines(spark, sf_dir).withColumn("known", F.lit(True)), "speaker", "left")
    own = F.when(F.col("speaker") == 19, 0.75).otherwise(0.6)
    mixed = own * F.col("net_score") + F.when(F.col("speaker") == 19, 0.25).otherwise(0.4) * F.tanh((F.col("net_score") - F.col("mean")) / F.col("sd") / 2)
    return rows.select("item_id", round_up(F.when(F.col("known"), mixed).otherwise(F.col("net_score"))).alias("score"))


CONSENSUS = "cons AS (SELECT k % 10 AS metric, avg(value) AS expected, greatest(stddev_pop(value), 0.1::DOUBLE) AS sd FROM items WHERE is_statistical GROUP BY 1)"


@query("dom_consensus_surprise", with_sql(ITEMS_SQL, CONSENSUS) + f"""SELECT item_id, {R3.format(C.format("0.35::DOUBLE * net_score + 0.65::DOUBLE * tanh((value - expected) / sd / 2) * CASE WHEN metric % 2 = 0 THEN 1 ELSE -1 END"))} AS score,
  round(greatest(0.5::DOUBLE, greatest(stat_weight, 1) * least(1.5::DOUBLE, 1 + abs((value - expected) / sd) / 4)), 6) AS weight FROM items JOIN cons ON k % 10 = metric WHERE is_statistical""")
def consensus_surprise(spark, sf_dir):
    stats = items(spark, sf_dir).where("is_statistical").withColumn("metric", F.col("k") % 10)
    cons = stats.groupBy("metric").agg(F.avg("value").alias("expected"), F.greatest(F.stddev_pop("value"), F.lit(0.1)).alias("sd"))
    z = (F.col("value") - F.col("expected")) / F.col("sd")
    rows = stats.join(cons, "metric").withColumn("z", z)
    direction = F.when(F.col("metric") % 2 == 0, 1).otherwise(-1)
    weight = F.greatest(F.lit(0.5), F.greatest("stat_weight", F.lit(1)) * F.least(F.lit(1.5), 1 + F.abs("z") / 4))
    return rows.select("item_id", round_up(clamp(0.35 * F.col("net_score") + 0.65 * F.tanh(F.col("z") / 2) * direction)).alias("score"), six(weight).alias("weight"))


@query("dom_sep_delta", """WITH d AS (SELECT o_orderpriority AS p, date_trunc('month', o_orderdate)::DATE AS month, avg(o_totalprice) / 100000 AS rate, count(*) / 50.0::DOUBLE AS jobs FROM orders GROUP BY ALL),
  l AS (SELECT *, rate - lag(rate) OVER w AS dr, jobs - lag(jobs) OVER w AS dj FROM d WINDOW w AS (PARTITION BY p ORDER BY month))
  SELECT p, month, round((3 * greatest(-1.0::DOUBLE, least(1.0::DOUBLE, dr / 0.3::DOUBLE)) - 2 * greatest(-1.0::DOUBLE, least(1.0::DOUBLE, dj / 0.3::DOUBLE))) / 5, 6) + 0.0 AS delta FROM l WHERE dr IS NOT NULL""")
def sep_delta(spark, sf_dir):
    d = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("p"), F.trunc("o_orderdate", "MM").alias("month")).agg((F.avg("o_totalprice") / 100000).alias("rate"), (F.count("*") / 50.0).alias("jobs"))
    w = W("p").orderBy("month")
    step = lambda c: clamp((F.col(c) - F.lag(c).over(w)) / 0.3)
    return d.select("p", "month", step("rate").alias("r"), step("jobs").alias("j"), F.lag("rate").over(w).alias("old")).where("old IS NOT NULL").select("p", "month", six((3 * F.col("r") - 2 * F.col("j")) / 5).alias("delta"))


#: A lexicon that the test texts can meet: phrases of one to four words, ends of words, points of their own and points that something closes.
LEXICON = [
    ("rate", "target", 1, 0, 0, "policy"), ("of the", "target", 1, 0, 0, "growth"), ("the", "target", 1, 0, 0, "prices"), ("and the", "target", -1, 0, 0, "growth"), ("the and attion", "target", 1, 0, 0, "policy"),
    ("the and attion to", "target", -1, 0, 0, "policy"), ("eri* tha*", "target", 1, 0, 0, "policy"), ("to", "direction", 1, 0, 0, None), ("is", "direction", 1, 0, 0, None), ("is the", "direction", -1, 0, 0, None), ("be", "direction", -1, 0, 0, None),
    ("tion*", "direction", 1, 0, 0, None), ("than*", "direction", -1, 0, 0, None), ("was", "negation", 0, 0, 0, None), ("not", "negation", 0, 0, 0, None), ("on the", "negation", 0, 0, 0, None), ("it is", "points", 0, 1, 0, "prices"),
    ("for the", "points", 0, 0, 2, "policy"), ("for the that*", "points", 0, 3, 0, "growth"), ("by", "opens", 0, 2, 0, "policy"), ("at", "closes", 0, 0, 0, "policy"), ("as", "opens", 0, 0, 2, "growth"), ("from", "closes", 0, 0, 0, "growth"),
]
RELEVANT_HERE = ("the", "of", "and", "und", "que")
_TEXT = lambda x: "NULL" if x is None else f"'{x}'"
LEXICON_SQL = "lex(p1, p2, p3, p4, size, role, sign, hawk, dove, dim) AS (VALUES " + ", ".join(
    "(" + ", ".join(_TEXT(p.replace("*", "%") if p else None) for p in (r[0].split() + [None] * 4)[:4]) + f", {len(r[0].split())}, '{r[1]}', {r[2]}, {r[3]}, {r[4]}, {_TEXT(r[5])})" for r in LEXICON
) + ")"
SENTENCES_SQL = f"""split AS (SELECT doc_id, list_filter(string_split(regexp_replace(trim(regexp_replace(replace(text, chr(173), ''), '\\s+', ' ', 'g')), '([.!?]) ([A-Z"“(])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda s: length(string_split(s, ' ')) >= 6) AS parts FROM documents),
  sents AS (SELECT doc_id, pos, lower(s) AS s FROM (SELECT doc_id, generate_subscripts(parts, 1) - 1 AS pos, unnest(parts) AS s FROM split) WHERE regexp_matches(s, '(?i)(^|[^\\p{{L}}\\p{{N}}_])({'|'.join(RELEVANT_HERE)})([^\\p{{L}}\\p{{N}}_]|$)'))"""
POINTS_SQL = f"""{LEXICON_SQL}, {SENTENCES_SQL},
  tok AS (SELECT *, lead(w1) OVER q AS w2, lead(w1, 2) OVER q AS w3, lead(w1, 3) OVER q AS w4 FROM (SELECT doc_id, pos, generate_subscripts(w, 1) AS i, unnest(w) AS w1 FROM (SELECT doc_id, pos, regexp_extract_all(s, '[a-z][a-z''-]*') AS w FROM sents)) WINDOW q AS (PARTITION BY doc_id, pos ORDER BY i)),
  every_hit AS (SELECT doc_id, pos, i, size, role, sign, hawk, dove, dim FROM tok JOIN lex ON w1 LIKE p1 AND (size < 2 OR coalesce(w2 LIKE p2, false)) AND (size < 3 OR coalesce(w3 LIKE p3, false)) AND (size < 4 OR coalesce(w4 LIKE p4, false))),
  hits AS (SELECT * FROM every_hit h WHERE NOT EXISTS (SELECT 1 FROM every_hit o WHERE o.doc_id = h.doc_id AND o.pos = h.pos AND o.role = h.role AND o.size > h.size AND o.i <= h.i AND o.i + o.size >= h.i + h.size)),
  pairs AS (SELECT t.doc_id, t.pos, t.dim, t.sign * d.sign * CASE WHEN EXISTS (SELECT 1 FROM hits n WHERE n.role = 'negation' AND n.doc_id = d.doc_id AND n.pos = d.pos AND d.i > n.i AND d.i - n.i <= 3) THEN -1 ELSE 1 END AS v
    FROM hits t JOIN hits d ON t.doc_id = d.doc_id AND t.pos = d.pos AND t.role = 'target' AND d.role = 'direction' AND abs(t.i - d.i) <= 6 AND t.i <> d.i),
  said AS (SELECT doc_id, pos, dim, 0 AS hawk, 0 AS dove FROM hits WHERE role = 'target' UNION ALL SELECT doc_id, pos, dim, (v > 0)::INT, (v < 0)::INT FROM pairs UNION ALL SELECT doc_id, pos, dim, hawk, dove FROM hits WHERE role = 'points'
    UNION ALL SELECT doc_id, pos, dim, hawk, dove FROM hits o WHERE role = 'opens' AND EXISTS (SELECT 1 FROM hits c WHERE c.role = 'closes' AND c.doc_id = o.doc_id AND c.pos = o.pos AND c.dim = o.dim AND c.i - o.i BETWEEN 1 AND 6)),
  points AS (SELECT doc_id, pos, dim, sum(hawk)::BIGINT AS hawk, sum(dove)::BIGINT AS dove FROM said GROUP BY ALL)"""


def sentences_of(spark, sf_dir):
    """(doc_id, pos, s): relevant sentences in lower case, numbered among all."""
    split = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(sentences(F.col("text"))).alias("pos", "s"))
    return split.where(scoring.mentions(F.col("s"), RELEVANT_HERE)).select("doc_id", "pos", F.lower("s").alias("s"))


def lexicon_points(spark, sf_dir):
    words = sentences_of(spark, sf_dir).select("doc_id", "pos", F.regexp_extract_all("s", F.lit("[a-z][a-z'-]*"), F.lit(0)).alias("words"))
    return scoring.lexicon_points(words, spark.createDataFrame(LEXICON, scoring.LEXICON))


@query("dom_lexicon_score", f"WITH {POINTS_SQL} SELECT doc_id, pos, dim, hawk, dove FROM points")
def lexicon_score(spark, sf_dir):
    return lexicon_points(spark, sf_dir)


#: A model of the form of the real one, whose weights are not public: runs of one to three words, their idf and a weight for each class.
VOCABULARY = [(t, 1 + i % 5 / 4, 0.6 - i % 3 * 0.5, i % 4 * 0.4 - 0.6, 0.3 - i % 7 * 0.1) for i, t in enumerate(["the", "of", "and", "to", "of the", "the of", "and the", "in the", "is the", "the and attion", "orre orre orre", "to thanedble the", "it", "this 1", "der", "que"])]
INTERCEPT = (0.1, -0.05, 0.2)
LINEAR_SQL = "vocab(term, idf, dove, hawk, neutral) AS (VALUES " + ", ".join(f"('{t}', {i}::DOUBLE, {d}::DOUBLE, {h}::DOUBLE, {n}::DOUBLE)" for t, i, d, h, n in VOCABULARY) + f"""),
  words AS (SELECT doc_id, pos, list_filter(regexp_extract_all(s, '[\\p{{L}}\\p{{N}}_]+'), lambda x: length(x) >= 2) AS w FROM sents),
  seq AS (SELECT doc_id, pos, w1, lead(w1) OVER q AS w2, lead(w1, 2) OVER q AS w3 FROM (SELECT doc_id, pos, generate_subscripts(w, 1) AS i, unnest(w) AS w1 FROM words) WINDOW q AS (PARTITION BY doc_id, pos ORDER BY i)),
  grams AS (SELECT doc_id, pos, w1 AS term FROM seq UNION ALL SELECT doc_id, pos, w1 || ' ' || w2 FROM seq WHERE w2 IS NOT NULL UNION ALL SELECT doc_id, pos, w1 || ' ' || w2 || ' ' || w3 FROM seq WHERE w3 IS NOT NULL),
  feats AS (SELECT doc_id, pos, term, (1 + ln(count(*))) * any_value(idf) AS x FROM grams JOIN vocab USING (term) GROUP BY ALL),
  sums AS (SELECT doc_id, pos, sum(x * dove) / sqrt(sum(x * x)) AS d, sum(x * hawk) / sqrt(sum(x * x)) AS h, sum(x * neutral) / sqrt(sum(x * x)) AS n FROM feats JOIN vocab USING (term) GROUP BY ALL),
  z AS (SELECT doc_id, pos, exp({INTERCEPT[0]}::DOUBLE + coalesce(d, 0)) AS d, exp({INTERCEPT[1]}::DOUBLE + coalesce(h, 0)) AS h, exp({INTERCEPT[2]}::DOUBLE + coalesce(n, 0)) AS n FROM sents LEFT JOIN sums USING (doc_id, pos)),
  lin AS (SELECT doc_id, pos, d / (d + h + n) AS p_dove, h / (d + h + n) AS p_hawk, n / (d + h + n) AS p_neutral FROM z)"""


def linear_probabilities(spark, sf_dir):
    words = F.filter(F.regexp_extract_all("s", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda x: F.length(x) >= 2)
    vocabulary = spark.createDataFrame(VOCABULARY, "term string, idf double, dove double, hawk double, neutral double")
    return scoring.linear_probabilities(sentences_of(spark, sf_dir).select("doc_id", "pos", words.alias("words")), vocabulary, INTERCEPT)


@query("dom_linear_score", f"""WITH {SENTENCES_SQL}, {LINEAR_SQL}
  SELECT doc_id, pos, round(p_dove, 6) AS p_dove, round(p_hawk, 6) AS p_hawk, round(p_neutral, 6) AS p_neutral, CASE WHEN p_hawk > p_dove AND p_hawk > p_neutral THEN 1 WHEN p_dove > p_hawk AND p_dove > p_neutral THEN -1 ELSE 0 END AS label FROM lin""")
def linear_score(spark, sf_dir):
    """Three classes of every relevant sentence; terms are a table."""
    found = linear_probabilities(spark, sf_dir)
    return found.select("doc_id", "pos", *(six(c).alias(c) for c in ("p_dove", "p_hawk", "p_neutral")), scoring.linear_label(F.col("p_dove"), F.col("p_hawk"), F.col("p_neutral")).alias("label"))


NORM = scoring.Norm(k=2.0, lex=(0.05, 0.25), lin=(-0.05, 0.15), z_to_net=2.5)
DOCUMENT_SQL = f"""lexed AS (SELECT doc_id, pos, sign(sum(hawk - dove))::INT AS lex FROM points GROUP BY ALL),
  vals AS (SELECT doc_id, pos, coalesce(lex, 0) AS lex, round(p_hawk - p_dove, 9) AS gap, (CASE WHEN p_hawk > p_dove AND p_hawk > p_neutral THEN 1 WHEN p_dove > p_hawk AND p_dove > p_neutral THEN -1 ELSE 0 END = coalesce(lex, 0))::INT AS agrees FROM lin LEFT JOIN lexed USING (doc_id, pos)),
  whole AS (SELECT doc_id, count(*) AS n, sum(lex)::DOUBLE AS a, sum(gap) AS b, avg(agrees) AS agreement,
    array_to_string((list(pos ORDER BY gap DESC, pos) FILTER (gap > 0.2))[1:3], ',') AS hawkish, array_to_string((list(pos ORDER BY gap, pos DESC) FILTER (gap < -0.2))[1:3], ',') AS dovish FROM vals GROUP BY doc_id),
  net AS (SELECT *, (((a + 2 * 0.05::DOUBLE) / (n + 2) - 0.05::DOUBLE) / 0.25::DOUBLE + ((b + 2 * (-0.05::DOUBLE)) / (n + 2) + 0.05::DOUBLE) / 0.15::DOUBLE) / 2 AS z FROM whole),
  about AS (SELECT p.doc_id, p.pos, p.dim, 0.5::DOUBLE * sign(p.hawk - p.dove) + 0.5::DOUBLE * gap AS v FROM points p JOIN vals USING (doc_id, pos)),
  dim1 AS (SELECT doc_id, dim, count(*) AS n, sum(v) AS v FROM about GROUP BY ALL),
  best AS (SELECT d.doc_id, d.dim, a.pos FROM dim1 d JOIN about a ON a.doc_id = d.doc_id AND a.dim = d.dim AND sign(a.v) = sign(d.v) WHERE d.v <> 0 QUALIFY row_number() OVER (PARTITION BY d.doc_id, d.dim ORDER BY abs(a.v) DESC, a.pos) = 1 AND abs(a.v) > 0.2),
  dims AS (SELECT doc_id, string_agg(dim || ' ' || n || ' ' || floor(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, v / (n + 3) / 0.257::DOUBLE)) * 1000 + 0.5)::BIGINT || ' ' || coalesce(pos::VARCHAR, '-'), ',' ORDER BY dim) AS dims FROM dim1 LEFT JOIN best USING (doc_id, dim) GROUP BY doc_id)"""


@query("dom_frozen_document_score", f"""WITH {POINTS_SQL}, {LINEAR_SQL}, {DOCUMENT_SQL}
  SELECT doc_id, n, {R3.format(C.format("z / 2.5::DOUBLE"))} AS score, CASE WHEN greatest(-1, least(1, z / 2.5::DOUBLE)) > 0.1 THEN 'hawkish' WHEN greatest(-1, least(1, z / 2.5::DOUBLE)) < -0.1 THEN 'dovish' ELSE 'neutral' END AS label, {R3.format("z")} AS z, {R3.format("a / n")} AS lexicon_measure, {R3.format("b / n")} AS linear_measure,
  {R3.format("agreement")} AS agreement, coalesce(hawkish, '') AS hawkish, coalesce(dovish, '') AS dovish, coalesce(dims, '') AS dims FROM net LEFT JOIN dims USING (doc_id)""")
def frozen_document_score(spark, sf_dir):
    """Both scorers together, with dimensions, agreement and evidence; evidence is the numbers of sentences."""
    scored_ = scoring.document_scores(scoring.sentence_values(lexicon_points(spark, sf_dir), linear_probabilities(spark, sf_dir)), NORM)
    shown = lambda d: F.concat_ws(" ", d["dim"], d["n"].cast("string"), F.round(d["score"] * 1000).cast("bigint").cast("string"), F.coalesce(d["evidence"].cast("string"), F.lit("-")))
    return scored_.withColumns({"hawkish": F.concat_ws(",", F.col("hawkish").cast("array<string>")), "dovish": F.concat_ws(",", F.col("dovish").cast("array<string>")), "dims": F.array_join(F.transform("dims", shown), ",")})


#: Sentences of decisions and of none, of which the test statements are made.
SAID = (
    "The weather was fine and rates of rain fell.", "The Committee decided to raise the target range for the federal funds rate by 1/2 percentage point.", "The Council agreed that the interest rate on the deposit facility will be lowered by 10 basis points.",
    "Members voted not to raise the federal funds rate.", "The Committee decided to maintain the target range for the federal funds rate.", "Today the target range was discussed at length; nothing else happened.",
    "The Committee decided to establish a target range for the federal funds rate of 0 to 1/4 percent.", "Interest rates on the main refinancing operations will be increased by 75 basis points, the Council decided.",
    "The Council decided to keep the three key ECB interest rates unchanged, and not cut anything.", "It decided to lower its policy rate.", "It decided to leave the policy rate and to raise the deposit facility later.",
    "It voted to increase the target range by 1 percentage point.", "The Board agreed to cut policy rates by 12.5 basis points, and then 50 basis points.",
)
SAID_SQL = ", ".join(f"({i}, '{s}')" for i, s in enumerate(SAID))
_PLACE = lambda d: "coalesce(" + ", ".join(f"CASE WHEN regexp_matches(s, '{p}') THEN length(regexp_extract(s, '^((?s:.)*?)(?:{p})', 1)) END" for p in scoring.MOVES[d]) + ")"


@query("dom_decision_score", I + f""", said(i, sentence) AS (VALUES {SAID_SQL}),
  sent AS (SELECT item_id AS doc_id, pos, sentence, lower(sentence) AS s, net_score * (pos - 1) AS value FROM (SELECT item_id, net_score, unnest([0, 1, 2]) AS pos, unnest([0, k % 13, (k * 7 + item_id) % 13]) AS i FROM items) JOIN said USING (i)),
  seen AS (SELECT *, {_PLACE(1)} AS up, {_PLACE(-1)} AS down, {_PLACE(0)} AS hold, regexp_matches(s, '{scoring.EMERGENCY}') AS emergency,
    regexp_matches(s, '{scoring.DECIDES}') AND regexp_matches(s, '{scoring.DECIDED_ON}') AND NOT regexp_matches(s, '{scoring.NEGATED}') AS decides,
    CASE WHEN contains(s, '75 basis points') THEN 75 WHEN contains(s, '10 basis points') THEN 10 WHEN contains(s, '12.5 basis points') THEN 12.5 WHEN contains(s, '1/2 percentage') THEN 50 WHEN contains(s, '1 percentage point') THEN 100 ELSE 25 END::DOUBLE AS size FROM sent),
  moves AS (SELECT *, CASE WHEN emergency OR down <= least(coalesce(up, 999), coalesce(hold, 999), 999) THEN -1 WHEN hold <= least(coalesce(up, 999), 999) THEN 0 ELSE 1 END AS direction FROM seen
    WHERE decides AND (emergency OR up IS NOT NULL OR down IS NOT NULL OR hold IS NOT NULL)),
  decided AS (SELECT d.doc_id, coalesce(direction, 0) AS direction, CASE WHEN coalesce(direction, 0) = 0 THEN 0 WHEN emergency THEN 75 ELSE size END::DOUBLE AS points, pos AS at
    FROM (SELECT DISTINCT doc_id FROM sent) d LEFT JOIN (SELECT * FROM moves QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY pos) = 1) m ON m.doc_id = d.doc_id),
  based AS (SELECT d.*, direction * CASE WHEN points <= 25 THEN 0.6::DOUBLE WHEN points <= 50 THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END AS base, coalesce((SELECT avg(value) FROM sent s WHERE s.doc_id = d.doc_id AND s.pos IS DISTINCT FROM d.at), 0) AS words FROM decided d)
  SELECT doc_id, direction, points, base + 0.0 AS base, {R3.format(C.format("base + words * (1 - abs(base))"))} + 0.0 AS score FROM based""")
def decision_score(spark, sf_dir):
    """Statements of three sentences each; the words' values are the items' scores, that of the middle sentence being 0."""
    said = F.array(*map(F.lit, SAID))
    rows = items(spark, sf_dir).select(F.col("item_id").alias("doc_id"), "net_score", F.posexplode(F.array(F.lit(0), F.col("k") % 13, ((F.col("k") * 7 + F.col("item_id")) % 13).cast("int"))).alias("pos", "i"))
    parts = rows.select("doc_id", "pos", F.element_at(said, F.col("i") + 1).alias("sentence"), (F.col("net_score") * (F.col("pos") - 1)).alias("value"))
    return scoring.decision_scores(scoring.decisions(parts, basis_points(F.col("sentence"))), parts).withColumns({x: F.col(x) + F.lit(0.0) for x in ("base", "score")})


@query("dom_scorer_combine", I + f"""SELECT item_id, {R3.format("CASE k % 4 WHEN 0 THEN a WHEN 1 THEN b WHEN 2 THEN (a + b) / 2 ELSE CASE WHEN sign(a) <> sign(b) AND abs(a) > 0.2 AND abs(b) > 0.2 THEN 0.0::DOUBLE ELSE (a + b) / 2 END END")} AS score,
  sign(a) <> sign(b) AND abs(a) > 0.2 AND abs(b) > 0.2 AS disagree FROM (SELECT *, net_score AS a, (k - 50) / 50.0::DOUBLE AS b FROM items)""")
def scorer_combine(spark, sf_dir):
    a, b = F.col("net_score"), (F.col("k") - 50) / 50.0
    apart = (F.signum(a) != F.signum(b)) & (F.abs(a) > 0.2) & (F.abs(b) > 0.2)
    mode = F.col("k") % 4
    score = F.when(mode == 0, a).when(mode == 1, b).when((mode == 3) & apart, 0.0).otherwise((a + b) / 2)
    return items(spark, sf_dir).select("item_id", round_up(score).alias("score"), apart.alias("disagree"))


@query("dom_hold_guard", I + f"SELECT item_id, {R3.format('CASE WHEN k % 3 = 0 AND sign(net_score) = sign(k - 50) THEN net_score * 0.5::DOUBLE ELSE greatest(-0.2::DOUBLE, least(0.2::DOUBLE, net_score)) END')} AS score FROM items WHERE source = 'error'")
def hold_guard(spark, sf_dir):
    """On a hold the words are limited, unless guidance points the same way: then half counts."""
    aligned = (F.col("k") % 3 == 0) & (F.signum("net_score") == F.signum(F.col("k") - 50))
    return items(spark, sf_dir).where("source = 'error'").select("item_id", round_up(F.when(aligned, F.col("net_score") * 0.5).otherwise(clamp("net_score", -0.2, 0.2))).alias("score"))


@query("dom_forward_guidance", """WITH s AS (SELECT doc_id, unnest(list_filter(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: length(x) > 15)) AS s FROM documents)
  SELECT doc_id, count(*) AS cues, round(max(CASE WHEN regexp_matches(s, '\\bwill\\b|\\bthat\\b') THEN 0.9 ELSE 0.5 END)::DOUBLE, 2) AS strength, sign(count(*) FILTER (regexp_matches(s, '\\bto\\b')) - count(*) FILTER (regexp_matches(s, '\\bby\\b')))::INT AS direction
  FROM s WHERE regexp_matches(s, '\\bthe\\b') AND regexp_matches(s, '\\b(to|by|with)\\b') AND NOT regexp_matches(s, '\\bwas\\b') GROUP BY doc_id""")
def forward_guidance(spark, sf_dir):
    """Sentences with an object and a marker that don't look back; the strongest cue and the majority."""
    s = table(spark, sf_dir, "documents").select("doc_id", F.explode(guidance_sentences(F.col("text"))).alias("s"))
    has = lambda p: F.col("s").rlike(p)
    cues = s.where(has(r"\bthe\b") & has(r"\b(to|by|with)\b") & ~has(r"\bwas\b"))
    strength = F.when(has(r"\bwill\b|\bthat\b"), 0.9).otherwise(0.5)
    return cues.groupBy("doc_id").agg(F.count("*").alias("cues"), F.max(strength).alias("strength"), F.signum(F.count_if(has(r"\bto\b")) - F.count_if(has(r"\bby\b"))).cast("int").alias("direction"))


@query("dom_ai_composite", I + f"SELECT item_id, CASE WHEN abs(c) < 0.10 THEN 0.0 ELSE {R3.format('c')} END AS score FROM (SELECT item_id, 0.5::DOUBLE * net_score + 0.5::DOUBLE * (0.45::DOUBLE * (k % 7 - 3) / 3 + 0.40::DOUBLE * (k % 5 - 2) / 2 + 0.15::DOUBLE * (k % 3 - 1)) AS c FROM items)")
def ai_composite(spark, sf_dir):
    part = lambda n, h: (F.col("k") % n - h)
    c = 0.5 * F.col("net_score") + 0.5 * (0.45 * part(7, 3) / 3 + 0.40 * part(5, 2) / 2 + 0.15 * part(3, 1))
    return items(spark, sf_dir).select("item_id", F.when(F.abs(c) < 0.10, 0.0).otherwise(round_up(c)).alias("score"))


BEST = "SELECT item_id FROM (SELECT item_id, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS rn FROM items) WHERE rn = 1"


ADDRESSED = """addressed AS (SELECT * REPLACE (title || CASE WHEN k % 11 = 0 THEN ' Q&A' ELSE '' END AS title, CASE WHEN user_id % 3 = 0 THEN 'Press Conf' ELSE source END AS source),
  CASE WHEN k % 4 > 0 THEN 'https://www.x.org/' || CASE WHEN k % 2 = 0 THEN 'en' ELSE 'de' END || '/p' || (k % 5) || '?q=1' END AS url FROM items)"""


@query("dom_dedup_items", with_sql(ITEMS_SQL, ADDRESSED) + """SELECT item_id FROM (SELECT item_id, row_number() OVER (PARTITION BY bank, item_date, CASE WHEN url IS NULL THEN 'T:' || lower(replace(title, '&', '')) ELSE 'U:' || (k % 5) END
  ORDER BY coalesce(contains(url, '/en/'), false) DESC, contains(title, 'Q&A') DESC, source = 'Press Conf', word_count DESC, item_id) AS rn FROM addressed) WHERE rn = 1""")
def dedup_items(spark, sf_dir):
    rows = items(spark, sf_dir)
    url = F.concat(F.lit("https://www.x.org/"), F.when(F.col("k") % 2 == 0, "en").otherwise("de"), F.lit("/p"), (F.col("k") % 5).cast("string"), F.lit("?q=1"))
    title = F.concat("title", F.when(F.col("k") % 11 == 0, " Q&A").otherwise(""))
    rows = rows.withColumns({"url": F.when(F.col("k") % 4 > 0, url), "title": title, "source": F.when(F.col("user_id") % 3 == 0, "Press Conf").otherwise(F.col("source"))})
    return dedup.dedup_items(rows, "item_id").select("item_id")


@query("dom_prune_cross_source", I + BEST.format(key="bank, item_date, speaker", order="(abs(net_score) > 0.001) DESC, CASE source WHEN 'error' THEN 1 WHEN 'view' THEN 2 ELSE 3 END, word_count DESC, item_id"))
def prune_cross_source(spark, sf_dir):
    tier = F.when(F.col("source") == "error", 1).when(F.col("source") == "view", 2).otherwise(3)
    return top_rows(items(spark, sf_dir), ["bank", "item_date", "speaker"], [(F.abs("net_score") > 0.001).desc(), tier, F.desc("word_count"), "item_id"], 1).select("item_id")


#: Copies of speeches: the speaker and words of a title vary in marks and case, the address is a bank's own for one in four.
COPIES_SQL = """copied AS (SELECT item_id, bank, item_date, CASE WHEN k % 10 = 0 THEN 'Minutes' ELSE 'Member Speech' END AS source, speaker, k, k % 4 = 0 AS own,
    CASE WHEN k % 10 > 0 AND NOT is_statistical AND k % 9 > 0 THEN 'S ' || bank || ' ' || item_date || ' ' || speaker || ' ' || k % 3 END AS a, CASE WHEN k % 9 > 0 THEN 'U ' || bank || ' ' || (user_id * 31 + k * 7 + day(item_date)) % 1500 END AS b FROM items)"""


@query("dom_group_evidence", "WITH RECURSIVE " + ITEMS_SQL + ", " + COPIES_SQL + """, keyed AS (SELECT item_id AS id, a AS key FROM copied WHERE a IS NOT NULL UNION ALL SELECT item_id, b FROM copied WHERE b IS NOT NULL),
  heads AS (SELECT key, min(id) AS head FROM keyed GROUP BY key),
  pairs AS (SELECT DISTINCT id AS x, head AS y FROM keyed JOIN heads USING (key) WHERE id <> head UNION SELECT DISTINCT head, id FROM keyed JOIN heads USING (key) WHERE id <> head),
  closure AS (SELECT item_id AS x, item_id AS least FROM copied UNION SELECT p.y, c.least FROM closure c JOIN pairs p ON p.x = c.x WHERE c.least < p.y),
  grouped AS (SELECT x AS item_id, min(least) AS "group" FROM closure GROUP BY x)
  SELECT "group", count(*) AS copies, coalesce(min(item_id) FILTER (own), min(item_id)) AS "primary", bool_or(own) AS is_original FROM grouped JOIN copied USING (item_id) GROUP BY 1""")
def group_evidence(spark, sf_dir):
    """By speech or by address, and by what these link; the bank's own copy is shown."""
    k = F.col("k")
    named = F.concat(F.lit("Dr. S-"), F.col("speaker").cast("string"), F.when(k % 2 == 0, ": On  Rates, part ").otherwise(" : ON rates - PART "), (k % 3).cast("string"))
    title = F.when(k % 9 > 0, named).otherwise("No speaker here")
    source = F.when(k % 10 == 0, "Minutes").otherwise("Member Speech")
    day = F.dayofmonth("item_date")
    page = F.concat(F.lit("/x"), ((F.col("user_id") * 31 + k * 7 + day) % 1500).cast("string"), F.when(k % 2 == 0, "/").otherwise("?q=1"))
    host = F.when(k % 4 != 0, "https://www.bis.org").when(F.col("bank") == "FED", "https://www.federalreserve.gov").otherwise("https://www.ecb.europa.eu")
    rows = items(spark, sf_dir).withColumns({"title": title, "source": source, "url": F.concat(host, page)})
    speech = evidence.speech_of(F.col("bank"), F.col("item_date"), F.col("source"), F.col("title"), F.col("is_statistical"))
    address = F.when(k % 9 > 0, F.concat(F.lit("U "), F.col("bank"), F.regexp_extract(canonical_url(F.col("url")), "(/.*)$", 1)))
    rows = rows.withColumn("keys", F.array(speech, address))
    found = rows.join(evidence.groups(rows, "item_id", "keys"), "item_id")
    return evidence.with_primary(found, "group", "item_id", evidence.is_original(F.col("bank"), F.col("url")))


STAT = "st AS (SELECT item_id, bank, k % 10 AS metric, k AS v, item_date, stat_weight, net_score, strftime(item_date, '%Y-%m') AS month FROM items WHERE is_statistical)"
OBSERVED = ["bank", "metric", "month"]


def prints(spark, sf_dir):
    return items(spark, sf_dir).where("is_statistical").withColumn("metric", F.col("k") % 10).withColumn("month", F.date_format("item_date", "yyyy-MM"))


@query("dom_dedup_stat_prints", with_sql(ITEMS_SQL, STAT) + """SELECT item_id, CASE WHEN item_date <> first_date THEN 0.0 ELSE net_score END AS net_score,
  CASE WHEN item_date <> first_date THEN 0.0 WHEN other THEN greatest(0.5, coalesce(nullif(stat_weight, 0), 1) * 0.5) ELSE stat_weight END::DOUBLE AS stat_weight
  FROM (SELECT *, first_value(item_date) OVER (PARTITION BY bank, metric, month, v ORDER BY item_id) AS first_date,
    coalesce(min(v) OVER p <> v OR max(v) OVER p <> v, false) AS other FROM st WINDOW p AS (PARTITION BY bank, metric, month ORDER BY item_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""")
def dedup_stat_prints(spark, sf_dir):
    return dedup.dedup_prints(prints(spark, sf_dir), OBSERVED, "k", "item_id").select("item_id", "net_score", "stat_weight")


@query("dom_month_revision", with_sql(ITEMS_SQL, STAT) + "SELECT item_id, v - p AS revision FROM (SELECT *, lag(v) OVER (PARTITION BY bank, metric, month ORDER BY item_id) AS p FROM st) WHERE v <> p")
def month_revision(spark, sf_dir):
    return dedup.revisions(prints(spark, sf_dir), OBSERVED, "k", "item_id").select("item_id", "revision")


CUSUM = """WITH RECURSIVE day_means AS (SELECT bank || '/' || speaker AS bank, item_date AS day, avg(net_score) AS m, count(*) AS c FROM items WHERE abs(net_score) > 0.001 GROUP BY ALL),
  d AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY bank) AS n, sum(m * c) OVER w AS cs, sum(c) OVER w AS cc FROM day_means WINDOW w AS (PARTITION BY bank ORDER BY day) QUALIFY count(*) OVER (PARTITION BY bank) >= 5 AND sum(c) OVER (PARTITION BY bank) >= 8),
  s AS (SELECT d.*, (d.cs - coalesce(p.cs, 0)) / (d.cc - coalesce(p.cc, 0)) AS x FROM d LEFT JOIN d p ON p.bank = d.bank AND p.i = d.i - least(5, d.n // 3)),
  t AS (SELECT *, sum(x) OVER (PARTITION BY bank ORDER BY i) AS sx, avg(x) OVER (PARTITION BY bank) AS level, coalesce(nullif(stddev_pop(x) OVER (PARTITION BY bank), 0), 0.03) AS spread, least(i, greatest(3, n // 4)) AS reach FROM s),
  u AS (SELECT t.bank, t.i, t.day, t.x - t.level AS gap, t.spread, t.spread * CASE WHEN t.n < 15 THEN 1.8 ELSE 2.0 END AS lim, (p.sx - coalesce(q.sx, 0)) / t.reach AS b, (r.sx - p.sx) / least(t.n - t.i, t.reach) AS a
    FROM t JOIN t p ON p.bank = t.bank AND p.i = t.i - 1 LEFT JOIN t q ON q.bank = t.bank AND q.i = t.i - t.reach - 1 JOIN t r ON r.bank = t.bank AND r.i = t.i + least(t.n - t.i, t.reach) - 1),
  walk AS (SELECT bank, 0::BIGINT AS i, 0.0::DOUBLE AS up, 0.0::DOUBLE AS down, NULL::DATE AS last_day, NULL::DOUBLE AS last_size, false AS told, false AS instead FROM t WHERE i = 0
    UNION ALL
    SELECT bank, i, CASE WHEN tells THEN 0 ELSE up END, CASE WHEN tells THEN 0 ELSE down END, CASE WHEN tells THEN day ELSE last_day END, CASE WHEN tells THEN size ELSE last_size END, tells, tells AND near
    FROM (SELECT *, (up > lim OR down < -lim) AND size >= greatest(0.03, 0.5 * spread) AND (NOT near OR size > last_size) AS tells
      FROM (SELECT w.bank, u.i, u.day, u.lim, u.spread, abs(u.a - u.b) AS size, greatest(0.0, w.up + u.gap - 0.3 * u.spread) AS up, least(0.0, w.down + u.gap + 0.3 * u.spread) AS down, w.last_day, w.last_size, coalesce(u.day - w.last_day < 7, false) AS near
        FROM walk w JOIN u ON u.bank = w.bank AND u.i = w.i + 1))),
  found AS (SELECT bank, i, lead(instead) OVER (PARTITION BY bank ORDER BY i) AS replaced FROM walk WHERE told)
  SELECT bank, day, CASE WHEN abs(a - b) > 2.5 * spread THEN 'regime_shift' WHEN least(a, b) < -0.01 AND greatest(a, b) > 0.01 THEN 'tone_reversal' ELSE 'guidance_change' END AS kind, round(abs(a - b), 6) AS magnitude, {b} AS before, {a} AS after
  FROM found JOIN u USING (bank, i) WHERE NOT coalesce(replaced, false)"""


@query("dom_cusum_change_points", CUSUM.replace("WITH RECURSIVE ", "WITH RECURSIVE " + ITEMS_SQL + ", ").replace("{b}", R3.format("b")).replace("{a}", R3.format("a")))
def cusum(spark, sf_dir):
    """A recursion over the days of each bank and speaker; streaming.changes finds the same in a stream."""
    rows = scored(items(spark, sf_dir))
    return changepoint.per_bank(rows.withColumn("bank", F.concat_ws("/", "bank", "speaker"))).withColumn("magnitude", six("magnitude"))


DRIFT = """, r AS (SELECT user_id, net_score AS s, row_number() OVER w AS rn, count(*) OVER (PARTITION BY user_id) AS n, avg(net_score) OVER (PARTITION BY user_id ORDER BY item_date, item_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS mean5
    FROM items WINDOW w AS (PARTITION BY user_id ORDER BY item_date, item_id)),
  g AS (SELECT user_id, count(*) AS n, regr_slope(s, rn - 1) AS slope, avg(s) FILTER (rn <= n // 2) AS a, avg(s) FILTER (rn > n // 2) AS b, sum(s) FILTER (rn > n - 3) / 3 - coalesce(sum(s) FILTER (rn <= n - 3), 0) / greatest(1, max(n) - 3) AS shift, max_by(mean5, rn) AS latest FROM r GROUP BY user_id)
  SELECT user_id, n, round(latest, 6) + 0.0 AS latest, CASE WHEN n >= 3 THEN round(slope, 6) + 0.0 END AS slope, CASE WHEN n >= 3 THEN round(least(1, CASE WHEN a * b < 0 THEN 0.4 ELSE 0 END + CASE WHEN abs(shift) > 0.2 THEN 0.3 WHEN abs(shift) > 0.1 THEN 0.15 ELSE 0 END
    + CASE WHEN abs(slope) > 0.05 THEN 0.2 WHEN abs(slope) > 0.02 THEN 0.1 ELSE 0 END + CASE WHEN n > 10 THEN 0.1 ELSE 0 END), 2)::DOUBLE END AS pivot FROM g"""


@query("dom_narrative_drift", I.rstrip() + DRIFT)
def narrative_drift(spark, sf_dir):
    return drift.narrative(items(spark, sf_dir), ["user_id"], "net_score", ["item_date", "item_id"]).withColumns({"latest": six("latest"), "slope": six("slope")})


@query("dom_surprise_index", with_sql(ITEMS_SQL, MEANS) + """SELECT item_id, round(abs(net_score - m.mean) / sd + abs(net_score - g) / sd, 6) AS surprise FROM items JOIN m USING (speaker), (SELECT avg(net_score) AS g, coalesce(nullif(stddev_pop(net_score), 0), 0.1) AS sd FROM items)
  WHERE abs(net_score - m.mean) / sd > 0.8 ORDER BY round(abs(net_score - m.mean) / sd + abs(net_score - g) / sd, 6) DESC, item_id LIMIT 5""")
def surprise_index(spark, sf_dir):
    rows = items(spark, sf_dir)
    by = rows.groupBy("speaker").agg(F.avg("net_score").alias("mean"))
    every = rows.agg(F.avg("net_score").alias("g"), F.coalesce(F.nullif(F.stddev_pop("net_score"), F.lit(0.0)), F.lit(0.1)).alias("sd"))
    all_ = rows.join(by, "speaker").crossJoin(F.broadcast(every))  # one row
    own, common = F.abs(F.col("net_score") - F.col("mean")) / F.col("sd"), F.abs(F.col("net_score") - F.col("g")) / F.col("sd")
    return all_.where(own > 0.8).select("item_id", six(own + common).alias("surprise")).orderBy(F.desc("surprise"), "item_id").limit(5)


@query("dom_cross_bank_spread", with_sql(ITEMS_SQL) + """, m AS (SELECT date_trunc('week', item_date)::DATE AS week, coalesce(avg(net_score) FILTER (bank = 'FED'), 0) - coalesce(avg(net_score) FILTER (bank = 'ECB'), 0) AS spread FROM items GROUP BY 1)
  SELECT week, round(spread, 6) AS spread, round(spread - lag(spread) OVER (ORDER BY week), 6) AS trend, CASE WHEN spread > 0.05 THEN 'FED' WHEN spread < -0.05 THEN 'ECB' ELSE 'even' END AS bias FROM m""")
def cross_bank_spread(spark, sf_dir):
    mean = lambda b: F.coalesce(F.avg(F.when(F.col("bank") == b, F.col("net_score"))), F.lit(0.0))
    m = items(spark, sf_dir).groupBy(F.trunc("item_date", "week").alias("week")).agg((mean("FED") - mean("ECB")).alias("s"))  # one row per week
    bias = F.when(F.col("s") > 0.05, "FED").when(F.col("s") < -0.05, "ECB").otherwise("even")
    return m.select("week", six("s").alias("spread"), six(F.col("s") - F.lag("s").over(Window.orderBy("week"))).alias("trend"), bias.alias("bias"))


FACTORS = {"inflation": "source = 'error'", "growth": "source = 'view'", "labour": "source = 'signup'", "guidance": "k % 5 = 0", "balance": "k % 7 = 0", "risk": "net_score < -0.3"}


@query("dom_stance_decomposition", I + "SELECT bank, factor, round(s / n, 6) AS part FROM (SELECT bank, count(*) AS n, " + ", ".join(f"coalesce(sum(net_score) FILTER ({v}), 0) AS {k}" for k, v in FACTORS.items()) + " FROM items GROUP BY bank) UNPIVOT (s FOR factor IN (" + ", ".join(FACTORS) + "))")
def stance_decomposition(spark, sf_dir):
    wide = items(spark, sf_dir).groupBy("bank").agg(F.count("*").alias("n"), *(F.coalesce(F.sum(F.when(F.expr(v), F.col("net_score"))), F.lit(0.0)).alias(k) for k, v in FACTORS.items()))
    return wide.unpivot(["bank", "n"], list(FACTORS), "factor", "s").select("bank", "factor", six(F.col("s") / F.col("n")).alias("part"))


@query("dom_speaker_dna", I + """SELECT user_id, n, round(avg(net_score), 6) AS focus, round(coalesce(stddev_pop(net_score), 0), 6) AS volatility, round(count(*) FILTER (sign(net_score) <> sign(p) AND abs(net_score) > 0.01 AND abs(p) > 0.01) / (n - 1), 6) AS flip_rate,
  round(avg(net_score) FILTER (rn > n // 2) - avg(net_score) FILTER (rn <= n // 2), 6) AS drift FROM (SELECT *, lag(net_score) OVER w AS p, row_number() OVER w AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM items WINDOW w AS (PARTITION BY user_id ORDER BY item_date, item_id)) WHERE n >= 2 GROUP BY user_id, n""")
def speaker_dna(spark, sf_dir):
    s, p = F.col("net_score"), F.col("p")
    rows = placed(spark, sf_dir).withColumn("p", F.lag("net_score").over(W("user_id").orderBy("item_date", "item_id"))).where("n >= 2")
    late = F.col("rn") > F.floor(F.col("n") / 2)
    flips = F.count_if((F.signum(s) != F.signum(p)) & (F.abs(s) > 0.01) & (F.abs(p) > 0.01))
    return rows.groupBy("user_id", "n").agg(six(F.avg(s)).alias("focus"), six(F.stddev_pop(s)).alias("volatility"), six(flips / (F.col("n") - 1)).alias("flip_rate"), six(F.avg(F.when(late, s)) - F.avg(F.when(~late, s))).alias("drift"))


USERS = "u AS (SELECT user_id, avg(net_score) AS mean, count(*) AS n FROM items WHERE NOT is_statistical GROUP BY user_id HAVING count(*) >= 2)"


@query("dom_network", with_sql(ITEMS_SQL, USERS) + """, e AS (SELECT a.user_id, count(*) AS degree, sum(1 - 5 * abs(a.mean - b.mean)) AS strength FROM u a JOIN u b ON a.user_id <> b.user_id AND 1 - 5 * abs(a.mean - b.mean) > 0.3 GROUP BY 1)
  SELECT user_id, round(mean, 6) AS mean, n, coalesce(degree, 0) AS degree, round(coalesce(strength, 0), 4) AS strength FROM u LEFT JOIN e USING (user_id)""")
def dom_network(spark, sf_dir):
    """Nodes with two items or more; the edges themselves are join_nested_loop_pairs."""
    nodes = items(spark, sf_dir).where("NOT is_statistical").groupBy(F.col("user_id").alias("name")).agg(F.avg("net_score").alias("mean"), F.count("*").alias("n")).where("n >= 2")
    return network.nodes_with_sums(nodes, doubles=True).select(F.col("name").alias("user_id"), six("mean").alias("mean"), "n", "degree", F.round("strength", 4).alias("strength"))


@query("dom_tone_evolution", with_sql(ITEMS_SQL, CALENDAR_SQL, DAILY) + """, p AS (SELECT c.bank, meeting, item_date, mean, n FROM calendar c JOIN d ON d.bank = c.bank AND item_date <= meeting AND item_date >= meeting - 30)
  SELECT bank, meeting, item_date, round(sum(mean * n) OVER w / sum(n) OVER w, 6) AS running FROM p WINDOW w AS (PARTITION BY bank, meeting ORDER BY item_date ROWS UNBOUNDED PRECEDING)""")
def tone_evolution(spark, sf_dir):
    """Days are summed first; then each meeting takes the days of the month before it."""
    m = F.broadcast(calendar(spark).select("bank", "meeting"))
    p = daily(spark, sf_dir).join(m, "bank").where((F.col("item_date") <= F.col("meeting")) & (F.col("item_date") >= F.date_sub("meeting", 30)))
    w = W("bank", "meeting").orderBy("item_date").rowsBetween(Window.unboundedPreceding, 0)
    return p.select("bank", "meeting", "item_date", six(F.sum(F.col("mean") * F.col("n")).over(w) / F.sum("n").over(w)).alias("running"))


@query("dom_topic_heatmap", with_sql(ITEMS_SQL, CALENDAR_SQL, SPANS) + """, x AS (SELECT i.bank, meeting, source, unnest([source, CASE WHEN k > 50 THEN 'late' ELSE 'early' END]) AS topic, max(source = 'error') OVER (PARTITION BY i.bank, meeting) AS policy FROM items i JOIN spans s ON i.bank = s.bank AND item_date > p AND item_date < x)
  SELECT bank, meeting, topic, count(*) AS n FROM x WHERE NOT policy OR source = 'error' GROUP BY ALL""")
def topic_heatmap(spark, sf_dir):
    """Where a cycle has tagged policy texts only those count; that is known per cycle, so it is
    counted both ways and chosen after."""
    tags = F.explode(F.array("source", F.when(F.col("k") > 50, "late").otherwise("early")))
    x = cycles(spark, sf_dir).select("bank", "meeting", "source", tags.alias("topic"))
    counts = x.groupBy("bank", "meeting", "topic").agg(F.count("*").alias("all"), F.count_if(F.col("source") == "error").alias("policy"))
    any_ = F.max(F.col("policy") > 0).over(W("bank", "meeting"))
    return counts.select("bank", "meeting", "topic", F.when(any_, F.col("policy")).otherwise(F.col("all")).alias("n")).where("n > 0")


@query("dom_policy_radar", I + f"SELECT speaker, round(avg(net_score), 6) AS x, round(avg(k / 50.0::DOUBLE - 1), 6) AS y, round(coalesce(avg(net_score) FILTER (item_date >= {AS_OF_SQL} - 14), 0) - coalesce(avg(net_score) FILTER (item_date < {AS_OF_SQL} - 14 AND item_date >= {AS_OF_SQL} - 45), 0), 6) AS drift, CASE WHEN avg(net_score) >= 0 THEN 'hawk' ELSE 'dove' END || CASE WHEN avg(k / 50.0::DOUBLE - 1) >= 0 THEN '+' ELSE '-' END AS quadrant FROM items GROUP BY speaker")
def policy_radar(spark, sf_dir):
    d, s = F.col("item_date"), F.col("net_score")
    y = F.avg(F.col("k") / 50.0 - 1)
    at = lambda n: F.date_sub(F.lit(AS_OF), n)
    mean = lambda c: F.coalesce(F.avg(F.when(c, s)), F.lit(0.0))
    quadrant = F.concat(F.when(F.avg(s) >= 0, "hawk").otherwise("dove"), F.when(y >= 0, "+").otherwise("-"))
    return items(spark, sf_dir).groupBy("speaker").agg(six(F.avg(s)).alias("x"), six(y).alias("y"), six(mean(d >= at(14)) - mean((d < at(14)) & (d >= at(45)))).alias("drift"), quadrant.alias("quadrant"))


PROBS = "(k % 7 + 1) / (k % 7 + k % 5 + k % 3 + 3.0::DOUBLE) AS hike, (k % 5 + 1) / (k % 7 + k % 5 + k % 3 + 3.0::DOUBLE) AS hold, (k % 3 + 1) / (k % 7 + k % 5 + k % 3 + 3.0::DOUBLE) AS cut"


def probabilities(spark, sf_dir):
    k = F.col("k")
    total = k % 7 + k % 5 + k % 3 + 3.0
    return items(spark, sf_dir).select("*", ((k % 7 + 1) / total).alias("hike"), ((k % 5 + 1) / total).alias("hold"), ((k % 3 + 1) / total).alias("cut"))


P = with_sql(ITEMS_SQL, f"p AS (SELECT *, {PROBS} FROM items)")


@query("dom_cie", P + "SELECT item_id, round((hike - cut) - net_score, 6) + 0.0 AS gap, CASE WHEN abs((hike - cut) - net_score) > 0.3 THEN 'high' WHEN abs((hike - cut) - net_score) > 0.15 THEN 'medium' ELSE 'low' END AS risk FROM p")
def cie(spark, sf_dir):
    gap = F.col("hike") - F.col("cut") - F.col("net_score")
    return probabilities(spark, sf_dir).select("item_id", six(gap).alias("gap"), F.when(F.abs(gap) > 0.3, "high").when(F.abs(gap) > 0.15, "medium").otherwise("low").alias("risk"))


@query("dom_market_blend", P + ", b AS (SELECT item_id, (1 - w) * hike + w * 0.2::DOUBLE AS hike, (1 - w) * hold + w * 0.5::DOUBLE AS hold, (1 - w) * cut + w * 0.3::DOUBLE AS cut, k FROM (SELECT *, CASE WHEN k >= 30 THEN 0.25::DOUBLE WHEN k <= 3 THEN 0.75::DOUBLE ELSE floor((0.75::DOUBLE - (k - 3) / 27.0::DOUBLE * 0.5::DOUBLE) * 100.0::DOUBLE + 0.5) / 100.0::DOUBLE END AS w FROM p)) SELECT item_id, round(hike, 6) AS hike, round(hold, 6) AS hold, round(cut, 6) AS cut, ['hike', 'hold', 'cut'][list_position([round(hike, 6), round(hold, 6), round(cut, 6)], list_max([round(hike, 6), round(hold, 6), round(cut, 6)]))] AS decision, least(0.95, 0.6 + CASE WHEN k <= 14 THEN 0.1 ELSE 0 END)::DOUBLE AS confidence FROM b")
def market_blend(spark, sf_dir):
    from tidemark.functions.numerics import market_weight

    w = market_weight("k")
    mix = lambda c, m: six((1 - w) * F.col(c) + w * m).alias(c)
    b = probabilities(spark, sf_dir).select("item_id", "k", mix("hike", 0.2), mix("hold", 0.5), mix("cut", 0.3))
    all_ = F.array("hike", "hold", "cut")
    names = F.array(F.lit("hike"), F.lit("hold"), F.lit("cut"))
    return b.select("item_id", "hike", "hold", "cut", F.element_at(names, F.array_position(all_, F.array_max(all_)).cast("int")).alias("decision"), F.round(F.least(F.lit(0.95), 0.6 + F.when(F.col("k") <= 14, 0.1).otherwise(0.0)), 2).alias("confidence"))


@query("dom_fx_consistency", I + "SELECT item_id, CASE WHEN source = 'click' THEN 'neutral' WHEN net_score > 0 THEN 'stronger' WHEN net_score < 0 THEN 'weaker' ELSE 'neutral' END AS direction FROM items")
def fx_consistency(spark, sf_dir):
    s = F.col("net_score")
    return items(spark, sf_dir).select("item_id", F.when(F.col("source") == "click", "neutral").when(s > 0, "stronger").when(s < 0, "weaker").otherwise("neutral").alias("direction"))


L1 = "abs(hike - 0.2::DOUBLE) + abs(hold - 0.5::DOUBLE) + abs(cut - 0.3::DOUBLE)"


@query("dom_divergence", P + f"SELECT item_id, round({L1}, 6) AS distance, round({L1}, 6) > 0.2 OR (hike > cut) <> (net_score > 0) AS alert FROM p")
def divergence(spark, sf_dir):
    d = six(F.abs(F.col("hike") - 0.2) + F.abs(F.col("hold") - 0.5) + F.abs(F.col("cut") - 0.3))
    return probabilities(spark, sf_dir).select("item_id", d.alias("distance"), ((d > 0.2) | ((F.col("hike") > F.col("cut")) != (F.col("net_score") > 0))).alias("alert"))


@query("dom_ois_gap", P + "SELECT item_id, floor((5.25::DOUBLE + hike * 0.25::DOUBLE - cut * 0.25::DOUBLE - 5.0::DOUBLE) * 100.0::DOUBLE + 0.5) / 100.0::DOUBLE AS gap FROM p")
def ois_gap(spark, sf_dir):
    return probabilities(spark, sf_dir).select("item_id", round_up(5.25 + F.col("hike") * 0.25 - F.col("cut") * 0.25 - 5.0, 2).alias("gap"))


@query("dom_probability_shape", P + "SELECT item_id, outcome, round(v, 6) AS v FROM (SELECT item_id, hike, hold, cut FROM p) UNPIVOT (v FOR outcome IN (hike, hold, cut))")
def probability_shape(spark, sf_dir):
    return probabilities(spark, sf_dir).unpivot("item_id", ["hike", "hold", "cut"], "outcome", "v").select("item_id", "outcome", six("v").alias("v"))


@query("dom_probability_diff", P + "SELECT item_id, CASE WHEN abs(hike - 0.2::DOUBLE) >= 0.01 THEN round(hike - 0.2::DOUBLE, 6) END AS hike, CASE WHEN abs(cut - 0.3::DOUBLE) >= 0.01 THEN round(cut - 0.3::DOUBLE, 6) END AS cut FROM p")
def probability_diff(spark, sf_dir):
    gap = lambda c, m: F.when(F.abs(F.col(c) - m) >= 0.01, six(F.col(c) - m)).alias(c)
    return probabilities(spark, sf_dir).select("item_id", gap("hike", 0.2), gap("cut", 0.3))


@query("dom_taylor_classic", S + "SELECT month, round(4 + 1.5 * p + 0.5 * y, 4) AS classic, round(4 + p + y, 4) AS balanced FROM (SELECT month, mean / 100000 - 2 AS p, n / 100.0::DOUBLE - 1 AS y FROM series)")
def taylor_classic(spark, sf_dir):
    p, y = F.col("mean") / 100000 - 2, F.col("n") / 100.0 - 1
    return series(spark, sf_dir).select("month", F.round(4 + 1.5 * p + 0.5 * y, 4).alias("classic"), F.round(4 + p + y, 4).alias("balanced"))


@query("dom_taylor_two_regime", S + """, t AS (SELECT mean / 100000 - 1.95::DOUBLE AS y, n / 100.0::DOUBLE AS x, month(month) / 12.0::DOUBLE AS z FROM series),
  r AS (SELECT unnest(list_filter([CASE WHEN y >= 0.5 OR (SELECT count(*) FILTER (y >= 0.5) FROM t) < 12 THEN 'normal' END, CASE WHEN y < 0.5 THEN 'low' END], lambda v: v IS NOT NULL)) AS regime, * FROM t),
  s AS (SELECT regime, count(*) AS n, covar_pop(x, x) AS xx, covar_pop(z, z) AS zz, covar_pop(x, z) AS xz, covar_pop(x, y) AS xy, covar_pop(z, y) AS zy, covar_pop(y, y) AS yy, avg(x) AS mx, avg(z) AS mz, avg(y) AS my FROM r GROUP BY regime),
  b AS (SELECT *, (xy * zz - zy * xz) / (xx * zz - xz * xz) AS b_x, (zy * xx - xy * xz) / (xx * zz - xz * xz) AS b_z FROM s)
  SELECT regime, n, round(my - b_x * mx - b_z * mz, 4) AS constant, round(b_x, 4) AS b_inflation, round(b_z, 4) AS b_output, round(sqrt((yy - b_x * xy - b_z * zy) * n / (n - 3)), 4) AS error, round(1 - (yy - b_x * xy - b_z * zy) / yy, 4) AS r2 FROM b""")
def taylor_two_regime(spark, sf_dir):
    t = series(spark, sf_dir).select((F.col("mean") / 100000 - 1.95).alias("y"), (F.col("n") / 100.0).alias("x"), (F.month("month") / 12.0).alias("z"))
    found = regression.two_regimes(t, "y", "x", "z", bound=0.5)
    four = lambda c: F.round(c, 4)
    return found.select("regime", "n", four("constant").alias("constant"), four("b_x").alias("b_inflation"), four("b_z").alias("b_output"), four("error").alias("error"), four("r2").alias("r2"))


#: Monthly series of five keys with missing months and values, from the orders.
MACRO_SQL = """o AS (SELECT o_orderpriority AS p, date_trunc('month', o_orderdate)::DATE AS month, count(*) AS c, avg(o_totalprice) AS mean, sum(o_totalprice) AS total, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders GROUP BY ALL),
  s AS (SELECT p, month, year(month) * 12 + month(month) AS m, CASE WHEN (year(month) * 12 + month(month)) % 23 <> 5 THEN mean / 100000 END AS policy_rate, total / 1e6::DOUBLE AS prices, c / 10.0::DOUBLE AS unemployment, low / 10000 AS short_rate, high / 100000 AS long_rate, mean / 1000 AS oil,
    CASE WHEN c % 3 = 0 THEN 4.5::DOUBLE END AS natural_rate, CASE WHEN c % 5 > 0 THEN total / 1e5::DOUBLE END AS equity, CASE WHEN c % 4 > 0 THEN c % 7 / 3.0::DOUBLE END AS credit_spread, CASE WHEN c % 6 > 0 THEN (c % 11)::DOUBLE END AS hy_spread, CASE WHEN c % 7 > 0 THEN c::DOUBLE END AS vix, (c % 5 - 2) / 2.0::DOUBLE AS fci
    FROM o WHERE (year(month) * 12 + month(month)) % 17 <> length(p))"""


def macro(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("p"), F.trunc("o_orderdate", "MM").alias("month"))
    rows = rows.agg(F.count("*").alias("c"), F.avg("o_totalprice").alias("mean"), F.sum("o_totalprice").alias("total"), F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"))
    c, m = F.col("c"), reaction.month_number(F.col("month"))
    some = lambda test, value: F.when(test, value)
    return rows.where(m % 17 != F.length("p")).select(
        "p", "month", some(m % 23 != 5, F.col("mean") / 100000).alias("policy_rate"), (F.col("total") / 1e6).alias("prices"), (c / 10.0).alias("unemployment"), (F.col("low") / 10000).alias("short_rate"), (F.col("high") / 100000).alias("long_rate"),
        (F.col("mean") / 1000).alias("oil"), some(c % 3 == 0, F.lit(4.5)).alias("natural_rate"), some(c % 5 > 0, F.col("total") / 1e5).alias("equity"), some(c % 4 > 0, c % 7 / 3.0).alias("credit_spread"), some(c % 6 > 0, (c % 11).cast("double")).alias("hy_spread"),
        some(c % 7 > 0, c.cast("double")).alias("vix"), ((c % 5 - 2) / 2.0).alias("fci"),
    )


FEATURES_SQL = MACRO_SQL + """,
  b AS (SELECT s.p, s.month, s.m, s.policy_rate, p1.policy_rate AS policy_rate_lag, (s.prices / p12.prices - 1) * 100 - 2 AS inflation_gap,
      coalesce(s.natural_rate, (SELECT avg(q.unemployment) FROM s q WHERE q.p = s.p AND q.m BETWEEN s.m - 120 AND s.m)) - s.unemployment AS unemployment_gap, s.short_rate AS y2y, s.long_rate - s.short_rate AS slope, ln(s.oil) - ln(p1.oil) AS oil_log_change,
      CASE WHEN s.equity IS NOT NULL AND p1.equity > 0 THEN greatest(-(ln(s.equity) - ln(p1.equity)), 0) ELSE 0 END AS r_neg_equity, coalesce(s.credit_spread, 0) AS credit_spread, coalesce(s.hy_spread, 0) AS hy_spread, coalesce(s.vix, 20) AS vix, coalesce(s.fci, 0) AS fci
    FROM s JOIN s p1 ON p1.p = s.p AND p1.m = s.m - 1 JOIN s p12 ON p12.p = s.p AND p12.m = s.m - 12 WHERE s.policy_rate IS NOT NULL AND p1.policy_rate IS NOT NULL AND p1.oil <> 0 AND p12.prices <> 0),
  f AS (SELECT b.*, b1.unemployment_gap AS unemployment_gap_l1, b6.unemployment_gap AS unemployment_gap_l6, b1.y2y AS y2y_l1, b3.y2y AS y2y_l3, b6.slope AS slope_l6, b1.credit_spread AS credit_spread_l1, b1.fci AS fci_l1, b3.fci AS fci_l3, b1.inflation_gap AS inflation_gap_l1,
      b1.policy_rate - coalesce(b2.policy_rate, b1.policy_rate) AS rate_change_l1, (b.credit_spread + b.hy_spread / 5 + b.vix / 20 + b.fci) / 4 AS stress_score
    FROM b JOIN b b1 ON b1.p = b.p AND b1.m = b.m - 1 LEFT JOIN b b2 ON b2.p = b.p AND b2.m = b.m - 2 JOIN b b3 ON b3.p = b.p AND b3.m = b.m - 3 JOIN b b6 ON b6.p = b.p AND b6.m = b.m - 6)"""
FEATURE_NAMES = [
    "policy_rate", "policy_rate_lag", "inflation_gap", "unemployment_gap", "y2y", "slope", "oil_log_change", "r_neg_equity", "credit_spread", "hy_spread", "vix", "fci", "unemployment_gap_l1", "unemployment_gap_l6", "y2y_l1", "y2y_l3", "slope_l6",
    "credit_spread_l1", "fci_l1", "fci_l3", "inflation_gap_l1", "rate_change_l1", "stress_score",
]


@query("dom_policy_reaction_features", f"WITH {FEATURES_SQL} SELECT p, month, " + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in FEATURE_NAMES) + " FROM f")
def policy_reaction_features(spark, sf_dir):
    return reaction.features(macro(spark, sf_dir), "p").select("p", "month", *((six(c) + F.lit(0.0)).alias(c) for c in FEATURE_NAMES))


TERMS_SQL = """h AS (SELECT p, coalesce(quantile_cont(hy_spread, 0.75) FILTER (hy_spread > 0), 6) AS high FROM f GROUP BY p),
  t AS (SELECT f.p, f.month, policy_rate, unnest([{'term': 'const', 'c': -0.265457::DOUBLE}, {'term': 'policy_rate_lag', 'c': 0.854363 * policy_rate_lag}, {'term': 'inflation_gap', 'c': -0.003450 * inflation_gap}, {'term': 'unemployment_gap', 'c': 0.056217 * unemployment_gap},
    {'term': 'slope', 'c': -0.033699 * slope}, {'term': 'r_neg_equity', 'c': 0.384390 * r_neg_equity}, {'term': 'vix', 'c': 0.017163 * vix}, {'term': 'unemployment_gap_l1', 'c': -0.044029 * unemployment_gap_l1}, {'term': 'vix_sq', 'c': -0.000455 * vix * vix},
    {'term': 'unemployment_gap_l6', 'c': -0.013982 * unemployment_gap_l6}, {'term': 'y2y_l1', 'c': 0.150443 * y2y_l1}, {'term': 'credit_spread_l1', 'c': 0.064071 * credit_spread_l1}, {'term': 'slope_l6', 'c': 0.012575 * slope_l6},
    {'term': 'y2y_x_d_hy_q75', 'c': -0.068016 * y2y * (hy_spread >= high)::INT}, {'term': 'p_next_restrictive', 'c': -0.053076::DOUBLE * 0.1345}, {'term': 'p_next_expansionary', 'c': -0.089751::DOUBLE * 0.011}, {'term': 'env_bias', 'c': 0.036675::DOUBLE * 0.1236},
    {'term': 'infl_x_p_restrictive', 'c': 0.066622 * inflation_gap * 0.1345}, {'term': 'unemp_x_p_expansionary', 'c': -0.015312 * unemployment_gap * 0.011}], recursive := true) FROM f JOIN h USING (p))"""


@query("dom_policy_reaction_predict", f"WITH {FEATURES_SQL}, {TERMS_SQL} SELECT p, month, term, round(c, 6) + 0.0 AS contribution, round(sum(c) OVER w, 3) + 0.0 AS implied, round(sum(c) OVER w - policy_rate, 3) + 0.0 AS gap FROM t WINDOW w AS (PARTITION BY p, month)")
def policy_reaction_predict(spark, sf_dir):
    """The first model over all keys and months: each term's contribution beside their sum."""
    parts = reaction.contributions(reaction.with_terms(reaction.features(macro(spark, sf_dir), "p"), "p"), reaction.FED, "p")
    three = lambda c: (F.round(c, 3) + F.lit(0.0)).alias(c)
    return parts.join(reaction.predictions(parts, "p"), ["p", "month"]).select("p", "month", "term", (six("contribution") + F.lit(0.0)).alias("contribution"), three("implied"), three("gap"))


@query("dom_regime_label", S + "SELECT month, CASE WHEN total >= (SELECT list_sort(list(total))[floor(count(*) * 0.8)::INT + 1] FROM series) THEN 'stress' WHEN total <= (SELECT list_sort(list(total))[floor(count(*) * 0.2)::INT + 1] FROM series) THEN 'calm' ELSE 'normal' END AS regime FROM series")
def regime_label(spark, sf_dir):
    s = series(spark, sf_dir)
    place = lambda q: F.element_at(F.array_sort(F.collect_list("total")), (F.floor(F.count("*") * q) + 1).cast("int"))
    bounds = s.agg(place(0.8).alias("high"), place(0.2).alias("low"))
    return s.crossJoin(F.broadcast(bounds)).select("month", F.when(F.col("total") >= F.col("high"), "stress").when(F.col("total") <= F.col("low"), "calm").otherwise("normal").alias("regime"))  # one row


PIVOT = f"SELECT bank, round(avg(net_score) FILTER (item_date >= {AS_OF_SQL} - 15), 6) AS now, round(avg(net_score) FILTER (item_date >= {AS_OF_SQL} - 15) - avg(net_score) FILTER (item_date < {AS_OF_SQL} - 15), 6) AS drift, round(coalesce(stddev_samp(net_score) FILTER (item_date >= {AS_OF_SQL} - 15), 0), 6) AS dispersion, round(avg((k < 20)::INT), 6) AS softening, count(*) FILTER (item_date >= {AS_OF_SQL} - 15) AS n FROM items GROUP BY bank"


@query("dom_pivot_features", I + PIVOT)
def pivot_features(spark, sf_dir):
    new, s = F.col("item_date") >= F.date_sub(F.lit(AS_OF), 15), F.col("net_score")
    pick = lambda c: F.when(c, s)
    return items(spark, sf_dir).groupBy("bank").agg(six(F.avg(pick(new))).alias("now"), six(F.avg(pick(new)) - F.avg(pick(~new))).alias("drift"), six(F.coalesce(F.stddev_samp(pick(new)), F.lit(0.0))).alias("dispersion"), six(F.avg((F.col("k") < 20).cast("int"))).alias("softening"), F.count_if(new).alias("n"))


@query("dom_horizon_windows", I + f"SELECT bank, days, count(*) AS n, round(avg(net_score), 6) AS mean, count(*) FILTER (net_score > 0.1) AS hawkish FROM items JOIN (VALUES (7), (30), (90)) h(days) ON item_date >= {AS_OF_SQL} - days GROUP BY ALL")
def horizon_windows(spark, sf_dir):
    """All horizons in one pass as conditional sums."""
    horizons, s = (7, 30, 90), F.col("net_score")
    inside = lambda d: F.col("item_date") >= F.date_sub(F.lit(AS_OF), d)
    wide = items(spark, sf_dir).groupBy("bank").agg(F.array(*(F.struct(F.lit(d).alias("days"), F.count_if(inside(d)).alias("n"), six(F.avg(F.when(inside(d), s))).alias("mean"), F.count_if(inside(d) & (s > 0.1)).alias("hawkish")) for d in horizons)).alias("h"))
    return wide.select("bank", F.inline("h")).where("n > 0")


@query("dom_alert_eval", I + """, m AS (SELECT bank, unnest([{'metric': 'tone', 'v': avg(net_score)}, {'metric': 'n', 'v': count(*)::DOUBLE}], recursive := true) FROM items GROUP BY bank)
  SELECT r.id, bank FROM m JOIN (VALUES (1, 'tone', 'gt', -0.5, 120), (2, 'n', 'gte', 10.0, 30), (3, 'tone', 'lte', 0.9, NULL)) r(id, metric, op, t, ago) USING (metric) WHERE coalesce(ago, 999) >= 60 AND CASE op WHEN 'gt' THEN v > t WHEN 'gte' THEN v >= t ELSE v <= t END""")
def alert_eval(spark, sf_dir):
    """Active rules on current metrics; a rule that fired less than an hour ago rests."""
    m = items(spark, sf_dir).groupBy("bank").agg(F.avg("net_score").alias("tone"), F.count("*").cast("double").alias("n")).unpivot("bank", ["tone", "n"], "metric", "v")
    rules = spark.createDataFrame([(1, "tone", "gt", -0.5, 120), (2, "n", "gte", 10.0, 30), (3, "tone", "lte", 0.9, None)], "id int, metric string, op string, t double, minutes_ago int")
    return evaluate(m, rules.where("coalesce(minutes_ago, 999) >= 60")).select("id", "bank")


GOES_ON_HERE = r"(?<![\p{L}\p{N}_])(?:of|to|de)(?![\p{L}\p{N}_])"
_WORD = lambda words: f"'(?i)(^|[^\\p{{L}}\\p{{N}}_])({words})([^\\p{{L}}\\p{{N}}_]|$)'"
VERIFIED_SQL = f"""names(name) AS (VALUES ('and'), ('of'), ('the')),
  texts AS (SELECT doc_id, name, coalesce(text, '') AS t, list_filter(string_split(regexp_replace(trim(regexp_replace(replace(coalesce(text, ''), chr(173), ''), '\\s+', ' ', 'g')), '([.!?]) ([A-Z"“(])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda s: length(string_split(s, ' ')) >= 6) AS parts FROM documents, names),
  lines AS (SELECT doc_id, name, i, s, len(list_filter(regexp_extract_all(lower(s), '\\p{{L}}+'), lambda x: x = name)) > 0 AS named, regexp_matches(s, {_WORD("of|to|de").replace("(?i)", "")}) AS goes, regexp_matches(s, {_WORD("|".join(RELEVANT_HERE))}) AS policy
    FROM (SELECT doc_id, name, unnest(parts) AS s, generate_subscripts(parts, 1) AS i FROM texts)),
  kept AS (SELECT doc_id, name, policy, named OR (goes AND coalesce(lag(named) OVER w OR (lag(goes) OVER w AND lag(named, 2) OVER w), false)) AS kept FROM lines WINDOW w AS (PARTITION BY doc_id, name ORDER BY i)),
  counts AS (SELECT doc_id, name, count(*) FILTER (kept AND policy) AS on_policy FROM kept GROUP BY ALL),
  facts AS (SELECT doc_id, name, len(list_filter(regexp_split_to_array(t, '\\s+'), lambda x: x <> ''))::BIGINT AS words, len(list_filter(regexp_extract_all(lower(t), '\\p{{L}}+'), lambda x: x = name))::BIGINT AS namings, (contains(lower(t), 'attion')::INT + contains(lower(t), 'tion')::INT + contains(lower(t), 'anea')::INT) / 3.0::DOUBLE AS share, coalesce(on_policy, 0) AS on_policy FROM texts LEFT JOIN counts USING (doc_id, name)),
  verdicts AS (SELECT *, CASE WHEN words < 150 THEN 'too short' WHEN namings < 2 THEN 'speaker not named' WHEN share < 0.5 THEN 'headline words missing' WHEN on_policy < 2 THEN 'nothing on policy' ELSE 'verified' END AS reason FROM facts)"""
KEYWORDS = ("attion", "tion", "anea")


@query("dom_verify_article", f"WITH {VERIFIED_SQL} SELECT doc_id, words, namings, round(share, 6) AS share, on_policy, reason FROM verdicts WHERE name = 'and'")
def verify_article(spark, sf_dir):
    """All tests of an article, the documents being on somebody called And."""
    articles = table(spark, sf_dir, "documents").select("doc_id", "text", F.lit("And").alias("name"), F.array(*map(F.lit, KEYWORDS)).alias("keywords"))
    return remarks.verified(articles, RELEVANT_HERE, GOES_ON_HERE).select("doc_id", "words", "namings", six("share").alias("share"), "on_policy", "reason")


@query("dom_fomc_rotation", "SELECT n_name, y AS year FROM nation, (SELECT unnest(generate_series(2022, 2026)) AS y) WHERE n_nationkey < 2 OR n_nationkey % 4 = ((y - 2024) % 4 + 4) % 4")
def fomc_rotation(spark, sf_dir):
    """Permanent members and a quarter of the others each year; both tables are of fixed size."""
    n = table(spark, sf_dir, "nation").withColumn("year", F.explode(F.sequence(F.lit(2022), F.lit(2026))))
    return n.where((F.col("n_nationkey") < 2) | (F.col("n_nationkey") % 4 == F.pmod(F.col("year") - 2024, F.lit(4)))).select("n_name", "year")


@query("dom_classify_member", "SELECT c_custkey, CASE WHEN regexp_matches(c_mktsegment, '^(AUTO|MACH)') THEN 'board' WHEN regexp_matches(c_mktsegment, 'BUILD') THEN 'governor' ELSE regexp_extract(c_name, '^([A-Za-z]+)', 1) END AS class FROM customer")
def classify_member(spark, sf_dir):
    m = F.col("c_mktsegment")
    return table(spark, sf_dir, "customer").select("c_custkey", F.when(m.rlike("^(AUTO|MACH)"), "board").when(m.rlike("BUILD"), "governor").otherwise(F.regexp_extract("c_name", "^([A-Za-z]+)", 1)).alias("class"))


@query("dom_official_selection", with_sql(ITEMS_SQL, CALENDAR_SQL, PLACES_SQL) + f"""SELECT bank, item_date AS meeting, min_by(item_id, (NOT (bank = 'ECB' AND contains(url, 'monetary-policy-statement')), item_id)) AS item_id FROM items JOIN places ON i = item_id % {len(PLACES)} JOIN calendar c USING (bank)
  WHERE item_date = c.meeting AND c.meeting < {AS_OF_SQL} AND NOT is_statistical AND official = bank GROUP BY ALL""")
def official_selection(spark, sf_dir):
    """One statement a past meeting: the opening statement where there is one, else the first; addresses that differ by a closing slash are one."""
    meetings = calendar(spark).where(F.col("meeting") < F.lit(AS_OF)).select("bank", F.col("meeting").alias("item_date"))
    test = rules.is_statement(F.col("bank"), F.col("url"), F.col("title"), F.col("source"), F.col("is_statistical"))
    found = published(spark, sf_dir).join(F.broadcast(meetings), ["bank", "item_date"]).where(test)
    opening = (F.col("bank") == "ECB") & F.contains("url", F.lit(rules.OPENING))
    return found.groupBy("bank", F.col("item_date").alias("meeting")).agg(F.min(F.struct((~opening).alias("other"), "item_id"))["item_id"].alias("item_id"))


@query("dom_repair_zero_docs", I + "SELECT item_id, 0.25::DOUBLE AS rescored FROM items WHERE source = 'error' AND abs(net_score) <= 0.3 AND k % 2 = 0 ORDER BY item_date DESC, item_id LIMIT 8")
def repair_zero_docs(spark, sf_dir):
    bad = items(spark, sf_dir).where("source = 'error' AND abs(net_score) <= 0.3 AND k % 2 = 0")
    return bad.orderBy(F.desc("item_date"), "item_id").limit(8).select("item_id", F.lit(0.25).alias("rescored"))


@query("dom_repair_transcripts", I + "SELECT item_id, CASE WHEN regexp_matches(title, '3$') THEN 'suspect' WHEN k % 11 = 0 THEN 'missing' WHEN k < 5 THEN 'stale' END AS why FROM items WHERE regexp_matches(title, '3$') OR k % 11 = 0 OR k < 5")
def repair_transcripts(spark, sf_dir):
    why = F.when(F.col("title").rlike("3$"), "suspect").when(F.col("k") % 11 == 0, "missing").when(F.col("k") < 5, "stale")
    return items(spark, sf_dir).select("item_id", why.alias("why")).where("why IS NOT NULL")


@query("dom_rescore_paged", I + f"SELECT item_id, {R3.format('net_score * 0.9::DOUBLE')} AS net_score, net_score AS legacy FROM items")
def rescore_paged(spark, sf_dir):
    """The whole table at once; the old score stays beside the new one."""
    return items(spark, sf_dir).select("item_id", round_up(F.col("net_score") * 0.9).alias("net_score"), F.col("net_score").alias("legacy"))


@query("dom_source_check", I + "SELECT item_id, CASE WHEN source = 'click' THEN 'removed: remark' WHEN net_score = 1 THEN 'removed: saturated' ELSE 'kept' END AS verdict FROM items")
def source_check(spark, sf_dir):
    verdict = F.when(F.col("source") == "click", "removed: remark").when(F.col("net_score") == 1, "removed: saturated").otherwise("kept")
    return items(spark, sf_dir).select("item_id", verdict.alias("verdict"))


@query("dom_resolve_remarks", with_sql(ITEMS_SQL, VERIFIED_SQL) + """, asked AS (SELECT item_id AS id, item_date AS day, CASE k % 4 WHEN 0 THEN 'and' WHEN 1 THEN 'of' WHEN 2 THEN 'the' END AS name, CASE WHEN k % 5 = 0 THEN item_id % 1200 END AS own FROM items WHERE source = 'view'),
  seen AS (SELECT doc_id, ['and', 'of', 'the'][doc_id % 3 + 1] AS name, DATE '2024-01-01' + (doc_id % 40)::INT AS day, doc_id % 5 AS merit, 'https://d.org/' || doc_id AS address FROM documents),
  ranked AS (SELECT a.id, a.name, s.doc_id, row_number() OVER (PARTITION BY id ORDER BY merit DESC, address) AS rank FROM asked a JOIN seen s ON s.name = a.name AND s.day = a.day WHERE DATE '2024-04-10' - a.day <= 88 QUALIFY rank <= 3),
  tried AS (SELECT id, name, own AS doc_id, 0 AS rank FROM asked WHERE own IS NOT NULL AND name IS NOT NULL UNION ALL SELECT id, name, doc_id, rank FROM ranked),
  told AS (SELECT id, rank, t.doc_id, coalesce(reason, 'page could not be read') AS reason FROM tried t LEFT JOIN verdicts v ON v.doc_id = t.doc_id AND v.name = t.name),
  best AS (SELECT id, min(rank) FILTER (reason = 'verified') AS best, arg_min(doc_id, rank) FILTER (reason = 'verified') AS doc_id, arg_max(reason, rank) AS last, max(rank) AS most FROM told GROUP BY id)
  SELECT id, CASE WHEN best = 0 THEN 'own address' WHEN best > 0 THEN 'search' END AS via, 'https://d.org/' || b.doc_id AS url, CASE WHEN name IS NULL THEN 'no speaker' WHEN best IS NOT NULL THEN 'verified' WHEN last IS NOT NULL THEN CASE WHEN DATE '2024-04-10' - day <= 88 AND most = 0 THEN 'no articles found' ELSE last END
    WHEN DATE '2024-04-10' - day > 88 THEN 'too old to search' ELSE 'no articles found' END AS reason FROM asked LEFT JOIN best b USING (id)""")
def resolve_remarks(spark, sf_dir):
    """Remarks of half a month lie in the window; some have an address of their own, some of these are of no page."""
    k, names = F.col("k"), F.array(F.lit("and"), F.lit("of"), F.lit("the"))
    own = F.when(k % 5 == 0, F.concat(F.lit("https://d.org/"), (F.col("item_id") % 1200).cast("string")))
    asked = items(spark, sf_dir).where("source = 'view'").select(F.col("item_id").alias("id"), F.col("item_date").alias("day"), F.get(names, k % 4).alias("name"), F.array(*map(F.lit, KEYWORDS)).alias("keywords"), own.alias("url"))
    docs = table(spark, sf_dir, "documents").withColumn("address", F.concat(F.lit("https://d.org/"), F.col("doc_id").cast("string")))
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 40).cast("int"))
    found = docs.select(F.get(names, (F.col("doc_id") % 3).cast("int")).alias("name"), day.alias("seen"), (F.col("doc_id") % 5).alias("merit"), "address")
    return remarks.resolve(asked, docs.select("address", "text"), found, F.lit("2024-04-10").cast("date"), 0, RELEVANT_HERE, GOES_ON_HERE)


@query("llm_outputs", I + "SELECT i.item_id, o.verdict FROM items i LEFT JOIN (SELECT item_id, 'given' AS verdict FROM items WHERE k = 1) o ON o.item_id = i.item_id WHERE i.source = 'error'")
def llm_outputs(spark, sf_dir):
    """What a hosted model would add is a nullable input table, joined by key."""
    rows = items(spark, sf_dir)
    given = rows.where("k = 1").select("item_id", F.lit("given").alias("verdict"))
    return rows.where("source = 'error'").join(given, "item_id", "left").select("item_id", "verdict")


