"""Scalar functions over documents, pages and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import numerics as N
from tidemark.functions import objects
from tidemark.functions import text as T
from tidemark.functions.numerics import round_up, six
from tidemark.operators import scoring
from tidemark.plans.base import AS_OF, AS_OF_SQL, ITEMS_SQL, MEETINGS_SQL, items, meetings, query, with_sql
from tidemark.session import table

I = with_sql(ITEMS_SQL)  # noqa: E741


def _docs(name, sql, expr):
    """One column over all documents."""

    def run(spark, sf_dir):
        return table(spark, sf_dir, "documents").select("doc_id", expr().alias("v"))

    query(name, f"SELECT doc_id, {sql} AS v FROM documents" if sql else None)(run)


def _pages(name, sql, expr):
    def run(spark, sf_dir):
        return table(spark, sf_dir, "pages").select("page_id", expr().alias("v"))

    query(name, f"SELECT page_id, {sql} AS v FROM pages" if sql else None)(run)


def _items(name, sql, expr):
    def run(spark, sf_dir):
        return items(spark, sf_dir).select("item_id", expr().alias("v"))

    query(name, I + f"SELECT item_id, {sql} AS v FROM items")(run)


def _replaced(first: str, steps) -> str:
    for a, b in steps:
        a, b = a.replace("'", "''").replace(r"\x{2014}", "—"), b.replace("$2", r"\2").replace("'", "''")
        first = f"regexp_replace({first}, '{a}', '{b}', 'g')"
    return first


def _decoded(first: str) -> str:
    for a, b in T.ENTITIES:
        first = "replace({}, '{}', '{}')".format(first, a.replace("'", "''"), b.replace("'", "''"))
    return first


_title = "regexp_extract(html, '<title>([^<]*)</title>', 1)"
title = lambda: F.regexp_extract("html", "<title>([^<]*)</title>", 1)
_pages("str_html_decode", f"md5({_decoded('html')})", lambda: F.md5(T.html_decode(F.col("html"))))
#: Written from the rules themselves: regular expressions over the whole address.
URL_STEPS = [
    ("^https?://", ""), ("[?#].*$", ""), ("/+$", ""), ("^www\\.", ""), ("/+", "/"), ("/(en|de|fr|es|it|nl|pt)/", "/__lang__/"), ("/presse/reden/", "/press/speeches/"), ("/presse/interviews/", "/press/interviews/"),
    ("/presse/gastbeitraege/", "/press/contributions/"), ("/presse/", "/press/"), ("-[0-9]{4,}$", ""), ("\\.(en|de|fr|es|it|nl|pt)\\.(html?|pdf)$", ".$2"),
]
#: Pages under addresses that have every case.
VARIED_SQL = """CASE page_id % 6 WHEN 0 THEN url WHEN 1 THEN 'https://www.x.org//Presse/reden/' || page_id || '-' || (page_id * 7919 % 100000) || '/'
  WHEN 2 THEN 'http://x.org/press/speeches/' || page_id || '?lang=de' WHEN 3 THEN 'x.org/pub/nl/a' || page_id || '.' || ['en', 'de', 'pt', 'xx'][page_id % 4 + 1] || '.' || ['html', 'pdf', 'htm'][page_id % 3 + 1]
  WHEN 4 THEN 'https://x.org/presse/' || ['interviews', 'gastbeitraege', 'texte', 'pt'][page_id % 4 + 1] || '/b#' || page_id ELSE replace(url, '/en/', '/presse/') END"""


def varied():
    p = F.col("page_id")
    s, one = p.cast("string"), lambda n, *names: F.get(F.array(*map(F.lit, names)), (p % n).cast("int"))
    cases = F.when(p % 6 == 0, F.col("url")).when(p % 6 == 1, F.concat(F.lit("https://www.x.org//Presse/reden/"), s, F.lit("-"), (p * 7919 % 100000).cast("string"), F.lit("/")))
    cases = cases.when(p % 6 == 2, F.concat(F.lit("http://x.org/press/speeches/"), s, F.lit("?lang=de"))).when(p % 6 == 3, F.concat(F.lit("x.org/pub/nl/a"), s, F.lit("."), one(4, "en", "de", "pt", "xx"), F.lit("."), one(3, "html", "pdf", "htm")))
    return cases.when(p % 6 == 4, F.concat(F.lit("https://x.org/presse/"), one(4, "interviews", "gastbeitraege", "texte", "pt"), F.lit("/b#"), s)).otherwise(F.replace("url", F.lit("/en/"), F.lit("/presse/")))


_pages("str_canonical_url", _replaced(f"lower(trim({VARIED_SQL}))", URL_STEPS), lambda: T.canonical_url(varied()))
_pages("str_canonical_url_sql", _replaced("lower(url)", [(r"^[a-z]+://(www\.)?", ""), ("/+$", "")]), lambda: T.canonical_url_short(F.col("url")))
#: Titles with every case.
TITLES_SQL = "{} || CASE page_id % 5 WHEN 0 THEN ' (with Q&amp;A)' WHEN 1 THEN ' | Site | ' || page_id WHEN 2 THEN ' 06/11/2026 Caf&#39;\u00e9' WHEN 3 THEN '\u2014 06/11/2026' ELSE ' 1.2.2024, &lt;b&gt;_x-y' END"


def titles():
    p = F.col("page_id")
    return F.concat(title(), F.when(p % 5 == 0, " (with Q&amp;A)").when(p % 5 == 1, F.concat(F.lit(" | Site | "), p.cast("string"))).when(p % 5 == 2, " 06/11/2026 Caf&#39;\u00e9").when(p % 5 == 3, "\u2014 06/11/2026").otherwise(" 1.2.2024, &lt;b&gt;_x-y"))


TITLE_STEPS = [("\\(with q&a\\)", ""), ("\\s+\\|\\s+.*$", ""), ("\u2014.*$", ""), ("[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}", ""), ("[^A-Za-z0-9_]", " "), (" +", " ")]
_pages("str_normalized_title", f"trim({_replaced(f'lower({_decoded(TITLES_SQL.format(_title))})', TITLE_STEPS)})", lambda: T.normal_title(titles()))
_pages("str_page_title", _title, title)
_pages("str_meta_author", "coalesce(nullif(regexp_extract(html, '<meta name=\"author\" content=\"([^\"]*)\"', 1), ''), 'unknown')", lambda: F.coalesce(F.nullif(F.regexp_extract("html", '<meta name="author" content="([^"]*)"', 1), F.lit("")), F.lit("unknown")))
_VISIBLE = [(r"<script[^>]*>[^<]*</script>", " "), (r"<style[^>]*>[^<]*</style>", " "), (r"<[^>]*>", " "), (r"\s+", " ")]
_pages("str_page_text", f"md5(trim({_replaced('html', _VISIBLE)}))", lambda: F.md5(F.trim(T.chain(F.col("html"), _VISIBLE))))
_pages("str_dedup_key", f"concat_ws('|', 'P', coalesce('U:' || nullif({_replaced('lower(trim(url))', URL_STEPS)}, ''), 'T:' || {_title}))", lambda: F.concat_ws("|", F.lit("P"), F.coalesce(F.concat(F.lit("U:"), F.nullif(T.canonical_url(F.col("url")), F.lit(""))), F.concat(F.lit("T:"), title()))))
_pages("str_speech_title", f"CASE WHEN starts_with({_title}, regexp_extract(url, '://([^./]+)', 1)) THEN {_title} ELSE regexp_extract(url, '://([^./]+)', 1) || ': ' || {_title} END", lambda: F.when(title().startswith(F.regexp_extract("url", "://([^./]+)", 1)), title()).otherwise(F.concat(F.regexp_extract("url", "://([^./]+)", 1), F.lit(": "), title())))
_pages("str_bis_title", f"regexp_extract(url, '://([^./]+)', 1) || ': ' || {_title}", lambda: F.concat(F.regexp_extract("url", "://([^./]+)", 1), F.lit(": "), title()))
_pages("date_from_link", "try_cast(nullif(regexp_extract(url || '/2024-01-' || lpad((page_id % 40)::VARCHAR, 2, '0'), '([0-9]{4}-[0-9]{2}-[0-9]{2})', 1), '') AS DATE)", lambda: F.expr("try_cast(nullif(regexp_extract(url || '/2024-01-' || lpad(string(page_id % 40), 2, '0'), '([0-9]{4}-[0-9]{2}-[0-9]{2})', 1), '') AS DATE)"))

_docs("str_word_count", r"length(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'))", lambda: T.word_count(F.col("text")))
_docs("str_sha256_prefix", "sha256(text)[:16]", lambda: T.fingerprint(F.col("text")))
_docs("str_split_sentences", """length(list_filter(string_split(regexp_replace(trim(regexp_replace(replace(text, chr(173), ''), '\\s+', ' ', 'g')), '([.!?]) ([A-Z"“(])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda s: length(string_split(s, ' ')) >= 6))""", lambda: F.size(T.sentences(F.col("text"))))
_docs("str_split_guidance", """length(list_filter(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: length(s) > 15))""", lambda: F.size(T.guidance_sentences(F.col("text"))))
_docs("str_sample_bme", "CASE WHEN length(text) <= 900 THEN text ELSE concat_ws(' ... ', substr(text, 1, 300), substr(text, (length(text) // 2 - 150 + 1)::INT, 300), right(text, 300)) END", lambda: T.sample_ends(F.col("text"), 900))
_docs("str_quote_context", "CASE WHEN strpos(text, ' the ') > 0 THEN substr(text, greatest(strpos(text, ' the ') - 350, 1)::INT, 700) END", lambda: F.when(F.instr("text", " the ") > 0, F.substring("text", F.greatest(F.instr("text", " the ") - 350, F.lit(1)), F.lit(700))))
_docs("str_surname_hits", "length(regexp_extract_all(text, '[^a-zA-Z\\x{80}-\\x{10FFFF}]the[^a-zA-Z\\x{80}-\\x{10FFFF}]'))", lambda: F.regexp_count("text", F.lit("[^a-zA-Z\\x{80}-\\x{10FFFF}]the[^a-zA-Z\\x{80}-\\x{10FFFF}]")))
_WORDS = "regexp_extract_all(lower(text), '[a-zäöüß]+')"
words = lambda: F.regexp_extract_all(F.lower("text"), F.lit("[a-zäöüß]+"), F.lit(0))
_among = lambda some: F.size(F.filter(words(), lambda x: x.isin(some)))
DE, EN = ["der", "die", "und", "das", "nicht", "mit", "den", "von"], ["the", "and", "of", "to", "that", "with", "for", "is"]
_docs("str_is_german", f"length(list_filter({_WORDS}, lambda x: list_contains({DE}, x))) > length(list_filter({_WORDS}, lambda x: list_contains({EN}, x)))", lambda: _among(DE) > _among(EN))
_docs("str_is_readable_prose", f"length({_WORDS}) >= 20 AND length(list_filter({_WORDS}, lambda x: list_contains({DE + EN}, x))) >= 0.05 * length({_WORDS})", lambda: (F.size(words()) >= 20) & (_among(DE + EN) >= 0.05 * F.size(words())))
_docs("str_headline_keywords", f"list_distinct(list_filter(regexp_extract_all(lower(split_part(text, chr(10), 1)), '[a-z]+'), lambda x: length(x) >= 4 AND NOT list_contains({EN}, x)))", lambda: F.array_distinct(F.filter(F.regexp_extract_all(F.lower(F.split_part("text", F.lit("\n"), F.lit(1))), F.lit("[a-z]+"), F.lit(0)), lambda x: (F.length(x) >= 4) & ~x.isin(EN))))


def _sorted(name):
    from tidemark.plans.base import ORACLES, QUERIES

    run, sql = QUERIES[name], ORACLES[name]
    QUERIES[name] = lambda spark, sf_dir: run(spark, sf_dir).select("doc_id", F.array_join(F.array_sort("v"), " ").alias("v"))
    ORACLES[name] = f"SELECT doc_id, array_to_string(list_sort(v), ' ') AS v FROM ({sql})"


_sorted("str_headline_keywords")
_docs("str_surname_from_headline", "regexp_extract(substr(split_part(text, chr(10), 1), 2), '[^A-Za-z]([A-Z][a-z]+)', 1)", lambda: F.regexp_extract(F.substring(F.split_part("text", F.lit("\n"), F.lit(1)), 2, 1_000_000), "[^A-Za-z]([A-Z][a-z]+)", 1))
_docs("str_extract_speaker", "CASE WHEN doc_id % 3 = 0 THEN upper(lang[1]) || lang[2:] || ' Speaker' WHEN doc_id % 3 = 1 THEN 'Jane Roe' END", lambda: T.speaker(F.when(F.col("doc_id") % 3 == 0, F.concat(F.initcap("lang"), F.lit(" Speaker, chair & others: on "), "source")).when(F.col("doc_id") % 3 == 1, "Remarks on rates by Jane Roe").otherwise(F.concat("source", F.lit(": rates")))))
_docs("str_speaker_of_cap", "lower(split_part(source || ', ' || lang, ',', 1))", lambda: F.lower(F.split_part(F.concat_ws(", ", "source", "lang"), F.lit(","), F.lit(1))))
_docs("str_comm_group_key", "CASE WHEN lang = 'en' THEN 'D|' || source ELSE 'T|' || sha256(text)[:8] END", lambda: F.when(F.col("lang") == "en", F.concat(F.lit("D|"), "source")).otherwise(F.concat(F.lit("T|"), T.fingerprint(F.col("text"), 8))))

_items("date_month_key", "strftime(item_date, '%Y-%m')", lambda: F.date_format("item_date", "yyyy-MM"))
_items("date_month_end_asof", "(date_trunc('month', item_date) + INTERVAL 1 MONTH)::DATE", lambda: F.add_months(F.trunc("item_date", "MM"), 1))
_items("date_age_days", f"greatest({AS_OF_SQL} - item_date, 0)", lambda: F.greatest(F.datediff(F.lit(AS_OF), "item_date"), F.lit(0)))
_items("date_rotation_year", "((k - 60) % 4 + 4) % 4", lambda: F.pmod(F.col("k") - 60, F.lit(4)))
_items("date_parse_any", "CASE k % 3 WHEN 0 THEN item_date WHEN 1 THEN item_date END", lambda: F.coalesce(F.try_to_date(F.when(F.col("k") % 3 == 0, F.date_format("item_date", "yyyy-MM-dd")).when(F.col("k") % 3 == 1, F.date_format("item_date", "d MMM yyyy")).otherwise("soon"), "yyyy-MM-dd"), F.try_to_date(F.when(F.col("k") % 3 == 1, F.date_format("item_date", "d MMM yyyy")), "d MMM yyyy")))
_LONG = "'On ' || strftime(item_date, '%-d %B %Y') || ' and, later, ' || strftime(item_date + 3, '%-d %B %Y')"
long_date = lambda: F.concat(F.lit("On "), F.date_format("item_date", "d MMMM yyyy"), F.lit(" and, later, "), F.date_format(F.date_add("item_date", 3), "d MMMM yyyy"))
_DAY = r"([0-9]{1,2} [A-Z][a-z]+ [0-9]{4})"
_items("date_page", f"strptime(regexp_extract({_LONG}, '{_DAY}', 1), '%d %B %Y')::DATE", lambda: F.try_to_date(F.regexp_extract(long_date(), _DAY, 1), "d MMMM yyyy"))
_items("date_delivered_last", f"strptime(regexp_extract_all({_LONG}, '{_DAY}')[-1], '%d %B %Y')::DATE", lambda: F.try_to_date(F.element_at(F.regexp_extract_all(long_date(), F.lit(_DAY), F.lit(1)), -1), "d MMMM yyyy"))


@query("date_month_spine", "SELECT unnest(generate_series(min(date_trunc('month', o_orderdate)), max(date_trunc('month', o_orderdate)), INTERVAL 1 MONTH))::DATE AS month FROM orders")
def date_month_spine(spark, sf_dir):
    ends = table(spark, sf_dir, "orders").agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
    return ends.select(F.explode(F.sequence(F.trunc("a", "MM"), F.trunc("b", "MM"), F.expr("interval 1 month"))).alias("month"))


@query("date_days_to_meeting", with_sql(MEETINGS_SQL) + f"SELECT bank, coalesce(min(meeting - {AS_OF_SQL}) FILTER (meeting >= {AS_OF_SQL}), 999) AS days FROM calendar GROUP BY bank")
def date_days_to_meeting(spark, sf_dir):
    gap = F.datediff("meeting", F.lit(AS_OF))
    return meetings(spark, sf_dir).groupBy("bank").agg(F.coalesce(F.min(F.when(gap >= 0, gap)), F.lit(999)).alias("days"))


D = "::DOUBLE"
_items("math_round3", "floor(net_score * 1000.0::DOUBLE + 0.5) / 1000.0::DOUBLE", lambda: round_up("net_score"))
_items("math_clamp", "greatest(-0.2::DOUBLE, least(0.3::DOUBLE, net_score))", lambda: N.clamp("net_score", -0.2, 0.3))
_items("math_decay", f"round(greatest(0.01::DOUBLE, pow(0.5::DOUBLE, ({AS_OF_SQL} - item_date) / 3.0::DOUBLE)), 6)", lambda: six(N.decay(F.datediff(F.lit(AS_OF), "item_date"), F.lit(3.0))))
_items("math_tanh_squash", "round(CASE WHEN k % 2 = 0 THEN -1 ELSE 1 END * tanh(net_score / 2), 6) + 0.0", lambda: six(F.when(F.col("k") % 2 == 0, -1).otherwise(1) * F.tanh(F.col("net_score") / 2)))
_items("math_band_score", "round(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, CASE WHEN abs((value - 50) / 40.0::DOUBLE) > 1 THEN sign(value - 50) * (1 - 0.05::DOUBLE / abs((value - 50) / 40.0::DOUBLE)) ELSE (value - 50) / 40.0::DOUBLE END)), 6) + 0.0", lambda: six(N.band_score(F.col("value"), F.lit(30.0), F.lit(70.0))))
_items("math_market_weight", "CASE WHEN k >= 30 THEN 0.25::DOUBLE WHEN k <= 3 THEN 0.75::DOUBLE ELSE floor((0.75::DOUBLE - (k - 3) / 27.0::DOUBLE * 0.5::DOUBLE) * 100.0::DOUBLE + 0.5) / 100.0::DOUBLE END", lambda: N.market_weight("k"))
_items("math_renormalise3", "floor((k % 7) / nullif((k % 7 + k % 5 + k % 3)::DOUBLE, 0) * 100.0::DOUBLE + 0.5) / 100.0::DOUBLE", lambda: round_up(F.col("k") % 7 / F.nullif((F.col("k") % 7 + F.col("k") % 5 + F.col("k") % 3).cast("double"), F.lit(0.0)), 2))
_items("math_log_return_neg", "round(greatest(-(ln(value) - ln(k + 1.0::DOUBLE)), 0), 6)", lambda: six(F.greatest(-(N.log_or_minus("value") - F.ln(F.col("k") + 1.0)), F.lit(0.0))))
_items("math_sigma_guard", "coalesce(nullif(stat_weight, 0), 0.1)::DOUBLE", lambda: F.coalesce(F.nullif(F.col("stat_weight"), F.lit(0)).cast("double"), F.lit(0.1)))
_items("math_extract_percent", "CASE WHEN k % 3 = 0 THEN -1 WHEN k % 3 = 1 THEN 1 ELSE 1 END * (k / 10.0)::DOUBLE + 0.0", lambda: T.percent(F.concat(F.when(F.col("k") % 3 == 0, "Prices fell by ").when(F.col("k") % 3 == 1, "Prices fell to ").otherwise("Prices rose "), F.format_string("%.1f", F.col("k") / 10.0), F.lit("% in June"))))
#: Moves in every form, and what each is worth.
MOVES = [
    ("raise by {k} basis points", "k"), ("by 1/2 percentage point", "50"), ("lower by 1.{d} percentage points", "100 + k % 10 * 10"), ("raise the rate", "25"), ("by 12.5 basis points, not 25 basis points", "12.5"), ("by 1 percentage point", "100"),
    ("a half percentage point", "50"), ("three quarters of a percentage point", "75"), ("by one-quarter percentage point", "25"), ("BY ONE HALF OF A PERCENTAGE POINT", "50"), ("by 0 basis points", "25"), ("3/4 percentage point or 2 percentage points", "75"), ("about {k}basis  points", "k"),
]


def moves():
    filled = [F.replace(F.replace(F.lit(s), F.lit("{k}"), F.greatest(F.col("k"), F.lit(1)).cast("string")), F.lit("{d}"), (F.col("k") % 10).cast("string")) for s, _ in MOVES]
    return F.get(F.array(*filled), (F.col("item_id") % len(MOVES)).cast("int"))


_items("math_bp_of", "CASE item_id % " + str(len(MOVES)) + "".join(f" WHEN {i} THEN {'greatest(k, 1)' if v == 'k' else v}" for i, (_, v) in enumerate(MOVES)) + " END::DOUBLE", lambda: T.basis_points(moves()))

#: Sentences on policy and on other things; which are relevant.
ABOUT = ("Risks remain.", "The sunflower grows.", "Monetary POLICY", "Reprices", "a rate", "rated", "Balance sheets", "the balance sheet", "tightening", "retighten", "labor of love", "labour", "belabored", "unemployment", "deposit facilities", "economy\u00e9", "demand_", "wage-price")
RELEVANT_AT = (0, 2, 4, 7, 8, 10, 11, 13, 17)
_items("str_relevant", f"item_id % {len(ABOUT)} IN {RELEVANT_AT}", lambda: scoring.mentions(F.get(F.array(*map(F.lit, ABOUT)), (F.col("item_id") % len(ABOUT)).cast("int"))))

tags = lambda: F.when(F.col("k") % 7 == 0, F.array().cast("array<string>")).otherwise(F.array(F.col("source"), F.when(F.col("k") > 50, "view").otherwise("old:x")))
_TAGS = "CASE WHEN k % 7 = 0 THEN []::VARCHAR[] ELSE [source, CASE WHEN k > 50 THEN 'view' ELSE 'old:x' END] END"
_j = lambda c: F.array_join(c, ",")
_items("arr_contains_tag", f"array_to_string(list_filter({_TAGS}, lambda t: list_contains(['click', 'view'], t)), ',')", lambda: _j(F.filter(tags(), lambda t: t.isin("click", "view"))))
_items("arr_default_tags", f"array_to_string(CASE WHEN length({_TAGS}) = 0 THEN CASE bank WHEN 'FED' THEN ['rates'] ELSE ['euro', 'rates'] END ELSE {_TAGS} END, ',')", lambda: _j(F.when(F.size(tags()) == 0, F.when(F.col("bank") == "FED", F.array(F.lit("rates"))).otherwise(F.array(F.lit("euro"), F.lit("rates")))).otherwise(tags())))
_items("arr_append_replace", f"array_to_string(list_append(list_filter({_TAGS}, lambda t: NOT starts_with(t, 'old:')), 'new:' || k), ',')", lambda: _j(F.concat(F.filter(tags(), lambda t: ~t.startswith("old:")), F.array(F.concat(F.lit("new:"), F.col("k").cast("string"))))))
_items("arr_join_lower", f"lower(array_to_string(list_concat([title], {_TAGS}), ' '))", lambda: F.lower(F.array_join(F.concat(F.array("title"), tags()), " ")))


@query("arr_sign_changes", I + "SELECT user_id, count(*) FILTER (sign(net_score) <> sign(p)) AS changes FROM (SELECT *, lag(net_score) OVER (PARTITION BY user_id ORDER BY item_id) AS p FROM items) GROUP BY user_id")
def arr_sign_changes(spark, sf_dir):
    from pyspark.sql import Window

    rows = items(spark, sf_dir).withColumn("p", F.lag("net_score").over(Window.partitionBy("user_id").orderBy("item_id")))
    return rows.groupBy("user_id").agg(F.count_if(F.signum("net_score") != F.signum("p")).alias("changes"))


_JSON = """'{"a": {"b": {"c": ' || k / 4.0::DOUBLE || '}}, "drop": 1}'"""


@query("json_path_cast", f"SELECT item_id, json_extract_string(j, '$.a.b.c')::DOUBLE AS v FROM ({I} SELECT item_id, {_JSON} AS j FROM items)")
def json_path_cast(spark, sf_dir):
    j = F.concat(F.lit('{"a": {"b": {"c": '), (F.col("k") / 4.0).cast("string"), F.lit('}}, "drop": 1}'))
    return items(spark, sf_dir).select("item_id", F.variant_get(F.parse_json(j), "$.a.b.c", "double").alias("v"))


@query("json_merge", I + """SELECT item_id, '{"extra":{"deep":[1,' || k || ']},' || CASE WHEN k % 3 = 0 THEN '' ELSE '"kept":' || k || ',' END || '"label":"' || source || '","legacy":{"k":' || k || ',"old":true}}' AS v FROM items""")
def json_merge(spark, sf_dir):
    """A record whose keys nobody knows, merged with another one: a key moves below ``legacy``, a null takes one out, the rest stays."""
    k = F.col("k").cast("string")
    old = F.concat(F.lit('{"extra":{"deep":[1,'), k, F.lit(']},"k":'), k, F.lit(',"kept":'), k, F.lit(',"legacy":{"old":true}}'))
    new = F.concat(F.lit('{"label":"'), F.col("source"), F.lit('"'), F.when(F.col("k") % 3 == 0, ',"kept":null').otherwise(""), F.lit("}"))
    return items(spark, sf_dir).select("item_id", objects.move(objects.merge(old, new), ("k",), "legacy").alias("v"))


@query("json_all_dims_valid", I + "SELECT item_id, k % 5 <> 0 AND source IN ('click', 'view', 'error') AS v FROM items")
def json_all_dims_valid(spark, sf_dir):
    dims = F.create_map(F.lit("source"), F.col("source"), F.lit("side"), F.when(F.col("k") % 5 != 0, "a"))
    domain = {"source": ["click", "view", "error"], "side": ["a"]}
    fine = F.lit(True)
    for d, some in domain.items():
        fine = fine & F.coalesce(dims[d].isin(some), F.lit(False))
    return items(spark, sf_dir).select("item_id", fine.alias("v"))


@query("map_counter_merge", I + "SELECT source, count(*) FILTER (bank = 'FED') + count(*) FILTER (bank = 'ECB') AS n FROM items GROUP BY source")
def map_counter_merge(spark, sf_dir):
    counts = items(spark, sf_dir).groupBy("bank", "source").agg(F.count("*").alias("n")).groupBy("bank").agg(F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("m"))
    one, two = counts.where("bank = 'FED'").select(F.col("m").alias("a")), counts.where("bank = 'ECB'").select(F.col("m").alias("b"))
    merged = one.join(F.broadcast(two), F.lit(True)).select(F.map_zip_with("a", "b", lambda _, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0))).alias("m"))  # one row each
    return merged.select(F.explode("m").alias("source", "n"))
