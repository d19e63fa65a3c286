"""Feeds, JSON and page tables from text columns, as DataFrame expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import html_decode


def _blocks(text: Column, tag: str) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"(?s)<{tag}\b[^>]*>(.*?)</{tag}>"), F.lit(1))


def _field(block: Column, tag: str) -> Column:
    raw = F.regexp_extract(block, rf"(?s)<{tag}\b[^>]*>(.*?)</{tag}>", 1)
    return F.nullif(html_decode(F.trim(F.regexp_replace(raw, r"^\s*<!\[CDATA\[|\]\]>\s*$", ""))), F.lit(""))


def rss(feeds: DataFrame, text: str = "text") -> DataFrame:
    """RSS 2.0: one row per <item> with title, link (or guid), date and category."""
    rows = feeds.select(*[c for c in feeds.columns if c != text], F.posexplode(_blocks(F.col(text), "item")).alias("pos", "b"))
    b = F.col("b")
    return rows.select("*", _field(b, "title").alias("title"), F.coalesce(_field(b, "link"), _field(b, "guid")).alias("link"), _field(b, "pubDate").alias("published"), _field(b, "category").alias("category")).drop("b")


def atom(feeds: DataFrame, text: str = "text") -> DataFrame:
    """Atom: one row per <entry> with title, the link's href and the update."""
    rows = feeds.select(*[c for c in feeds.columns if c != text], F.posexplode(_blocks(F.col(text), "entry")).alias("pos", "b"))
    b = F.col("b")
    link = F.nullif(F.regexp_extract(b, r"<link\b[^>]*?href=[\"']([^\"']+)[\"']", 1), F.lit(""))
    return rows.select("*", _field(b, "title").alias("title"), link.alias("link"), _field(b, "updated").alias("published")).drop("b")


def mixed(feeds: DataFrame, text: str = "text") -> DataFrame:
    """Items of either kind."""
    return rss(feeds, text).unionByName(atom(feeds, text), allowMissingColumns=True)


def speeches(feeds: DataFrame, text: str = "text") -> DataFrame:
    """Namespaced feed of speeches: creator without an honorific, date and link."""
    rows = feeds.select(*[c for c in feeds.columns if c != text], F.posexplode(_blocks(F.col(text), "item")).alias("pos", "b"))
    b = F.col("b")
    who = F.regexp_replace(_field(b, "dc:creator"), r"^(Mr|Ms|Mrs|Dr|Prof)\.? ", "")
    return rows.select("*", _field(b, "title").alias("title"), who.alias("speaker"), F.try_to_date(F.left(_field(b, "dc:date"), F.lit(10)), "yyyy-MM-dd").alias("date"), F.coalesce(_field(b, "cb:link"), _field(b, "link")).alias("link")).drop("b")


#: Fixed value: what a link's address is taken from, in either kind of quotes.
HREF = r"href=[\"']([^\"'#]+)"


def links(pages: DataFrame, url: str, html: str, pattern: str, skip: str | None = r"[?&]page=", key: tuple[str, ...] = (), href: str = HREF) -> DataFrame:
    """(page url, pos, link, rooted): distinct links of a page that match, made absolute, in page order; ``rooted``: given as a path of the page's
    host. ``key``: columns that make a page, where several have one address; they come first."""
    found = pages.select(*key, F.col(url).alias("page"), F.posexplode(F.regexp_extract_all(F.col(html), F.lit(href), F.lit(1))).alias("pos", "href"))
    root = F.regexp_extract("page", r"^([a-z]+://[^/?#]+)", 1)
    folder = F.regexp_replace(F.regexp_replace("page", r"[?#].*$", ""), r"/[^/]*$", "/")
    full = F.when(F.col("href").rlike(r"^[a-z]+://"), F.col("href")).when(F.col("href").startswith("/"), F.concat(root, "href")).otherwise(F.concat(folder, "href"))
    kept = found.withColumn("link", full).where(F.col("link").rlike(pattern))
    if skip is not None:
        kept = kept.where(~F.col("link").rlike(skip))
    return kept.groupBy(*key, "page", "link").agg(F.min("pos").alias("pos"), F.max(F.col("href").startswith("/")).alias("rooted"))


def feed_links(pages: DataFrame, html: str) -> DataFrame:
    """Feeds a page announces."""
    tags = F.regexp_extract_all(F.col(html), F.lit(r"(<link\b[^>]*>)"), F.lit(1))
    fits = F.filter(tags, lambda t: t.rlike("rel=[\"']?alternate") & t.rlike(r"application/(rss|atom)\+xml"))
    return pages.withColumn("feed", F.explode(F.transform(fits, lambda t: F.regexp_extract(t, "href=[\"']([^\"']+)", 1)))).drop(html)


def observations(rows: DataFrame, json: str, limit: int = 15, ties: tuple[str, ...] = ()) -> DataFrame:
    """The newest ``limit`` JSON observations, missing ones (coded ".") left out; ``ties``: columns
    that order observations of one day."""
    kind = "struct<observations:array<struct<date:string,value:string>>>"
    found = rows.select(*[c for c in rows.columns if c != json], F.inline(F.from_json(json, kind)["observations"]))
    fine = found.where("value <> '.'").select("*", F.to_date("date").alias("day"), F.col("value").try_cast("double").alias("number"))
    return fine.orderBy(F.desc("day"), *ties).limit(limit).drop("date", "value")


def json_stat(rows: DataFrame, json: str) -> DataFrame:
    """JSON-stat: categories by position joined with values by position."""
    kind = "struct<index:map<string,int>,value:map<string,double>>"
    parsed = rows.select(*[c for c in rows.columns if c != json], F.from_json(json, kind).alias("j"))
    index = parsed.select(*[c for c in parsed.columns if c != "j"], "j.value", F.explode("j.index").alias("category", "at"))
    return index.select("*", F.try_element_at("value", F.col("at").cast("string")).alias("number")).drop("value", "at").where("number IS NOT NULL")


def chart(rows: DataFrame, json: str) -> DataFrame:
    """Parallel arrays of seconds and closing prices."""
    kind = "struct<timestamp:array<long>,close:array<double>>"
    zipped = rows.select(*[c for c in rows.columns if c != json], F.from_json(json, kind).alias("j")).select("*", F.inline(F.arrays_zip("j.timestamp", "j.close"))).drop("j")
    return zipped.where("close IS NOT NULL").select("*", F.to_date(F.timestamp_seconds("timestamp")).alias("day")).drop("timestamp")


def search_results(rows: DataFrame, json: str) -> DataFrame:
    kind = "struct<articles:array<struct<url:string,title:string,seendate:string,domain:string>>>"
    return rows.select(*[c for c in rows.columns if c != json], F.inline(F.from_json(json, kind)["articles"])).withColumn("day", F.try_to_date(F.left("seendate", F.lit(8)), "yyyyMMdd")).drop("seendate")


def first_release(vintages: DataFrame, sentinel: str = "1776-07-04", ties: tuple[str, ...] = ("value",)) -> DataFrame:
    """Of each observation (period, released, value) the first release; a sentinel date stands for
    the period itself. ``ties``: columns that order the releases of one day."""
    day = F.when(F.col("released") == sentinel, F.col("period")).otherwise(F.col("released"))
    first = F.min(F.struct(day.alias("released"), *(F.col(t).alias(f"tie{i}") for i, t in enumerate(ties)), F.col("value"))).alias("first")
    return vintages.groupBy("period").agg(first).select("period", "first.released", "first.value")


def csv_series(spark, path: str) -> DataFrame:
    """date,value files: rows whose value is no number go."""
    raw = spark.read.schema("date string, value string").csv(path, header=True)
    return raw.select(F.to_date("date").alias("date"), F.col("value").try_cast("double").alias("value")).where("value IS NOT NULL")


def csv_columns(spark, path: str, date_at: int, value_at: int) -> DataFrame:
    """A statistical file by the positions of its columns."""
    raw = spark.read.csv(path, header=True)
    names = raw.columns
    return raw.select(F.col(f"`{names[date_at]}`").alias("period"), F.col(f"`{names[value_at]}`").try_cast("double").alias("value")).where("value IS NOT NULL")
