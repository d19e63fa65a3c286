"""Which of several rows on the same thing counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import canonical_url, normal_title


def item_key(url: Column, title: Column) -> Column:
    """What makes items of a bank and day the same: the canonical address, or the title where there is none.
    The source doesn't matter, as feeds label the same thing differently."""
    address = F.nullif(canonical_url(url), F.lit(""))
    return F.coalesce(F.concat(F.lit("U:"), address), F.concat(F.lit("T:"), normal_title(title)))


def preference() -> list[Column]:
    """English first, then questions and answers, then what isn't of a wrapper source, then the longer text."""
    url, title, source = (F.coalesce(F.col(c), F.lit("")) for c in ("url", "title", "source"))
    english = url.rlike("/en/") | url.rlike(r"(?i)\.en\.(?:html?|pdf)")
    return [english.desc(), title.rlike("(?i)q&amp;a|q ?& ?a").desc(), source.rlike(r"(?i)press\s+conf").asc(), F.coalesce(F.col("word_count"), F.lit(0)).desc()]


def dedup_items(items: DataFrame, order: str) -> DataFrame:
    """One item (bank, item_date, url, title, source, word_count, ..) of each key; of equal ones the first by ``order``."""
    by = Window.partitionBy("bank", "item_date", item_key(F.col("url"), F.col("title"))).orderBy(*preference(), order)
    return items.withColumn("__place", F.row_number().over(by)).where("__place = 1").drop("__place")


def dedup_prints(prints: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """Releases (item_date, stat_weight, net_score, ..) of an observation, in the order of arrival: the same value again on
    another day counts nothing, and a value that differs from one before counts half. ``by``: what makes an
    observation, as the bank, metric and month."""
    first = F.first("item_date").over(Window.partitionBy(*by, value).orderBy(order))
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    other = F.coalesce((F.min(value).over(before) != F.col(value)) | (F.max(value).over(before) != F.col(value)), F.lit(False))
    again = F.col("item_date") != first
    half = F.greatest(F.lit(0.5), F.coalesce(F.nullif("stat_weight", F.lit(0)), F.lit(1)) * 0.5)
    weight = F.when(again, 0.0).when(other, half).otherwise(F.col("stat_weight").cast("double"))
    return prints.withColumns({"__score": F.when(again, 0.0).otherwise(F.col("net_score")), "__weight": weight}).drop("net_score", "stat_weight").withColumnsRenamed({"__score": "net_score", "__weight": "stat_weight"})


def revisions(prints: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """Releases that change the one before of the same observation, and by how much (``revision``)."""
    before = F.lag(value).over(Window.partitionBy(*by).orderBy(order))
    return prints.withColumn("revision", F.col(value) - before).where("revision <> 0")
