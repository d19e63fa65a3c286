"""Copies of one document: grouped by any of several keys, the original publisher's first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import drop_folder, fresh_folder
from tidemark.sources.documents import folded


def speech_of(bank: Column, day: Column, source: Column, title: Column, is_statistical: Column) -> Column:
    """What two copies of a named speech share: bank, day, speaker and title, in letters, digits and blanks; null for all else. A
    speaker stands before a colon at the third to the 61st character."""
    colon = F.instr(title, ":") - 1
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}\s]", ""), r"\s+", " "))
    whole = folded(title)
    speaker, name = plain(F.split_part(whole, F.lit(":"), F.lit(1))), plain(F.regexp_extract(whole, r"(?s)^[^:]*:(.*)$", 1))
    named = ~F.coalesce(is_statistical, F.lit(False)) & F.coalesce(source, F.lit("")).rlike("(?i)speech") & colon.between(2, 60) & (name != "")
    return F.when(named, F.concat_ws("|", bank, day.cast("string"), speaker, name))


#: The hosts of the two banks, and of the districts of one.
HOSTS = {"FED": ("federalreserve.gov",), "ECB": ("ecb.europa.eu",)}
DISTRICTS = r"(^|\.)(newyorkfed|bostonfed|philadelphiafed|clevelandfed|richmondfed|atlantafed|chicagofed|stlouisfed|minneapolisfed|kansascityfed|dallasfed|frbsf)\.(org|com)$"


def is_original(bank: Column, url: Column) -> Column:
    """Whether an address is the bank's own; no address is nobody's."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    own = lambda names: F.lit(False) if not names else host.isin(*names) | host.rlike(r"\.(" + "|".join(n.replace(".", r"\.") for n in names) + ")$")
    found = F.when(bank == "FED", own(HOSTS["FED"]) | host.rlike(DISTRICTS)).when(bank == "ECB", own(HOSTS["ECB"])).otherwise(False)
    return F.coalesce(found, F.lit(False))


def groups(rows: DataFrame, id_column: str, keys: str) -> DataFrame:
    """(id, group): rows that share any key of the array ``keys`` are in one group, and so are those that are linked over others; ``group`` is the least id. Null
    keys link nothing. Ids must be distinct and not null.

    Each round takes the least label of every key and of every row, then a label's own label, so paths shrink at least by half; a key's
    rows meet its one label, never each other. A round's table is written to the shared folder and the one before removed."""
    spark = rows.sparkSession
    links = rows.select(F.col(id_column).alias("id"), F.explode(F.array_distinct(F.array_compact(F.col(keys)))).alias("key"))
    place = fresh_folder(spark, "groups-links")
    links.write.parquet(place)
    links = spark.read.schema(links.schema).parquet(place)
    labels = links.select("id").distinct().withColumn("group", F.col("id"))
    written: list[str] = []
    while True:
        by_key = links.join(labels, "id").groupBy("key").agg(F.min("group").alias("least"))
        met = links.join(by_key, "key").groupBy("id").agg(F.min("least").alias("next"))
        new = labels.join(met, "id").select("id", F.least("group", "next").alias("next"), F.col("group").alias("old"))
        onward = new.select(F.col("id").alias("next"), F.col("next").alias("far"))
        jumped = new.join(onward, "next", "left").select("id", F.coalesce("far", "next").alias("group"), "old")
        folder = fresh_folder(spark, "groups-round")
        jumped.write.parquet(folder)
        written.append(folder)
        held = spark.read.schema(jumped.schema).parquet(folder)
        labels = held.drop("old")
        if held.where("group < old").isEmpty():
            break
        if len(written) > 1:
            drop_folder(spark, written.pop(0))
    out = rows.select(F.col(id_column).alias("id")).join(labels, "id", "left")
    return out.select(F.col("id").alias(id_column), F.coalesce("group", "id").alias("group"))


def with_primary(rows: DataFrame, group: str, order: str, original: Column) -> DataFrame:
    """Per ``group``: how many copies, and the one that is shown, the first by ``order`` of the original publisher's, else of all. Copies
    are counted, not listed: a group may be large."""
    first = F.min(F.struct((~original).alias("other"), F.col(order).alias("at")))
    return rows.groupBy(group).agg(F.count("*").alias("copies"), first.alias("p")).select(group, "copies", F.col("p.at").alias("primary"), (~F.col("p.other")).alias("is_original"))
