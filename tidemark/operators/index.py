"""From weighted items to the published index."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numerics import clamp, five_levels, round_up
from tidemark.operators.weights import TIER_RULES, cap_speakers, day, meetings_of, speaker_factors, speaker_sums, weighted

#: Half of the index moves with decisions by this share; 25 points are worth STEP.
ANCHOR_SHARE, STEP, ANCHOR_DAYS, ANCHOR_HALF, ANCHOR_MOST = 0.35, 0.45, 180, 120.0, 0.7
COMMS_DAYS, STATS_DAYS = 45, 60


def weighted_scores() -> Column:
    return F.sum(F.col("weight") * F.col("net_score")).alias("ws")


def aggregate(rows: DataFrame, group: list[str], exempt: int) -> DataFrame:
    """Weighted mean under the speaker cap to 3 places, count, label counts and tier counts per group.
    Rows are summed by group and speaker once; all else runs on these sums."""
    tone = F.when(F.col("net_score") > 0.1, "hawkish").when(F.col("net_score") < -0.1, "dovish").otherwise("neutral")
    counts = {f"n_{t}": F.count_if(tone == t) for t in ("hawkish", "dovish", "neutral")} | {f"tier_{t}": F.count_if(F.col("tier") == t) for t in (1, 2, 3, 4)}
    sums = speaker_factors(speaker_sums(rows, group, exempt, weighted_scores(), F.min("age").alias("age"), *(f.alias(x) for x, f in counts.items())), group)
    w, ws = F.sum(F.col("w") * F.col("factor")), F.sum(F.col("ws") * F.col("factor"))
    out = sums.groupBy(*group).agg(F.when(w > 0, ws / w).alias("raw"), F.sum("n").alias("n"), F.min("age").alias("freshest"), *(F.sum(x).alias(x) for x in counts))
    return out.withColumn("score", round_up("raw")).withColumn("label", five_levels("score")).drop("raw")


def anchor(meetings: Column, as_of: Column) -> Column:
    """Decayed sum of the decisions of the last half year, to 3 places."""
    age = lambda m: F.datediff(as_of, m["meeting"])
    seen = F.filter(meetings, lambda m: age(m).between(0, ANCHOR_DAYS))
    total = F.aggregate(seen, F.lit(0.0), lambda a, m: a + m["bps"] / 25.0 * STEP * F.pow(F.lit(0.5), age(m) / ANCHOR_HALF))
    return round_up(clamp(total, -ANCHOR_MOST, ANCHOR_MOST))


def anchors(calendar: DataFrame, as_of: dt.date | Column) -> DataFrame:
    """(bank, anchor) of the banks that decided anything in the last half year."""
    seen = calendar.where(F.datediff(day(as_of), "meeting").between(0, ANCHOR_DAYS))
    return meetings_of(seen).select("bank", anchor(F.col("meetings"), day(as_of)).alias("anchor"))


def alpha(text_age: Column, stat_age: Column, half_life: Column) -> Column:
    """Weight of the text channel: more where it is fresher, and around meetings."""
    gap = clamp(stat_age - text_age, -14.0, 14.0)
    mixed = 0.6 + gap / 14 * 0.2 + F.when(half_life <= 10, 0.05).otherwise(0.0)
    return F.when(text_age.isNull(), 0.0).when(stat_age.isNull(), 1.0).otherwise(round_up(clamp(mixed, 0.35, 0.85), 2))


def window(items: DataFrame, calendar: DataFrame, as_of: dt.date) -> DataFrame:
    """What counts: recent text, binding documents since the last meeting, and statistics."""
    at = F.lit(as_of)
    last = F.broadcast(calendar.where(F.col("meeting") <= at).groupBy("bank").agg(F.max("meeting").alias("last_meeting")))
    kept = items.join(last, "bank", "left")
    text = ~F.col("is_statistical") & ((F.col("item_date") >= F.date_sub(at, COMMS_DAYS)) | ((F.col("tier") == 1) & (F.col("item_date") >= F.col("last_meeting"))))
    return kept.where((F.col("item_date") <= at) & (text | (F.col("is_statistical") & (F.col("item_date") >= F.date_sub(at, STATS_DAYS))))).drop("last_meeting")


def blended(rows: DataFrame, calendar: DataFrame, group: list[str], as_of: Column, exempt: int) -> DataFrame:
    """One row per group, of which the bank is one column: both channels, alpha, anchor, narrative and
    index of weighted ``rows``. ``as_of`` is an expression over the group's columns."""
    sums = speaker_factors(speaker_sums(rows, [*group, "is_statistical"], exempt, weighted_scores(), F.min("age").alias("age"), F.min("half_life").alias("half_life")), [*group, "is_statistical"])
    w, ws = F.col("w") * F.col("factor"), F.col("ws") * F.col("factor")
    sides = [(side, on, name) for side, on in (("text", ~F.col("is_statistical")), ("stat", F.col("is_statistical"))) for name in ("score", "n", "age")]
    of = lambda on: {"score": round_up(F.sum(F.when(on, ws)) / F.sum(F.when(on, w))), "n": F.coalesce(F.sum(F.when(on, F.col("n"))), F.lit(0)), "age": F.min(F.when(on, F.col("age")))}
    out = sums.groupBy(*group).agg(*(of(on)[name].alias(f"{side}_{name}") for side, on, name in sides), F.min("half_life").alias("half_life"))
    out = out.join(F.broadcast(meetings_of(calendar)), "bank", "left").withColumn("anchor", F.coalesce(anchor(F.col("meetings"), as_of), F.lit(0.0)))
    out = out.withColumn("alpha", alpha(F.col("text_age"), F.col("stat_age"), F.col("half_life")))
    narrative = round_up(F.col("alpha") * F.coalesce("text_score", F.lit(0.0)) + (1 - F.col("alpha")) * F.coalesce("stat_score", F.lit(0.0)))
    out = out.withColumn("narrative", narrative)
    out = out.withColumn("index", round_up((1 - ANCHOR_SHARE) * F.col("narrative") + ANCHOR_SHARE * F.col("anchor")))
    return out.withColumn("label", five_levels("index")).select(*group, "text_score", "text_n", "stat_score", "stat_n", "alpha", "anchor", "narrative", "index", "label")


def published(items: DataFrame, calendar: DataFrame, as_of: dt.date, exempt: int, rules=TIER_RULES) -> DataFrame:
    """The index of each bank on one day, over the window that counts then. ``items`` are scored."""
    rows = window(weighted(items, calendar, as_of, rules), calendar, as_of)
    return blended(rows, calendar, ["bank"], F.lit(as_of), exempt)


def monthly(items: DataFrame, calendar: DataFrame, exempt: int, rules=TIER_RULES) -> DataFrame:
    """The blended index of each bank and month, of the month's items as of the first day of the next
    month. The day is a column, so all months are one job. ``items`` are scored."""
    dated = items.withColumn("as_of", F.add_months(F.trunc("item_date", "MM"), 1))
    return blended(weighted(dated, calendar, F.col("as_of"), rules), calendar, ["bank", "as_of"], F.col("as_of"), exempt).withColumn("month", F.add_months("as_of", -1))


def history(months: DataFrame, one: str, two: str) -> DataFrame:
    """(month, one, one_n, two, two_n): index and count of two banks by month, missing ones null and 0."""
    side = lambda bank: months.where(F.col("bank") == bank).select("month", F.col("index").alias(bank.lower()), (F.col("text_n") + F.col("stat_n")).alias(f"{bank.lower()}_n"))
    both = side(one).join(side(two), "month", "full_outer")
    return both.withColumns({f"{bank.lower()}_n": F.coalesce(f"{bank.lower()}_n", F.lit(0)) for bank in (one, two)})


def attribution(items: DataFrame, calendar: DataFrame, as_of: dt.date, exempt: int, rules=TIER_RULES) -> DataFrame:
    """(bank, item_id, is_statistical, contribution, share): signed points that each item adds to the narrative, and
    its share of all absolute influence within its channel."""
    rows = cap_speakers(window(weighted(items, calendar, as_of, rules), calendar, as_of), ["bank", "is_statistical"], exempt)
    part = F.col("net_score") * F.col("weight")
    totals = rows.groupBy("bank", "is_statistical").agg(F.sum("weight").alias("w"), F.sum(F.abs(part)).alias("a"))
    mixed = blended(rows, calendar, ["bank"], F.lit(as_of), exempt).select("bank", "alpha")
    totals = totals.join(mixed, "bank")  # a row per bank and channel
    share = F.when(F.col("is_statistical"), 1 - F.col("alpha")).otherwise(F.col("alpha"))
    return rows.join(F.broadcast(totals), ["bank", "is_statistical"]).select("bank", "item_id", "is_statistical", round_up(part / F.col("w") * share).alias("contribution"), (F.abs(part) / F.col("a")).alias("share"))
