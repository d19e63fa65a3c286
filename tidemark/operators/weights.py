"""Weights of items: decay, tiers, and the cap on single speakers."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numerics import decay

#: Weight of each document tier.
TIER_WEIGHT = {1: 1.0, 2: 0.7, 3: 0.4, 4: 0.1}
#: Patterns of the tiers of documents, on source and title, in the order in which they are
#: tested; 3 if none fits.
TIER_RULES = (
    (4, "digital euro|payment|target2|t2s|banknote|supervis|ssm|resolution|balance sheet|financial stability review|annual report|appointment|obituar|award|conference announcement|call for papers|vacanc"),
    (1, "monetary policy (statement|decision)|policy decision|fomc statement|press conf|rate decision|combined monetary policy|introductory statement|summary of economic projections|fomc sep"),
    (2, "minutes|account|testimony|semiannual|monetary policy report"),
    (3, "speech|remarks|keynote|lecture|interview|media|blog|podcast|panel|op-?ed"),
)
#: The share of the total weight one speaker may have, and the passes.
SPEAKER_SHARE, PASSES = 0.10, 5
#: Half-life where the calendar says nothing.
BASE_HALF_LIFE = 21.0


def day(at: dt.date | Column) -> Column:
    return at if isinstance(at, Column) else F.lit(at)


def meetings_of(calendar: DataFrame) -> DataFrame:
    """(bank, meetings array<struct<meeting, bps>>): the calendar as one row per bank, small enough to send along."""
    return calendar.groupBy("bank").agg(F.collect_list(F.struct("meeting", "bps")).alias("meetings"))


def half_life(meetings: Column, as_of: Column) -> Column:
    """Short around meetings. Today counts as the next meeting."""
    gaps = F.transform(meetings, lambda m: F.datediff(m["meeting"], as_of))
    ahead = F.array_min(F.filter(gaps, lambda g: g >= 0))
    behind = -F.array_max(F.filter(gaps, lambda g: g < 0))
    return F.when(ahead <= 5, 7.0).when(ahead <= 14, 10.0).when(behind <= 5, 8.0).otherwise(BASE_HALF_LIFE)


def half_lives(calendar: DataFrame, as_of: dt.date | Column) -> DataFrame:
    """(bank, half_life)."""
    return meetings_of(calendar).select("bank", half_life(F.col("meetings"), day(as_of)).alias("half_life"))


def first_rule(text: Column, rules: Sequence[tuple], otherwise) -> Column:
    """What the first of the ordered rules (value, pattern) says whose pattern is found in ``text``."""
    out = F.lit(otherwise)
    for value, pattern in reversed(rules):
        out = F.when(text.rlike(f"(?i){pattern}"), F.lit(value)).otherwise(out)
    return out


def tier(source: Column, title: Column, rules: Sequence[tuple[int, str]] = TIER_RULES) -> Column:
    """Tier of a document by where it is from and what it is called."""
    return first_rule(F.concat_ws(" ", F.coalesce(source, F.lit("")), F.coalesce(title, F.lit(""))), rules, 3)


def item_weight(half_life: Column) -> Column:
    """Weight of one item: decay times tier, or for statistics times half their own weight."""
    own = F.when(F.coalesce(F.col("stat_weight"), F.lit(0)) > 0, F.least(F.lit(3.0), F.col("stat_weight").cast("double")) / 2).otherwise(0.5)
    by_tier = F.lit(TIER_WEIGHT[3])
    for k, w in TIER_WEIGHT.items():
        by_tier = F.when(F.col("tier") == k, w).otherwise(by_tier)
    return decay("age", half_life) * F.when(F.col("is_statistical"), own).otherwise(by_tier)


def weighted(items: DataFrame, calendar: DataFrame, as_of: dt.date | Column, rules: Sequence[tuple[int, str]] = TIER_RULES) -> DataFrame:
    """Items with tier, age in days, half-life and weight. ``as_of`` may be a column, so that each
    month's items have a day of their own."""
    at = day(as_of)
    aged = items.withColumn("tier", tier(F.col("source"), F.col("title"), rules)).withColumn("age", F.greatest(F.datediff(at, "item_date"), F.lit(0)))
    aged = aged.join(F.broadcast(meetings_of(calendar)), "bank", "left").withColumn("half_life", half_life(F.col("meetings"), at)).drop("meetings")
    return aged.withColumn("weight", item_weight(F.col("half_life")))


def speaker_sums(items: DataFrame, group: list[str], exempt: int, *more: Column) -> DataFrame:
    """One row per group and speaker: (group.., speaker, w, n, more..), ``w`` being the sum of weights.
    Statistical rows and the exempt speaker are speaker -1."""
    key = F.when(~F.col("is_statistical") & (F.col("speaker") != exempt), F.col("speaker")).otherwise(-1)
    return items.groupBy(*group, key.alias("speaker")).agg(F.sum("weight").alias("w"), F.count("*").alias("n"), *more)


def speaker_factors(sums: DataFrame, group: list[str], share: float = SPEAKER_SHARE, passes: int = PASSES) -> DataFrame:
    """``sums`` with ``factor``, what each speaker's weights are multiplied with. In every pass the total is fixed at its
    start; speaker -1 is never limited. Only sums per speaker matter, so the passes run over one row per
    group and speaker."""
    out = sums.withColumn("factor", F.lit(1.0))
    every = Window.partitionBy(*group)
    for _ in range(passes):
        now = F.col("w") * F.col("factor")
        out = out.withColumn("limit", share * F.sum(now).over(every))
        over = (F.col("speaker") >= 0) & (F.col("limit") > 0) & (now > F.col("limit") + 1e-9)
        out = out.withColumn("factor", F.when(over, F.col("limit") / F.col("w")).otherwise(F.col("factor")))
    return out.drop("limit")


def cap_speakers(items: DataFrame, group: list[str], exempt: int, share: float = SPEAKER_SHARE, passes: int = PASSES) -> DataFrame:
    """``items`` with the weights of limited speakers lowered, for what needs weights per row; sums don't.

    A pass limits less than 1 / share speakers of a group, so there are passes / share limited ones a
    group at most: few enough to be broadcast, and the rows aren't shuffled."""
    factors = speaker_factors(speaker_sums(items, group, exempt), group, share, passes).where("factor < 1")
    limited = factors.select(*group, "speaker", "factor", F.lit(False).alias("__free"))
    free = F.col("is_statistical") | (F.col("speaker") == exempt)
    joined = items.withColumn("__free", free).join(F.broadcast(limited), [*group, "speaker", "__free"], "left")
    return joined.withColumn("weight", F.col("weight") * F.coalesce("factor", F.lit(1.0))).select(*items.columns)
