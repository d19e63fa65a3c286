"""Finding the article behind a remark: candidates in stages, verified, the first that passes wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import sentences
from tidemark.operators.scoring import RELEVANT, mentions

#: Least words of an article, namings of the speaker, share of the headline's words (namings where it has fewer than two), and
#: sentences on policy; days that a search reaches back, and candidates tried.
WORDS, NAMINGS, SHARE, NAMINGS_ALONE, ON_POLICY, WINDOW_DAYS, TRIED = 150, 2, 0.5, 3, 2, 88, 3
#: What a sentence that goes on from one that names the speaker has in it.
GOES_ON = r"[\"“”]|(?i:\b(?:said|says|added|told|according to)\b)|^(?:He|She|They)\b"


def attributed(text: Column, name: Column, goes_on: str = GOES_ON) -> Column:
    """Sentences of six words or more that name the speaker as a whole word, and up to two behind each that go on from it."""
    pattern = naming(name)

    def step(state: Column, s: Column) -> Column:
        names = F.rlike(s, pattern)
        follows = (state["left"] > 0) & s.rlike(goes_on)
        left = F.when(names, 2).when(follows, state["left"] - 1).otherwise(0).cast("int")
        return F.struct(F.when(names | follows, F.concat(state["out"], F.array(s))).otherwise(state["out"]).alias("out"), left.alias("left"))

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("left"))
    return F.aggregate(sentences(text), start, step, lambda s: s["out"])


def naming(name: Column) -> Column:
    """The pattern of a name as a whole word, in any case."""
    return F.concat(F.lit(r"(?i)(?<!\p{L})\Q"), name, F.lit(r"\E(?!\p{L})"))


def verified(articles: DataFrame, relevant: tuple[str, ...] = RELEVANT, goes_on: str = GOES_ON) -> DataFrame:
    """``articles`` (text, name, keywords, ..) with words, namings, share, on_policy and the reason: the first test that fails, or
    ``verified``. Null texts are empty; without keywords the share is 0."""
    text = F.coalesce("text", F.lit(""))
    known = articles.withColumns({
        "words": F.size(F.filter(F.split(text, r"\s+"), lambda x: x != "")).cast("long"), "namings": F.regexp_count(text, naming(F.col("name"))).cast("long"),
        "__n": F.size("keywords"), "__met": F.size(F.filter("keywords", lambda k: F.contains(F.lower(text), k))),
        "on_policy": F.size(F.filter(attributed(text, F.col("name"), goes_on), lambda s: mentions(s, relevant))).cast("long"),
    })
    known = known.withColumn("share", F.when(F.col("__n") > 0, F.col("__met") / F.col("__n")).otherwise(0.0))
    fits = F.when(F.col("__n") >= 2, F.col("share") >= SHARE).otherwise(F.col("namings") >= NAMINGS_ALONE)
    reason = F.when(F.col("words") < WORDS, "too short").when(F.col("namings") < NAMINGS, "speaker not named").when(~fits, "headline words missing").when(F.col("on_policy") < ON_POLICY, "nothing on policy").otherwise("verified")
    return known.withColumn("reason", reason).drop("__n", "__met")


def resolve(remarks: DataFrame, pages: DataFrame, found: DataFrame, as_of: Column, days: int = 5, relevant: tuple[str, ...] = RELEVANT, goes_on: str = GOES_ON) -> DataFrame:
    """(id, via, url, reason) of remarks (id, day, name, keywords, url).

    First the remark's own address is tried, if it is one. Where that doesn't verify and the remark is 88 days old at most, the candidates of a search
    ``found`` (name, seen, merit, address) are, those seen up to ``days`` days from the remark: distinct addresses, best merit first, three of
    them. These are the same for all remarks of a name and day, so they are found once for each, of the best three of every day seen: an address that is
    among the best of several days is so on the day of its highest merit. A text is read once for all remarks that ask it the same."""
    base = remarks.where("name IS NOT NULL AND name <> ''")
    nameless = remarks.where("name IS NULL OR name = ''").select("id", F.lit(None).cast("string").alias("via"), F.lit(None).cast("string").alias("url"), F.lit("no speaker").alias("reason"))
    own = base.where(F.col("url").rlike("^https?://")).select("id", "name", "keywords", F.col("url").alias("address"), F.lit(0).alias("rank"))
    recent = base.where(F.datediff(as_of, "day") <= WINDOW_DAYS).select("id", "day", "name", "keywords")
    best_of = lambda *key: F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("merit"), "address"))
    daily = found.groupBy("name", F.to_date("seen").alias("seen"), "address").agg(F.max("merit").alias("merit")).withColumn("rank", best_of("name", "seen")).where(F.col("rank") <= TRIED).drop("rank")
    asking = recent.select("name", "day").distinct().withColumn("seen", F.explode(F.transform(F.sequence(F.lit(-days), F.lit(days)), lambda d: F.date_add("day", d))))
    near = asking.join(daily, ["name", "seen"]).groupBy("name", "day", "address").agg(F.max("merit").alias("merit"))
    ranked = near.withColumn("rank", best_of("name", "day")).where(F.col("rank") <= TRIED).select("name", "day", "address", "rank")
    tried = own.unionByName(recent.join(ranked, ["name", "day"]).select("id", "name", "keywords", "address", "rank"))
    questions = tried.select("address", "name", "keywords").distinct()
    # the texts stay where they are, only those that are asked for go on
    asked = questions.join(pages.join(questions.select("address").distinct(), "address", "left_semi"), "address", "left")
    told = verified(asked, relevant, goes_on).withColumn("reason", F.when(F.col("text").isNull(), "page could not be read").otherwise(F.col("reason")))
    read = tried.join(told.select("address", "name", "keywords", "reason"), ["address", "name", "keywords"])
    best = read.groupBy("id").agg(F.min(F.when(F.col("reason") == "verified", F.struct("rank", "address"))).alias("best"), F.max(F.struct("rank", "reason"))["reason"].alias("last"), F.max("rank").alias("most"))
    old = F.datediff(as_of, "day") > WINDOW_DAYS
    reason = F.when(F.col("best").isNotNull(), "verified").when(F.col("last").isNotNull(), F.when(~old & (F.col("most") == 0), "no articles found").otherwise(F.col("last"))).when(old, "too old to search").otherwise("no articles found")
    via = F.when(F.col("best.rank") == 0, "own address").when(F.col("best.rank") > 0, "search")
    return base.join(best, "id", "left").select("id", via.alias("via"), F.col("best.address").alias("url"), reason.alias("reason")).unionByName(nameless)
