"""Scores of texts from sentences: lexicon, document score and decisions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numerics import clamp, round_up

#: How far a direction may be from its target, a negation in front of a direction, and what closes behind what opens, in words.
REACH, NEGATION, GAP = 6, 3, 6
#: Words of the longest phrase, and first letters by which words find the phrases that may begin there.
LONGEST, KEY = 4, 3
LEXICON = "phrase string, role string, sign int, hawk int, dove int, dim string"


#: What a sentence must mention to be scored; \\w* stands for any ending.
RELEVANT = (
    "inflation", "prices?", "growth", "employment", "unemployment", "labou?r", "rates?", "policy", r"accommodat\w*", r"tighten\w*", "easing", "outlook", "activity", "demand", "wages?", "expectations?", "balance sheet",
    "asset purchases?", "target range", "federal funds", "deposit facility", "economy", "economic", "risks?",
)


def mentions(sentence: Column, words: tuple[str, ...] = RELEVANT) -> Column:
    """Whether one of ``words`` (patterns) stands in a sentence as a whole word, letters of all scripts making words."""
    letter = r"[\p{L}\p{N}_]"
    inside = "|".join(w.replace(r"\w", letter) for w in words)
    return sentence.rlike(f"(?i)(?<!{letter})(?:{inside})(?!{letter})")


def phrases(lexicon: DataFrame) -> DataFrame:
    """A lexicon (phrase, role, sign, hawk, dove, dim) as a table by first letters. A phrase has one to ``LONGEST`` words; one
    that ends in * stands for all that begin so, and has ``KEY`` letters at least if it is the first. Roles: ``target`` and ``direction`` carry a sign, ``negation`` nothing,
    ``points`` hawk and dove points of their own, ``opens`` such points that count if a ``closes`` of the same dim follows within ``GAP`` words."""
    parts = F.split(F.trim("phrase"), " +")
    return lexicon.withColumn("parts", parts).withColumn("__key", F.left(F.rtrim(F.element_at("parts", 1), F.lit("*")), F.lit(KEY)))


def phrase_hits(sentences: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(doc_id, pos, at, size, role, sign, hawk, dove, dim): phrases in sentences (doc_id, pos, words array), ``at`` being the first of ``size`` words.
    Of one role a match inside a longer one doesn't count. Each word is looked up once by its first letters, with the next words at hand, and only
    matches are shuffled, by document, so neither phrases nor long sentences multiply rows. The next words are read only where the first one fits."""
    begun = sentences.select("doc_id", "pos", "words", F.posexplode("words").alias("at", "word")).withColumn("__key", F.left("word", F.lit(KEY)))
    fits = lambda part, word: F.when(part.endswith("*"), F.startswith(word, F.rtrim(part, F.lit("*")))).otherwise(part == word)
    size = F.size("parts")
    found = begun.join(F.broadcast(phrases(lexicon)), "__key").where(fits(F.element_at("parts", 1), F.col("word")))
    found = found.where((size == 1) | (F.col("at") + size <= F.size("words")) & F.forall(F.zip_with("parts", F.slice("words", F.col("at") + 1, size), fits), lambda x: x))
    found = found.select("doc_id", "pos", "at", size.alias("size"), "role", "sign", "hawk", "dove", "dim").repartition("doc_id")
    end = F.col("at") + F.col("size")
    same = Window.partitionBy("doc_id", "pos", "role").orderBy("at")
    inside = (F.max(end).over(same.rangeBetween(1 - LONGEST, -1)) >= end) | (F.max(end).over(same.rangeBetween(0, 0)) > end)
    return found.withColumn("inside", F.coalesce(inside, F.max(end).over(same.rangeBetween(0, 0)) > end)).where("NOT inside").drop("inside")


def lexicon_points(sentences: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(doc_id, pos, dim, hawk, dove) of sentences (doc_id, pos, words array): a row for each dimension that a sentence has a target
    or points of. A target meets each direction within ``REACH`` words but at another place, and the product of their signs gives
    a point; a negation up to ``NEGATION`` words in front of a direction turns it. Places are those of first words."""
    order = Window.partitionBy("doc_id", "pos").orderBy("at")
    hits = phrase_hits(sentences, lexicon)
    turned = F.max(F.col("role") == "negation").over(order.rangeBetween(-NEGATION, -1))
    hits = hits.withColumn("turn", F.when(F.coalesce(turned, F.lit(False)), -F.col("sign")).otherwise(F.col("sign")))
    # directions of both signs within reach, less those at the same place
    pointing = lambda test: F.coalesce(F.sum(F.when((F.col("role") == "direction") & test, 1)).over(order.rangeBetween(-REACH, REACH)), F.lit(0)) - F.coalesce(F.sum(F.when((F.col("role") == "direction") & test, 1)).over(order.rangeBetween(0, 0)), F.lit(0))
    closes = F.max(F.col("role") == "closes").over(Window.partitionBy("doc_id", "pos", "dim").orderBy("at").rangeBetween(1, GAP))
    hits = hits.withColumns({"up": pointing(F.col("turn") > 0), "down": pointing(F.col("turn") < 0)}).where(F.col("role").isin("target", "points", "opens", "closes"))
    hits = hits.withColumn("closed", F.coalesce(closes & F.col("dim").isNotNull(), F.lit(False)))
    target = F.col("role") == "target"
    own = (F.col("role") == "points") | (F.col("role") == "opens") & F.col("closed")
    met = lambda same, other: F.when(target & (F.col("sign") > 0), F.col(same)).when(target & (F.col("sign") < 0), F.col(other)).otherwise(0)
    total = lambda c, n: F.sum(F.when(own, F.col(c)).otherwise(0) + n).alias(c)
    return hits.where(target | own).groupBy("doc_id", "pos", "dim").agg(total("hawk", met("up", "down")), total("dove", met("down", "up")))


@dataclass(frozen=True)
class Norm:
    """How values of sentences become scores of documents: pseudo-sentences and mean and deviation of both scorers over the
    corpus, what a z-value of 1 is worth, the neutral band, and pseudo-sentences and scale of the dimensions."""

    k: float
    lex: tuple[float, float]
    lin: tuple[float, float]
    z_to_net: float
    band: float = 0.1
    dim_k: float = 3.0
    dim_scale: float = 0.257


def linear_probabilities(sentences: DataFrame, vocabulary: DataFrame, intercept: tuple[float, float, float], longest: int = 3) -> DataFrame:
    """(doc_id, pos, p_dove, p_hawk, p_neutral) of every sentence (doc_id, pos, words array): softmax of a linear model over runs of one to ``longest`` words. ``vocabulary``
    (term, idf, dove, hawk, neutral) is the model's own table, of fixed size. Term frequencies are sublinear, and vectors have length 1. A
    sentence without a known term has the intercepts' probabilities."""
    # every sentence also says the empty term, which counts nothing, so that it has a row
    said = sentences.select("doc_id", "pos", "words", F.posexplode(F.concat(F.array(F.lit("")), "words")).alias("at", "word"))
    blank = vocabulary.sparkSession.range(1).select(F.lit("").alias("term"), *(F.lit(0.0).alias(c) for c in ("idf", "dove", "hawk", "neutral")))
    known = vocabulary.select("term", "idf", "dove", "hawk", "neutral").where("term <> ''").unionByName(blank)
    parts = known.select("term", F.split("term", " ").alias("parts")).select("term", F.element_at("parts", 1).alias("word"), F.slice("parts", 2, longest).alias("rest")).where(F.size("rest") < longest)
    size = F.size("rest")
    fits = (size == 0) | (F.col("at") + size <= F.size("words")) & (F.slice("words", F.col("at") + 1, size) == F.col("rest"))
    # a word is looked up once; matches are shuffled once, by document, which all that follows keeps to
    counted = said.join(F.broadcast(parts), "word").where(fits).select("doc_id", "pos", "term").repartition("doc_id").groupBy("doc_id", "pos", "term").agg(F.count("*").alias("n")).join(F.broadcast(known), "term")
    x = (1 + F.ln("n")) * F.col("idf")
    length = F.coalesce(F.nullif(F.sqrt(F.sum(x * x)), F.lit(0.0)), F.lit(1.0))
    names = ("dove", "hawk", "neutral")
    z = counted.groupBy("doc_id", "pos").agg(*((F.lit(b) + F.sum(x * F.col(c)) / length).alias(c) for b, c in zip(intercept, names)))
    most = F.greatest(*names)
    powers = [F.exp(F.col(c) - most) for c in names]
    return z.select("doc_id", "pos", *((p / (powers[0] + powers[1] + powers[2])).alias(f"p_{c}") for c, p in zip(names, powers)))


def linear_label(dove: Column, hawk: Column, neutral: Column) -> Column:
    """1, -1 or 0: the direction that is likelier than both others, ties being neutral."""
    return F.when(hawk > F.greatest(dove, neutral), 1).when(dove > F.greatest(hawk, neutral), -1).otherwise(0)


def sentence_values(points: DataFrame, linear: DataFrame) -> DataFrame:
    """Per sentence of ``linear``: lex (the sign of all hawk and dove points), gap (hawk less dove probability), agrees, and leans
    (dim, lean) of the dimensions that it is about. Gaps have nine places, so that equal sentences are equal in whatever order they were summed. One shuffle of both sides by sentence."""
    by = points.groupBy("doc_id", "pos").agg(F.signum(F.sum(F.col("hawk") - F.col("dove"))).cast("int").alias("lex"), F.collect_list(F.struct("dim", F.signum(F.col("hawk") - F.col("dove")).cast("int").alias("lean"))).alias("leans"))
    lex = F.coalesce("lex", F.lit(0))
    label = linear_label(F.col("p_dove"), F.col("p_hawk"), F.col("p_neutral"))
    return linear.join(by, ["doc_id", "pos"], "left").select("doc_id", "pos", lex.alias("lex"), (F.col("p_hawk") - F.col("p_dove")).alias("gap"), (label == lex).cast("int").alias("agrees"), "leans").withColumn("gap", F.round("gap", 9))


def document_scores(values: DataFrame, norm: Norm) -> DataFrame:
    """One row per document of sentence_values(): n, score, label, z, both measures, agreement, hawkish and dovish evidence
    (places of up to three sentences) and ``dims`` (dim, n, score, evidence).

    Sums are shrunk with k pseudo-sentences towards the corpus means; the score is the mean of both z-values on its scale. A dimension is
    the mean of lean and gap over its sentences, shrunk towards 0; its evidence is the sentence that says most in its direction, if that is over 0.2. Of
    equal sentences the first is evidence, on the dovish side the last."""
    gap, n = F.col("gap"), F.col("n")
    dovish = F.transform(F.slice(F.array_sort(F.collect_list(F.when(gap < -0.2, F.struct(gap.alias("o"), (-F.col("pos")).alias("back"))))), 1, 3), lambda x: -x["back"])
    hawkish = F.transform(F.slice(F.array_sort(F.collect_list(F.when(gap > 0.2, F.struct((-gap).alias("o"), F.col("pos").alias("at"))))), 1, 3), lambda x: x["at"])
    # values are read once: each sentence has a row of no dimension, and one for each that it is about
    leans = F.array_append(F.coalesce("leans", F.array().cast("array<struct<dim:string,lean:int>>")), F.struct(F.lit(None).cast("string").alias("dim"), F.lit(None).cast("int").alias("lean")))
    rows = values.select("doc_id", "pos", "lex", "gap", "agrees", F.inline(leans)).withColumn("sentence", F.col("lean").isNull()).withColumn("v", 0.5 * F.col("lean") + 0.5 * F.col("gap"))
    strongest = lambda sign: F.min(F.when(F.signum("v") == sign, F.struct((-F.abs("v")).alias("o"), F.col("pos").alias("at"))))
    parts = rows.groupBy("doc_id", "sentence", "dim").agg(
        F.count("*").alias("n"), F.sum("lex").cast("double").alias("a"), F.sum("gap").alias("b"), F.avg("agrees").alias("agreement"), hawkish.alias("hawkish"), dovish.alias("dovish"),
        F.sum("v").alias("v"), strongest(1.0).alias("up"), strongest(-1.0).alias("down"),
    )
    best = F.when(F.col("v") > 0, F.col("up")).when(F.col("v") < 0, F.col("down"))
    score = round_up(clamp(F.col("v") / (n + norm.dim_k) / norm.dim_scale))
    dim = F.struct("dim", "n", score.alias("score"), F.when(best["o"] < -0.2, best["at"]).alias("evidence"))
    whole = parts.groupBy("doc_id").agg(F.max(F.when(F.col("sentence"), F.struct("n", "a", "b", "agreement", "hawkish", "dovish"))).alias("w"), F.array_sort(F.collect_list(F.when(~F.col("sentence"), dim))).alias("dims")).select("doc_id", "w.*", "dims")
    shrunk = lambda c, m: ((F.col(c) + norm.k * m[0]) / (n + norm.k) - m[0]) / m[1]
    whole = whole.withColumn("z", (shrunk("a", norm.lex) + shrunk("b", norm.lin)) / 2).withColumn("net", clamp(F.col("z") / norm.z_to_net))

    label = F.when(F.col("net") > norm.band, "hawkish").when(F.col("net") < -norm.band, "dovish").otherwise("neutral")
    return whole.select(
        "doc_id", "n", round_up("net").alias("score"), label.alias("label"), round_up("z").alias("z"), round_up(F.col("a") / n).alias("lexicon_measure"), round_up(F.col("b") / n).alias("linear_measure"),
        round_up("agreement").alias("agreement"), "hawkish", "dovish", "dims",
    )


#: The strength of a decision by its size in basis points.
STEPS = ((25, 0.6), (50, 0.8))
LARGEST = 1.0


def action_base(direction: Column, points: Column) -> Column:
    size = F.lit(LARGEST)
    for most, value in reversed(STEPS):
        size = F.when(points <= most, value).otherwise(size)
    return direction * size


def combine(action: Column, words: Column) -> Column:
    """What was done, plus what was said in the room that leaves."""
    return clamp(action + words * (1 - F.abs(action)))


#: What a deciding sentence must have (a verb of deciding and what is decided on), and the words of moves
#: up, down and of holds.
DECIDES = "decided|decides|voted|agreed|today|will be (?:raised|lowered|increased|decreased|reduced)"
DECIDED_ON = "federal funds rate|target range|(?:three |our )?key (?:ecb )?interest rates|ecb interest rates|deposit facility|main refinancing|policy rates?|interest rates? on the (?:main|deposit|marginal)"
UP = "raise|raising|raised|increase|increasing|increased|lift|hike"
DOWN = "lower|lowering|lowered|reduce|reducing|reduced|cut|cutting|decrease|decreased"
HOLD = "keep|keeping|maintain|maintaining|leave|leaving|hold|remain"
#: The move to the first range ever, which states no size, and that size in basis points.
EMERGENCY, EMERGENCY_POINTS = r"establish(?:ed)? a target range[^.;]{0,60}?0 to 1/4", 75.0

#: Of each direction the patterns of a move, the next being looked for only where one isn't found: with the verb in
#: front of the object, and behind it.
MOVES = {
    1: (rf"(?:{UP})[^.;]{{0,120}}?(?:{DECIDED_ON})", rf"(?:{DECIDED_ON})[^.;]{{0,80}}?will be (?:raised|increased)"),
    -1: (rf"(?:{DOWN})[^.;]{{0,120}}?(?:{DECIDED_ON})", rf"(?:{DECIDED_ON})[^.;]{{0,80}}?will be (?:lowered|reduced|decreased|cut)"),
    0: (rf"(?:{HOLD})\w*[^.;]{{0,120}}?(?:{DECIDED_ON})", rf"(?:{DECIDED_ON})[^.;]{{0,60}}?\b(?:unchanged|remain\w*)"),
}
NEGATED = rf"\b(?:not|no)\s+(?:to\s+)?(?:{UP}|{DOWN})"


def move(sentence: Column) -> Column:
    """struct<direction, emergency> of a deciding sentence: the direction of its leftmost move, the lesser one
    of those that start together; null if it decides nothing. Sentences that deny a move don't count."""
    s = F.lower(sentence)
    place = lambda p: F.nullif(F.regexp_instr(s, F.lit(p)), F.lit(0))
    seen = [F.struct(F.coalesce(*map(place, patterns)).alias("at"), F.lit(d).alias("direction")) for d, patterns in MOVES.items()]
    first = F.array_min(F.filter(F.array(*seen), lambda x: x["at"].isNotNull()))
    found = F.when(s.rlike(EMERGENCY), F.struct(F.lit(-1).alias("direction"), F.lit(True).alias("emergency")))
    found = found.when(first.isNotNull(), F.struct(first["direction"].alias("direction"), F.lit(False).alias("emergency")))
    return F.when(s.rlike(DECIDES) & s.rlike(DECIDED_ON) & ~s.rlike(NEGATED), found)


def decisions(sentences: DataFrame, points: Column, first: int = 20) -> DataFrame:
    """(doc_id, direction, points, at): what the first deciding sentence (doc_id, pos, sentence) among the ``first``
    decides, and its pos; a hold if there is none. ``points``: the size that a sentence states."""
    read = sentences.where(F.col("pos") < first).withColumn("move", move(F.col("sentence"))).withColumn("size", points)
    best = read.groupBy("doc_id").agg(F.min(F.when(F.col("move").isNotNull(), F.struct("pos", "move", "size"))).alias("m"))
    d = F.coalesce(F.col("m.move.direction"), F.lit(0))
    size = F.when(d == 0, 0.0).when(F.col("m.move.emergency"), EMERGENCY_POINTS).otherwise(F.col("m.size"))
    return best.select("doc_id", d.alias("direction"), size.alias("points"), F.col("m.pos").alias("at"))


def decision_scores(decided: DataFrame, words: DataFrame) -> DataFrame:
    """(doc_id, direction, points, base, score): what was done, moved by what was said. ``words`` (doc_id, pos, value):
    scores of sentences; that of the deciding sentence doesn't count twice."""
    said = words.join(decided.select("doc_id", "at"), "doc_id").where(~F.col("pos").eqNullSafe(F.col("at"))).groupBy("doc_id").agg(F.avg("value").alias("words"))
    out = decided.join(said, "doc_id", "left").withColumn("base", action_base(F.col("direction"), F.col("points")))
    return out.select("doc_id", "direction", "points", "base", round_up(combine(F.col("base"), F.coalesce("words", F.lit(0.0)))).alias("score"))
