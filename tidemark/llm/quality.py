"""Quality rules as weak supervision.

Each rule looks at counts of a text and votes good (1), bad (-1) or abstains (0). Texts are a
mixture of good ones and, for each rule, of ones with the defect that this rule is about. Each of
these classes has an own probability that a rule which votes votes bad; abstaining says nothing. So the good votes of other rules, which
agree with one another on most bad texts as well, don't outvote the one that sees a defect, and
rules that see the same defect count once. Expectation-maximisation over all texts estimates the
probabilities, which are the rules' accuracies, and the shares of the classes, under Beta and
Dirichlet priors: pseudo-counts in proportion to the number of texts, which say that votes are mostly
right, and under two bounds that tell the classes apart, ``FALSE_ALARMS`` and ``HITS``. The posterior
probability of a text to be good then decides, instead of a demand that all
rules pass. All the texts with the same votes are alike, so the corpus enters as counts of vote
patterns: at most 3 ** rules of them, whatever its size.

Words and lines are compared by their bytes, runs of words by their words: hashes only find
the candidates.

Defined results: null and empty texts have no words and fail the base rules; repeated rows get
the same result each; an empty table gives an empty result; further columns are ignored. A text is
counted whole within a task, in some 100 bytes of memory a character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.support import Words, cut, gram_numbers, mix64, ngram_hashes, numbered, packed_spans, ship, slices, text_bytes

WINDOW = 8
#: Prior share of bad votes among a rule's votes: on texts with its defect, and on others.
DEFECT_VOTES, OTHER_VOTES = 0.95, 0.002
#: What these priors, and that of even shares of the defects, weigh against all texts.
PRIOR_WEIGHT, SHARE_WEIGHT = 0.002, 0.001
#: A rule votes against good texts so often at most, and against texts of its own defect at least.
FALSE_ALARMS, HITS = 0.01, 0.8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct", "n_upper", "n_letters", "n_bangs", "n_lines", "n_end_lines", "n_adjacent")


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[[ord(x) for x in chars]] = 1
    return out


#: The symbols that count.
SYMBOLS = _table("#*$%&|<>")
_UPPER = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LETTER = _UPPER | _table("abcdefghijklmnopqrstuvwxyz")
_BANG = _table("!")
_ENDS = _table(".!?:;\"'")


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[offsets])


def _again(key: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which entries occur twice or more in their row, and which of them aren't the first."""
    order = np.lexsort((key, row))
    k, r = key[order], row[order]
    same = np.zeros(len(k) + 1, dtype=bool)
    same[1:-1] = (k[1:] == k[:-1]) & (r[1:] == r[:-1])
    twice, later = np.zeros(len(k), dtype=bool), np.zeros(len(k), dtype=bool)
    twice[order], later[order] = same[:-1] | same[1:], same[:-1]  # lexsort is stable
    return twice, later


def text_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of each row."""
    words = Words(data, offsets)
    rows = len(offsets) - 1
    number, _ = words.numbers()
    n_words = np.diff(words.first)
    out = {"n_words": n_words, "word_chars": _per_row(words.inside & ((data & 0xC0) != 0x80), offsets), "n_symbols": _per_row(SYMBOLS[data], offsets)}
    opens = np.zeros(len(data), dtype=bool)  # lines, without their \n
    edge = offsets[:-1][offsets[:-1] < len(data)]
    opens[edge] = True
    opens[1:] |= data[:-1] == 10
    start = np.flatnonzero(opens)
    end = np.append(start[1:], len(data))
    end = end - (data[end - 1] == 10) if len(start) else end
    visible = np.concatenate([[0], np.cumsum(words.inside, dtype=np.int64)])
    full = visible[end] > visible[start]
    start, end = start[full], end[full]
    line_row = np.searchsorted(offsets, start, "right") - 1
    _, later = _again(numbered(packed_spans(data, start, end), end - start)[0], line_row)
    last = words.end[np.searchsorted(words.start, end) - 1] - 1 if len(start) else start
    out["n_dup_lines"] = np.bincount(line_row[later], minlength=rows)
    grams = ngram_hashes(mix64(number.astype(np.uint64)), WINDOW)
    inside = words.doc[: len(grams)] == words.doc[WINDOW - 1 :] if len(grams) else np.zeros(0, dtype=bool)
    at = np.flatnonzero(inside)
    twice, _ = _again(grams[at], words.doc[at])
    at = at[twice]
    twice, _ = _again(gram_numbers(number, at, WINDOW), words.doc[at])
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + WINDOW, -1)
    out["n_repeat_words"] = np.bincount(words.doc[np.cumsum(cover[:-1]) > 0], minlength=rows)
    _, later_word = _again(number, words.doc)
    out["n_distinct"] = n_words - np.bincount(words.doc[later_word], minlength=rows)
    out["n_upper"], out["n_letters"], out["n_bangs"] = (_per_row(t[data], offsets) for t in (_UPPER, _LETTER, _BANG))
    out["n_lines"] = np.bincount(line_row, minlength=rows)
    out["n_end_lines"] = np.bincount(line_row[_ENDS[data[last]] > 0], minlength=rows)
    beside = (number[1:] == number[:-1]) & (words.doc[1:] == words.doc[:-1])
    out["n_adjacent"] = np.bincount(words.doc[1:][beside], minlength=rows)
    return out


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        found = text_counts(*text_bytes(batch.column(batch.schema.get_field_index("text"))))
        columns = [batch.column(i) for i, x in enumerate(batch.schema.names) if x != "text"]
        names = [x for x in batch.schema.names if x != "text"]
        yield pa.RecordBatch.from_arrays([*columns, *(pa.array(found[x], pa.int64()) for x in COUNTS)], [*names, *COUNTS])


def count_texts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, counts...) per row."""
    ship(docs.sparkSession)
    kind = dict(docs.dtypes)[id_column]
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(_counts, f"id {kind}, " + ", ".join(f"{x} long" for x in COUNTS)).withColumnRenamed("id", id_column)


def base_failed() -> Column:
    """Too short, or too much of it repeats."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def default_rules() -> dict[str, Column]:
    """Votes over the counts: 1 good, -1 bad, 0 abstains. All but the first abstain on short texts."""
    c = F.col
    long = c("n_words") >= 20

    def share(part: str, whole: str, good: float, bad: float) -> Column:
        return _vote(long & (c(part) > bad * c(whole)), long & (c(part) < good * c(whole)))

    return {
        "words": _vote(c("n_words") < 5, c("n_words") >= 50),
        "symbols": share("n_symbols", "n_words", 0.02, 0.10),
        "shouting": share("n_upper", "n_letters", 0.20, 0.50),
        "bangs": share("n_bangs", "n_words", 0.02, 0.20),
        "repeats": share("n_repeat_words", "n_words", 0.10, 0.30),
        "lines": share("n_dup_lines", "n_lines", 0.10, 0.50),
        "stutter": share("n_adjacent", "n_words", 0.03, 0.10),
        "variety": _vote(long & (c("n_distinct") < 0.15 * F.least(c("n_words"), F.lit(400))), long & (c("n_distinct") > 0.3 * F.least(c("n_words"), F.lit(400)))),
        "word_length": _vote(long & ((c("word_chars") < 2 * c("n_words")) | (c("word_chars") > 15 * c("n_words"))), long & c("word_chars").between(3 * c("n_words"), 11 * c("n_words"))),
        "endings": _vote(long & (c("n_lines") >= 5) & (c("n_end_lines") < 0.1 * c("n_lines")), long & (c("n_end_lines") > 0.5 * c("n_lines"))),
    }


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 500, tolerance: float = 1e-9) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Expectation-maximisation over (votes, count). Returns the shares of the classes (good, then one
    defect a rule), ``p[class, rule]``, the probability that a vote is bad, and the logarithm of the
    posterior density a text after each round, which never falls. It starts from the priors and from
    what share of texts each rule votes against."""
    votes = np.array([v for v, _ in patterns], np.int64)
    n = np.array([c for _, c in patterns], np.float64)
    total, rules = n.sum(), votes.shape[1]
    bad, good = (votes < 0).astype(np.float64), (votes > 0).astype(np.float64)
    own = np.arange(rules)
    p = np.full((rules + 1, rules), OTHER_VOTES)
    p[own + 1, own] = DEFECT_VOTES
    low, high = np.zeros_like(p), np.ones_like(p)
    high[0], low[own + 1, own] = FALSE_ALARMS, HITS
    pseudo, even = PRIOR_WEIGHT * total * np.stack([p, 1 - p]), np.full(rules + 1, SHARE_WEIGHT * total / (rules + 1))
    defects = n @ bad + even[1:]
    shares = np.concatenate([[max(total - defects.sum(), 0.1 * total)], defects])
    shares /= shares.sum()
    history: list[float] = []
    for _ in range(rounds):
        joint = bad @ np.log(p).T + good @ np.log1p(-p).T + np.log(shares)
        top = joint.max(axis=1)
        part = np.exp(joint - top[:, None])
        mass = part.sum(axis=1)
        prior = (pseudo[0] * np.log(p) + pseudo[1] * np.log1p(-p)).sum() + (even * np.log(shares)).sum()
        history.append(float(((n * (top + np.log(mass))).sum() + prior) / total))
        if len(history) > 1 and history[-1] - history[-2] < tolerance:
            break
        of = (n / mass)[:, None] * part
        hits, misses = of.T @ bad + pseudo[0], of.T @ good + pseudo[1]
        p = np.clip(hits / (hits + misses), low, high)  # the maximum under bounds, as the density is concave
        shares = of.sum(axis=0) + even
        shares /= shares.sum()
    return shares, p, history


def posterior(votes: np.ndarray, shares: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Probability of being good of texts with these votes [text, rule]."""
    joint = (votes < 0) @ np.log(p).T + (votes > 0) @ np.log1p(-p).T + np.log(shares)
    part = np.exp(joint - joint.max(axis=1, keepdims=True))
    return part[:, 0] / part.sum(axis=1)


def judge(counts: DataFrame, rules: dict[str, Column] | None = None, least: float = 0.5) -> DataFrame:
    """``counts`` with a vote per rule (``vote_<rule>``), base_failed, quality (posterior that the
    text is good) and kept. The counts are materialised, as they are read twice; the patterns of
    votes, of which there are 3 ** rules at most, are sent along with their posteriors."""
    rules = rules or default_rules()
    votes = [f"vote_{x}" for x in rules]
    code = sum(((F.col(x) + 1) * 3**i for i, x in enumerate(votes)), F.lit(0))
    voted = cut(counts.withColumns({f"vote_{x}": e.cast("int") for x, e in rules.items()}).withColumn("__pattern", code))
    found = voted.groupBy("__pattern").count().collect()
    patterns = sorted((tuple(r[0] // 3**i % 3 - 1 for i in range(len(votes))), r[1], r[0]) for r in found)
    told: list[tuple[int, float]] = []
    if patterns:
        shares, p, _ = fit([(v, n) for v, n, _ in patterns])
        told = list(zip((x[2] for x in patterns), posterior(np.array([v for v, _, _ in patterns]), shares, p).tolist(), strict=True))
    known = F.broadcast(counts.sparkSession.createDataFrame(told, "__pattern int, quality double"))
    judged = voted.join(known, "__pattern").drop("__pattern").withColumn("base_failed", base_failed())
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= least))
