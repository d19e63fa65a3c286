"""Toxic spans by a linear-chain conditional random field.

The field has two states, toxic or not, and its chains are sentences, however long. A token's
score sums the weights of its features: the word, its first and last three letters, its shape, and
how toxic the words before and behind look by their counts; transitions join neighbours. Forward-
backward marginals give each token a probability; their largest value and their sum make the score of a
document by a logistic regression on the training sample, and runs of tokens over a half are the
offending spans.

Labels tell of documents, the field needs labelled tokens. In toxic documents of the sample, words
that are significantly more frequent there than in clean ones are toxic at first; the field is
fitted, tags the toxic documents, and is fitted again to its own tags, ``REFITS`` times. All
tokens of clean documents are clean.

The sample has at most ``SAMPLE`` labelled documents, the first by a hash of their id, with whole
texts. Executors hold it coded and sum likelihoods and gradients; the driver gets these sums, the
counts of the words that occur in ``LEAST_DOCS`` documents of the sample, and two numbers per
document of it. All documents are scored, over their whole texts.

Defined results: a null or empty text has the score of a text without any toxic token; repeated
rows get the same score each (of rows of the sample that share an id one is learned from); without
labels of both kinds nothing is learned and all scores are the share of toxic labels (0 without
labels); an empty table gives an empty result; further columns are ignored. A text is tagged whole
within a task, in some 100 bytes of memory a character.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.optimise import minimise
from tidemark.llm.support import Words, cut, ship, slices, span_hashes, text_bytes

SAMPLE, REFITS, ROUNDS = 6_000, 2, 12
#: A word has a weight of its own if so many documents of the sample have it, and is toxic at first
#: if it occurs so much more often in toxic documents than by chance (log-likelihood of its counts).
LEAST_DOCS, LEAST_EVIDENCE = 4, 8.0
#: Classes of three letters, and of what the counts say of a neighbour (0: unknown or none).
AFFIXES, GRADES = 4096, 10
#: Penalties of squared weights: of words, affixes, shapes, neighbours, and of the chain's five.
DECAY = (0.5, 5.0, 0.1, 1.0, 0.1)

_SOLID = np.zeros(256, dtype=bool)
_SOLID[128:] = True
_SOLID[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[[ord(x) for x in ".!?"]] = True


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words, the start and end of each without punctuation around it, and hashes (0: nothing left)."""
    words = Words(data, offsets)
    kept = _SOLID[data]
    solid, before = np.flatnonzero(kept), np.concatenate([[0], np.cumsum(kept, dtype=np.int32)])
    a, b = before[words.start], before[words.end]
    some = b > a
    start, end = words.start.copy(), words.start.copy()
    start[some], end[some] = solid[a[some]], solid[b[some] - 1] + 1
    hashes = np.zeros(len(words), np.uint64)
    hashes[some] = span_hashes(data, start[some], end[some], lower=True)
    return words, start, end, hashes


def chains(words: Words) -> np.ndarray:
    """First word of each chain, and the number of words at the end."""
    opens = np.zeros(len(words) + 1, dtype=bool)
    opens[words.first] = True
    if len(words):
        opens[1:] |= _STOP[words.data[words.end - 1]]
    opens[len(words)] = True
    return np.flatnonzero(opens)


def _affix(data: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Class of the three bytes from ``at``, as far as ``end``."""
    code = np.zeros(len(at), np.uint32)
    for i in range(3):
        byte = np.where(at + i < end, data[np.minimum(at + i, len(data) - 1)], 0).astype(np.uint32)
        code = (code << np.uint32(8)) | (byte + 32 * ((byte >= 65) & (byte <= 90))).astype(np.uint32)
    return ((code * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int64)


def _count(flags: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return sums[end] - sums[start]


@dataclass
class Lexicon:
    """Words by the sorted hashes ``keys``, and the grade of each."""

    keys: np.ndarray
    grade: np.ndarray

    def blocks(self) -> list[int]:
        """How many weights words, two affixes, shapes and two neighbours have, and the chain."""
        return [len(self.keys) + 1, AFFIXES, AFFIXES, 16, GRADES, GRADES, 5]

    def features(self, data: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
        """Words, their bare starts and ends, and [6, word] numbers of weights."""
        words, start, end, hashes = tokens(data, offsets)
        out = np.zeros((6, len(words)), np.int64)
        if not len(words):
            return words, start, end, out
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
            out[0] = np.where(self.keys[at] == hashes, at + 1, 0)
        out[1], out[2] = _affix(data, start, end), _affix(data, np.maximum(end - 3, start), end)
        upper = _count(_UPPER[data], start, end)
        capital = _UPPER[data[start]] & (end > start)
        out[3] = capital + 2 * ((upper > 1) & (upper == _count(_LETTER[data], start, end))) + 4 * (_count(_DIGIT[data], start, end) > 0) + 8 * (data[words.end - 1] == ord("!"))
        grade = np.concatenate([[0], self.grade])[out[0]]
        same = words.doc[1:] == words.doc[:-1]
        out[4, 1:], out[5, :-1] = np.where(same, grade[:-1], 0), np.where(same, grade[1:], 0)
        out += np.concatenate([[0], np.cumsum(self.blocks()[:5])])[:, None]
        return words, start, end, out


class Chains:
    """Marginals of chains of tokens: ``first`` has their first tokens and the number of tokens."""

    def __init__(self, score: np.ndarray, first: np.ndarray, start: float, move: np.ndarray) -> None:
        """``score``: of the toxic state; ``start``: more of it at a chain's first token; ``move``: of the
        transitions [from, to]."""
        size = np.diff(first)
        place = np.arange(len(score)) - np.repeat(first[:-1], size)
        self.first, self.place = first, place
        opens = place == 0
        e = np.exp(np.clip(score + np.where(opens, start, 0), -60, 60))
        m = np.exp(np.clip(move, -60, 60))
        #: What a step multiplies weights with; a chain's first token has the same rows.
        self.step = [np.where(opens, 1.0, m[0, 0]), np.where(opens, e, m[0, 1] * e), np.where(opens, 1.0, m[1, 0]), np.where(opens, e, m[1, 1] * e)]
        ahead, self.log = _products(self.step, place)
        self.alpha = np.stack(ahead[:2])
        a, b, c, d = self.step
        back, _ = _products([x[::-1] for x in (a, c, b, d)], (np.repeat(size, size) - 1 - place)[::-1])
        a, c, b, d = (x[::-1] for x in back)
        self.beta = np.ones((2, len(score)))
        inner = np.flatnonzero(~opens)
        self.beta[:, inner - 1] = (a + b)[inner], (c + d)[inner]

    def toxic(self) -> np.ndarray:
        """P(toxic) of each token."""
        zero, one = self.alpha * self.beta
        return one / (zero + one)

    def total(self) -> float:
        """Sum of the chains' log-partitions."""
        last = self.first[1:] - 1
        return float((self.log[last] + np.log(self.alpha[:, last].sum(axis=0))).sum())

    def moves(self) -> np.ndarray:
        """Expected numbers of the transitions [from, to]."""
        t = np.flatnonzero(self.place)
        pair = np.stack([self.alpha[i, t - 1] * self.step[2 * i + j][t] * self.beta[j, t] for i in (0, 1) for j in (0, 1)])
        return (pair / pair.sum(axis=0)).sum(axis=1).reshape(2, 2) if len(t) else np.zeros((2, 2))


def _products(step: list[np.ndarray], place: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Products of the 2 x 2 matrices ``step`` from the first of a chain to each, scaled to a largest entry of
    1, and the logarithms of the scales. By doubling: a pass joins the products of ``d``
    matrices to those of twice as many, so passes grow as the logarithm of a chain's length."""
    top = np.maximum(np.maximum(step[0], step[1]), np.maximum(step[2], step[3]))
    a, b, c, d = (x / top for x in step)
    log = np.log(top)
    reach = 1
    at = np.flatnonzero(place >= 1)
    while len(at):
        i = at - reach
        p, q, r, s = a[i], b[i], c[i], d[i]
        t, u, v, w = a[at], b[at], c[at], d[at]
        new = (p * t + q * v, p * u + q * w, r * t + s * v, r * u + s * w)
        top = np.maximum(np.maximum(new[0], new[1]), np.maximum(new[2], new[3]))
        more = log[i] + np.log(top)
        a[at], b[at], c[at], d[at] = (x / top for x in new)
        log[at] += more
        reach *= 2
        at = at[place[at] >= reach]
    return [a, b, c, d], log


@dataclass
class Model:
    """``theta``: weights of the features, then of starting toxic and of the four transitions."""

    lexicon: Lexicon
    theta: np.ndarray | None
    weights: tuple[float, float, float]

    def chains(self, features: np.ndarray, first: np.ndarray) -> Chains:
        return field(self.theta, features, first)

    def tag(self, data: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
        """Words, their bare starts and ends, and P(toxic) of each."""
        words, start, end, features = self.lexicon.features(data, offsets)
        if self.theta is None or not len(words):
            return words, start, end, np.zeros(len(words))
        return words, start, end, self.chains(features, chains(words)).toxic()


def field(theta: np.ndarray, features: np.ndarray, first: np.ndarray) -> Chains:
    score = theta[features[0]]
    for of in features[1:]:
        score = score + theta[of]
    return Chains(score, first, float(theta[-5]), theta[-4:].reshape(2, 2))


def likelihood(theta: np.ndarray, features: np.ndarray, first: np.ndarray, truth: np.ndarray) -> tuple[float, np.ndarray]:
    """Logarithm of the probability of the 0/1 states ``truth``, and its gradient."""
    found = field(theta, features, first)
    gap = truth - found.toxic()
    gradient = np.zeros_like(theta)
    for of in features:
        gradient += np.bincount(of, gap, len(theta))
    gradient[-5] += gap[first[:-1]].sum()
    inner = np.flatnonzero(found.place)
    moved = np.bincount(2 * truth[inner - 1] + truth[inner], minlength=4).astype(np.float64)
    gradient[-4:] += moved - found.moves().ravel()
    score = theta[features[:, truth > 0]].sum()
    value = score + theta[-5] * truth[first[:-1]].sum() + theta[-4:] @ moved - found.total()
    return float(value), gradient


def _features(p: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Of each row: the largest probability and the sum of those that count (over a tenth)."""
    rows = len(words.first) - 1
    top = np.zeros(rows)
    np.maximum.at(top, words.doc, p)
    return top, np.bincount(words.doc, np.where(p > 0.1, p, 0), minlength=rows)


def _score(model: Model, top: np.ndarray, total: np.ndarray) -> np.ndarray:
    a, b, c = model.weights
    return 1 / (1 + np.exp(-np.clip(a + b * top + c * np.log1p(total), -500, 500)))


def _words_of(texts: DataFrame) -> pa.Table:
    """(key, bad, good): how many toxic and clean documents have each word, of those that LEAST_DOCS have."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words, _, _, hashes = tokens(*text_bytes(batch.column("text")))
            keys, where = np.unique(hashes, return_inverse=True)
            row = np.unique(np.stack([where, words.doc]), axis=1) if len(where) else np.zeros((2, 0), np.int64)
            flag = batch.column("label").to_numpy()[row[1]] > 0
            bad, good = (np.bincount(row[0], f, len(keys)).astype(np.int64) for f in (flag, ~flag))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(bad), pa.array(good)], ["key", "bad", "good"])

    counted = texts.mapInArrow(count, "key long, bad long, good long").where("key <> 0").groupBy("key").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    return counted.where(F.col("bad") + F.col("good") >= LEAST_DOCS).toArrow()


def _lexicon(found: pa.Table, share: float) -> tuple[Lexicon, np.ndarray]:
    """The lexicon, and which of its words are toxic at first."""
    order = np.argsort(found["key"].to_numpy().view(np.uint64))
    keys, bad, good = (found[x].to_numpy()[order] for x in ("key", "bad", "good"))
    rate = bad / (bad + good)
    part = lambda x, r, s: np.where(x > 0, x * np.log(np.maximum(r, 1e-12) / s), 0.0)
    evidence = part(bad, rate, share) + part(good, 1 - rate, 1 - share)
    odds = np.log((bad + 0.5) / (good + 0.5)) - np.log(share / (1 - share))
    grade = np.clip(np.round(odds) + 5, 1, GRADES - 1).astype(np.int64)
    return Lexicon(keys.view(np.uint64), grade), (rate > max(0.5, share)) & (bad >= LEAST_DOCS) & (evidence >= LEAST_EVIDENCE)


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", sample: int = SAMPLE) -> Model:
    """Learn from ``labels`` (id, label); null labels are left out, of several the largest counts."""
    spark = docs.sparkSession
    ship(spark)
    known = labels.where(F.col(label_column).isNotNull()).groupBy(F.col(id_column).alias("id")).agg(F.max(label_column).cast("int").alias("label"))
    picked = known.orderBy(F.xxhash64("id"), "id").limit(sample)  # at most ``sample`` small rows
    texts = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text")).join(F.broadcast(picked), "id")
    texts = cut(texts.groupBy("id", "label").agg(F.min("text").alias("text")).repartition(max(8, spark.sparkContext.defaultParallelism)))
    base = {r[0]: r[1] for r in texts.groupBy("label").count().collect()}
    clean, toxic = base.get(0, 0), sum(n for k, n in base.items() if k)
    share = toxic / max(1, clean + toxic)
    if not clean or not toxic:
        return Model(Lexicon(np.zeros(0, np.uint64), np.zeros(0, np.int64)), None, (float(np.log((share + 1e-9) / (1 - share + 1e-9))), 0.0, 0.0))
    lexicon, seeds = _lexicon(_words_of(texts), share)
    model = Model(lexicon, None, (0.0, 0.0, 0.0))
    seeded = np.concatenate([[False], seeds])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words, _, _, features = lexicon.features(*text_bytes(batch.column("text")))
            if len(words):
                bad = batch.column("label").to_numpy()[words.doc] > 0
                row = features.astype("<i4").tobytes(), chains(words).astype("<i4").tobytes(), bad.tobytes(), (bad & seeded[features[0]]).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in row], ["features", "first", "bad", "seed"])

    coded = cut(texts.mapInArrow(code, "features binary, first binary, bad binary, seed binary"))
    blocks = lexicon.blocks()
    decay = np.repeat(np.array([DECAY[0], DECAY[1], DECAY[1], DECAY[2], DECAY[3], DECAY[3], DECAY[4]]), blocks)
    theta = np.zeros(sum(blocks))
    theta[: blocks[0]] = np.where(seeded, 9.0, 0.0)  # where the search begins
    theta[sum(blocks[:3]) : sum(blocks[:4])] = -6.0
    for turn in range(REFITS + 1):
        known = _tagged(coded, theta) if turn else coded
        theta = minimise(lambda x, known=known: _objective(known, x, decay), theta, ROUNDS, tolerance=1e-4)
    model.theta = theta

    def rated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words, _, _, p = model.tag(*text_bytes(batch.column("text")))
            top, total = _features(p, words)
            yield pa.RecordBatch.from_arrays([pa.array(top), pa.array(total), batch.column("label")], ["top", "total", "label"])

    found = texts.mapInArrow(rated, "top double, total double, label int").toArrow()  # three numbers a document of the sample
    top, total, label = (found[x].to_numpy() for x in ("top", "total", "label"))
    model.weights = _logistic(top, np.log1p(total), label > 0, share)
    return model


def _arrays(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for features, first, bad, seed in zip(*(batch.column(x).to_pylist() for x in ("features", "first", "bad", "seed")), strict=True):
        yield np.frombuffer(features, "<i4").reshape(6, -1), np.frombuffer(first, "<i4").astype(np.int64), np.frombuffer(bad, bool), np.frombuffer(seed, bool)


def _tagged(coded: DataFrame, theta: np.ndarray) -> DataFrame:
    """``coded`` with those tokens of toxic documents as seeds that the weights find toxic."""
    sent = coded.sparkSession.sparkContext.broadcast(theta)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seeds = [(bad & (field(sent.value, features, first).toxic() >= 0.5)).tobytes() for features, first, bad, _ in _arrays(batch)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(seeds, pa.binary())], ["features", "first", "bad", "seed"])

    return cut(coded.mapInArrow(run, "features binary, first binary, bad binary, seed binary"))


def _objective(coded: DataFrame, theta: np.ndarray, decay: np.ndarray) -> tuple[float, np.ndarray]:
    """Penalised negative log-likelihood of the sample and its gradient, summed over executors."""
    sent = coded.sparkSession.sparkContext.broadcast(theta)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        theta = sent.value
        value, gradient = 0.0, np.zeros_like(theta)
        for batch in batches:
            for features, first, _, truth in _arrays(batch):
                more, slope = likelihood(theta, features, first, truth.astype(np.int64))
                value += more
                gradient += slope
        at = np.flatnonzero(gradient)
        yield pa.RecordBatch.from_arrays([pa.array([value]), pa.array([at.astype("<i4").tobytes()], pa.binary()), pa.array([gradient[at].tobytes()], pa.binary())], ["value", "at", "gradient"])

    found = coded.mapInArrow(run, "value double, at binary, gradient binary").toArrow()
    value, gradient = 0.5 * float(decay @ theta**2), decay * theta
    for row in found.to_pylist():
        value -= row["value"]
        gradient[np.frombuffer(row["at"], "<i4")] -= np.frombuffer(row["gradient"])
    sent.destroy()
    return value, gradient


def _logistic(top: np.ndarray, total: np.ndarray, truth: np.ndarray, share: float) -> tuple[float, float, float]:
    """Newton's method with a ridge and steps of at most 1."""
    x = np.stack([np.ones_like(top), top, total], axis=1)
    w = np.array([np.log(share / (1 - share)), 0.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        ridge = np.diag([1e-3, 1.0, 1.0])
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge, x.T @ (truth - p) - ridge @ w)
        w = w + step / max(1.0, float(np.abs(step).max()))
    return tuple(float(v) for v in w)


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, score, spans array<struct<start, end, p>>): spans are character offsets of the runs of
    toxic tokens and the largest probability in each."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, offsets = text_bytes(batch.column("text"))
            words, start, end, p = model.tag(data, offsets)
            scores = _score(model, *_features(p, words))
            spans: list[list] = [[] for _ in range(batch.num_rows)]
            bad = np.flatnonzero(p >= 0.5)
            if len(bad):
                chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                row = words.doc[bad]
                opens = np.flatnonzero(np.concatenate([[True], (np.diff(bad) > 1) | (np.diff(row) > 0)]))
                closes = np.append(opens[1:], len(bad)) - 1
                tops = np.maximum.reduceat(p[bad], opens)
                base = chars[offsets[row[opens]]]
                places = zip(row[opens].tolist(), (chars[start[bad[opens]]] - base).tolist(), (chars[end[bad[closes]]] - base).tolist(), tops.tolist(), strict=True)
                for k, a, b, most in places:
                    spans[k].append({"start": a, "end": b, "p": most})
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(scores), pa.array(spans, kind)], ["id", "score", "spans"])

    kind = dict(docs.dtypes)[id_column]
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, score double, spans array<struct<start:long,end:long,p:double>>").withColumnRenamed("id", id_column)
