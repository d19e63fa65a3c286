"""Language of web pages by Bayesian fusion of evidence.

Text: byte trigrams hashed to ``BINS`` classes, with add-one smoothed frequencies per language
learned from labelled documents. Declared markup language and address suffix (a language segment
of the path, else the last label of the host): how often each language, as the text tells it, goes
with each declared value. Host: what the other pages of the host say, smoothed towards the
registered domain, that towards the suffix, and that towards all pages. All these counts are
grouped aggregations over all pages; the sums of the logarithms give the posterior. Counts of up to
``HEAVY`` values are broadcast to the pages, others are joined with heavy values dealt to shares.

Defined results: a null or empty page has only the other evidence; a null address has no host,
domain or suffix evidence of its own and counts with the other such pages; repeated rows count
each; without pages or labelled documents the result is empty; further columns are ignored.
"""

from __future__ import annotations

import html
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.support import HEAVY, LEAST_HEAVY, cut, join_spread, ship, slices, text_bytes

BINS = 1 << 13
#: Labelled documents the text model learns from at most, the first by a hash of their id.
SAMPLE = 5_000
#: Pseudo-counts with which a level of the hierarchy holds on to the level above.
HOLD = 5.0
#: Calibration: neighbouring trigrams overlap and repeat, so a text weighs no more than so many
#: independent ones, however long it is.
INDEPENDENT = 60
#: Pseudo-count of each value that a language may go with.
EVEN = 0.5


def visible_text(page: Column) -> Column:
    """Text of a page: without comments, scripts, styles, head and tags; character entities stay."""
    out = F.coalesce(page, F.lit(""))
    for pattern in (r"(?s)<!--.*?-->", r"(?is)<(script|style|head|nav)\b.*?</\1\s*>", r"(?s)<[^>]*>", r"\s+"):
        out = F.regexp_replace(out, pattern, " ")
    return F.trim(out)


def _bins(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Trigram classes of all rows, and the row of each."""
    lower = data + 32 * ((data >= 65) & (data <= 90)).astype(np.uint8)
    b = lower.astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    code = ((code * np.uint32(2654435761)) >> np.uint32(32 - 13)).astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = row[:-2] == row[2:]
    return code[inside], row[:-2][inside]


@dataclass
class TextModel:
    languages: list[str]
    logs: np.ndarray  # [bin, language]


def fit_text(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", language_column: str = "lang", sample: int = SAMPLE) -> TextModel:
    ship(docs.sparkSession)
    rows = docs.where(F.col(language_column).isNotNull() & F.col(text_column).isNotNull())
    ids = rows.select(F.col(id_column).alias("id")).distinct().orderBy(F.xxhash64("id"), "id").limit(sample)
    picked = rows.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), F.col(language_column).alias("language")).join(F.broadcast(ids), "id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            code, row = _bins(*text_bytes(batch.column("text")))
            names, which = np.unique(np.array(batch.column("language").to_pylist()), return_inverse=True)
            counts = np.zeros((len(names), BINS), np.int64)
            np.add.at(counts, (which[row], code), 1)
            at = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(names[at[0]].tolist(), pa.string()), pa.array(at[1]), pa.array(counts[at])], ["language", "bin", "n"])

    found = picked.mapInArrow(count, "language string, bin long, n long").groupBy("language", "bin").agg(F.sum("n").alias("n")).collect()
    languages = sorted({r.language for r in found})
    counts = np.ones((BINS, len(languages)))
    for r in found:
        counts[r.bin, languages.index(r.language)] += r.n
    return TextModel(languages, np.log(counts / counts.sum(axis=0)))


def _text_logs(model: TextModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            plain = [html.unescape(x) if x and "&" in x else x for x in batch.column("text").to_pylist()]
            code, row = _bins(*text_bytes(pa.array(plain, pa.string())))
            sums = np.stack([np.bincount(row, model.logs[code, k], batch.num_rows) for k in range(len(model.languages))], axis=1)
            n = np.bincount(row, minlength=batch.num_rows)
            logs = sums * (np.minimum(n, INDEPENDENT) / np.maximum(n, 1))[:, None]
            rest = [batch.column(i) for i, x in enumerate(batch.schema.names) if x != "text"]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(list(logs), pa.list_(pa.float64()))], [*(x for x in batch.schema.names if x != "text"), "logs"])

    return run


def evidence(pages: DataFrame, id_column: str, url_column: str, html_column: str) -> DataFrame:
    """(id, host, domain, suffix, declared, text) of each page."""
    url, page = F.lower(F.col(url_column)), F.col(html_column)
    host = F.regexp_extract(url, r"^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)
    segment = F.regexp_extract(url, r"^[a-z][a-z0-9+.-]*://[^/?#]*/([a-z]{2})(?:[-_][a-z]{2})?(?:[/?#]|$)", 1)
    last = F.regexp_extract(host, r"([^.]+)$", 1)
    declared = F.regexp_extract(F.lower(page), r"<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", 1)
    return pages.select(
        F.col(id_column).alias("id"), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1), F.lit("")).alias("domain"),
        F.coalesce(F.when(segment != "", F.concat(F.lit("/"), segment)).otherwise(last), F.lit("")).alias("suffix"), F.coalesce(declared, F.lit("")).alias("declared"), visible_text(page).alias("text"),
    )


def identify(pages: DataFrame, model: TextModel, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """(id, lang, probability, text_lang, declared, suffix, host) per page."""
    ship(pages.sparkSession)
    languages = model.languages
    kind = dict(pages.dtypes)[id_column]
    if not languages:
        return pages.sparkSession.createDataFrame([], f"{id_column} {kind}, lang string, probability double, text_lang string, declared string, suffix string, host string")
    seen = evidence(pages, id_column, url_column, html_column)
    told = cut(seen.mapInArrow(_text_logs(model), f"id {kind}, host string, domain string, suffix string, declared string, logs array<double>"))
    number = lambda c: F.array_position(c, F.array_max(c)).cast("int") - 1
    told = told.withColumn("text_at", number(F.col("logs")))
    votes = [F.count_if(F.col("text_at") == k).cast("double") for k in range(len(languages))]

    def counts(*keys: str) -> DataFrame:
        return told.groupBy(*keys).agg(F.array(*votes).alias("n_" + keys[-1]))

    every = told.agg(F.array(*votes).alias("n")).first()["n"] or [0.0] * len(languages)
    total = sum(every)
    top = [(n + 1) / (total + len(languages)) for n in every]
    size = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    out, values = told, {}
    for key in ("suffix", "domain", "host", "declared"):
        known = cut(counts(key))
        values[f"n_{key}"] = known.count()
        if values[f"n_{key}"] <= HEAVY:
            out = out.join(F.broadcast(known), key)
        else:
            heavy = cut(known.where(size(F.col(f"n_{key}")) > max(LEAST_HEAVY, total // HEAVY)).select(key).repartition(1))  # HEAVY values at most
            out = join_spread(out, known, [key], None if heavy.isEmpty() else heavy)
    own = [F.when(F.col("text_at") == k, 1.0).otherwise(0.0) for k in range(len(languages))]
    scores = []
    for k in range(len(languages)):
        prior = F.lit(top[k])
        for key in ("n_suffix", "n_domain", "n_host"):  # without the page itself
            prior = (F.col(key)[k] - own[k] + HOLD * prior) / (size(F.col(key)) - 1 + HOLD)
        value = F.col("logs")[k] + F.log(prior)
        for key in ("n_declared", "n_suffix"):  # P(value | language), without the page itself
            value = value + F.log((F.col(key)[k] - own[k] + EVEN) / (every[k] - own[k] + EVEN * values[key]))
        scores.append(value)
    out = out.withColumn("scores", F.array(*scores))
    best = F.array_max("scores")
    chance = 1 / F.aggregate("scores", F.lit(0.0), lambda a, x: a + F.exp(x - best))
    name = lambda at: F.element_at(F.array(*map(F.lit, languages)), at + 1)
    return out.select(F.col("id").alias(id_column), name(number(F.col("scores"))).alias("lang"), chance.alias("probability"), name(F.col("text_at")).alias("text_lang"), "declared", "suffix", "host")
