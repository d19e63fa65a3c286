"""Spelling variants: words that differ by one code point, found by two-dimensional range reporting.

If two words differ by one code point at place i, both have the i code points before it and all
that follow it, T - 1 together, T being the longer one's length. In the lexicon's forward order the words
with that beginning are an interval, in the order of the reversed words those with that ending are
one, and the words in both are the word itself and its partners at that place, nothing else. A wavelet
tree over the reverse ranks in forward order reports them.

The lexicon is spread by what partners share. A group (T, a, b) holds words of lengths T and T - 1 with
the same a first and T - b last code points, and answers for places a to b - 1. Every word is in the groups of both
halves of the places, for its own length and the next. Groups over ``CELLS`` code points are cut
in two by their places, each half with a longer common part, until they fit; a group of one place holds
one word per code point of the alphabet at most, so this ends however hot a beginning or an ending is. Whole
groups are put together to trees of about ``CELLS``, and each word's partners become a count and
a best one where they are found: pairs never travel. An insertion in a run of equal code points counts
at the last of the places it may have, so each partner is found once.

Defined results: null and empty texts have no words; a null id is written as nothing in what chooses the
deletions; repeated rows count as often as they occur; an empty table gives an empty
result; further columns are ignored. Equally frequent forms: the first in the order of code points. Texts
are split in SQL functions, a row at a time; a run of letters may have any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.support import cut, cut_small, cut_table, heavy_keys, join_small, join_spread, ship
from tidemark.llm.wavelet import WaveletTree

#: Code points of words in one tree, and rectangles answered at a time.
CELLS, RECTANGLES = 400_000, 100_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOUND = "word string, n_near long, best_n long, best string"


def lexicon(docs: DataFrame, least: int = 7, often: int = 2, every: int = 31) -> DataFrame:
    """(word, n): lower-cased runs of letters, one in ``every`` of them less a code point by a checksum of its row's
    id and itself, of ``least`` code points that occur ``often`` or oftener."""
    runs = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(f"[a-zÀ-ÿ]{{{least},}}"), 0)
    said = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(runs).alias("run"))
    drawn = said.select("run", F.crc32(F.concat("doc", F.lit(":"), "run")).alias("h"), F.length("run").alias("size"))
    at = (F.col("h") % F.col("size")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.col("size")))
    word = F.when(F.col("h") % every == 0, less).otherwise(F.col("run"))
    return drawn.select(word.alias("word")).where(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= often)


def with_group(rows: DataFrame) -> DataFrame:
    """``rows`` (word, n, t, a, b) with the hash ``g`` of what the words of a group share."""
    ending = F.col("t") - F.col("b")
    shared = F.substring("word", F.lit(1), F.col("a")), F.substring("word", F.length("word") - ending + 1, ending)
    return rows.withColumn("g", F.xxhash64("t", "a", "b", *shared))


def halves(rows: DataFrame) -> DataFrame:
    """Each row of places a to b - 1 as two, of the first half and the rest."""
    middle = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
    parts = F.array(F.struct(F.col("a"), middle.alias("b")), F.struct(middle.alias("a"), F.col("b")))
    return with_group(rows.select("word", "n", "t", F.explode(parts).alias("p")).select("word", "n", "t", "p.a", "p.b"))


def groups(words: DataFrame, cells: int = CELLS) -> DataFrame:
    """(word, n, t, a, b, g): the rows of all groups, none of more than ``cells`` code points but those of one place."""
    size = F.length("word")
    todo = halves(words.select("word", "n", F.explode(F.array(size, size + 1)).alias("t"), F.lit(0).alias("a")).withColumn("b", F.col("t")))
    ready: DataFrame | None = None
    while True:
        counted = todo.groupBy("g").agg(F.sum(F.col("t").cast("long")).alias("cells"), F.max(F.col("b") - F.col("a")).alias("places"))
        large = cut(counted.where((F.col("cells") > cells) & (F.col("places") > 1)).select("g", F.lit(True).alias("large")))
        many = large.count()
        if many:
            todo = join_small(todo, large, "g", many, "left")
        fit = todo.where("large IS NULL").drop("large") if many else todo
        ready = fit if ready is None else ready.unionByName(fit)
        if not many:
            return ready
        todo = cut_table(halves(todo.where("large")))


def common(rows: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Of sorted rows: how many first code points each has in common with the one before, -1 where a group begins; -1 at the end."""
    out = np.full(len(rows) + 1, -1, np.int64)
    differ = rows[1:] != rows[:-1]
    same = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    out[1:-1] = np.where(group[1:] == group[:-1], same, -1)
    return out


def intervals(shared: np.ndarray, at: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Around each place ``at``, the interval whose neighbours have ``least`` code points in common: by doubling
    steps over the minima of runs of powers of two."""
    minima, step = [shared], 1
    while 2 * step < len(shared):
        last = minima[-1]
        longer = np.full(len(shared), -1, np.int64)
        longer[:-step] = np.minimum(last[:-step], last[step:])
        minima.append(longer)
        step *= 2
    lo, hi = at.copy(), at + 1
    for k in reversed(range(len(minima))):
        far = lo - (1 << k) + 1
        ok = (far >= 0) & (minima[k][np.maximum(far, 0)] >= least)
        lo = np.where(ok, lo - (1 << k), lo)
        ok = (hi < len(shared)) & (minima[k][np.minimum(hi, len(shared) - 1)] >= least)
        hi = np.where(ok, hi + (1 << k), hi)
    return lo, hi


def matrix(words: list[str], size: np.ndarray, width: int) -> np.ndarray:
    """Code points, a row per word, then a number that is none."""
    out = np.full((len(words), width), 0xFFFFFFFF, np.uint32)
    out[np.arange(width) < size[:, None]] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
    return out


def partners(words: list[str], n: np.ndarray, t: np.ndarray, a: np.ndarray, b: np.ndarray, group: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Of whole groups in forward order, several times: (word's row, partners, most frequent one's row)."""
    size = np.array([len(w) for w in words])
    width = int(t.max())
    turned = [w[::-1] for w in words]
    order = np.array(sorted(range(len(words)), key=lambda j: (group[j], turned[j])))
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    letters = matrix(words, size, width)
    ahead = common(letters, group)
    behind = common(matrix([turned[j] for j in order], size[order], width), group[order])
    tree = WaveletTree(rank)
    # a place can have partners only if a neighbour in forward order has all before it, and one in reverse order all after it
    first = np.maximum(a, t - 1 - np.maximum(behind[rank], behind[rank + 1]))
    beyond = np.minimum(b, np.maximum(ahead[:-1], ahead[1:]) + 1)
    many = np.maximum(0, beyond - first)
    ends = np.cumsum(many)
    for start in range(0, int(ends[-1]), RECTANGLES):
        number = np.arange(start, min(start + RECTANGLES, int(ends[-1])))
        row = np.searchsorted(ends, number, "right")
        at = first[row] + number - (ends[row] - many[row])
        lo, hi = intervals(ahead, row, at)
        low, high = intervals(behind, rank[row], t[row] - 1 - at)
        query, value = tree.report(lo, hi, low, high)
        here, there, at = row[query], order[value], at[query]
        longer = np.where(size[here] >= size[there], here, there)
        next_to = letters[longer, np.minimum(at + 1, width - 1)]
        last = (at + 1 >= t[here]) | (letters[longer, at] != next_to)
        real = (here != there) & ((size[here] == size[there]) | last)
        here, there = here[real], there[real]
        by = np.lexsort((there, -n[there], here))
        here, there = here[by], there[by]
        found, begin, count = np.unique(here, return_index=True, return_counts=True)
        yield found, count, there[begin]


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by group, in tables of whole groups with two rows or more, of about ``CELLS`` code points each."""
    held: list[pa.Table] = []
    rows = 0

    def dealt(table: pa.Table, whole: bool) -> Iterator[pa.Table]:
        keys = np.stack([table.column(c).to_numpy() for c in ("t", "a", "b", "g")])
        starts = np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)))
        ends = np.append(starts[1:], table.num_rows)
        if not whole:  # the last group may go on
            held.append(table.slice(int(starts[-1])))
            starts, ends = starts[:-1], ends[:-1]
        some = ends - starts > 1
        begin, cells = 0, 0
        starts, ends = starts[some], ends[some]
        for i, (s, e) in enumerate(zip(starts, ends)):
            more = int(e - s) * int(keys[0, s])
            if i > begin and cells + more > CELLS:
                yield pa.concat_tables([table.slice(x, y - x) for x, y in zip(starts[begin:i], ends[begin:i])])
                begin, cells = i, 0
            cells += more
        if begin < len(starts):
            yield pa.concat_tables([table.slice(x, y - x) for x, y in zip(starts[begin:], ends[begin:])])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        rows += batch.num_rows
        if rows >= 50_000:
            table = pa.concat_tables(held)
            held.clear()
            yield from dealt(table, False)
            rows = held[0].num_rows
    if held:
        table = pa.concat_tables(held)
        held.clear()
        yield from dealt(table, True)


def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow() of rows sorted by group and word: of each word with partners how many, and the best one."""
    for table in whole_groups(batches):
        words = table.column("word").to_pylist()
        n, t, a, b = (table.column(c).to_numpy().astype(np.int64) for c in ("n", "t", "a", "b"))
        keys = np.stack([t, a, b, table.column("g").to_numpy()])
        group = np.cumsum(np.append(0, (keys[:, 1:] != keys[:, :-1]).any(axis=0)))
        for found, count, best in partners(words, n, t, a, b, group):
            columns = [pa.array([words[i] for i in found], pa.string()), pa.array(count, pa.int64()), pa.array(n[best], pa.int64()), pa.array([words[i] for i in best], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["word", "n_near", "best_n", "best"])


def near(words: DataFrame, cells: int = CELLS) -> DataFrame:
    """Of each word of (word, n) that has words at distance one: (word, n_near, best_n, best)."""
    ship(words.sparkSession)
    rows = groups(words, cells)
    dealt = rows.repartition("g").sortWithinPartitions("t", "a", "b", "g", "word")
    found = dealt.mapInArrow(report, FOUND)
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("m")).select("word", "n_near", (-F.col("m.less")).alias("best_n"), "m.best")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form), by doubling: every form is far more frequent than its word, so the way is short."""
    steps = cut_table(forms.select("word", F.col("form").alias("root")))
    while True:
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = join_spread(steps, further, ["root"], heavy_keys(steps, "root"), "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        moved = cut_small(moved)
        steps = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return steps


def variants(words: DataFrame, factor: int = 10, cells: int = CELLS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of (word, n), distinct words. A form is the most frequent near word, if it
    is ``factor`` times as frequent."""
    words = cut_table(words)
    is_form: Column = F.col("best_n") >= factor * F.col("n")
    known = words.join(near(words, cells), "word", "left").withColumns({"form": F.when(is_form, F.col("best")), "form_n": F.when(is_form, F.col("best_n"))})
    known = cut_table(known.select("word", "form", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_n"))
    found = roots(known.where("form IS NOT NULL"))
    return known.join(found, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
