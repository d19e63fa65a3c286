"""Near duplicates: banded MinHash candidates, sequential Bayesian verification, exact check.

1. A text's set is its distinct word n-grams; texts whose sets have equal digests are one node.
2. Nodes that share a band of their MinHash signature are candidates. At similarity s a pair
   shares one of ``b`` bands of ``r`` rows with probability 1 - (1 - s**r)**b; with 24 bands of 4
   rows two in a hundred million pairs of similarity 0.85 share none.
3. Candidates are compared by batches of their signatures. With m of n values equal, the
   similarity has the posterior Beta(m + 1, n - m + 1); a pair is dropped once the posterior
   probability of reaching the threshold is below ``miss``. Survivors are checked on the full sets
   of their texts' words; hashes only find them.
4. Within a bucket no pairs are listed but these: every member with the bucket's first member;
   then the members that the links so far do not join. In buckets of more than
   ``SMALL`` members these are few too: pairs that share a gram which at most ``RARE`` candidates
   have are found by that gram; in all other pairs such grams of x are missing from y, so
   |x & y| <= |x| - rare(x), which leaves x only partners of a certain size, or none; members are
   met by classes of size. Neither loses a link.

Defined results: texts without words have an empty set and are linked with nothing; texts with
fewer words than ``n`` have their whole sequence as one gram; null counts as empty; rows that
share an id are one document, linked if any of its texts is; a row without an id is linked with
nothing and has no component; an empty table gives an empty result; further columns are ignored.
A text's set is made whole within a task, in some 60 bytes of memory a character.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.graph import components
from tidemark.llm.support import HEAVY, LEAST_HEAVY, SALTS, SLICE_BYTES, Words, cut, cut_small, gram_numbers, heaviest, heavy_keys, join_spread, mix64, ngram_hashes, ship, sift, slices, text_bytes

BANDS, ROWS, BATCH = 24, 4, 16
MISS = 1e-6
SMALL, RARE = 32, 64
#: Classes of size: a factor of 1.05 each.
SIZE_STEP = math.log(1.05)


@lru_cache(maxsize=2)
def _permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    seed = mix64(np.arange(1, 2 * count + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))
    return seed[:count] | np.uint64(1), seed[count:]


def signature(grams: np.ndarray, count: int) -> np.ndarray:
    """MinHash values (32 bits each) of a set of hashes."""
    factor, shift = _permutations(count)
    low = np.full(count, np.uint64(2**64 - 1))
    for at in range(0, len(grams), 1024):
        low = np.minimum(low, (grams[None, at : at + 1024] * factor[:, None] + shift[:, None]).min(axis=1))
    return (mix64(low) >> np.uint64(32)).astype("<u4")


def gram_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct n-grams of each row, lower-cased."""
    words = Words(data, offsets)
    hashes = words.hashes(lower=True)
    grams = ngram_hashes(hashes, n)
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= n:
            yield np.unique(grams[a : b - n + 1])
        elif b > a:
            yield ngram_hashes(hashes[a:b], b - a)
        else:
            yield np.zeros(0, np.uint64)


def _signed(n: int, count: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            size, digest, signed = [], [], []
            for grams in gram_sets(*text_bytes(batch.column("text")), n):
                size.append(len(grams))
                digest.append(hashlib.blake2b(grams.tobytes(), digest_size=16).digest())
                signed.append(signature(grams, count).tobytes() if len(grams) else b"")
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("mark"), pa.array(size, pa.int64()), pa.array(digest, pa.binary()), pa.array(signed, pa.binary())], ["id", "mark", "size", "digest", "signed"])

    return run


@lru_cache(maxsize=8)
def least_matches(threshold: float, count: int, batch: int, miss: float) -> tuple[int, ...]:
    """Per batch of compared values: the fewest equal ones with which a pair may go on."""
    out = []
    for n in range(batch, count + 1, batch):
        # P(similarity >= t | m of n) = P(Binomial(n + 1, t) <= m) for a uniform prior
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return tuple(out)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, width)


def _prune(threshold: float, count: int, miss: float):
    least = least_matches(threshold, count, BATCH, miss)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            one, two = _matrix(batch.column("sa"), count), _matrix(batch.column("sb"), count)
            alive, equal = np.arange(len(one)), np.zeros(len(one), np.int64)
            for i, fewest in enumerate(least):
                part = slice(i * BATCH, (i + 1) * BATCH)
                equal[alive] += (one[alive, part] == two[alive, part]).sum(axis=1)
                alive = alive[equal[alive] >= fewest]
            yield batch.select(["a", "b"]).take(pa.array(alive))

    return run


def common_grams(one: pa.Array, two: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each pair of texts with ``n`` words at least: the sizes of their sets and of what these share,
    compared word by word."""
    pairs = len(one)
    words = Words(*text_bytes(pa.concat_arrays([one, two])))
    at = np.flatnonzero(words.doc[: len(words) - n + 1] == words.doc[n - 1 :]) if len(words) >= n else np.zeros(0, np.int64)
    gram = gram_numbers(words.numbers(lower=True)[0], at, n)
    many = int(gram.max()) + 1 if len(gram) else 1
    distinct = np.unique(words.doc[at] * many + gram)  # ordered by text
    doc = distinct // many
    size = np.bincount(doc, minlength=2 * pairs)
    both = np.intersect1d(distinct[doc < pairs], distinct[doc >= pairs] - pairs * many, assume_unique=True)
    return size[:pairs], size[pairs:], np.bincount(both // many, minlength=pairs)


def _verify(n: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bytes_ = np.cumsum([len(x.as_buffer()) + len(y.as_buffer()) for x, y in zip(batch.column("ta"), batch.column("tb"), strict=True)])
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(bytes_, (bytes_[at - 1] if at else 0) + SLICE_BYTES, "right")))
                part = batch.slice(at, to - at)
                one, two, both = common_grams(part.column("ta"), part.column("tb"), n)
                yield part.select(["a", "b"]).take(pa.array(np.flatnonzero((both > 0) & (100 * both >= percent * (one + two - both)))))
                at = to

    return run


def _two(nodes: DataFrame, pairs: DataFrame, heavy: dict[str, DataFrame | None], **columns: str) -> DataFrame:
    """``pairs`` (materialised) with columns of both nodes: ``_two(.., s="signed")`` adds sa and sb."""
    ends = {end: pairs.select(F.col(end).alias("node")).distinct() for end in ("a", "b")}
    for end in ("a", "b"):
        found = sift(nodes, ends[end], ["node"]).select(F.col("node").alias(end), *(F.col(c).alias(f"{x}{end}") for x, c in columns.items()))
        pairs = join_spread(pairs, found, [end], heavy[end])
    return pairs


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", n: int = 3, percent: int = 85, bands: int = BANDS, rows: int = ROWS, miss: float = MISS) -> DataFrame:
    """(id, n_shingles, component_id, kept) per row. ``percent``: least similarity of a link."""
    ship(docs.sparkSession)
    count, t = bands * rows, percent / 100
    kind = dict(docs.dtypes)[id_column]
    docs = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    marked = docs.withColumn("mark", F.xxhash64("text"))  # tells texts of one id apart
    signed = cut(marked.mapInArrow(_signed(n, count), f"id {kind}, mark long, size long, digest binary, signed binary"))
    usable = signed.where("id is not null and size > 0")
    classes = usable.groupBy("digest").agg(F.min("id").alias("node"))
    first = usable.join(classes.withColumnRenamed("node", "id"), ["digest", "id"], "left_semi").withColumnRenamed("id", "node")
    nodes = cut(first.dropDuplicates(["node", "digest"]))

    band = [F.xxhash64(F.lit(i), F.expr(f"substring(signed, {4 * rows * i + 1}, {4 * rows})")) for i in range(bands)]
    banded = nodes.select("node", "size", F.explode(F.array(*band)).alias("key"))
    shared = cut(banded.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last"), F.count("*").alias("n")).where("first <> last").select("key", "first", "n"))
    heavy = heaviest(shared.select("key", "n"), "key")
    members = cut(join_spread(banded, shared.select("key", "first"), ["key"], heavy).select("key", "first", "node", "size"))

    # only nodes with candidates are shuffled for their pairs; no semi-joins: Spark would move them below the sieve
    seen = cut_small(members.select("node").distinct())
    nodes = cut(sift(nodes, seen, ["node"]).join(seen, "node"))
    wanted = cut_small(nodes.select(F.col("node").alias("id"), "mark").distinct())
    texts = cut(sift(marked, wanted, ["id", "mark"]).join(wanted, ["id", "mark"]).dropDuplicates(["id", "mark"]).select(F.col("id").alias("node"), "text"))

    def links(pairs: DataFrame, both: bool) -> DataFrame:
        """``both``: whether b may be heavy as well as a."""
        pairs = cut_small(pairs)
        heavy = {"a": heavy_keys(pairs, "a"), "b": heavy_keys(pairs, "b") if both else None}
        near = _two(nodes, pairs, heavy, s="signed", z="size").where(100 * F.least("za", "zb") >= percent * F.greatest("za", "zb"))
        alive = cut_small(near.mapInArrow(_prune(t, count, miss), f"a {kind}, b {kind}"))
        return cut(_two(texts, alive, heavy, t="text").mapInArrow(_verify(n, percent), f"a {kind}, b {kind}"))

    # a node is the second of such a pair once per band at most
    found = links(members.where("first <> node").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct(), both=False)
    salted = usable.select("id", "size", "digest", F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt"))
    known = salted.select("digest", "salt").distinct().join(classes, "digest")
    placed = cut(salted.join(known, ["digest", "salt"]).select("id", "size", "node"))
    again = placed.groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select("id", "a")
    twice = placed.join(again, "id").where("a <> node").select("a", F.col("node").alias("b")).distinct()
    rest = links(_remaining(members, _towards(found), texts, heavy, n, percent), both=True)
    root = cut_small(components(found.unionByName(rest).unionByName(twice)))
    low = root.groupBy("root").agg(F.min("node").alias("component_id"))
    named = cut_small(join_spread(root, low, ["root"], heavy_keys(root, "root")).select("node", "component_id"))
    some = join_spread(placed, named, ["node"], heavy_keys(placed, "node"), "left").select("id", "size", F.coalesce("component_id", "node").alias("component_id"))
    none = signed.where("id is null or size = 0").select("id", "size", F.col("id").alias("component_id"))
    return some.unionByName(none).select(F.col("id").alias(id_column), F.col("size").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _towards(links: DataFrame) -> DataFrame:
    """(node, root): a node that two steps along links to ever smaller neighbours lead to. Equal
    roots are in one component; the others may be or not."""
    step = links.groupBy(F.greatest("a", "b").alias("node")).agg(F.min(F.least("a", "b")).alias("to"))
    onward = step.select(F.col("node").alias("to"), F.col("to").alias("root"))
    return step.join(onward, "to", "left").select("node", F.coalesce("root", "to").alias("root"))


def _remaining(members: DataFrame, root: DataFrame, texts: DataFrame, heavy: DataFrame | None, n: int, percent: int) -> DataFrame:
    """Pairs of candidates that are in different components yet, and may be linked."""
    placed = members.join(root, "node", "left").select("key", "node", "size", F.coalesce("root", "node").alias("root"))
    per = placed.groupBy("key", "root").agg(F.count("*").alias("n"))
    keys = per.groupBy("key").agg(F.max(F.struct("n", "root"))["root"].alias("main"), F.sum("n").alias("all"), F.count("*").alias("roots")).where("roots > 1").drop("roots")
    open_ = cut_small(join_spread(placed, keys, ["key"], heavy))
    large = open_.where(F.col("all") > SMALL)

    # grams that at most RARE candidates of the large buckets have
    kind = dict(texts.dtypes)["node"]
    inside = large.select("node", "root", "size").distinct()
    grams = cut(texts.join(inside.select("node"), "node", "left_semi").mapInArrow(_one_by_one(n), f"node {kind}, gram long"))
    counted = cut(grams.groupBy("gram").agg(F.count("*").alias("n")))
    common = counted.where(F.col("n") > max(RARE, LEAST_HEAVY, grams.count() // HEAVY)).select("gram")  # HEAVY grams at most
    rare = cut_small(grams.join(F.broadcast(common), "gram", "left_anti").join(counted.where(F.col("n") <= RARE), "gram"))
    own = rare.groupBy("node").agg(F.count("*").alias("own"))
    one = rare.where("n > 1").select("gram", "node").join(inside, "node").select("gram", F.col("node").alias("a"), F.col("root").alias("ra"), F.col("size").alias("za"))
    two = one.select("gram", F.col("a").alias("b"), F.col("ra").alias("rb"), F.col("za").alias("zb"))
    close = 100 * F.least("za", "zb") >= percent * F.greatest("za", "zb")
    sharing = one.join(two, "gram").where((F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb")) & close).select("a", "b")
    least = percent / 100
    most = F.floor((F.col("size") - F.coalesce("own", F.lit(0))) * ((1 + least) / least) + 1e-6) - F.col("size")
    bounded = large.join(own, "node", "left").select("key", "node", "size", "root", "main", most.alias("most")).where(100 * F.col("most") >= percent * F.col("size"))
    buckets = large.groupBy("node").agg(F.sort_array(F.collect_set("key")).alias("keys"))  # one per band at most
    large = cut_small(bounded.join(buckets, "node"))

    def met(one: DataFrame, two: DataFrame, on: list[str], more) -> DataFrame:
        left = one.select(*[c for c in on if c in one.columns], F.col("node").alias("x"), F.col("root").alias("rx"), F.col("size").alias("zx"), *(F.col(c).alias(f"{c}x") for c in ["most", "keys"] if c in one.columns))
        right = two.select(*on, F.col("node").alias("y"), F.col("root").alias("ry"), F.col("size").alias("zy"), (F.col("root") == F.col("main")).alias("in_main"), *(F.col(c).alias(f"{c}y") for c in ["most", "keys"] if c in two.columns))
        differ = (F.col("rx") != F.col("ry")) & (F.col("in_main") | (F.col("x") < F.col("y"))) & (100 * F.least("zx", "zy") >= percent * F.greatest("zx", "zy"))
        return join_spread(right, left, on, heavy).where(differ & more).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))

    small = open_.where(F.col("all") <= SMALL)
    few = met(small.where("root <> main"), small, ["key"], F.lit(True))
    step = lambda c: F.floor(F.log(c) / SIZE_STEP).cast("int")
    spread = large.where("root <> main").withColumn("step", F.explode(F.sequence(step(F.col("size") * least), step(F.least(F.col("most"), F.col("size") / least) + 1))))
    classed = large.withColumn("step", step(F.col("size")))
    many = met(spread.select("key", "step", "node", "size", "root", "most", "keys"), classed, ["key", "step"], (F.col("zy") <= F.col("mostx")) & (F.col("zx") <= F.col("mosty")) & (F.array_min(F.array_intersect("keysx", "keysy")) == F.col("key")))
    return cut_small(few).unionByName(cut_small(many)).unionByName(cut_small(sharing)).distinct()


def _one_by_one(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = list(gram_sets(*text_bytes(batch.column("text")), n))
            node = batch.column("node").take(pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found])))
            yield pa.RecordBatch.from_arrays([node, pa.array(np.concatenate(found).view(np.int64))], ["node", "gram"])

    return run
