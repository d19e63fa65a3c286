"""Shared plumbing: checkpoints, code shipping and vectorised word arrays."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at once inside a task, in some 60 to 100 bytes of a worker's memory each.
SLICE_BYTES = 1_000_000

#: The white space of the word pattern [^\x20\x09-\x0D]+.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where that is unset a local master
    (as in tests) uses a folder of this machine, and any other is refused."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = f"file://{tempfile.gettempdir()}/tidemark-checkpoints"
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, what: str) -> str:
    """A fresh path below the shared folder, for a table that a job writes and rereads."""
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder, so that lost executors cost no recomputation and
    iterative plans stay short."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def cut_table(df: DataFrame) -> DataFrame:
    """Materialise as a table in the shared folder. What goes round in a loop must be cut so: a
    checkpoint keeps the estimated size of its plan, and each join multiplies the estimates of both sides,
    until the planner multiplies numbers of millions of digits; a table has the size it has."""
    folder = new_folder(df.sparkSession, "cut")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def cut_small(df: DataFrame) -> DataFrame:
    """cut_table() for what is small next to the corpus and cheap to make: in a twenty-fourth of the partitions, as
    every file of a shared folder costs a few calls of the file system, and on a local one two processes that Hadoop
    starts from the executor to set its mode and its checksum's. The rows are dealt anew for that, as a task of
    coalesce() would go through all these partitions of joins and sorts."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut_table(df.repartition(max(8, partitions // 24)))


#: A key is heavy if it has over 1 / HEAVY of all rows: there are HEAVY such keys at most.
HEAVY, LEAST_HEAVY, SALTS = 10_000, 200, 64


def heavy_keys(rows: DataFrame, key: str) -> DataFrame | None:
    """The keys that have over 1 / HEAVY of ``rows`` (which should be materialised), and at least
    LEAST_HEAVY of them; None without any. As there are HEAVY at most, they may be broadcast."""
    return heaviest(rows.groupBy(key).agg(F.count("*").alias("n")), key)


def heaviest(counted: DataFrame, key: str) -> DataFrame | None:
    """heavy_keys() of rows whose number per key is known: (key, n)."""
    most, total = counted.agg(F.max("n"), F.sum("n")).first()
    least = max(LEAST_HEAVY, (total or 0) // HEAVY)
    return None if (most or 0) <= least else cut(counted.where(F.col("n") > least).select(key).coalesce(1))


def join_small(rows: DataFrame, lookup: DataFrame, on: str, size: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``lookup`` of ``size`` rows, one a key: it is sent along if there are HEAVY at most."""
    if size <= HEAVY:
        return rows.join(F.broadcast(lookup), on, how)
    return join_spread(rows, lookup, [on], heavy_keys(rows, on), how)


def join_spread(rows: DataFrame, lookup: DataFrame, on: list[str], heavy: DataFrame | None, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``lookup``, which has few rows a key. The rows of ``heavy`` keys (a table of
    HEAVY rows at most, of one column that ``on`` holds) are dealt to SALTS shares, to each of which
    the lookup's rows of these keys are copied, so that no task gets all of a key."""
    if heavy is None:
        return rows.join(lookup, on, how)
    key = heavy.columns[0]
    hot = F.broadcast(heavy.withColumn("__hot", F.lit(True)))
    shares = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    copied = lookup.join(hot, key, "left").withColumn("__salt", F.explode(shares)).drop("__hot")
    others = [c for c in rows.columns if c not in on] or rows.columns
    salt = F.when(F.col("__hot"), F.pmod(F.xxhash64(*others), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    dealt = rows.join(hot, key, "left").withColumn("__salt", salt).drop("__hot")
    return dealt.join(copied, [*on, "__salt"], how).drop("__salt")


#: Bits of a sieve at most: what a broadcast of it takes doesn't grow beyond.
SIEVE = 1 << 24


def sift(rows: DataFrame, wanted: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` (wide ones) without most of those whose key isn't in ``wanted``, before a join that would shuffle them all. The bit of each wanted key
    is set in a table of at most SIEVE bits, which is sent along; rows whose bit isn't set go. None of a wanted key goes; of the others there stay
    one in sixteen or fewer, or more beyond SIEVE / 16 keys, so an exact join must follow."""
    bits = 1024
    while bits < min(SIEVE, 16 * wanted.count()):
        bits *= 2
    slot = F.pmod(F.xxhash64(*on), F.lit(bits))
    mask = F.expr("shiftleft(1L, cast(__slot & 63 AS int))")
    table = wanted.select(slot.alias("__slot")).groupBy(F.shiftright("__slot", 6).alias("__word")).agg(F.bit_or(mask).alias("__bits"))
    found = rows.withColumn("__slot", slot).withColumn("__word", F.shiftright("__slot", 6)).join(F.broadcast(table), "__word")
    return found.where(F.col("__bits").bitwiseAND(mask) != 0).select(*rows.columns)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application."""
    context = spark.sparkContext
    name = f"tidemark-{context.applicationId}"
    if any(name in str(p) for p in context._python_includes):
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    made = shutil.make_archive(os.path.join(tempfile.mkdtemp(), name), "zip", root, "tidemark")
    context.addPyFile(made)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows together and the rows' offsets; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], limit: int = SLICE_BYTES, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of about ``limit`` bytes of text, a row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_bytes(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (xor-shift and multiply, twice)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_BASE = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: Hashes of short strings that a Python worker has seen, ``_KEEP`` at most.
_SEEN: dict[bytes, int] = {}
_KEEP = 200_000


def numbered(packed: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Numbers of the byte strings that lie one after the other in ``packed``, equal for equal
    strings and for those only, and the distinct strings in the order of their numbers."""
    ends = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=ends[1:])
    strings = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(packed))])
    found = strings.dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary


def string_hashes(strings: pa.Array) -> np.ndarray:
    """64 bits of each string's BLAKE2 digest."""
    if len(_SEEN) > _KEEP:
        _SEEN.clear()
    items = strings.to_pylist()
    out = list(map(_SEEN.get, items))
    for i in [i for i, x in enumerate(out) if x is None]:
        out[i] = int.from_bytes(blake2b(items[i], digest_size=8).digest(), "little")
        if len(items[i]) <= 64:
            _SEEN[items[i]] = out[i]
    return np.array(out, np.uint64)


def packed_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The bytes of spans, one after the other."""
    size = end - start
    to = np.cumsum(size)
    return data[np.arange(int(to[-1]) if len(to) else 0) + np.repeat(start - (to - size), size)]


class Words:
    """The words of some texts as flat arrays: ``start``/``end`` byte positions, ``doc`` row
    numbers, ``first`` the number of the first word of each row (one more entry at the end)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.data, self.offsets = data, offsets
        inside = ~SPACE[data]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[offsets] = True
        opens, closes = inside.copy(), inside.copy()
        opens[1:] &= ~inside[:-1] | edge[1:-1]
        closes[:-1] &= ~inside[1:] | edge[1:-1]
        self.inside = inside
        self.start, self.end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.start)

    def numbers(self, lower: bool = False) -> tuple[np.ndarray, pa.Array]:
        """A number for each word, equal for equal words and for those only; and the distinct words."""
        packed = self.data[self.inside]
        return numbered(_LOWER[packed] if lower else packed, self.end - self.start)

    def hashes(self, lower: bool = False) -> np.ndarray:
        """64-bit hashes of the words' bytes."""
        number, strings = self.numbers(lower)
        return string_hashes(strings)[number]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hashes of the bytes of spans."""
    packed = packed_spans(data, start, end)
    number, strings = numbered(_LOWER[packed] if lower else packed, end - start)
    return string_hashes(strings)[number]


def gram_numbers(number: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """A number for each run of ``n`` neighbours of ``number`` that begins ``at`` a place, equal for equal
    runs and for those only."""
    out, many = number[at], int(number.max()) + 1 if len(number) else 1
    for i in range(1, n):
        out = np.unique(out * many + number[at + i], return_inverse=True)[1]
    return out


def ngram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` neighbours; the last n-1 places have none."""
    rest = len(hashes) - n + 1
    if rest <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(rest, np.uint64(n), np.uint64)
    for i in range(n):
        out = out * _BASE + hashes[i : i + rest]
    return mix64(out)
