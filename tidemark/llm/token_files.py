"""Token ids on disk as patched frame-of-reference blocks.

A file is a Parquet table of segments. A segment holds the ids of whole documents, at least
``SEGMENT_IDS`` ids where there are so many, in blocks of ``BLOCK`` ids: the block's minimum
is subtracted, the rest is packed at the bit width that the chosen percentile of the block
needs, and higher bits of the outliers go to an exception list. ``block_start`` indexes where
each block begins in ``packed``, so a document is read without the blocks before it.
Segments are in ascending order of document id within a part, and parts are in order.

Defined results: a null or empty text has its end id only; rows that repeat are kept, next to
one another; an empty table gives no segments; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.support import ship, slices, text_bytes
from tidemark.llm.tokens import piece_encoder

BLOCK = 128
SEGMENT_IDS = 131_072
PERCENTILE = 90

#: part and seg order the segments; at: ids of the same part before the segment.
SEGMENT = "part int, seg int, at long, n_ids long, doc_ids array<long>, sizes array<long>, minimum binary, width binary, block_start binary, packed binary, exception_block binary, exception_place binary, exception_high binary"


def _pack_words(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of 64 values below 2**width as rows of ``width`` 64-bit words."""
    out = np.zeros((len(values), width), np.uint64)
    for i in range(64):
        word, shift = divmod(i * width, 64)
        out[:, word] |= values[:, i] << np.uint64(shift)
        if shift + width > 64:
            out[:, word + 1] |= values[:, i] >> np.uint64(64 - shift)
    return out


def _unpack_words(words: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(words), 64), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for i in range(64):
        word, shift = divmod(i * width, 64)
        value = words[:, word] >> np.uint64(shift)
        if shift + width > 64:
            value = value | (words[:, word + 1] << np.uint64(64 - shift))
        out[:, i] = value & mask
    return out


def _bits(x: np.ndarray) -> np.ndarray:
    """How many bits numbers below 2**32 need."""
    return np.frexp(x.astype(np.float64))[1].astype(np.int64)


def pack_blocks(ids: np.ndarray, percentile: int = PERCENTILE) -> dict[str, bytes]:
    """Patched frame-of-reference blocks of some ids."""
    count = -(-len(ids) // BLOCK)
    full = np.zeros(count * BLOCK, np.uint64)
    full[: len(ids)] = ids
    if count:
        full[len(ids) :] = full[len(ids) - 1]
    full = full.reshape(count, BLOCK)
    low = full.min(axis=1) if count else np.zeros(0, np.uint64)
    rest = full - low[:, None]
    bits = _bits(rest)
    at = min(BLOCK - 1, BLOCK * percentile // 100)
    width = np.partition(bits, at, axis=1)[:, at] if count else np.zeros(0, np.int64)
    block, place = np.nonzero(bits > width[:, None])
    high = (rest[block, place] >> width[block].astype(np.uint64)).astype("<u4")
    words = 2 * width
    start = np.concatenate([[0], np.cumsum(words)])
    packed = np.zeros(int(start[-1]), np.uint64)
    for w in np.unique(width):
        if w:
            some = np.flatnonzero(width == w)
            masked = (rest[some] & np.uint64((1 << int(w)) - 1)).reshape(-1, 64)
            packed[(start[some][:, None] + np.arange(2 * w)).ravel()] = _pack_words(masked, int(w)).ravel()
    return {
        "minimum": low.astype("<u4").tobytes(), "width": width.astype(np.uint8).tobytes(), "block_start": start.astype("<u4").tobytes(), "packed": packed.astype("<u8").tobytes(),
        "exception_block": block.astype("<u4").tobytes(), "exception_place": place.astype(np.uint8).tobytes(), "exception_high": high.tobytes(),
    }


def unpack_blocks(segment: dict, n_ids: int) -> np.ndarray:
    """The ids that pack_blocks() was given."""
    low, width = np.frombuffer(segment["minimum"], "<u4").astype(np.uint64), np.frombuffer(segment["width"], np.uint8)
    start, packed = np.frombuffer(segment["block_start"], "<u4").astype(np.int64), np.frombuffer(segment["packed"], "<u8")
    out = np.zeros((len(low), BLOCK), np.uint64)
    for w in np.unique(width):
        if w:
            some = np.flatnonzero(width == w)
            words = packed[(start[some][:, None] + np.arange(2 * int(w))).ravel()].reshape(-1, int(w))
            out[some] = _unpack_words(words, int(w)).reshape(-1, BLOCK)
    block, place = np.frombuffer(segment["exception_block"], "<u4"), np.frombuffer(segment["exception_place"], np.uint8)
    out[block, place] |= np.frombuffer(segment["exception_high"], "<u4").astype(np.uint64) << width[block].astype(np.uint64)
    return (out + low[:, None]).ravel()[:n_ids].astype(np.uint32)


_ARROW = pa.schema(
    [("part", pa.int32()), ("seg", pa.int32()), ("at", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64()))]
    + [(x, pa.binary()) for x in ("minimum", "width", "block_start", "packed", "exception_block", "exception_place", "exception_high")]
)


def _segments(path: str, end_id: int, segment_ids: int, percentile: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = piece_encoder(path), TaskContext.get().partitionId()
        seg = at = held = 0
        doc_ids: list = []
        sizes: list = []
        flat: list[np.ndarray] = []

        def done() -> pa.RecordBatch:
            ids = np.concatenate(flat)
            row = {"part": part, "seg": seg, "at": at, "n_ids": len(ids), "doc_ids": doc_ids, "sizes": sizes}
            return pa.RecordBatch.from_pylist([row | pack_blocks(ids, percentile)], schema=_ARROW)

        for batch in slices(batches):
            data, offsets = text_bytes(batch.column("text"))
            ids, size = encoder.encode(data, offsets)
            ends = np.cumsum(size)
            ids = np.insert(ids, ends, np.uint32(end_id))
            flat.append(ids)
            doc_ids += batch.column("doc_id").to_pylist()
            sizes += (size + 1).tolist()
            held += len(ids)
            if held >= segment_ids:
                yield done()
                seg, at, held, doc_ids, sizes, flat = seg + 1, at + held, 0, [], [], []
        if doc_ids:
            yield done()

    return run


def write(docs: DataFrame, folder: str, path: str, end_id: int, id_column: str = "doc_id", text_column: str = "text", segment_ids: int = SEGMENT_IDS, percentile: int = PERCENTILE) -> None:
    """Encode, append ``end_id`` to each document and write in ascending order of id."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    rows = rows.withColumn("mark", F.xxhash64("text"))  # splits the rows of one id
    ordered = rows.repartitionByRange("doc_id", "mark").sortWithinPartitions("doc_id", "mark")
    ordered.mapInArrow(_segments(path, end_id, segment_ids, percentile), SEGMENT).write.option("compression", "uncompressed").parquet(folder)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = unpack_blocks(row, row["n_ids"])
            sizes = np.array(row["sizes"], np.int64)
            ends = np.cumsum(sizes)
            parts = [ids[a:b].astype("<u4").tobytes() for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
            n = len(parts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["part"]] * n, pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(row["at"] + ends - sizes, pa.int64()), pa.array(sizes, pa.int64()), pa.array([zlib.crc32(x) for x in parts], pa.int64()), pa.array(parts, pa.binary())],
                ["part", "doc_id", "at", "n_tokens", "ids_crc32", "ids"],
            )


def read(spark, folder: str, ids: bool = True) -> DataFrame:
    """One row per document: (doc_id, start, n_tokens, ids_crc32, ids). ``start``: ids of all
    documents before it. The offsets of the parts come from a sum per part, of which there are
    as many as partitions were written."""
    segments = spark.read.schema(SEGMENT).parquet(folder)
    totals = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))

    def run(batches):
        for batch in _documents(batches):
            yield batch if ids else batch.select(batch.schema.names[:-1])

    rows = segments.mapInArrow(run, "part int, doc_id long, at long, n_tokens long, ids_crc32 long" + ", ids binary" * ids)
    return rows.join(totals, "part").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * ids)
