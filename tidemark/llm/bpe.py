"""Byte-level BPE encoding by overlapping chunks, and decoding.

Texts over ``chunk`` characters are cut into overlapping chunks that any task can
pre-tokenise. A match of the pattern depends only on what follows its start, so two
neighbouring chunks agree on everything behind the first start that both find in their
overlap; there the text is cut and the pieces are encoded. Cuts follow visible characters only,
as white space is split differently at the end of a text. Where an overlap holds no common
start (one match longer than the overlap) the text is encoded in one piece.

Defined results: null and empty texts have no ids; rows that repeat, ids included, are kept
as they are; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.support import ship, slices
from tidemark.llm.tokens import rank_encoding, splitter

CHUNK, OVERLAP = 32_768, 1_024
#: How far behind its end a match of the pattern may depend on the text; starts so near the end of
#: a chunk are not trusted.
LOOKAHEAD = 8


def _ids(encoding, pattern: str, text: str) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    try:
        ids = encoding.encode_ordinary(text)
    except ValueError:  # the library's own splitter gives up on extreme runs
        ids = [i for piece in splitter(pattern).findall(text) for i in encoding._encode_single_piece(piece)]
    return np.array(ids, dtype="<u4").tobytes()


def _encode(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = rank_encoding(path, pattern)
        for batch in slices(batches):
            ids = [_ids(encoding, pattern, x or "") for x in batch.column("text").to_pylist()]
            rest = [batch.column(x) for x in ("row", "doc_id", "part")]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(ids, pa.binary())], ["row", "doc_id", "part", "ids"])

    return run


def _chunks(chunk: int, overlap: int):
    step = chunk - overlap

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(x).to_pylist() for x in ("row", "doc_id", "text"))
            for row, doc_id, text in zip(*columns, strict=True):
                at = list(range(0, max(1, len(text) - overlap), step))
                for i in range(0, len(at), 64):
                    some = at[i : i + 64]
                    yield pa.RecordBatch.from_pylist(
                        [{"row": row, "doc_id": doc_id, "part": a // step, "parts": len(at), "at": a, "text": text[a : a + chunk]} for a in some],
                        schema=pa.schema([("row", pa.int64()), ("doc_id", batch.schema.field("doc_id").type), ("part", pa.int32()), ("parts", pa.int32()), ("at", pa.int64()), ("text", pa.string())]),
                    )

    return run


def _starts(pattern: str, chunk: int, overlap: int):
    """Adds ``heads`` and ``tails``: where matches start in the overlap with the chunk before
    and with the one behind."""
    step = chunk - overlap

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = splitter(pattern).finditer
        for batch in batches:
            heads, tails = [], []
            for at, text in zip(batch.column("at").to_pylist(), batch.column("text").to_pylist(), strict=True):
                start = [x.start() for x in find(text)]
                heads.append([at + x for x in start if 0 < x < overlap and not text[x - 1].isspace()])
                tails.append([at + x for x in start if step <= x <= chunk - LOOKAHEAD])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(heads, pa.list_(pa.int64())), pa.array(tails, pa.list_(pa.int64()))], [*batch.schema.names, "heads", "tails"])

    return run


def encode(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> tuple[DataFrame, DataFrame]:
    """Rows (row, doc_id, part, ids): the ids of each piece of each text as little-endian
    unsigned 32-bit integers. ``row`` tells input rows apart, ``part`` orders their pieces.
    Texts of one chunk come first, those of several chunks second."""
    ship(docs.sparkSession)
    kind = dict(docs.dtypes)[id_column]
    docs = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    out = f"row long, doc_id {kind}, part int, ids binary"
    is_long = F.coalesce(F.length("text"), F.lit(0)) > chunk
    short = docs.where(~is_long).withColumn("part", F.lit(0)).mapInArrow(_encode(path, pattern), out)
    schema = f"row long, doc_id {kind}, part int, parts int, at long, text string"
    chunks = docs.where(is_long).mapInArrow(_chunks(chunk, overlap), schema).repartition("row", "part")
    starts = chunks.mapInArrow(_starts(pattern, chunk, overlap), f"{schema}, heads array<long>, tails array<long>")
    order = Window.partitionBy("row").orderBy("part")
    begin = F.when(F.col("part") == 0, F.lit(0)).otherwise(F.array_min(F.array_intersect(F.lag("tails").over(order), "heads")))
    cuts = starts.withColumn("begin", begin)
    cuts = cuts.withColumn("end", F.lead("begin").over(order)).withColumn("whole", F.max(F.col("begin").isNull()).over(Window.partitionBy("row")))
    text = F.when(F.col("end").isNull(), F.expr("substring(text, int(begin - at) + 1)")).otherwise(F.expr("substring(text, int(begin - at) + 1, int(end - begin))"))
    pieces = cuts.where(~F.col("whole")).select("row", "doc_id", "part", text.alias("text"))
    fresh = F.when(F.col("part") == 0, F.col("text")).otherwise(F.expr(f"substring(text, {overlap + 1})"))
    joined = cuts.where("whole").groupBy("row", "doc_id").agg(F.sort_array(F.collect_list(F.struct("part", fresh.alias("text")))).alias("all"))
    whole = joined.select("row", "doc_id", F.lit(0).alias("part"), F.array_join("all.text", "").alias("text"))
    return short, pieces.unionByName(whole).mapInArrow(_encode(path, pattern), out)


def encode_whole(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row per text: (doc_id, ids array<binary>), the pieces in order. Only texts of
    several chunks are shuffled."""
    short, pieces = encode(docs, path, pattern, id_column, text_column, chunk, overlap)
    listed = pieces.groupBy("row", "doc_id").agg(F.sort_array(F.collect_list(F.struct("part", "ids"))).alias("all"))
    return short.select("doc_id", F.array("ids").alias("ids")).unionByName(listed.select("doc_id", F.col("all.ids").alias("ids")))


@lru_cache(maxsize=2)
def _bytes_of(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all ids in a row, where those of an id begin, and how many it has."""
    encoding = rank_encoding(path, r"\S+|\s+")
    known = {i: x for x, i in encoding._mergeable_ranks.items()}
    parts = [known.get(i, b"") for i in range(max(known) + 1)]
    size = np.array([len(x) for x in parts])
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(size) - size, size


def decode_bytes(path: str, ids: np.ndarray) -> bytes:
    """The bytes of ids, one after the other."""
    data, begin, size = _bytes_of(path)
    n = size[ids]
    total = np.cumsum(n)
    return data[np.repeat(begin[ids] - (total - n), n) + np.arange(total[-1] if len(total) else 0)].tobytes()


def _digest(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, parts in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                of_ids, of_text, n = hashlib.sha256(), hashlib.sha256(), 0
                for part in parts:
                    of_ids.update(part)
                    of_text.update(decode_bytes(path, np.frombuffer(part, "<u4")))
                    n += len(part) // 4
                rows.append((doc_id, n, of_ids.hexdigest(), of_text.hexdigest()))
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            kinds = (batch.schema.field("doc_id").type, pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def digest(pieces: DataFrame, path: str) -> DataFrame:
    """Per text: number of ids, digest of the ids and digest of the decoded bytes."""
    kind = dict(pieces.dtypes)["doc_id"]
    return pieces.mapInArrow(_digest(path), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
