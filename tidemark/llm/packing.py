"""Packing documents into sequences: dominance reduction, then best fit.

Sequences have a fixed capacity, so an instance of the packing problem is its histogram of
piece lengths: at most ``capacity`` numbers, whatever the size of the corpus. The driver solves
that histogram; the result is a list of patterns (lengths that share a sequence) with how many
sequences use each. Spark numbers the pieces of each length and looks up their places.

Reduction (Martello and Toth): for a length j with r tokens left, let k be the longest that fits.
{j} dominates all sets that hold j if nothing fits. {j, k} does if k fills r exactly, or if no three
pieces fit and no feasible pair sums to more than k. {j, k, b} does if no three pieces fit, k and b
are the feasible pair of the largest sum, and no two other pieces longer than b fit together:
then each piece of any other feasible set beside j can be exchanged for one of these. Such sets are
fixed as often as their lengths occur, until none is left; the remainder is packed by best fit,
longest first.

Defined results: a null or empty text has its end id only; rows that repeat are packed each;
an empty table gives no pieces; further columns of documents are ignored, those of pieces kept, but for
sequence_id and offset, which are replaced. A text over some megabytes is encoded in parts.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.support import cut, ship, slices, text_bytes
from tidemark.llm.tokens import piece_encoder

Pattern = tuple[int, tuple[int, ...]]


def _shortest(counts: list[int], lengths: list[int], n: int) -> list[int]:
    """The ``n`` shortest pieces, or all if there are fewer."""
    out: list[int] = []
    for x in lengths:
        out += [x] * min(n - len(out), counts[x])
        if len(out) == n:
            break
    return out


def _largest_pair(counts: list[int], lengths: list[int], room: int) -> int:
    """Largest sum of two pieces that fits in ``room``; 0 if none does."""
    best, low, high = 0, 0, len(lengths) - 1
    while low <= high:
        total = lengths[low] + lengths[high]
        if total > room:
            high -= 1
        else:
            if low != high or counts[lengths[low]] > 1:
                best = max(best, total)
            low += 1
    return best


def _companions(counts: list[int], lengths: list[int], room: int) -> tuple[int, ...] | None:
    """What dominates all other sets of pieces that fit in ``room``; None if nothing is known to."""
    if not lengths:
        return ()
    k = lengths[-1]
    if k == room:
        return (k,)
    three = _shortest(counts, lengths, 3)
    if len(three) == 3 and sum(three) <= room:
        return None
    b = _largest_pair(counts, lengths, room) - k
    if b <= 0:
        return (k,)
    if not counts[b] or b > k or (b == k and counts[k] < 2):
        return None
    counts[k] -= 1
    longer = _shortest(counts, [x for x in lengths if x > b and counts[x]], 2)
    counts[k] += 1
    return (k, b) if len(longer) < 2 or sum(longer) > room else None


def reduce_instance(counts: list[int], capacity: int) -> list[Pattern]:
    """Fix dominating sets; takes their pieces out of ``counts`` (index: length)."""
    fixed: list[Pattern] = []
    again = True
    while again:
        again = False
        lengths = [x for x in range(1, capacity + 1) if counts[x]]
        for j in reversed(lengths):
            if not counts[j]:
                continue
            lengths = [x for x in lengths if counts[x]]
            counts[j] -= 1
            found = _companions(counts, [x for x in lengths if x <= capacity - j and counts[x]], capacity - j)
            counts[j] += 1
            if found is not None:
                held = (j, *found)
                n = min(counts[x] // held.count(x) for x in held)
                fixed.append((n, held))
                for x in held:
                    counts[x] -= n
                again = True
    return fixed


def best_fit(counts: list[int], capacity: int) -> list[Pattern]:
    """Best fit, longest first, for whole groups of equal sequences at once."""
    rooms: list[int] = []
    groups: dict[int, list[Pattern]] = {}

    def put(n: int, held: tuple[int, ...], room: int) -> None:
        if room not in groups:
            groups[room] = []
            insort(rooms, room)
        groups[room].append((n, held))

    for length in range(capacity, 0, -1):
        left = counts[length]
        while left:
            i = bisect_left(rooms, length)
            if i == len(rooms):
                each = capacity // length
                if left >= each:
                    put(left // each, (length,) * each, capacity - each * length)
                if left % each:
                    put(1, (length,) * (left % each), capacity - left % each * length)
                break
            room = rooms[i]
            n, held = groups[room].pop()
            if not groups[room]:
                del groups[room], rooms[i]
            take = min(n, left)
            if take < n:
                put(n - take, held, room)
            put(take, (*held, length), room - length)
            left -= take
    return [x for some in groups.values() for x in some]


def solve(histogram: dict[int, int], capacity: int) -> list[Pattern]:
    """Patterns for all pieces of a histogram of lengths."""
    counts = [0] * (capacity + 1)
    for length, n in histogram.items():
        counts[length] = n
    return reduce_instance(counts, capacity) + best_fit(counts, capacity)


def _slots(patterns: list[Pattern]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per length: the first rank, first sequence and offset of each run of equal places."""
    used: dict[int, int] = {}
    out: dict[int, list] = {}
    base = 0
    for n, held in patterns:
        offset = 0
        for length in held:
            rank = used.get(length, 0)
            out.setdefault(length, []).append((rank, base, offset))
            used[length] = rank + n
            offset += length
        base += n
    return {k: tuple(np.array(x, np.int64) for x in zip(*v, strict=True)) for k, v in out.items()}


def pack(pieces: DataFrame, capacity: int, length_column: str = "length", share: int = 100_000, order: tuple[str, ...] = ()) -> DataFrame:
    """``pieces`` with sequence_id and offset. Lengths are from 1 to ``capacity``.

    The pieces of a length are numbered within shares, 256 or as many as hold ``share`` pieces each, so
    that a length which a third of all pieces have is spread; the shares' first numbers come from
    their counts.
    """
    pieces = cut(pieces.drop("sequence_id", "offset"))
    names = pieces.columns
    key = list(order) or names
    salts = max(256, pieces.count() // share)
    salted = pieces.withColumn("__salt", F.pmod(F.xxhash64(*key), F.lit(salts)).cast("int"))
    counted = salted.groupBy(F.col(length_column).alias("__length"), "__salt").agg(F.count("*").alias("__n"))
    counted = cut(counted)
    histogram = {r[0]: r[1] for r in counted.groupBy("__length").agg(F.sum("__n")).collect()}
    slots = _slots(solve(histogram, capacity))
    before = Window.partitionBy("__length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    first = counted.select(F.col("__length").alias("__l"), F.col("__salt").alias("__s"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    ranked = salted.withColumn("__in", F.row_number().over(Window.partitionBy(length_column, "__salt").orderBy(*key)))
    ranked = ranked.join(first, (F.col(length_column) == F.col("__l")) & (F.col("__salt") == F.col("__s")))
    ranked = ranked.select(*names, (F.col("__first") + F.col("__in") - 1).alias("__rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(x)).to_numpy(zero_copy_only=False) for x in (length_column, "__rank"))
            sequence, offset = np.zeros((2, len(length)), np.int64)
            for x in np.unique(length):
                some = np.flatnonzero(length == x)
                ranks, bases, offsets = slots[int(x)]
                i = np.searchsorted(ranks, rank[some], "right") - 1
                sequence[some], offset[some] = bases[i] + rank[some] - ranks[i], offsets[i]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    fields = ", ".join(f"`{x}` {k}" for x, k in pieces.dtypes)
    return ranked.mapInArrow(place, f"{fields}, sequence_id long, offset long")


def cut_documents(docs: DataFrame, path: str, end_id: int, capacity: int, id_column: str = "doc_id", text_column: str = "text", ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` ids: (doc_id, piece, start, length, ids_crc32[, ids]).
    Only longer documents are cut; their first piece takes what the full ones leave."""
    ship(docs.sparkSession)
    kind = dict(docs.dtypes)[id_column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = piece_encoder(path)
        for batch in slices(batches):
            flat, size = encoder.encode(*text_bytes(batch.column("text")))
            flat = np.insert(flat, np.cumsum(size), np.uint32(end_id)).astype("<u4")
            size = size + 1
            count = -(-size // capacity)
            row = np.repeat(np.arange(len(size)), count)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            first = size - (count - 1) * capacity
            start = np.where(piece == 0, 0, first[row] + (piece - 1) * capacity)
            length = np.where(piece == 0, first[row], capacity)
            begin = (np.cumsum(size) - size)[row] + start
            parts = [flat[a:b].tobytes() for a, b in zip(begin.tolist(), (begin + length).tolist(), strict=True)]
            columns = [batch.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array([zlib.crc32(x) for x in parts], pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if ids:
                columns, names = [*columns, pa.array(parts, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)
        encoder.clear()  # the worker lives on, and would keep the store while other stages run

    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * ids)
