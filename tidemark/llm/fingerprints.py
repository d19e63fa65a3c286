"""Fingerprints of documents from closed syncmers, in SQL functions only.

Of the runs of ``K`` code points of a text those are anchors whose least inner run of ``S`` code points, by
hash, is their first or last one. Whether a run is an anchor depends on nothing but itself, so an edit
moves the anchors after it and changes only those it touches. An anchor's key has the upper half of its least inner hash
in front of half a hash of itself, so keys of anchors are ordered as their inner hashes are. A text's fingerprint is the ``SIZE`` anchors of least
key, each with the place of its first occurrence (all, if there are fewer), as text: key and place in hexadecimal.

Only inner runs of small hash can make small keys: the inner hashes below the one that about ``LOW`` of a text are expected below are taken as candidates, and the runs that have
one at an edge tested. Where these give less than ``SIZE`` anchors, all inner runs are candidates, so the result is exact. The work
is done piece by piece, pieces overlapping by K - 1 code points, which gives the same anchors as the whole, on UTF-32 bytes, as those are cut in
constant time.

Likeness of two fingerprints estimates the share of common anchors: of the ``SIZE`` least keys of both together,
those in both. shift() compares the places of common anchors: by how far most of them are moved, and how many.

Defined results: a null text is an empty one; an empty text has no anchors and is like another without any (1)
and nothing else (0); a text shorter than K is one anchor, the hash of the whole; equal texts have equal
fingerprints; further columns are ignored. Texts need some 100 bytes a code point of one piece, and 4 of the rest.

edited() orders documents by descending id, those without one last. Rows that share an id follow one
another by the hash of their text, so their order is defined up to equal rows; an empty table gives an empty one, and a single
document is followed by itself. The order is cut into buckets of ``BUCKET`` rows or so, more than partitions in any case; the first row
of each is also sent to the one before, so each text travels once and no task sees more than its buckets. Rows that are equal in id and
text share a bucket.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, S, SIZE, LOW, PIECE, BUCKET = 16, 9, 64, 64, 16_384, 5_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def piece_anchors(letters: Column, start: Column, k: int, s: int, size: int, low: int) -> Column:
    """The ``size`` least anchors of a piece, given in UTF-32, of ``k`` code points at least: (h, at), sorted, ``at`` counted from ``start``."""
    places = F.sequence(F.lit(1), F.octet_length(letters) - 4 * s + 1, F.lit(4))
    inner = F.transform(places, lambda p: F.xxhash64(F.substring(letters, p, F.lit(4 * s))))
    far = k - s

    def anchor(h: Column, i: Column) -> Column:
        """The anchor at ``i``, null if there is none."""

        def of(least: Column) -> Column:
            half = F.shiftleft(F.shiftrightunsigned(least, 32), 32)
            key = half.bitwiseOR(F.xxhash64(h[i], h[i + far]).bitwiseAND(0xFFFFFFFF))
            return F.when((least == h[i]) | (least == h[i + far]), F.struct(key.alias("h"), (start + i).alias("at")))

        return let(F.array_min(F.slice(h, i + 1, far + 1)), of)

    def near(h: Column, limit: Column) -> Column:
        """Anchors with an inner hash up to ``limit`` at an edge."""
        some = F.array_compact(F.transform(h, lambda x, i: F.when(x <= limit, i)))
        both = F.flatten(F.transform(some, lambda i: F.array(i, i - far)))
        whole = F.filter(both, lambda i: (i >= 0) & (i + far < F.size(h)))
        return first_places(F.array_compact(F.transform(whole, lambda i: anchor(h, i))), size)

    def least(h: Column) -> Column:
        n = F.size(h)
        limit = F.when(n > 4 * low, ((low * 2.0 / n - 1) * 2.0**63).cast("long").bitwiseOR(0xFFFFFFFF))
        every = F.array_compact(F.transform(F.sequence(F.lit(0), n - far - 1), lambda i: anchor(h, i)))
        return let(let(limit, lambda x: near(h, x)), lambda a: F.when(F.size(a) >= size, a).otherwise(first_places(every, size)))

    return let(inner, least)


def first_places(anchors: Column, size: int) -> Column:
    """The ``size`` least keys of (h, at), each with its first place."""
    first = lambda a: F.filter(a, lambda x, i: (i == 0) | (x["h"] != a[F.greatest(i - 1, F.lit(0))]["h"]))
    return F.slice(let(F.sort_array(anchors), first), 1, size)


def anchors(text: Column, k: int = K, s: int = S, size: int = SIZE, low: int = LOW, piece: int = PIECE) -> Column:
    """The ``size`` least anchors of ``text`` as array of (h, at)."""
    if not 0 < s < k <= 2 * s:
        raise ValueError("the inner runs at both edges must cover the outer one: s < k <= 2 s")
    none = F.array().cast("array<struct<h:bigint,at:int>>")
    whole = lambda t: F.array(F.struct(F.xxhash64(t).alias("h"), F.lit(0).alias("at")))

    def by_pieces(letters: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor(F.octet_length(letters) / 4).cast("int") - k, F.lit(piece))
        part = lambda at: F.substring(letters, 4 * at + 1, F.lit(4 * (piece + k - 1)))
        return first_places(F.flatten(F.transform(starts, lambda at: let(part(at), lambda p: piece_anchors(p, at, k, s, size, low)))), size)

    of = lambda t: F.when(t == "", none).when(F.length(t) < k, whole(t)).otherwise(let(F.encode(t, "UTF-32"), by_pieces))
    return let(F.coalesce(text, F.lit("")), of)


def likeness(a: Column, b: Column, size: int = SIZE) -> Column:
    """The estimated share of common anchors of two arrays of keys, 0 to 1."""
    both = F.slice(F.sort_array(F.array_union(a, b)), 1, size)
    common = let(both, lambda u: F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.size(u))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(common)


def shift(one: Column, other: Column) -> Column:
    """How far most of the common anchors of ``one`` are moved in ``other``, the smallest distance of equally frequent ones, and
    how many are: (shift, aligned); null without a common one."""
    moved = F.sort_array(F.flatten(F.transform(one, lambda x: F.transform(F.filter(other, lambda y: y["h"] == x["h"]), lambda y: y["at"] - x["at"]))))
    counted = lambda m: F.transform(F.array_distinct(m), lambda d: F.struct((-F.size(F.filter(m, lambda x: x == d))).alias("less"), F.abs(d).alias("far"), d.alias("shift")))
    best = lambda m: F.when(F.size(m) > 0, F.array_min(counted(m)))
    return let(let(moved, best), lambda b: F.when(b.isNotNull(), F.struct(b["shift"].alias("shift"), (-b["less"]).alias("aligned"))))


def written(found: Column) -> Column:
    """A fingerprint as text."""
    return F.array_join(F.transform(found, lambda x: F.concat(F.lpad(F.hex(x["h"]), 16, "0"), F.lit(":"), F.hex(x["at"]))), " ")


def bounds(docs: DataFrame, buckets: int) -> list[int]:
    """Ids between which about equally many rows lie, ``buckets`` - 1 at most, from the highest."""
    shares = [i / buckets for i in range(1, buckets)]
    found = docs.select(F.percentile_approx("doc_id", shares, 20 * buckets).alias("p")).first().p if shares else None
    return sorted(set(found or []), reverse=True)


def later(limits: list[int], block: int = 64) -> Column:
    """How many of the falling ``limits`` are above an id: first among the last of each ``block``, then in one block."""
    if not limits:
        return F.lit(0)
    blocks = [limits[i : i + block] for i in range(0, len(limits), block)]
    above = lambda values: F.size(F.filter(values, lambda x: F.col("doc_id") < x))
    literal = lambda values: F.array(*map(F.lit, values))
    whole = above(literal([b[-1] for b in blocks]))
    return let(whole, lambda n: F.least(n * block, F.lit(len(limits))) + F.coalesce(above(F.get(F.array(*map(literal, blocks)), n)), F.lit(0))).cast("int")


def edited(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """``docs`` (doc_id, text, keys, places) with what follows: (doc_id, text, n_chars, edited, keys, places, next_keys). The
    edited text has the first code points of the next document, as many as there are, for its own second half."""
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = buckets or max(2 * partitions, docs.count() // BUCKET)
    limits = bounds(docs, buckets)
    rows = docs.withColumns({"h": F.xxhash64("text"), "bucket": F.when(F.col("doc_id").isNull(), len(limits) + 1).otherwise(later(limits))})
    # a row a bucket, as many as there are limits and two at most
    firsts = rows.groupBy("bucket").agg(F.min(F.struct((-F.col("doc_id")).alias("less"), "h")).alias("first"), F.lit(0).alias("all"))
    every = Window.partitionBy("all")
    before = F.coalesce(F.lag("bucket").over(every.orderBy("bucket")), F.max("bucket").over(every))
    rows = rows.join(F.broadcast(firsts.select("bucket", "first", before.alias("before"))), "bucket")
    guest = F.when(F.struct((-F.col("doc_id")).alias("less"), "h").eqNullSafe(F.col("first")), F.struct(F.col("before").alias("to"), F.lit(True).alias("guest")))
    sent = rows.withColumn("p", F.explode(F.array_compact(F.array(F.struct(F.col("bucket").alias("to"), F.lit(False).alias("guest")), guest))))
    sent = sent.select("doc_id", "text", "keys", "places", "h", "p.to", "p.guest").repartition(max(partitions, buckets // 4), "to")
    turn = Window.partitionBy("to").orderBy("guest", F.col("doc_id").desc_nulls_last(), "h")
    met = sent.withColumns({"next_text": F.lead("text").over(turn), "next_keys": F.lead("keys").over(turn)}).where("NOT guest")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    made = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    return met.select("doc_id", "text", n.cast("long").alias("n_chars"), made.alias("edited"), "keys", "places", "next_keys")


def compare(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Of each row of ``docs`` (doc_id, text): both texts' fingerprints, and how like it is to its edited text and to the next document."""
    known = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("anchors", anchors(F.col("text")))
    known = known.select("doc_id", "text", F.col("anchors")["h"].alias("keys"), F.col("anchors")["at"].alias("places"))
    found = edited(known, buckets).withColumn("edited_anchors", anchors(F.col("edited")))
    own = F.zip_with("keys", "places", lambda h, at: F.struct(h.alias("h"), at.alias("at")))
    found = found.withColumn("anchors", own).withColumn("moved", shift(F.col("anchors"), F.col("edited_anchors")))
    return found.select(
        "doc_id", "n_chars", "text", "edited", written(F.col("anchors")).alias("fingerprint"), written(F.col("edited_anchors")).alias("edited_fingerprint"),
        likeness(F.col("keys"), F.col("edited_anchors")["h"]).alias("near_edited"), likeness(F.col("keys"), F.col("next_keys")).alias("near_next"),
        F.col("moved.shift").alias("shift_edited"), F.col("moved.aligned").alias("aligned_edited"),
    )
