"""Exact duplicates by a tree-merge of sorted digest runs.

Each row's text is reduced to a SHA-256 digest, its length and a second 64-bit hash; ids and
digests travel, texts don't. Rows are dealt to runs by a hash of their id, as many as keep a run
at ``RUN_ROWS`` rows or so, and every run is sorted by digest. Then the runs exchange in rounds, as
in a binomial tree: in each round those whose numbers differ in one digit (of base ``fan``) only
exchange. A run keeps the digests whose own digit is its number's, merges the sorted parts of the
``fan`` runs it is sent, and retains per digest the preferred id and the sum of the counts. After
the last round a run's number is a function of the digest alone, so every digest is in one
place. No run ever gets more than ``fan`` rows of one digest, however many copies there are. The
answers travel back to the first runs' rows, of which a digest has one per run.

Equality is verified at every level: only rows that agree in digest, length and second hash
are merged, and the retained id is the first of the merged rows in the order of preference. Bytes
of texts aren't compared, as that would shuffle the corpus for a chance of 2 ** -128.

Defined results: a null text counts as empty (an empty text is a text like others); repeated
rows, id included, are copies of one another and all share the kept id; an empty table gives
an empty result; further columns are ignored. A row whose id is null is a row like others; it
is never preferred, and counts as kept only if all its copies lack an id. Texts are digested as
streams of bytes, so their length doesn't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.support import cut

FAN, RUN_ROWS = 8, 500_000
KEY = ("digest", "size", "second")


def digests(docs: DataFrame, id_column: str, text: Column) -> DataFrame:
    """(id, digest, size, second): what stands for each row."""
    text = F.coalesce(text, F.lit(""))
    return docs.select(F.col(id_column).alias("id"), F.unhex(F.sha2(text, 256)).alias("digest"), F.octet_length(text).cast("long").alias("size"), F.xxhash64(text).alias("second"))


def rounds_for(rows: int, fan: int = FAN, run_rows: int = RUN_ROWS) -> int:
    """Rounds, so that ``fan ** rounds`` runs have about ``run_rows`` rows each; two at least."""
    rounds = 2
    while fan**rounds * run_rows < rows:
        rounds += 1
    return rounds


def merge_sorted(rows: DataFrame, keep: str, runs: int) -> DataFrame:
    """One row per run and digest. Each run is one task's, sorted by digest and then by preference,
    so that equal digests of the runs merged are neighbours: the first keeps its id."""
    preferred = F.col("keep").desc_nulls_last() if keep == "max" else F.col("keep").asc_nulls_last()
    same = Window.partitionBy("run", *KEY)
    ranked = rows.repartition(runs, "run").withColumn("place", F.row_number().over(same.orderBy(preferred)))
    ranked = ranked.withColumn("total", F.sum("n").over(same.orderBy(preferred).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return ranked.where("place = 1").select("run", *KEY, "keep", F.col("total").alias("n"))


def exchange(runs: DataFrame, keep: str, fan: int, rounds: int) -> DataFrame:
    """One row per digest: (digest, size, second, keep, n). ``runs``: (run, digest, size,
    second, keep, n), a row per run and digest."""
    own = F.pmod(F.col("second"), F.lit(fan**rounds)).cast("int")  # the run where a digest ends
    for level in range(rounds):
        unit = fan**level
        digit = lambda x: F.floor(x / unit).cast("int") % fan  # noqa: B023, E731
        to = F.col("run") + (digit(own) - digit(F.col("run"))) * unit
        runs = merge_sorted(runs.withColumn("run", to.cast("int")), keep, fan**rounds)
    return runs.drop("run")


def exact_duplicates(docs: DataFrame, id_column: str = "doc_id", text: Column | str = "text", keep: str = "min", fan: int = FAN, rounds: int | None = None) -> DataFrame:
    """Per row: (id, keep_id, group_size, kept, text_sha256). ``keep``: "min" or "max" id of
    equal texts. ``text``: the column, or an expression that normalises it."""
    if keep not in ("min", "max"):
        raise ValueError(f"keep is min or max, not {keep}")
    column = F.col(text) if isinstance(text, str) else text
    rows = cut(digests(docs, id_column, column))
    rounds = rounds_for(rows.count(), fan) if rounds is None else rounds
    rows = rows.withColumn("run", F.pmod(F.xxhash64("id", "digest"), F.lit(fan**rounds)).cast("int"))
    runs = cut(merge_sorted(rows.select("run", *KEY, F.col("id").alias("keep"), F.lit(1).cast("long").alias("n")), keep, fan**rounds))
    known = runs.select("run", *KEY).join(exchange(runs, keep, fan, rounds), list(KEY))
    out = rows.join(known, ["run", *KEY])
    return out.select(
        F.col("id").alias(id_column), F.col("keep").alias("keep_id"), F.col("n").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )
