"""Fill-in-the-middle, in SQL functions only.

A text is cut into units, runs of letters and single other code points, by one regular expression.
The digits of a digest of the row's key choose two cuts among the units and the form: ``psm`` is
prefix, suffix, middle, ``spm`` suffix, prefix, middle, each after its sentinel, ``plain`` the text
as it is. Slices of the unit array are joined to the parts. restore() gets the text back from an output and its
form by the sentinels alone: none occurs in a part, as texts with one stay plain, and none can arise where two
parts meet, as a sentinel's first character occurs in it once.

Defined results: a null text is an empty one, which has no units and is plain; a null id is written
as nothing in the key; rows are treated one by one, so repeated rows give repeated rows and an
empty table an empty one; further columns are ignored, whatever their names. A text is held whole in
its row, at some 60 bytes a unit, so texts of tens of MB want executors of GB.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNITS = "[A-Za-z]+|[^A-Za-z]"
#: What comes before prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")


def draw(key: Column, i: int) -> Column:
    """The ``i``-th group of eight hexadecimal digits of the key's digest, as a number."""
    return F.conv(F.substring(F.sha2(key, 256), 8 * i + 1, 8), 16, 10).cast("long")


def rearrange(docs: DataFrame, seed: int = 1, plain_from: int = 90, spm_below: int = 20, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """Per row: (doc_id, text, n, form, prefix, middle, suffix, output), the parts null where plain. Of 100 texts
    ``plain_from`` or so are rearranged, and of 100 of these ``spm_below`` as suffix, prefix, middle."""
    p, s, m = (F.lit(x) for x in sentinels)
    whole = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    cut = whole.withColumns({"units": F.regexp_extract_all("text", F.lit(UNITS), 0), "key": key}).withColumn("n", F.size("units").cast("long"))
    a, b = (draw(F.col("key"), i) % (F.col("n") + 1) for i in (0, 1))
    held = [F.contains("text", x) for x in (p, s, m)]
    plain = (F.col("text") == "") | held[0] | held[1] | held[2] | (draw(F.col("key"), 2) % 100 >= plain_from)
    form = F.when(plain, "plain").when(draw(F.col("key"), 3) % 100 < spm_below, "spm").otherwise("psm")
    cut = cut.withColumns({"lo": F.least(a, b).cast("int"), "hi": F.greatest(a, b).cast("int"), "form": form})
    units, lo, hi = F.col("units"), F.col("lo"), F.col("hi")
    part = lambda start, many: F.when(F.col("form") != "plain", F.array_join(F.slice(units, start, many), ""))
    parts = cut.withColumns({"prefix": part(F.lit(1), lo), "middle": part(lo + 1, hi - lo), "suffix": part(hi + 1, F.size(units) - hi)})
    shown = F.when(F.col("form") == "psm", F.concat(p, "prefix", s, "suffix", m, "middle")).when(F.col("form") == "spm", F.concat(s, "suffix", p, "prefix", m, "middle"))
    return parts.select("doc_id", "text", "n", "form", "prefix", "middle", "suffix", F.coalesce(shown, "text").alias("output"))


def restore(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text from an output of rearrange() and its form."""
    parts = F.split(output, "|".join(map(re.escape, sentinels)), -1)
    prefix, suffix = F.when(form == "psm", parts[1]).otherwise(parts[2]), F.when(form == "psm", parts[2]).otherwise(parts[1])
    return F.when(form == "plain", output).otherwise(F.concat(prefix, parts[3], suffix))
