"""Linking tool calls to their results, in DataFrame operations only.

``calls`` (conv_id, call_id, seq, name, arguments, after) and ``results`` (conv_id, call_id, seq,
content): ``arguments`` is JSON text, ``after`` the ids of calls that must come first. Both sides
are reduced to one row per identifier, then hash-joined on it; what occurs several times is
counted. Rows without an identifier pass by both steps. A call's level in the topological order is one
above the highest it waits for, 0 if it waits for none; calls in cycles, and those that wait for
them, have no level. Levels are found in rounds. In each, calls are placed whose predecessors
are, and what waits for a call that itself waits for one other call only waits for that one
instead, at twice the distance; so a chain of n calls takes log2(n) rounds. Before, waits that follow from
two others are left out, so a chain whose calls also wait for earlier ones is still a chain. Arguments are
validated against schemas, and each link becomes one line of canonical JSON: keys sorted, no white
space.

Defined results: null identifiers link with nothing and are kept as unlinked calls and results, each
by itself, repeated or not; a result without a call is kept as an orphan, without a level; arguments
that aren't a JSON object are invalid, null ones count as {}; repeated calls and results are one
with counts, the first by seq and text being taken; calls don't wait for missing ones; empty
tables give an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.support import cut, cut_table

#: Of each tool the fields: kind (text, integer, number, boolean, object, array) and whether required.
Schemas = dict[str, dict[str, tuple[str, bool]]]

#: What Spark calls the kinds of JSON values.
_KINDS = {"text": ("STRING",), "integer": ("BIGINT",), "number": ("BIGINT", "DECIMAL", "DOUBLE"), "boolean": ("BOOLEAN",), "object": ("OBJECT",), "array": ("ARRAY",)}


#: Rows that can be linked.
_NAMED = "conv_id IS NOT NULL AND call_id IS NOT NULL"


def one_per_id(rows: DataFrame, *columns: str) -> DataFrame:
    """The first row of each (conv_id, call_id) and how many there were; rows without either are left out."""
    first = F.min(F.struct("seq", *columns)).alias("first")
    return rows.where(_NAMED).groupBy("conv_id", "call_id").agg(first, F.count("*").alias("n")).select("conv_id", "call_id", "n", "first.*")


def link(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Calls with the result of the same identifier, if there is one, and results without a call
    (``orphan``); those without an identifier as they are."""
    left = one_per_id(calls, "name", "arguments", "after").withColumnRenamed("n", "n_calls").withColumn("called", F.lit(True))
    right = one_per_id(results, "content").select("conv_id", "call_id", F.col("seq").alias("result_seq"), "content", F.col("n").alias("n_results"))
    out = left.join(right.hint("shuffle_hash"), ["conv_id", "call_id"], "full")
    one = F.lit(1).cast("long")
    lone = calls.where(f"NOT ({_NAMED})").select("conv_id", "call_id", one.alias("n_calls"), "seq", "name", "arguments", "after", F.lit(True).alias("called"))
    alone = results.where(f"NOT ({_NAMED})").select("conv_id", "call_id", F.col("seq").alias("result_seq"), "content", one.alias("n_results"))
    out = out.unionByName(lone, allowMissingColumns=True).unionByName(alone, allowMissingColumns=True)
    none = F.lit(0).cast("long")
    return out.withColumns({"n_calls": F.coalesce("n_calls", none), "n_results": F.coalesce("n_results", none), "orphan": F.col("called").isNull()}).drop("called")


#: Distances stop growing here: only what waits for a cycle gets so far, and it has no level.
FAR = 1 << 40


def without_implied(edges: DataFrame, first: str) -> DataFrame:
    """``edges`` (conv_id, to, of, seq: that of ``of``) but for those implied by two others: ``to`` waits for x, x for ``of``, and x comes
    ``first`` ("later" or "earlier") of the two by seq. Levels stay the same, with cycles too: of the calls that a placed call waits for, the first by
    that order is kept, and each one left out is below another, so by the levels' order it is placed lower."""
    before = edges.select("conv_id", F.col("to").alias("x"), "of")
    x = edges.select("conv_id", "to", F.col("of").alias("x"), F.col("seq").alias("__x"))
    order = F.col("__x") > F.col("seq") if first == "later" else F.col("__x") < F.col("seq")
    implied = x.join(before, ["conv_id", "x"]).join(edges, ["conv_id", "to", "of"]).where(order)
    return edges.join(implied.select("conv_id", "to", "of").distinct(), ["conv_id", "to", "of"], "left_anti")


def levels(linked: DataFrame) -> DataFrame:
    """``linked`` with ``level``."""
    named, number = F.concat(F.lit("i"), "call_id"), F.concat(F.lit("n"), F.monotonically_increasing_id().cast("string"))
    key = F.when(F.expr(_NAMED), named).otherwise(number)  # rows without an identifier have one here
    linked = cut(linked.withColumn("key", key))
    calls = linked.where(~F.col("orphan"))
    waits = calls.select("conv_id", F.col("key").alias("to"), F.explode(F.array_distinct("after")).alias("call_id"))
    waits = waits.join(calls.select("conv_id", "call_id", F.col("key").alias("of"), "seq"), ["conv_id", "call_id"]).select("conv_id", "to", "of", "seq")
    waits = cut_table(without_implied(cut_table(waits), "later"))
    waits = without_implied(waits, "earlier")
    edges = cut_table(waits.select("conv_id", "to", "of", F.lit(1).cast("long").alias("far"), F.lit(None).cast("long").alias("base")))
    fresh = calls.join(edges.select("conv_id", F.col("to").alias("key")), ["conv_id", "key"], "left_anti").select("conv_id", "key", F.lit(0).cast("long").alias("level"))
    placed = [fresh]
    while not edges.isEmpty():
        met = edges.join(fresh.withColumnRenamed("key", "of"), ["conv_id", "of"], "left").withColumn("base", F.coalesce("base", F.col("level") + F.col("far"))).drop("level")
        met = cut_table(met)
        each = met.groupBy("conv_id", F.col("to").alias("key")).agg(F.max("base").alias("level"), F.count("*").alias("n"), F.count("base").alias("done"), F.max("of").alias("onward"), F.max("far").alias("step"))
        each = cut_table(each)
        fresh = each.where("done = n").select("conv_id", "key", "level")
        if fresh.isEmpty():  # all that is left is in cycles or waits for them
            break
        placed.append(fresh)
        single = each.where("n = 1 AND done = 0").select("conv_id", F.col("key").alias("of"), "onward", "step")
        left = met.join(fresh.select("conv_id", F.col("key").alias("to")), ["conv_id", "to"], "left_anti").join(single, ["conv_id", "of"], "left")
        jump = F.col("onward").isNotNull() & F.col("base").isNull()
        moved = left.select("conv_id", "to", F.when(jump, F.col("onward")).otherwise(F.col("of")).alias("of"), F.when(jump, F.least(F.col("far") + F.col("step"), F.lit(FAR))).otherwise(F.col("far")).alias("far"), "base")
        edges = cut_table(moved.groupBy("conv_id", "to", "of").agg(F.max("far").alias("far"), F.max("base").alias("base")))
    found = placed[0]
    for more in placed[1:]:
        found = found.unionByName(more)
    found = found.select(F.col("conv_id").alias("__conv"), F.col("key").alias("__key"), "level")
    return linked.join(found, F.col("conv_id").eqNullSafe(F.col("__conv")) & (F.col("key") == F.col("__key")), "left").drop("key", "__conv", "__key")


def problems(name: Column, arguments: Column, schemas: Schemas) -> Column:
    """What is wrong with the arguments, in order of the fields' names; empty: valid."""
    value = F.try_parse_json(F.coalesce(arguments, F.lit("{}")))
    shape = F.schema_of_variant(value)
    no_object = value.isNull() | ~shape.startswith("OBJECT")
    cases = F.when(no_object, F.array(F.lit("not an object")))
    for tool, fields in sorted(schemas.items()):
        found = []
        for field, (kind, required) in sorted(fields.items()):
            part = F.try_variant_get(value, f"$.{field}", "variant")
            of = F.regexp_extract(F.schema_of_variant(part), "^([A-Z]+)", 1)
            missing = part.isNull() | (of == "VOID")
            found.append(F.when(missing, F.lit(f"missing {field}") if required else F.lit(None)).when(~of.isin(*_KINDS[kind]), F.lit(f"{field} is no {kind}")))
        cases = cases.when(name == tool, F.array_compact(F.array(*found)))
    return cases.otherwise(F.array(F.lit("unknown tool")))


def quoted(text: Column) -> Column:
    """A string as JSON."""
    return F.regexp_extract(F.to_json(F.struct(text.alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1)


def canonical(text: Column) -> Column:
    """JSON text with sorted keys and without white space; a JSON string where it is no JSON."""
    return F.coalesce(F.to_json(F.try_parse_json(text)), quoted(F.coalesce(text, F.lit(""))))


def lines(linked: DataFrame, schemas: Schemas) -> DataFrame:
    """Per call, and result without one: its place, validity, and its canonical JSON line."""
    text = lambda c: F.when(F.col(c).isNull(), "null").otherwise(quoted(F.col(c)))
    wrong = F.when(F.col("orphan"), F.array(F.lit("no call"))).otherwise(problems(F.col("name"), F.col("arguments"), schemas))
    bad = linked.withColumn("problems", wrong)
    line = F.concat(
        F.lit('{"arguments":'), F.when(F.col("arguments").isNull(), "{}").otherwise(canonical(F.col("arguments"))), F.lit(',"call_id":'), text("call_id"), F.lit(',"name":'), text("name"),
        F.lit(',"problems":'), F.to_json("problems"), F.lit(',"result":'), text("content"), F.lit("}"),
    )
    return bad.withColumn("valid", F.size("problems") == 0).withColumn("line", line)


def from_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of plain conversations (conv_id, turn, role, text), by a rule that has every case
    in it. What a user says is a call of the tool ``answer``, what the system says one of ``setup``,
    and what the assistant says the result of the call one turn before, be there one or not. A user's
    call waits for the call two turns before; where conv_id % 5 = 2 also for that four turns before;
    where conv_id % 7 = 3 the first two turns also wait for the call two turns behind, which is a
    cycle. Where conv_id % 4 = 1 calls are logged last first. Where conv_id % 6 = 4 a user's n_words is
    text, which the schema refuses, and where conv_id % 11 = 5 a user's arguments are no JSON. Null
    texts leave the field out, which the schema refuses. Rows of other roles are neither."""
    conv, turn = F.col("conv_id"), F.col("turn")
    name = lambda t: F.concat(F.lit("call_"), t.cast("string"))
    user = F.col("role") == "user"
    words = F.size(F.split(F.trim(F.coalesce("text", F.lit(""))), r"\s+"))
    fields = lambda n: F.to_json(F.struct("text", "turn", n.alias("n_words")))
    said = F.when(conv % 11 == 5, F.col("text")).when(conv % 6 == 4, fields(words.cast("string"))).otherwise(fields(words))
    after = F.array_compact(F.array(name(turn - 2), F.when(conv % 5 == 2, name(turn - 4)), F.when((conv % 7 == 3) & (turn < 2), name(turn + 2))))
    calls = turns.where(F.col("role").isin("user", "system")).select(
        "conv_id", name(turn).alias("call_id"), F.when(conv % 4 == 1, -turn).otherwise(turn).alias("seq"), F.when(user, "answer").otherwise("setup").alias("name"),
        F.when(user, said).otherwise(F.to_json(F.struct("text"))).alias("arguments"), F.when(user, after).otherwise(F.array().cast("array<string>")).alias("after"),
    )
    results = turns.where(F.col("role") == "assistant").select("conv_id", name(turn - 1).alias("call_id"), turn.alias("seq"), F.col("text").alias("content"))
    return calls, results


#: The schemas of what from_turns() makes.
TOOLS: Schemas = {"answer": {"text": ("text", True), "turn": ("integer", True), "n_words": ("integer", True)}, "setup": {"text": ("text", True)}}
