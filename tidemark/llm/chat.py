"""Tool calls in conversations: linking, ordering, validation and canonical JSON.

Calls and results meet in a join on the call's identifier.  Calls are ordered topologically
by their dependencies, arguments are checked against the tool's schema, and every call leaves
as canonical JSON: sorted keys, no white space, UTF-8.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.words import word_count
from tidemark.settings import settle


@dataclass(frozen=True)
class Field:
    """A tool argument: its kind (string, integer or boolean) and whether it must be there."""

    name: str
    kind: str
    required: bool = True


# The kind of a parsed JSON value that each kind of field takes.
KINDS = {"string": "STRING", "integer": "BIGINT", "boolean": "BOOLEAN"}

Schemas = Mapping[str, tuple[Field, ...]]


def parsed_json(raw: Column) -> Column:
    """One JSON value as a variant, null where ``raw`` is not exactly one.

    The parser stops after a value and ignores what follows.  Inside a list, alone and before
    another value, nothing can follow unnoticed: a text that closes the list itself leaves both
    lists equally long.
    """
    listed = lambda end: F.try_variant_get(
        F.try_parse_json(F.concat(F.lit("["), raw, F.lit(end))), "$", "array<variant>"
    )
    alone = listed("]")
    return F.when((F.size(alone) == 1) & (F.size(listed(",0]")) == 2), F.get(alone, F.lit(0)))


def schema_errors(tool: Column, arguments: Column, schemas: Schemas) -> Column:
    """Names of what is wrong with ``arguments`` (a map of raw JSON values), in a fixed order."""
    known = F.lit(False)
    errors = F.array().cast("array<string>")
    for name in sorted(schemas):
        fields = sorted(schemas[name], key=lambda f: f.name)
        found = []
        for f in fields:
            value = F.try_element_at(arguments, F.lit(f.name))
            absent = F.lit(f"missing:{f.name}") if f.required else F.lit(None).cast("string")
            found.append(
                F.when(value.isNull(), absent).when(
                    ~F.schema_of_variant(parsed_json(value)).eqNullSafe(F.lit(KINDS[f.kind])), F.lit(f"type:{f.name}")
                )
            )
        allowed = F.array(*[F.lit(f.name) for f in fields]).cast("array<string>")
        extra = F.transform(
            F.array_sort(F.array_except(F.map_keys(arguments), allowed)), lambda k: F.concat(F.lit("unknown:"), k)
        )
        errors = F.when(tool == name, F.concat(F.array_compact(F.array(*found)), extra)).otherwise(errors)
        known = known | (tool == name)
    return F.when(F.coalesce(known, F.lit(False)), errors).otherwise(F.array(F.lit("unknown_tool")))


def json_string(text: Column) -> Column:
    """A JSON string; null is the JSON null."""
    body = F.to_json(F.struct(F.coalesce(text, F.lit("")).alias("s")))
    inner = body.substr(F.lit(6), F.length(body) - 6)
    return F.when(text.isNull(), F.lit("null")).otherwise(inner)


def canonical_value(raw: Column) -> Column:
    """A raw JSON value parsed and written anew: no white space, sorted keys; what no parser reads is a string."""
    parsed = parsed_json(raw)
    text = F.try_variant_get(parsed, "$", "string")
    told = F.when(F.schema_of_variant(parsed) == "STRING", json_string(text)).otherwise(F.to_json(parsed))
    return F.when(parsed.isNull(), json_string(raw)).otherwise(told)


def canonical_arguments(arguments: Column) -> Column:
    """A map of raw JSON values as an object with sorted keys."""
    entries = F.array_sort(F.map_entries(arguments))
    pairs = F.transform(entries, lambda e: F.concat(json_string(e["key"]), F.lit(":"), canonical_value(e["value"])))
    return F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))


def _anchored(edges: DataFrame, every: DataFrame) -> DataFrame:
    """``conv_id, call_id, anchor, far``: the end of each call's chain, and how many steps away it is.

    A chain is a run of calls with one dependency each; it ends at an anchor, a call with none or
    with several.  Pointers double, so a chain of n calls takes log2(n) rounds; a round that ends
    no pointer shows that those left run in circles, and they have no row.
    """
    key = ["conv_id", "call_id"]
    needs = edges.groupBy(*key).agg(F.count("*").alias("needs"), F.min("on").alias("on"))
    held = settle(every.join(needs, key, "left").withColumn("needs", F.coalesce("needs", F.lit(0))), "needs")
    anchors = held.where("needs <> 1").select(*key, F.col("call_id").alias("anchor"), F.lit(0).cast("long").alias("far"))
    done = settle(anchors, "anchors")
    open_ = held.where("needs = 1").select(*key, F.col("on").alias("next"), F.lit(1).cast("long").alias("far"))
    pointing, parts = settle(open_, "pointers"), [done]
    while True:
        # Pointers to calls that have ended end there; the others take over their target's pointer.
        ended = done.select("conv_id", F.col("call_id").alias("next"), F.col("anchor").alias("_end"), F.col("far").alias("_far"))
        found = settle(
            pointing.join(ended, ["conv_id", "next"])
            .select(*key, F.col("_end").alias("anchor"), (F.col("far") + F.col("_far")).alias("far")),
            "ended",
        )
        if found.isEmpty():
            break
        parts.append(found)
        done = done.unionByName(found)
        left = pointing.join(found.select(*key), key, "left_anti")
        ahead = pointing.select("conv_id", F.col("call_id").alias("next"), F.col("next").alias("_next"), F.col("far").alias("_far"))
        jumped = left.join(ahead, ["conv_id", "next"]).select(*key, F.col("_next").alias("next"), (F.col("far") + F.col("_far")).alias("far"))
        pointing = settle(jumped, "pointers")
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def depths(calls: DataFrame) -> DataFrame:
    """``conv_id, call_id, depth``: 0 without known dependencies, else one more than the deepest.

    Chains are folded by doubling pointers first; what is left are the calls with several
    dependencies, placed in rounds once all of theirs are, so rounds grow with how deep such calls
    nest, not with how long chains are.  Calls on a cycle, and calls that wait for them, have no row.
    """
    key = ["conv_id", "call_id"]
    every = settle(calls.select(*key).distinct(), "names")
    edges = settle(
        calls.select("conv_id", "call_id", F.explode("depends_on").alias("on")).distinct().join(
            every.withColumnRenamed("call_id", "on"), ["conv_id", "on"]
        ),
        "edges",
    )
    chains = settle(_anchored(edges, every), "chains")
    anchors = chains.where("far = 0").select(*key)
    # How an anchor depends on other anchors, each at the end of a dependency's chain.
    ways = (
        edges.join(anchors, key)
        .join(chains.select("conv_id", F.col("call_id").alias("on"), "anchor", "far"), ["conv_id", "on"], "left")
        .groupBy(*key).agg(F.count("*").alias("needs"), F.collect_list(F.struct("anchor", "far")).alias("ways"))
    )
    ways = settle(ways.select(*key, "needs", F.explode("ways").alias("w")).select(*key, "needs", "w.*"), "ways")
    level = settle(anchors.join(ways.select(*key).distinct(), key, "left_anti").withColumn("depth", F.lit(0).cast("long")), "level")
    placed, met = level, None
    while True:
        now = level.select("conv_id", F.col("call_id").alias("anchor"), "depth")
        fresh = ways.join(now, ["conv_id", "anchor"]).groupBy(*key, "needs").agg(
            F.count("*").alias("got"), F.max(F.col("depth") + F.col("far") + 1).alias("depth")
        )
        met = fresh if met is None else met.unionByName(fresh)
        met = settle(met.groupBy(*key, "needs").agg(F.sum("got").alias("got"), F.max("depth").alias("depth")), "met")
        ready = met.where("got = needs").join(placed.select(*key), key, "left_anti").select(*key, "depth")
        level = settle(ready, "level")
        if level.isEmpty():
            break
        placed = placed.unionByName(level)
    ends = placed.select("conv_id", F.col("call_id").alias("anchor"), "depth")
    return chains.join(ends, ["conv_id", "anchor"]).select(*key, (F.col("depth") + F.col("far")).cast("int").alias("depth"))


def linked(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """One row per call: ``conv_id, turn, call_id, tool, depth, n_results, status, errors, json``.

    ``calls`` has conv_id, turn, call_id, tool, arguments (map of raw JSON values) and
    depends_on; ``results`` has conv_id, call_id and content.  Status is ``invalid`` when the
    arguments break the schema, ``cycle`` when dependencies never resolve, ``unanswered``
    without a result, ``repeated`` with several, else ``linked``.  Dependencies outside the
    conversation's calls are ignored; a call without an identifier is dropped as it cannot be
    linked; repeated rows of a call are one call, the earliest turn first; of several results
    the least content is kept.  An argument that no JSON parser reads has the wrong type and is
    written as a string.  Empty tables give empty results.
    """
    key = ["conv_id", "call_id"]
    named = calls.where(F.col("call_id").isNotNull() & F.col("conv_id").isNotNull())
    once = settle(
        named.withColumn("arguments", F.coalesce(F.map_entries("arguments"), F.array()))
        .groupBy(*key).agg(F.min_by(F.struct("turn", "tool", "arguments", "depends_on"), F.struct("turn", "tool")).alias("c"))
        .select(*key, "c.turn", "c.tool", F.map_from_entries("c.arguments").alias("arguments"), "c.depends_on"),
        "calls",
    )
    answers = results.where(F.col("call_id").isNotNull()).groupBy(*key).agg(
        F.count("*").alias("n_results"), F.min("content").alias("content")
    )
    joined = (
        once.join(answers, key, "left").join(depths(once), key, "left")
        .withColumn("n_results", F.coalesce("n_results", F.lit(0)).cast("long"))
        .withColumn("errors", schema_errors(F.col("tool"), F.col("arguments"), schemas))
    )
    status = (
        F.when(F.size("errors") > 0, "invalid").when(F.col("depth").isNull(), "cycle")
        .when(F.col("n_results") == 0, "unanswered").when(F.col("n_results") > 1, "repeated").otherwise("linked")
    )
    after = F.array_join(F.transform(F.array_sort(F.coalesce("depends_on", F.array())), json_string), ",")
    body = F.concat(
        F.lit('{"after":['), after, F.lit('],"arguments":'), canonical_arguments(F.col("arguments")),
        F.lit(',"id":'), json_string(F.col("call_id")), F.lit(',"name":'), json_string(F.col("tool")),
        F.lit(',"result":'), json_string(F.col("content")), F.lit("}"),
    )
    return joined.select(
        "conv_id", "turn", "call_id", "tool", "depth", "n_results", status.alias("status"),
        F.array_join("errors", ",").alias("errors"), body.alias("json"),
    )


# The tools that the query reads into conversations.
TOOLS: Schemas = {
    "search": (Field("limit", "integer"), Field("query", "string")),
    "summarise": (Field("strict", "boolean", False), Field("text", "string")),
}


def calls_of(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results read into a plain conversation.

    Every assistant turn is a call with its number in the conversation as identifier; every other
    turn is the result of the turn before it.  The number of words n of the turn decides the rest:
    the tool (``lookup``, which no schema knows, when n % 5 is 4, else a search for odd n and a
    summary for even n), a query that is a number (n % 7 is 3), a missing limit (n % 11 is 5), a
    ``strict`` that is a string (n % 3 is 0), an argument that no schema knows (n % 17 is 6).  A call
    depends on the turn two before it, or on the one two after it (n % 13 is 0), which closes a
    cycle whenever that one depends on the turn before it.
    """
    text = F.coalesce("text", F.lit(""))
    said = conversations.where(F.col("turn").isNotNull() & F.col("conv_id").isNotNull())
    name = lambda turn: F.concat(F.lit("call_"), turn.cast("string"))
    n, turn = F.col("_n"), F.col("turn")
    tool = F.when(n % 5 == 4, "lookup").when(n % 2 == 1, "search").otherwise("summarise")
    query = F.when(n % 7 == 3, n.cast("string")).otherwise(json_string(text))
    limit = F.when(n % 11 != 5, F.length(text).cast("string"))
    strict = F.when(n % 3 == 0, F.lit('"yes"')).otherwise(F.lit(" true "))
    pair = lambda key, value: F.struct(F.lit(key).alias("key"), value.alias("value"))
    note = pair("note", F.when(n % 17 == 6, F.lit("[1, 2]")))
    given = (
        F.when(tool == "search", F.array(pair("query", query), pair("limit", limit), note))
        .when(tool == "summarise", F.array(pair("text", json_string(text)), pair("strict", strict), note))
        .otherwise(F.array(pair("key", json_string(text)), note))
    )
    on = F.when(n % 13 == 0, name(turn + 2)).when(turn >= 2, name(turn - 2))
    calls = said.where("role = 'assistant'").withColumn("_n", word_count(text)).select(
        "conv_id", "turn", name(turn).alias("call_id"), tool.alias("tool"),
        F.map_from_entries(F.filter(given, lambda e: e["value"].isNotNull())).alias("arguments"),
        F.array_compact(F.array(on)).alias("depends_on"),
    )
    results = said.where("role <> 'assistant'").select(
        "conv_id", name(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content")
    )
    return calls, results
