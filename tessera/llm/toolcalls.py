"""Tool-call linking, in DataFrame operations only: calls and results are hash-joined by identifier, ordered
topologically by what they depend on, validated against schemas and serialised as canonical JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import dropped, partitions, spread_join, stored

#: Kinds of schema_of_variant for the types of a schema.
KINDS = {"string": "STRING", "integer": "BIGINT", "boolean": "BOOLEAN", "number": "BIGINT|DOUBLE|FLOAT|DECIMAL.*"}

#: Tools of the conversations table: parameter -> type, required, least and most (value or length).
SCHEMAS = {
    "open": {"text": ("string", True, 1, 4000), "turn": ("integer", True, 0, 1), "words": ("integer", True, 1, 120)},
    "follow_up": {"text": ("string", True, 1, 4000), "turn": ("integer", True, 1, None), "words": ("integer", True, 1, 120), "after": ("string", True, 1, None)},
}


def problem(name: Column, arguments: Column, schemas: dict) -> Column:
    """What is wrong with a call's arguments (a JSON string), or null. The first of: tool, JSON, and then by parameter
    in alphabetical order missing, type, range; then parameters that the schema hasn't."""
    parsed = F.try_parse_json(arguments)
    found = None
    for tool, parameters in sorted(schemas.items()):
        checks: list[Column] = []
        for p, (kind, required, least, most) in sorted(parameters.items()):
            value = F.try_variant_get(parsed, f"$['{p}']", "variant")
            type_ = F.schema_of_variant(value)
            absent = value.isNull() | (type_ == "VOID")
            size = F.length(F.try_variant_get(parsed, f"$['{p}']", "string")) if kind == "string" else F.try_variant_get(parsed, f"$['{p}']", "double")
            if required:
                checks.append(F.when(absent, f"missing {p}"))
            checks.append(F.when(~absent & ~type_.rlike(f"^({KINDS[kind]})$"), f"type {p}"))
            if least is not None:
                checks.append(F.when(~absent & (size < least), f"range {p}"))
            if most is not None:
                checks.append(F.when(~absent & (size > most), f"range {p}"))
        other = F.array_sort(F.array_except(F.json_object_keys(arguments), F.array(*(F.lit(p) for p in sorted(parameters)))))
        checks.append(F.when(F.size(other) > 0, F.concat(F.lit("unexpected "), F.element_at(other, 1))))
        of_tool = F.coalesce(*checks)
        found = F.when(name == tool, of_tool) if found is None else found.when(name == tool, of_tool)
    known = name.isin(*schemas) if schemas else F.lit(False)
    return F.when(name.isNull() | ~known, "tool").when(parsed.isNull() | F.json_object_keys(arguments).isNull(), "JSON").otherwise(found)


def canonical(json: Column) -> Column:
    """JSON with keys in order at every level and no white space; null if it isn't JSON."""
    return F.to_json(F.try_parse_json(json))


def _anchored(state: DataFrame) -> DataFrame:
    """state(call_id, to, way, done): pointers, of which the done ones point to where a way ends (with way 0 to themselves).
    Every pointer goes on to such an end, unless it runs in a cycle (done stays false). By pointer doubling: every round
    doubles the way that a pointer spans, so a chain of n calls takes log2(n) joins."""
    state = stored(state, "depths")
    for _ in range(int(state.count()).bit_length() + 1):
        open_ = state.where(~F.col("done"))
        if open_.isEmpty():
            break
        further = state.select(F.col("call_id").alias("to"), F.col("to").alias("further"), F.col("way").alias("more"), F.col("done").alias("ends"))
        moved = spread_join(open_, further, "to", "call_id").select("call_id", F.col("further").alias("to"), (F.col("way") + F.col("more")).alias("way"), F.col("ends").alias("done"))
        new = stored(moved.unionByName(state.where("done")), "depths")
        dropped(state)
        state = new
    return state


def depths(calls: DataFrame) -> DataFrame:
    """calls(call_id, after), after a list of what a call depends on, to call_id, depth: 0 for a call that depends on none,
    else one more than the deepest of them.

    Null for calls in or behind a cycle. Unknown, null and repeated prerequisites count as none. Calls with one
    prerequisite are followed by pointer doubling to a call with none or several; levels of those with several come in
    rounds, as many as lie behind each other.
    """
    ids = calls.select("call_id").distinct()
    edges = calls.select("call_id", F.explode("after").alias("to")).distinct().join(ids.withColumnRenamed("call_id", "to"), "to", "left_semi")
    edges = stored(edges, "edges")
    degree = edges.groupBy("call_id").agg(F.count("*").alias("n"), F.min("to").alias("only"))
    one = F.coalesce(F.col("n") == 1, F.lit(False))
    state = ids.join(degree, "call_id", "left").select("call_id", F.when(one, F.col("only")).otherwise(F.col("call_id")).alias("to"), F.when(one, 1).otherwise(0).cast("long").alias("way"), (~one).alias("done"))
    state = _anchored(state)
    several = degree.where("n > 1").select("call_id")
    # known(to, level): calls at the ends of ways whose depth is known, at first those that depend on none
    ends = state.where("done and way = 0").select("call_id")
    known = stored(ends.join(several, "call_id", "left_anti").select(F.col("call_id").alias("to"), F.lit(0).cast("long").alias("level")), "levels")
    reached = edges.join(several, "call_id", "left_semi").join(state.where("done").select(F.col("call_id").alias("to"), F.col("to").alias("end"), "way"), "to", "left")
    waiting = stored(reached.groupBy("call_id", F.col("end").alias("to")).agg((F.max("way") + 1).alias("way")), "edges")
    while not waiting.isEmpty():
        seen = waiting.join(known, "to", "left")
        ready = seen.groupBy("call_id").agg(F.max(F.col("level") + F.col("way")).alias("level"), F.count_if(F.col("level").isNull()).alias("missing")).where("missing = 0").select(F.col("call_id").alias("to"), "level")
        ready = stored(ready, "levels")
        if ready.isEmpty():
            break
        left = stored(waiting.join(ready.select(F.col("to").alias("call_id")), "call_id", "left_anti"), "edges")
        new = stored(known.unionByName(ready), "levels")
        for x in (waiting, known):
            dropped(x)
        waiting, known = left, new
    found = spread_join(state.where("done"), known, "to", "call_id").select("call_id", (F.col("way") + F.col("level")).alias("depth"))
    return ids.join(found, "call_id", "left")


def positions(calls: DataFrame) -> DataFrame:
    """calls(call_id, conversation, depth) to call_id, position: the place (from 1) of a call in a topological order of its
    conversation, by depth and identifier. Calls without a depth have none.

    Calls are sorted over all tasks by ranges, and counted on from one task to the next: one conversation may have most
    of them.
    """
    order = ["conversation", "depth", "call_id"]
    parts = partitions(calls.sparkSession)
    dealt = stored(calls.where("depth is not null").select(*order).repartitionByRange(parts, *order).withColumn("task", F.spark_partition_id()), "positions")
    before = dealt.groupBy("conversation", "task").agg(F.count("*").alias("n"))
    # at most as many rows of a conversation as there are tasks
    before = before.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("conversation").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = dealt.withColumn("place", F.row_number().over(Window.partitionBy("task", "conversation").orderBy("depth", "call_id")))
    same = own.conversation.eqNullSafe(before.conversation) & (own.task == before.task)
    return own.join(before, same).select("call_id", (F.col("place") + F.col("before")).cast("long").alias("position"))


def link(calls: DataFrame, results: DataFrame, schemas: dict) -> DataFrame:
    """calls(call_id, conversation, name, arguments, after) and results(call_id, content) to one row for every identifier;
    after is a list of identifiers.

    Columns: call_id, conversation, name, after, state ("linked", "no result", "no call"), problem, depth, position (in a
    topological order of the conversation), n_calls, n_results and message, canonical JSON of the call with its result
    (null without a call or with arguments that aren't JSON).
    Of several calls or results of an identifier the least counts (by conversation, name, arguments, after; by content);
    rows without an identifier are left out, as nothing can link to them. Results with null content count as results.
    Long texts are checked and copied whole. Empty tables give no rows; other columns aren't read.
    """
    one = calls.where("call_id is not null").groupBy("call_id").agg(F.min(F.struct("conversation", "name", "arguments", "after")).alias("c"), F.count("*").alias("n_calls")).select("call_id", "c.*", "n_calls")
    one = stored(one, "calls")
    depth = stored(depths(one), "depths")
    place = positions(one.select("call_id", "conversation").join(depth, "call_id"))
    two = results.where("call_id is not null").groupBy("call_id").agg(F.min("content").alias("content"), F.count("*").alias("n_results"))
    both = one.join(depth, "call_id", "left").join(place, "call_id", "left").join(two, "call_id", "full_outer")
    called, answered = F.col("n_calls").isNotNull(), F.col("n_results").isNotNull()
    state = F.when(called & answered, "linked").when(called, "no result").otherwise("no call")
    parsed = F.try_parse_json("arguments")
    whole = F.struct(F.when(F.size("after") > 0, F.col("after")).alias("after"), parsed.alias("arguments"), F.col("call_id"), F.col("name"), F.col("content").alias("result"))
    message = F.when(called & parsed.isNotNull(), canonical(F.to_json(whole)))
    return both.select(
        "call_id", "conversation", "name", "after", state.alias("state"), F.when(called, problem(F.col("name"), F.col("arguments"), schemas)).alias("problem"), "depth", "position",
        F.coalesce("n_calls", F.lit(0)).cast("long").alias("n_calls"), F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"), message.alias("message"),
    )


def of_conversations(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of conversations(conv_id, turn, role, text): a user's turn calls, the assistant's next turn answers.

    A call depends on a list of one, the user's turn before it (two turns earlier), if there is one. Turns without conv_id or
    turn have no identifier."""
    name = lambda turn: F.concat(F.lit("call_"), F.col("conv_id"), F.lit("_"), turn)
    user = turns.where("role = 'user'").select("conv_id", "turn", "text")
    before = user.select("conv_id", (F.col("turn") + 2).alias("turn"), F.lit(True).alias("has")).distinct()
    user = user.join(before, ["conv_id", "turn"], "left")
    after = F.when(F.col("has"), name(F.col("turn") - 2))
    words = F.size(F.filter(F.split("text", "[ \\t-\\r]+"), lambda w: w != "")).cast("long")
    arguments = F.to_json(F.struct(after.alias("after"), F.col("text"), F.col("turn"), F.when(F.col("text").isNotNull(), words).alias("words")))
    calls = user.select(
        name(F.col("turn")).alias("call_id"), F.col("conv_id").alias("conversation"), F.when(after.isNull(), "open").otherwise("follow_up").alias("name"), arguments.alias("arguments"),
        F.when(after.isNotNull(), F.array(after)).otherwise(F.array().cast("array<string>")).alias("after"),
    )
    results = turns.where("role = 'assistant'").select(name(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def link_conversations(turns: DataFrame) -> DataFrame:
    """The rows of op6: link() of the calls and results of conversations, after as text. Turns of no known role, or without
    conv_id or turn, are left out; null and empty texts are problems of their calls; an empty table gives no rows."""
    calls, results = of_conversations(turns)
    return link(calls, results, SCHEMAS).drop("conversation").withColumn("after", F.when(F.size("after") > 0, F.array_join("after", ",")))
