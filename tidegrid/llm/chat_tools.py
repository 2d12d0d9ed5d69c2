"""Chat formatting with linked tool calls (operator 3), in DataFrame functions only.

Calls and results are joined by identifier, put in topological order, their
arguments are checked against schemas, and every message is serialised as
canonical JSON: keys in alphabetical order, no spaces, absent values left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.llm.common import written

#: A call's message: {"tool_calls": [{"id": ..., "name": ..., "arguments": {...}}]}; a result's: {"tool_call_id": ..., "content": ...}.
CALL_SCHEMA = "struct<content:string,tool_calls:array<struct<id:string,name:string,arguments:string>>>"
RESULT_SCHEMA = "struct<tool_call_id:string,content:string>"

#: The type that Spark gives to a parsed JSON value, by the type that a tool's schema names.
JSON_TYPES = {
    "string": r"^STRING$",
    "integer": r"^(BIGINT|DECIMAL\([0-9]+,0\))$",
    "number": r"^(BIGINT|DOUBLE|FLOAT|DECIMAL\(.*\))$",
    "boolean": r"^BOOLEAN$",
    "object": r"^OBJECT<",
    "array": r"^ARRAY<",
}


def message_key() -> Column:
    """Tells the messages of one turn apart; messages with equal role and text are equal."""
    return F.xxhash64(F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))).alias("message")


def explicit_calls(messages: DataFrame) -> DataFrame:
    """(conv_id, call_id, turn, name, arguments, message): every call that an assistant's JSON message names."""
    parsed = messages.where(F.col("role") == "assistant").select(
        "conv_id", "turn", message_key(), F.explode(F.from_json("text", CALL_SCHEMA)["tool_calls"]).alias("c")
    )
    return parsed.select(
        "conv_id", F.col("c.id").alias("call_id"), "turn", F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments"), "message"
    )


def explicit_results(messages: DataFrame) -> DataFrame:
    """(conv_id, call_id, turn, message): the results that tool messages give."""
    parsed = messages.where(F.col("role") == "tool").withColumn("r", F.from_json("text", RESULT_SCHEMA))
    return parsed.select("conv_id", F.col("r.tool_call_id").alias("call_id"), "turn", message_key()).where("call_id is not null")


def turn_calls(messages: DataFrame) -> DataFrame:
    """Plain conversations: every user turn calls ``reply`` with its prompt; the turn's number is the identifier."""
    return messages.where(F.col("role") == "user").select(
        "conv_id",
        F.concat(F.lit("turn-"), F.col("turn")).alias("call_id"),
        "turn",
        F.lit("reply").alias("name"),
        F.concat(F.lit('{"prompt":'), json_text(F.col("text")), F.lit(',"turn":'), F.col("turn"), F.lit("}")).alias("arguments"),
        message_key(),
    )


def turn_results(messages: DataFrame) -> DataFrame:
    """Plain conversations: an assistant's turn is the result of the turn before it."""
    return messages.where(F.col("role") == "assistant").select(
        "conv_id", F.concat(F.lit("turn-"), F.col("turn") - 1).alias("call_id"), "turn", message_key()
    )


def json_text(text: Column) -> Column:
    """A JSON string literal; null counts as empty."""
    whole = F.to_json(F.struct(F.coalesce(text, F.lit("")).alias("v")))
    return F.substring(whole, F.lit(6), F.length(whole) - 6)


def valid_arguments(name: Column, arguments: Column, schemas: dict[str, dict[str, str]]) -> Column:
    """Whether the arguments are a JSON object with every field of the tool's schema, each of its JSON type, and no other.

    ``schemas``: tool name -> field -> string, integer, number, boolean, object
    or array. A field whose name ends in ``?`` may be absent (but not null). An
    unknown tool, broken JSON and a repeated key are not valid. 1.0 counts as an
    integer, as in JSON schemas.
    """
    parsed = F.try_parse_json(arguments)
    out = F.lit(False)
    for tool, fields in sorted(schemas.items()):
        known = F.array(*[F.lit(n.rstrip("?")) for n in sorted(fields)])
        ok = F.schema_of_variant(parsed).rlike("^OBJECT<") & (F.size(F.array_except(F.json_object_keys(arguments), known)) == 0)
        for field, kind in sorted(fields.items()):
            found = F.schema_of_variant(F.try_variant_get(parsed, f"$['{field.rstrip('?')}']", "variant"))
            ok = ok & F.coalesce(found.rlike(JSON_TYPES[kind]), F.lit(field.endswith("?")))
        out = F.when(name == tool, ok).otherwise(out)
    return F.coalesce(out, F.lit(False))


def canonical_json(text: Column) -> Column:
    """The JSON value with keys in order and without spaces; text that is no JSON becomes a JSON string, null stays null."""
    return F.when(text.isNotNull(), F.coalesce(F.to_json(F.try_parse_json(text)), json_text(text)))


def call_json(call_id: Column, name: Column, arguments: Column) -> Column:
    """A call as canonical JSON."""
    fields = [
        F.concat(F.lit('"arguments":'), canonical_json(arguments)),
        F.concat(F.lit('"id":'), json_text(call_id)),
        F.when(name.isNotNull(), F.concat(F.lit('"name":'), json_text(name))),
    ]
    return F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))


KEY = ["conv_id", "turn", "message"]


def _doubled(links: DataFrame, rounds: int) -> DataFrame:
    """(conv_id, node, best, jump): of each node the greatest (turn, distance) among itself and what it answers, directly or not.

    Every round doubles how far back a node has looked, so a chain of L links
    takes log L rounds of L rows. ``jump`` is null where the chain's end was
    reached; after enough rounds only nodes on or behind a circle have one.
    """
    own = F.struct(F.col("node.turn").alias("at"), F.lit(0).alias("step")).alias("best")
    state = links.select("conv_id", "node", own, F.col("parent").alias("jump"))
    for k in range(rounds):
        state = written(state, "chat_chains")
        if state.where("jump is not null").isEmpty():
            break
        far = state.select("conv_id", F.col("node").alias("jump"), F.col("best").alias("_best"), F.col("jump").alias("_jump"))
        joined = state.join(far, ["conv_id", "jump"], "left")
        # The end of a chain has no row of its own.
        top = F.coalesce("_best", F.when(F.col("jump").isNotNull(), F.struct(F.col("jump.turn").alias("at"), F.lit(0).alias("step"))))
        beyond = F.when(top.isNotNull(), F.struct(top["at"].alias("at"), (top["step"] + 2**k).alias("step")))
        state = joined.select("conv_id", "node", F.greatest("best", beyond).alias("best"), F.col("_jump").alias("jump"))
    return written(state, "chat_chains")


def order_of(links: DataFrame) -> DataFrame:
    """(conv_id, turn, message, order_turn, order_step, cyclic) of the messages that links move or that answer in a circle.

    ``links`` has one row for each result's message, with the message of its
    call (call_turn, call_message). A result stands behind its call: its place
    is the latest turn among itself and all that it answers, directly or not,
    and behind that as many steps as there are links since. Where messages
    answer each other in a circle, the one whose call comes last is marked and
    keeps its turn, so the rest has an order.
    """
    child = links.select("conv_id", F.struct("turn", "message").alias("node"), F.struct(F.col("call_turn").alias("turn"), F.col("call_message").alias("message")).alias("parent"))
    child = written(child, "chat_links")
    cyclic = F.lit(False).alias("cyclic")
    moved = child.limit(0).select("conv_id", "node", F.struct(F.col("node.turn").alias("at"), F.lit(0).alias("step")).alias("best"), cyclic)
    # Without an early link every result stands behind what it answers, and no circle closes.
    if not child.where("parent.turn >= node.turn").isEmpty():
        most = child.groupBy("conv_id").count().agg(F.max("count")).first()[0]
        rounds = int(most).bit_length() + 1
        state = _doubled(child, rounds)
        stuck = state.where("jump is not null")
        # Whoever has gone round often enough stands on a circle, and has seen all of it.
        circle = stuck.select("conv_id", F.col("jump").alias("node")).distinct()
        last = circle.join(stuck.select("conv_id", "node", "best"), ["conv_id", "node"]).join(child, ["conv_id", "node"])
        cut = written(last.where(F.col("parent.turn") == F.col("best.at")).select("conv_id", "node"), "chat_cut")
        moved = moved.union(state.where("jump is null").select("conv_id", "node", "best", cyclic))
        if not cut.isEmpty():
            rest = child.join(stuck.select("conv_id", "node"), ["conv_id", "node"], "left_semi").join(cut, ["conv_id", "node"], "left_anti")
            moved = moved.union(_doubled(rest.select("conv_id", "node", "parent"), rounds).select("conv_id", "node", "best", cyclic))
            none = F.struct(F.lit(None).cast("long").alias("at"), F.lit(0).alias("step"))
            moved = moved.union(cut.select("conv_id", "node", none, F.lit(True)))
    return moved.where("cyclic or best.step > 0").select(
        "conv_id",
        F.col("node.turn").alias("turn"),
        F.col("node.message").alias("message"),
        F.when(~F.col("cyclic"), F.col("best.at")).alias("order_turn"),
        F.when(~F.col("cyclic"), F.col("best.step")).alias("order_step"),
        "cyclic",
    )


def format_chat(
    messages: DataFrame,
    calls: DataFrame,
    results: DataFrame,
    schemas: dict[str, dict[str, str]],
) -> DataFrame:
    """One row per message, linked and serialised.

    (conv_id, turn, role, calls, valid_calls, link_status, order_turn,
    order_step, message_json). ``link_status`` of a result is ``linked``,
    ``orphan`` (no call has its identifier), ``early`` (it stands before its
    call or on its turn) or ``cycle`` (early, and the last link of a circle);
    other messages have null. Sorting a conversation by ``order_turn``,
    ``order_step``, ``turn`` is a topological order of the links: an early
    result moves behind its call, and what answers a moved message moves with
    it; everything else keeps its turn. Where a conversation uses an identifier
    again, every call stays, and a result answers the nearest one before its
    turn, or else the first; on one turn the least message's; on one message
    its first use by name and arguments is written, and it is valid if all its
    uses there are. Calls and results belong to their own messages, however
    many stand on a turn. Null texts count as
    empty; null ids and turns pass and link with nothing. A conversation is
    never gathered into one row, so a very long one is no hot group. Rows that
    repeat are formatted each. An empty table gives an empty result; other
    columns don't take part.
    """
    calls = calls.where("call_id is not null and conv_id is not null and turn is not null")
    checked = (
        calls.select("conv_id", "call_id", F.col("turn").alias("call_turn"), "message", "name", "arguments", valid_arguments(F.col("name"), F.col("arguments"), schemas).alias("valid"))
        .groupBy("conv_id", "call_id", "call_turn", "message")
        .agg(F.min("valid").alias("valid"), F.min(F.struct("name", "arguments")).alias("use"))
    )
    by_message = checked.groupBy("conv_id", F.col("call_turn").alias("turn"), "message").agg(
        F.count("*").alias("calls"),
        F.count_if("valid").alias("valid_calls"),
        F.array_sort(F.collect_list(F.struct("call_id", call_json(F.col("call_id"), F.col("use.name"), F.col("use.arguments")).alias("json")))).alias("made"),
    )
    called = checked.groupBy("conv_id", "call_id", F.col("call_turn").alias("turn")).agg(F.struct("call_turn", F.min("message").alias("call_message")).alias("call"))
    # A message has one identifier.
    given = results.where("conv_id is not null and turn is not null").groupBy(*KEY).agg(F.min("call_id").alias("call_id"))
    none = F.lit(None).cast("long")
    both = called.select("conv_id", "call_id", "turn", "call", none.alias("message"), F.lit(False).alias("is_result")).union(
        given.select("conv_id", "call_id", "turn", F.lit(None).cast(called.schema["call"].dataType), "message", F.lit(True))
    )
    by_id = Window.partitionBy("conv_id", "call_id")
    earlier = F.last("call", ignorenulls=True).over(by_id.orderBy("turn").rangeBetween(Window.unboundedPreceding, -1))
    paired = both.withColumn("_to", F.coalesce(earlier, F.min("call").over(by_id))).where("is_result")
    answered = paired.select(*KEY, "call_id", F.col("_to.call_turn").alias("call_turn"), F.col("_to.call_message").alias("call_message"))
    answered = written(answered, "chat_answered")
    links = answered.where("call_turn is not null")
    key = KEY
    linked = messages.select("conv_id", "turn", "role", "text", message_key()).join(by_message, key, "left").join(answered, key, "left")
    linked = linked.join(order_of(links), key, "left").withColumn(
        "link_status",
        F.when(F.col("call_id").isNull(), None)
        .when(F.col("cyclic"), "cycle")
        .when(F.col("call_turn").isNull(), "orphan")
        .when(F.col("call_turn") >= F.col("turn"), "early")
        .otherwise("linked"),
    )
    fields = [
        F.when(F.col("link_status").isin("linked", "early", "cycle"), F.concat(F.lit('"answers":'), json_text(F.col("call_id")))),
        F.when(F.col("calls") > 0, F.concat(F.lit('"calls":['), F.array_join(F.transform("made", lambda x: x["json"]), ","), F.lit("]"))),
        F.concat(F.lit('"content":'), json_text(F.col("text"))),
        F.concat(F.lit('"conv_id":'), F.col("conv_id").cast("string")),
        F.concat(F.lit('"role":'), json_text(F.col("role"))),
        F.concat(F.lit('"turn":'), F.col("turn").cast("string")),
    ]
    return linked.select(
        "conv_id",
        "turn",
        "role",
        F.coalesce("calls", F.lit(0)).cast("long").alias("calls"),
        F.coalesce("valid_calls", F.lit(0)).cast("long").alias("valid_calls"),
        "link_status",
        F.coalesce("order_turn", "turn").alias("order_turn"),
        F.coalesce("order_step", F.lit(0)).alias("order_step"),
        F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}")).alias("message_json"),
    )
