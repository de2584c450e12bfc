"""Tool-call linking in DataFrame functions alone: calls and results meet by identifier, get a topological order,
arguments are validated against schemas, and every message becomes canonical JSON.

Nothing gathers a conversation in one place: links are found per (conversation, identifier), and the order is a key, not
a rank, so that one conversation may hold any share of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motifold.llm.shared import cut

#: By field its kind and whether it is needed. Kinds are JSON types, `array<type>`, or Fields of an object of its own.
Fields = dict[str, tuple["str | Fields", bool]]
#: By tool: its fields.
Schemas = dict[str, Fields]

#: JSON types by the names that Spark gives parsed values.
_TYPES = {"string": r"^STRING$", "integer": r"^BIGINT$", "number": r"^(BIGINT|DOUBLE|DECIMAL.*)$", "boolean": r"^BOOLEAN$", "array": r"^ARRAY<", "object": r"^OBJECT<"}

#: What a conversation's turns are taken as: a user turn calls the tool `reply`.
REPLY: Schemas = {"reply": {"chars": ("integer", True), "prompt": ("string", True), "turn": ("integer", True)}}


def canonical(json: Column) -> Column:
    """JSON with sorted keys and without spaces; null if it doesn't parse."""
    return F.to_json(F.try_parse_json(json))


def _fits(value: Column, kind: str | Fields) -> Column:
    """Whether a parsed value (not null) is of a kind."""
    told = F.schema_of_variant(value)
    if isinstance(kind, str):
        if not kind.startswith("array<"):
            return told.rlike(_TYPES[kind])
        return told.startswith("ARRAY<") & F.coalesce(F.forall(F.try_variant_get(value, "$", "array<variant>"), lambda x: F.coalesce(_fits(x, kind[6:-1]), F.lit(False))), F.lit(False))
    names = F.json_object_keys(F.to_json(value))
    fits = told.startswith("OBJECT<") & (F.size(F.array_except(names, F.array(*map(F.lit, kind)).cast("array<string>"))) == 0)
    for field, (own, needed) in kind.items():
        found = F.try_variant_get(value, f"$['{field}']", "variant")
        fits &= F.coalesce(F.when(F.schema_of_variant(found) != "VOID", _fits(found, own)), F.lit(not needed))
    return fits


def valid_arguments(tool: Column, value: Column, schemas: Schemas) -> Column:
    """Whether parsed arguments are an object that fits the tool's schema, at every depth: all it needs, right types, nothing
    else. Unknown tools, and arguments that are null or no JSON: false. An optional field may be null."""
    out = F.lit(False)
    for name, fields in schemas.items():
        out = F.when(tool == name, _fits(value, fields)).otherwise(out)
    return F.coalesce(out, F.lit(False))


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level, after): of calls (conv_id, call_id, parent_id, done), a row for each identifier, how many calls it
    waits for, one after another, and the latest `done` of these (null: none). Those in a cycle, or that wait for one, have
    level -1. A parent that is no call of the conversation is none.

    Each round looks twice as far up, so a chain of n calls takes log2(n) rounds; lineage is cut in each.
    """
    known = calls.select("conv_id", F.col("call_id").alias("up"), F.col("done").alias("up_done"))
    at = calls.withColumnRenamed("parent_id", "up").join(known, ["conv_id", "up"], "left")
    has = F.col("up_done").isNotNull()
    at = cut(at.select("conv_id", "call_id", F.when(has, F.col("up")).alias("up"), F.when(has, 1).otherwise(0).alias("level"), F.when(has, F.col("up_done")).alias("after")))
    left, rounds = at.where("up is not null").count(), 0
    while left and (1 << rounds) <= left:  # a chain of the calls that still look up is over by then; what isn't is a cycle
        rounds += 1
        above = at.select("conv_id", F.col("call_id").alias("up"), F.col("up").alias("next"), F.col("level").alias("more"), F.col("after").alias("also"))
        moved = at.join(above, ["conv_id", "up"], "left")
        at = cut(moved.select("conv_id", "call_id", F.col("next").alias("up"), (F.col("level") + F.coalesce("more", F.lit(0))).alias("level"), F.greatest("after", "also").alias("after")))
        now = at.where("up is not null").count()
        if not now:
            break
    looped = F.col("up").isNotNull()
    return at.select("conv_id", "call_id", F.when(looped, -1).otherwise(F.col("level")).alias("level"), F.when(~looped, F.col("after")).alias("after"))


#: Parts over which rows without an identifier are dealt in the join, so that nulls don't meet in one task.
_SALTS = 1024


def linked(events: DataFrame, schemas: Schemas) -> DataFrame:
    """events: conv_id, turn, role, kind (message, call or result), call_id, tool, arguments, content, and perhaps parent_id, the
    call whose result a call waits for; any other columns are ignored.

    Per row: conv_id, turn, role, kind, call_id, linked, valid, order_turn, level, order_phase, message.

    A call is linked if a result has its identifier in its conversation, a result if a call has; of calls that share an
    identifier only the earliest turn's are linked, and results follow it. Sorted by (order_turn, level, order_phase, turn),
    each result follows its call, and each call the first result of every call it waits for: order_turn is at least
    theirs, and level (how many calls it waits for in turn, a result's being its call's, else 0) is larger. Calls in a cycle,
    or that wait for one, have level -1 and aren't valid. valid is null but for calls. A null identifier links nothing.
    message is canonical JSON without the fields that are null; arguments that are no JSON stay as a string. Repeated rows
    are kept and get equal answers.
    """
    parent = F.col("parent_id").cast("string") if "parent_id" in events.columns else F.lit(None).cast("string")
    rows = events.select("conv_id", "turn", "role", "kind", "call_id", "tool", "arguments", "content", parent.alias("parent_id"))
    is_call, is_result = F.coalesce(F.col("kind") == "call", F.lit(False)), F.coalesce(F.col("kind") == "result", F.lit(False))
    keyed = (is_call | is_result) & F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    turn_of = lambda kind: F.min(F.when(kind, F.col("turn")))
    first = F.min_by("parent_id", F.when(is_call, F.col("turn")))
    ids = rows.where(keyed).groupBy("conv_id", "call_id").agg(turn_of(is_call).alias("call_turn"), turn_of(is_result).alias("result_turn"), F.bool_or(is_call).alias("called"), F.bool_or(is_result).alias("answered"), first.alias("parent_id"))
    if "parent_id" in events.columns:
        ids = cut(ids)
        done = F.coalesce(F.greatest("call_turn", "result_turn"), F.lit(-(1 << 63)))
        ids = ids.join(levels(ids.where("called").select("conv_id", "call_id", "parent_id", done.alias("done"))), ["conv_id", "call_id"], "left")
    else:
        ids = ids.withColumns({"level": F.lit(0), "after": F.lit(None).cast("long")})
    ids = ids.select("conv_id", "call_id", F.lit(0).alias("salt"), "call_turn", "called", "answered", "level", F.col("after").alias("after"))
    salted = rows.drop("parent_id").withColumn("salt", F.when(keyed, 0).otherwise(F.pmod(F.xxhash64("conv_id", "turn", "role", "content"), F.lit(_SALTS)).cast("int") + 1))
    out = salted.join(ids.hint("shuffle_hash"), ["conv_id", "call_id", "salt"], "left").withColumn("value", F.try_parse_json(F.when(is_call, F.col("arguments"))))
    call_order = F.greatest("call_turn", "after")
    level = F.coalesce("level", F.lit(0))
    arguments = F.when(is_call, F.coalesce("value", F.col("arguments").cast("variant")))
    message = F.to_json(F.struct(arguments.alias("arguments"), "call_id", "content", "kind", "role", "tool"))
    return out.select(
        "conv_id",
        "turn",
        "role",
        "kind",
        "call_id",
        F.when(is_call, F.coalesce("answered", F.lit(False)) & F.col("turn").eqNullSafe(F.col("call_turn"))).when(is_result, F.coalesce("called", F.lit(False))).otherwise(False).alias("linked"),
        F.when(is_call, (level >= 0) & valid_arguments(F.col("tool"), F.col("value"), schemas)).alias("valid"),
        F.when(is_result, F.greatest("turn", call_order)).when(is_call, F.greatest("turn", "after")).otherwise(F.col("turn")).alias("order_turn"),
        level.alias("level"),
        F.when(is_result, 1).otherwise(0).alias("order_phase"),
        message.alias("message"),
    )


def reply_events(conversations: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) as events: a user turn calls `reply`, the assistant's next turn is its result.

    The identifier is `call_<turn of the user>`. Other roles, and null ones, are messages.
    """
    turn, role = F.col("turn").cast("long"), F.col("role").cast("string")
    text = F.col("text").cast("string")
    is_call, is_result = F.coalesce(role == "user", F.lit(False)), F.coalesce(role == "assistant", F.lit(False))
    called = F.when(is_call, turn).when(is_result, turn - 1)
    return conversations.select(
        "conv_id",
        turn.alias("turn"),
        role.alias("role"),
        F.when(is_call, "call").when(is_result, "result").otherwise("message").alias("kind"),
        F.concat(F.lit("call_"), called.cast("string")).alias("call_id"),
        F.when(is_call, F.lit("reply")).alias("tool"),
        F.when(is_call, F.to_json(F.struct(turn.alias("turn"), text.alias("prompt"), F.length(text).alias("chars")))).alias("arguments"),
        F.when(~is_call, text).alias("content"),
    )


def formatted_conversations(conversations: DataFrame) -> DataFrame:
    """linked(reply_events(conversations)): one row for each turn."""
    return linked(reply_events(conversations), REPLY)
