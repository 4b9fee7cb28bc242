"""Tool calls of conversations: linked to results, put in dependency order, checked and written as canonical JSON."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from plotweave.llm.common import staged
from plotweave.plans.picking import priority_pick

#: Turns of a conversation that one task numbers together, so that a conversation of any length spreads.
TURNS = 256

_CHECKED = StructType([StructField("valid", BooleanType()), StructField("error", StringType()), StructField("canonical", StringType())])
_TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "object": dict, "array": list}


def canonical(value) -> str:
    """JSON with sorted keys and no spaces; whole numbers without a fraction, other characters as they are."""
    def plain(x):
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items()}
        if isinstance(x, list):
            return [plain(v) for v in x]
        return int(x) if isinstance(x, float) and x.is_integer() and abs(x) < 2**53 else x
    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def schema_error(value, schema: dict, at: str = "$") -> str | None:
    """The first way in which a value breaks a schema (type, required, properties, additionalProperties, items, enum, minimum,
    maximum, minLength), or nothing."""
    kind = schema.get("type")
    whole = kind == "integer" and isinstance(value, float) and value.is_integer()
    if kind and not whole and (not isinstance(value, _TYPES[kind]) or (isinstance(value, bool) and kind in ("integer", "number"))):
        return f"{at}: not {kind}"
    if "enum" in schema and value not in schema["enum"]:
        return f"{at}: not one of the allowed values"
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", value) or value > schema.get("maximum", value):
            return f"{at}: out of range"
    if isinstance(value, str) and len(value) < schema.get("minLength", 0):
        return f"{at}: too short"
    if isinstance(value, list) and "items" in schema:
        return next((e for i, x in enumerate(value) if (e := schema_error(x, schema["items"], f"{at}[{i}]"))), None)
    if isinstance(value, dict):
        known = schema.get("properties", {})
        for name in schema.get("required", ()):
            if name not in value:
                return f"{at}.{name}: missing"
        for name in sorted(value):
            if name in known:
                if error := schema_error(value[name], known[name], f"{at}.{name}"):
                    return error
            elif schema.get("additionalProperties") is False:
                return f"{at}.{name}: not allowed"
    return None


def _reject(name: str):
    raise ValueError(f"{name} is no JSON number")


def checked_call(name: str | None, arguments: str | None, schemas: dict) -> dict:
    """Verdict on one call; arguments that are no JSON have no canonical form."""
    try:
        value = json.loads(arguments or "", parse_constant=_reject)
        text = canonical(value)
    except (ValueError, RecursionError):
        return {"valid": False, "error": "arguments are no JSON", "canonical": None}
    if name not in schemas:
        return {"valid": False, "error": "unknown tool", "canonical": text}
    error = schema_error(value, schemas[name])
    return {"valid": error is None, "error": error, "canonical": text}


def _layers(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """``conv_id, call_id, layer`` of conversations in which a call depends on one that stands later.

    Calls whose dependencies are all placed go first, round by round; as many rounds as the longest chain of such a
    conversation. Calls on a cycle, and those behind one, get no layer.
    """
    late = edges.where("late").select("conv_id").distinct()
    open_calls = staged(calls.join(late, "conv_id", "left_semi").select("conv_id", "call_id"), "open")
    open_edges = staged(edges.join(late, "conv_id", "left_semi").select("conv_id", "call_id", "needs"), "needs")
    done = open_calls.select("*", F.lit(0).alias("layer")).limit(0)
    layer = 0
    while True:
        ready = staged(open_calls.join(open_edges.select("conv_id", "call_id").distinct(), ["conv_id", "call_id"], "left_anti"), "ready")
        if ready.isEmpty():
            break
        done = done.union(ready.withColumn("layer", F.lit(layer)))
        open_calls = staged(open_calls.join(ready, ["conv_id", "call_id"], "left_anti"), "open")
        open_edges = staged(open_edges.join(ready.withColumnRenamed("call_id", "needs"), ["conv_id", "needs"], "left_anti"), "needs")
        layer += 1
    return done.union(open_calls.withColumn("layer", F.lit(None).cast("int")))


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict) -> DataFrame:
    """One row per call and per result without a call: ``conv_id, position, call_id, turn, status, n_results, valid, error, json``.

    ``calls``: ``conv_id, call_id, turn, name, arguments`` (JSON text), ``depends`` (ids of calls of the conversation that
    come first). ``results``: ``conv_id, call_id, turn, content``.

    Calls and results meet in a hash join on (conversation, id). A call's result is the earliest one, by turn and content;
    ``n_results`` counts all. ``status`` is ``linked``, ``no result``, ``early`` (result before the call), ``cycle`` (the call depends on itself,
    directly or not) or ``orphan`` (a result whose call is missing). Arguments are checked against the tool's schema.

    ``position`` numbers a conversation's rows, from 0: calls after all calls they depend on, otherwise by (turn, id); orphans stand
    by their turn. Where no call depends on a later one that is the order of turns. Unknown dependencies do not hold a
    call back. Calls on a cycle come last.

    Rows without a conversation or an id stand alone: they are linked with nothing. A repeated call id counts once, the first by (turn,
    name, arguments). Numbering counts blocks of ``TURNS`` turns first, so no conversation is sorted in one task.
    Empty tables give no rows; other columns are ignored.
    """
    plain = calls.select("conv_id", "call_id", "turn", "name", "arguments", "depends")
    named = plain.where(F.col("conv_id").isNotNull() & F.col("call_id").isNotNull())
    once = staged(priority_pick(named, ["conv_id", "call_id"], ["turn", "name", "arguments", F.to_json(F.struct("depends"))]), "calls")
    loose = plain.where(F.col("conv_id").isNull() | F.col("call_id").isNull())

    answers = results.where(F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()).groupBy("conv_id", "call_id").agg(
        F.min(F.struct(F.col("turn").alias("t"), F.col("content").alias("c"))).alias("_first"), F.count("*").alias("n_results"))
    edges = (
        once.select("conv_id", "call_id", "turn", F.explode(F.array_distinct("depends")).alias("needs"))
        .join(once.select("conv_id", F.col("call_id").alias("needs"), F.col("turn").alias("_turn")), ["conv_id", "needs"])
        .select("conv_id", "call_id", "needs",
                (F.struct(F.col("_turn"), F.col("needs")) >= F.struct(F.col("turn"), F.col("call_id"))).alias("late"))
    )
    layers = _layers(once, edges)
    placed = once.join(layers.withColumn("_layered", F.lit(True)), ["conv_id", "call_id"], "left").join(answers, ["conv_id", "call_id"], "full")
    missing = F.col("name").isNull() & F.col("turn").isNull() & F.col("arguments").isNull()
    status = (
        F.when(missing & F.col("_first").isNotNull(), "orphan")
        .when(F.col("_layered") & F.col("layer").isNull(), "cycle")
        .when(F.col("_first").isNull(), "no result")
        .when(F.col("_first.t") < F.col("turn"), "early").otherwise("linked")
    )
    lone = loose.select("*", F.lit("no result").alias("status"))
    lost = results.where(F.col("conv_id").isNull() | F.col("call_id").isNull()).select(
        "conv_id", "call_id", "turn", F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("arguments"),
        F.lit("orphan").alias("status"), F.lit(1).cast("bigint").alias("n_results"), F.col("content").alias("result"),
        F.lit(0).alias("layer"))
    rows = placed.select(
        "conv_id", "call_id", F.coalesce("turn", "_first.t").alias("turn"), "name", "arguments", status.alias("status"),
        F.coalesce("n_results", F.lit(0).cast("bigint")).alias("n_results"), F.col("_first.c").alias("result"),
        F.when(F.col("_layered"), F.coalesce("layer", F.lit(2**31 - 1))).otherwise(F.lit(0)).alias("layer"),
    ).union(lone.select("conv_id", "call_id", "turn", "name", "arguments", "status", F.lit(0).cast("bigint"), F.lit(None).cast("string"), F.lit(0))
            ).union(lost.select("conv_id", "call_id", "turn", "name", "arguments", "status", "n_results", "result", "layer"))
    return _written(_numbered(staged(rows, "linked")), schemas)


def _numbered(rows: DataFrame) -> DataFrame:
    """Positions within conversations by (layer, turn, id), by counts of blocks of turns and places within a block."""
    block = ["layer", "_block"]
    blocked = rows.withColumn("_block", F.floor(F.coalesce("turn", F.lit(-1)) / TURNS))
    counts = blocked.groupBy("conv_id", *block).agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("conv_id").orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("conv_id").alias("_conv"), F.col("layer").alias("_layer"), F.col("_block").alias("_at"),
                           F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    within = Window.partitionBy("conv_id", *block).orderBy("turn", "call_id", "status", "name", "arguments", "result")
    same = blocked["conv_id"].eqNullSafe(starts["_conv"]) & (blocked["layer"] == starts["_layer"]) & (blocked["_block"] == starts["_at"])
    return blocked.join(starts, same).withColumn("position", F.col("_start") + F.row_number().over(within) - 1)


def _written(rows: DataFrame, schemas: dict) -> DataFrame:
    """Verdicts, and one canonical JSON object per row."""
    def check(names: pa.Array, arguments: pa.Array) -> pa.Array:
        return pa.array([checked_call(n, a, schemas) for n, a in zip(names.to_pylist(), arguments.to_pylist())],
                        pa.struct([("valid", pa.bool_()), ("error", pa.string()), ("canonical", pa.string())]))

    def quote(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else canonical(t) for t in texts.to_pylist()], pa.string())

    check.__annotations__ = {"names": pa.Array, "arguments": pa.Array, "return": pa.Array}
    quote.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    quoted = F.arrow_udf(quote, StringType())
    tried = rows.withColumn("_c", F.arrow_udf(check, _CHECKED)("name", "arguments")).withColumns(
        {f"_{c}": quoted(F.col(c).cast("string")) for c in ("call_id", "name", "arguments", "result")})
    orphan = F.col("status") == "orphan"
    field = lambda key, value: F.when(value.isNotNull(), F.concat(F.lit(f'"{key}":'), value))
    body = F.concat(F.lit("{"), F.concat_ws(
        ",", F.when(~orphan, field("arguments", F.coalesce("_c.canonical", "_arguments"))), field("id", F.col("_call_id")),
        field("name", F.col("_name")), field("result", F.col("_result"))), F.lit("}"))
    return tried.select(
        "conv_id", F.col("position").cast("bigint").alias("position"), "call_id", "turn", "status", "n_results",
        F.when(~orphan, F.col("_c.valid")).alias("valid"), F.when(~orphan, F.col("_c.error")).alias("error"), body.alias("json"))


# --- messages as calls -----------------------------------------------------------------------------

#: Tools of the message form below.
MESSAGE_SCHEMAS = {
    "configure": {"type": "object", "required": ["text"], "additionalProperties": False,
                  "properties": {"text": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0, "maximum": 0}}},
    "reply": {"type": "object", "required": ["text", "turn"], "additionalProperties": False,
              "properties": {"text": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}, "to": {"type": "string"}}},
}


def message_calls(messages: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Calls and results that plain conversations stand for.

    A message of the system configures and one of the assistant replies: both are calls whose id follows from
    (conversation, turn). The message at the next turn is the result of that call if a user wrote it. A reply depends on the call two turns before.
    A user's message that follows no call is an orphan result.
    """
    name = lambda t: F.concat(F.lit("call_"), F.substring(F.md5(F.concat_ws(":", F.col(conv_id), t)), 1, 16))
    called = messages.where(F.col(role).isin("system", "assistant"))
    reply = F.col(role) == "assistant"
    arguments = F.to_json(F.struct(
        F.col(turn).alias("turn"), F.col(text).alias("text"), F.when(reply & (F.col(turn) >= 2), name(F.col(turn) - 2)).alias("to")))
    calls = called.select(
        F.col(conv_id).alias("conv_id"), F.when(F.col(turn).isNotNull(), name(F.col(turn))).alias("call_id"), F.col(turn).alias("turn"),
        F.when(reply, "reply").otherwise("configure").alias("name"), arguments.alias("arguments"),
        F.array_compact(F.array(F.when(reply & (F.col(turn) >= 2), name(F.col(turn) - 2)))).alias("depends"))
    results = messages.where(F.col(role) == "user").select(
        F.col(conv_id).alias("conv_id"), F.when(F.col(turn).isNotNull(), name(F.col(turn) - 1)).alias("call_id"), F.col(turn).alias("turn"),
        F.col(text).alias("content"))
    return calls, results
