"""Tool calls of conversations: linked to their results, ordered, checked against schemas, serialised."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import stored

_KINDS = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict, "null": type(None)}


def problems(value, schema: dict, at: str = "$") -> list[str]:
    """What of a value breaks a schema (type, enum, properties, required, additionalProperties, items,
    minimum, maximum), as sorted "place: rule" lines."""
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(isinstance(value, _KINDS[k]) and (k in ("boolean",) or not isinstance(value, bool)) for k in kinds):
        return [f"{at}: type"]
    found = []
    if "enum" in schema and value not in schema["enum"]:
        found.append(f"{at}: enum")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        found += [f"{at}: minimum"] * (value < schema.get("minimum", value)) + [f"{at}: maximum"] * (value > schema.get("maximum", value))
    if isinstance(value, dict):
        known = schema.get("properties", {})
        found += [f"{at}.{k}: required" for k in schema.get("required", []) if k not in value]
        for k, v in value.items():
            if k in known:
                found += problems(v, known[k], f"{at}.{k}")
            elif schema.get("additionalProperties", True) is False:
                found.append(f"{at}.{k}: unknown")
    if isinstance(value, list) and "items" in schema:
        for i, v in enumerate(value):
            found += problems(v, schema["items"], f"{at}[{i}]")
    return sorted(found)


def canonical(value) -> str:
    """JSON with sorted keys, no spaces, and all signs as they are."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


#: Arguments nested deeper are refused.
MOST_DEPTH = 100


def parsed(text: str | None) -> tuple[object, list[str]]:
    """The value of a call's argument text, and why it can't be arguments: not JSON, nested too deep, a sign that UTF-8 lacks
    (half of a surrogate pair), a number that JSON lacks, or no object."""
    if text is None:
        return None, ["$: type"]
    try:
        value = json.loads(text)
    except RecursionError:
        return None, ["$: depth"]
    except ValueError:
        return None, ["$: JSON"]
    open_values, depth = [value], 0
    while open_values:
        depth += 1
        inner: list = []
        for v in open_values:
            if isinstance(v, dict):
                inner += [*v.keys(), *v.values()]
            elif isinstance(v, list):
                inner += v
            elif isinstance(v, str) and any("\ud800" <= c <= "\udfff" for c in v):
                return None, ["$: encoding"]
            elif isinstance(v, float) and v - v != 0:
                return None, ["$: number"]
        open_values = inner
        if depth > MOST_DEPTH:
            return None, ["$: depth"]
    return value, [] if isinstance(value, dict) else ["$: type"]


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of calls (conv_id, call_id, needs): 0 without needs, else one more than
    the highest level needed.  A need that is no call of the conversation does not count.  A call on a
    cycle, or behind one, gets no row.  Rounds are as many as levels, each a written table."""
    edges = calls.select("conv_id", "call_id", F.explode("needs").alias("need")).distinct()
    have = calls.select("conv_id", F.col("call_id").alias("need"))
    edges = stored(edges.join(have, ["conv_id", "need"], "left_semi"), "needs")
    left = edges.select("conv_id", "call_id").distinct()
    done = stored(calls.select("conv_id", "call_id").join(left, ["conv_id", "call_id"], "left_anti").withColumn("level", F.lit(0)), "level")
    placed, level = done, 0
    while True:
        level += 1
        met = done.select("conv_id", F.col("call_id").alias("need"))
        # Of the calls that lean on this level, those that lean on nothing that is still open.
        next_ones = edges.join(met, ["conv_id", "need"], "left_semi").select("conv_id", "call_id").distinct()
        known = placed.select("conv_id", F.col("call_id").alias("need"))
        still = edges.join(next_ones, ["conv_id", "call_id"], "left_semi").join(known, ["conv_id", "need"], "left_anti").select("conv_id", "call_id").distinct()
        done = stored(next_ones.join(still, ["conv_id", "call_id"], "left_anti").withColumn("level", F.lit(level)), "level")
        if done.isEmpty():
            return placed
        placed = placed.unionByName(done)


def numbered(df: DataFrame, order: list[str], name: str, which: str = "true") -> DataFrame:
    """df with the running count, within each conv_id, of the rows where ``which`` holds, in this order.

    Rows are range-partitioned by conv_id and the order and written once, so that a conversation may
    be longer than a task takes; what it has in earlier partitions is added, a row a partition.
    """
    keys = ["conv_id", *order]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = stored(df.repartitionByRange(parts, *keys).withColumn("_part", F.spark_partition_id()), "numbered")
    here = Window.partitionBy("conv_id", "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ends = rows.groupBy("conv_id", "_part").agg(F.count_if(F.expr(which)).alias("_n"), F.count(F.lit(1)).alias("_all"))
    ends = stored(ends, "ends")
    # Only conversations that lie in several partitions have rows before a partition.
    split = ends.groupBy("conv_id").agg(F.count(F.lit(1)).alias("_parts")).where("_parts > 1").select("conv_id")
    past = Window.partitionBy("conv_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = stored(ends.join(split, "conv_id").select("conv_id", "_part", F.coalesce(F.sum("_n").over(past), F.lit(0)).alias("_before")), "before")
    counted = rows.withColumn(name, F.count_if(F.expr(which)).over(here))
    return counted.join(before, ["conv_id", "_part"], "left").withColumn(name, F.col(name) + F.coalesce("_before", F.lit(0))).drop("_part", "_before")


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """A row per call id of calls (conv_id, call_id, turn, name, arguments, needs) with its result of
    results (conv_id, call_id, turn, content).

    Returns (conv_id, call_id, turn, level, position, name, n_calls, n_results, status, problems, message).
    The rows are in no order; position counts a conversation's calls from 1 by level, turn and call_id,
    so that every call comes after those it needs; calls without a level have none.  status is, in this
    order: cycle, unknown tool, invalid arguments, unanswered, ok.  message is canonical JSON of the call
    and its result.  Of several calls or results with one id in a conversation, that of the smallest
    turn counts, ties to the smaller name and text.  Results without a call come as rows of status
    "no call".

    Null ids of calls and results link with nothing and are left out; a null conv_id is a conversation
    of its own; arguments that are null, no JSON object, nested more than MOST_DEPTH deep or hold what UTF-8 or JSON lack are
    invalid and serialised as null (a value that is no object as it is); needs may be null.  Empty tables
    give no rows; other columns are ignored.
    """
    conv = F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv_id")
    listed = F.coalesce(F.col("needs"), F.array().cast("array<string>")).alias("needs")
    calls = calls.where("call_id IS NOT NULL").select(conv, "call_id", "turn", "name", "arguments", listed)
    calls = calls.groupBy("conv_id", "call_id").agg(
        F.min(F.struct("turn", "name", "arguments", "needs")).alias("c"), F.count(F.lit(1)).alias("n_calls")).select("conv_id", "call_id", "c.*", "n_calls")
    calls = stored(calls, "calls")
    results = results.where("call_id IS NOT NULL").select(conv, "call_id", F.col("turn").alias("rturn"), "content")
    results = results.groupBy("conv_id", "call_id").agg(
        F.min(F.struct("rturn", "content")).alias("r"), F.count(F.lit(1)).alias("n_results")).select("conv_id", "call_id", "r.content", "r.rturn", "n_results")
    leveled = levels(calls).join(calls.select("conv_id", "call_id", "turn"), ["conv_id", "call_id"])
    placed = numbered(leveled, ["level", "turn", "call_id"], "position").drop("turn")
    joined = calls.join(results.hint("shuffle_hash"), ["conv_id", "call_id"], "full").join(placed, ["conv_id", "call_id"], "left")

    def work(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            status, wrong, message = [], [], []
            for r in batch.to_pylist():
                arguments, found = parsed(r["arguments"])
                schema = schemas.get(r["name"])
                if not found and schema is not None:
                    found = problems(arguments, schema)
                state = ("no call" if r["n_calls"] is None else "cycle" if r["level"] is None else "unknown tool" if schema is None
                         else "invalid arguments" if found else "unanswered" if r["n_results"] is None else "ok")
                status.append(state)
                wrong.append(found if r["n_calls"] is not None else [])
                call = None if r["n_calls"] is None else {"arguments": arguments, "id": r["call_id"], "name": r["name"]}
                message.append(canonical({"call": call, "result": r["content"]}))
            keep = batch.select(["conv_id", "call_id", "turn", "level", "position", "name", "n_calls", "n_results"])
            yield pa.RecordBatch.from_arrays([*keep.columns, pa.array(status, pa.string()), pa.array(wrong, pa.list_(pa.string())), pa.array(message, pa.string())],
                                             names=[*keep.schema.names, "status", "problems", "message"])

    ready = joined.select("conv_id", "call_id", F.coalesce("turn", "rturn").cast("long").alias("turn"), "level", "position", "name", "arguments", "content", "n_calls", "n_results")
    return ready.mapInArrow(work, "conv_id string, call_id string, turn long, level int, position long, name string, n_calls long, n_results long, status string, problems array<string>, message string")


#: Schemas of the tools that derived() calls.
SCHEMAS = {
    "search": {"type": "object", "required": ["query", "limit"], "additionalProperties": False,
               "properties": {"query": {"type": "string"}, "limit": {"type": "integer", "minimum": 1, "maximum": 40}, "after": {"type": "string"}}},
    "measure": {"type": "object", "required": ["n_chars"], "properties": {"n_chars": {"type": "integer", "minimum": 1}}},
}


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, nth, call_id): all turns of conversations (conv_id, turn, role, text).

    nth counts the assistant's turns so far.  Each assistant's turn makes the call of its number; the
    first user's turn after it, before the next assistant's, is that call's result.  Other turns have
    a null call_id.
    """
    told = conversations.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.col("text").cast("string").alias("text"))
    nth = numbered(told, ["turn", "role", "text"], "nth", "role = 'assistant'")
    # Of the user's turns that follow one assistant's turn, the first answers.
    answers = nth.where("role = 'user' AND nth > 0").groupBy("conv_id", "nth").agg(F.min(F.struct("turn", "text")).alias("first"))
    answers = answers.select("conv_id", "nth", F.col("first.turn").alias("_turn"), F.col("first.text").alias("_text"))
    mine = nth.join(answers, ["conv_id", "nth"], "left")
    answer = (F.col("role") == "user") & F.col("turn").eqNullSafe(F.col("_turn")) & F.col("text").eqNullSafe(F.col("_text")) & (F.col("nth") > 0)
    call_id = F.when((F.col("role") == "assistant") | answer, call_name(F.col("nth")))
    return mine.select("conv_id", "turn", "role", "text", "nth", call_id.alias("call_id"))


def call_name(nth: Column) -> Column:
    return F.concat(F.lit("call-"), nth.cast("string"))


def derived(told: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results made from turns().

    An assistant's turn calls a tool with arguments from its text, after the call of the assistant's
    turn half as far into the conversation.
    """
    words = F.size(F.split(F.coalesce("text", F.lit("")), " "))
    nth = F.col("nth")
    search = nth % 2 == 1
    name = F.when(search, "search").when(nth % 8 == 0, "other").otherwise("measure")
    before = call_name(F.floor((nth + 1) / 2))
    arguments = F.when(search, F.to_json(F.struct(
        F.substring_index(F.coalesce("text", F.lit("")), " ", 3).alias("query"), words.alias("limit"), F.when(nth > 1, before).alias("after"))))
    arguments = arguments.otherwise(F.to_json(F.struct(F.length(F.coalesce("text", F.lit(""))).alias("n_chars"))))
    calls = told.where("role = 'assistant'").select(
        "conv_id", "call_id", "turn", name.alias("name"), arguments.alias("arguments"), F.when(nth > 1, F.array(before)).alias("needs"))
    results = told.where("role = 'user' AND call_id IS NOT NULL").select("conv_id", "call_id", "turn", F.col("text").alias("content"))
    return calls, results


def linked(conversations: DataFrame) -> DataFrame:
    """Whole conversations as chat: a row of kind "turn" for each turn, of kind "call" for each call.

    The call rows are those of link() over the derived calls and results.  A turn row has the turn's
    role as status, the call it makes or answers as call_id, and as message canonical JSON of role,
    whole text and that call.  Repeated rows are turns each for itself.
    """
    told = stored(turns(conversations), "turns")
    called = link(*derived(told), SCHEMAS).withColumn("kind", F.lit("call"))

    def work(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            message = [canonical({"call": r["call_id"], "content": r["text"], "role": r["role"]}) for r in batch.to_pylist()]
            keep = batch.select(["conv_id", "call_id", "turn", "role"])
            yield pa.RecordBatch.from_arrays([*keep.columns, pa.array(message, pa.string())], names=["conv_id", "call_id", "turn", "status", "message"])

    chat = told.mapInArrow(work, "conv_id string, call_id string, turn long, status string, message string").withColumn("kind", F.lit("turn"))
    return chat.unionByName(called, allowMissingColumns=True).select("kind", *(c for c in called.columns if c != "kind"))
