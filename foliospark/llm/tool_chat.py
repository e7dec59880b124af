"""Chat formatting with linked tool calls.

Calls and results are joined by conversation and identifier, calls are ordered so that each comes after those that it
depends on, arguments are validated against the tool's schema, and every call becomes one line of canonical JSON:
keys sorted, no spaces, characters as themselves.

Results are reduced to one an identifier (the earliest; of ties, the least) before the join, so repeated results don't
multiply calls, and no conversation is gathered in a task: where every dependency has an earlier turn, the turn is the
order; the others are ordered in rounds, a call a round after its last dependency.

Defined results: a call without an identifier, or without a result, stays unlinked with a null result; dependencies on
unknown calls are ignored but reported; calls in a cycle, or after one, have no step and are invalid; null or broken
arguments and unknown tools are invalid and kept as text; repeated calls are kept; empty tables give no rows. Other
columns are not read.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, spill

LINES = "conv_id long, call_id string, turn long, step long, name string, linked boolean, valid boolean, errors string, json string"
_TYPES = {"string": str, "boolean": bool, "object": dict, "array": list, "null": type(None)}


def canonical(value: Any) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)


def _parse(text: str | None) -> Any:
    def distinct(pairs: list[tuple[str, Any]]) -> dict:
        if len({k for k, _ in pairs}) < len(pairs):
            raise ValueError("repeated key")
        return dict(pairs)

    def refuse(name: str) -> None:
        raise ValueError(name)

    value = json.loads(text or "", object_pairs_hook=distinct, parse_constant=refuse)
    canonical(value)  # refuses numbers beyond those of JSON
    return value


def violations(value: Any, schema: dict, at: str = "$") -> list[str]:
    """What of a JSON schema (type, enum, const, bounds, lengths, items, properties, required, additionalProperties) a value breaks."""
    out, kinds = [], schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds

    def number(v: Any) -> bool:
        return isinstance(v, (int, float)) and not isinstance(v, bool)

    def fits(kind: str) -> bool:
        return number(value) if kind == "number" else number(value) and value == math.floor(value) if kind == "integer" else isinstance(value, _TYPES[kind])

    if kinds and not any(map(fits, kinds)):
        return [f"{at}: type"]
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: enum")
    if "const" in schema and value != schema["const"]:
        out.append(f"{at}: const")
    if number(value) and not schema.get("minimum", -math.inf) <= value <= schema.get("maximum", math.inf):
        out.append(f"{at}: range")
    if isinstance(value, (str, list)):
        low, high = ("minLength", "maxLength") if isinstance(value, str) else ("minItems", "maxItems")
        if not schema.get(low, 0) <= len(value) <= schema.get(high, math.inf):
            out.append(f"{at}: length")
    if isinstance(value, list) and "items" in schema:
        for i, v in enumerate(value):
            out += violations(v, schema["items"], f"{at}[{i}]")
    if isinstance(value, dict):
        own = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        more = schema.get("additionalProperties", True)
        for k in sorted(value):
            if k in own:
                out += violations(value[k], own[k], f"{at}.{k}")
            elif more is False:
                out.append(f"{at}.{k}: unknown")
            elif isinstance(more, dict):
                out += violations(value[k], more, f"{at}.{k}")
    return out


def line(schemas: dict[str, dict], call_id: str | None, name: str | None, arguments: str | None, result: str | None, unknown: int, cyclic: bool) -> tuple[bool, str, str]:
    """Whether a call is valid, its errors, and its canonical JSON."""
    errors = []
    try:
        value = _parse(arguments)
        errors += violations(value, schemas[name]) if name in schemas else ["unknown tool"]
    except (ValueError, RecursionError):
        value = arguments
        errors.append("broken arguments")
    if unknown:
        errors.append("unknown dependency")
    if cyclic:
        errors.append("cyclic dependency")
    try:
        told = _parse(result)
    except (ValueError, RecursionError):
        told = result
    valid = not [e for e in errors if e != "unknown dependency"]
    return valid, "; ".join(errors), canonical({"arguments": value, "id": call_id, "name": name, "result": told})


def _lines(schemas: dict[str, dict]):
    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = {n: b.column(n).to_pylist() for n in ("call_id", "name", "arguments", "result", "unknown", "cyclic")}
            found = [line(schemas, *r) for r in zip(*c.values(), strict=True)]
            valid, errors, text = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_pydict({n: b.column(n) for n in ("conv_id", "call_id", "turn", "step", "name", "linked")} | {"valid": pa.array(valid, pa.bool_()), "errors": pa.array(errors, pa.string()), "json": pa.array(text, pa.string())})

    return lines


def _steps(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """conv_id, call_id, level of nodes, none for those in or after a cycle; and what to discard afterwards. edges: conv_id, call_id, dep.

    A round a level, each over the calls and dependencies that are left. Levels are written apart and united at the end.
    """
    todo, level, levels = nodes, 0, []
    while True:
        ready = spill(todo.join(edges.select("conv_id", "call_id").distinct(), ["conv_id", "call_id"], "left_anti").withColumn("level", F.lit(level).cast("long")))
        levels.append(ready)
        if ready.isEmpty():
            discard(todo, edges)
            done = levels[0]
            for more in levels[1:]:
                done = done.unionByName(more)
            return done, levels
        done_now = ready.select("conv_id", "call_id")
        was = todo, edges
        todo = spill(todo.join(done_now, ["conv_id", "call_id"], "left_anti"))
        edges = spill(edges.join(done_now.withColumnRenamed("call_id", "dep"), ["conv_id", "dep"], "left_anti"))
        discard(*was)
        level += 1


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """calls: conv_id, turn, call_id, name, arguments (JSON), after (identifiers). results: conv_id, turn, call_id, content. A row a call, as in LINES."""
    calls = calls.select("conv_id", "turn", "call_id", "name", "arguments", "after")
    told = results.where("call_id is not null").groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "content")).alias("_r"))
    known = calls.where("call_id is not null").groupBy("conv_id", "call_id").agg(F.max("turn").alias("_t"))
    asked = calls.select("conv_id", "call_id", "turn", F.explode(F.array_distinct("after")).alias("dep")).where("dep is not null")
    edges = asked.join(known.select("conv_id", F.col("call_id").alias("dep"), "_t"), ["conv_id", "dep"], "left")
    unknown = edges.where("_t is null and call_id is not null").groupBy("conv_id", "call_id").agg(F.count("*").alias("_u"))
    edges = edges.where("_t is not null and call_id is not null")
    late = spill(edges.where("_t >= turn or turn is null").select("conv_id").distinct())
    rows = calls.join(told, ["conv_id", "call_id"], "left").join(unknown, ["conv_id", "call_id"], "left")
    used = [late]
    if late.isEmpty():
        rows = rows.withColumn("step", F.col("turn")).withColumn("cyclic", F.lit(False))
    else:
        some = edges.join(late, "conv_id", "left_semi").select("conv_id", "call_id", "dep").distinct()
        levels, written = _steps(spill(some), spill(known.join(late, "conv_id", "left_semi").select("conv_id", "call_id")))
        used += written
        rows = rows.join(levels, ["conv_id", "call_id"], "left").join(late.withColumn("_late", F.lit(True)), "conv_id", "left")
        rows = rows.withColumn("cyclic", F.coalesce("_late", F.lit(False)) & F.col("level").isNull() & F.col("call_id").isNotNull()).withColumn("step", F.when(F.col("_late"), F.col("level")).otherwise(F.col("turn")))
    rows = rows.select("conv_id", "call_id", "turn", "step", "name", F.col("_r").isNotNull().alias("linked"), "arguments", F.col("_r.content").alias("result"), F.coalesce("_u", F.lit(0)).alias("unknown"), "cyclic")
    out = spill(rows.mapInArrow(_lines(schemas), LINES))
    discard(*used)
    return out


#: The tool of the turns below.
ANSWER = {"answer": {"type": "object", "required": ["text", "turn"], "additionalProperties": False, "properties": {"text": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}}}}


def turns_as_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Plain conversations as calls of `answer`, in all the states that real logs have, as the CRC of a turn's text says.

    Each user turn asks, and the next turn, if the assistant's, is its result. It depends on the user turn two before,
    or on the one two after (out of order, or a cycle if that one depends on it), on itself, or on none. Its arguments
    are right, or have a wrong type, lack a field, are cut off, or name another tool; it is logged once or twice; a
    result may be logged again later, with other content, which doesn't count.
    """
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("_h", F.crc32(F.coalesce("text", F.lit("")).cast("binary")))
    name = lambda t: F.concat_ws("-", F.col("conv_id").cast("string"), t.cast("string"))
    after, kind, again = F.col("_h") % 6, F.expr("_h div 6 % 8"), F.expr("_h div 48 % 4")
    turn = F.col("turn")
    right = F.to_json(F.struct("text", "turn"))
    arguments = F.when(kind == 0, F.to_json(F.struct("text", turn.cast("string").alias("turn")))).when(kind == 1, F.to_json(F.struct("turn"))).when(kind == 2, right.substr(F.lit(1), F.length(right) - 1)).otherwise(right)
    before = F.when(after == 0, turn + 2).when(after == 1, turn).when((after > 2) & (turn >= 2), turn - 2)
    deps = F.when(before.isNotNull(), F.array(name(before))).otherwise(F.array().cast("array<string>"))
    calls = rows.where("role = 'user'").select("conv_id", "turn", name(turn).alias("call_id"), F.when(kind == 3, "search").otherwise("answer").alias("name"), arguments.alias("arguments"), deps.alias("after"), F.explode(F.when(again == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy")).drop("_copy")
    told = rows.where("role = 'assistant'")
    copies = F.explode(F.when(again == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy")
    results = told.select("conv_id", "turn", "text", name(turn - 1).alias("call_id"), copies)
    return calls, results.select("conv_id", (turn + F.col("_copy")).alias("turn"), "call_id", F.when(F.col("_copy") == 0, F.to_json(F.struct("text"))).otherwise("late").alias("content"))
