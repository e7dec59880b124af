import json
import zlib

import pytest

from foliospark.llm import tool_chat as t

CALLS = "conv_id long, turn long, call_id string, name string, arguments string, after array<string>, step string"
RESULTS = "conv_id long, turn long, call_id string, content string, name string"


def link(spark, calls, results, schemas=t.ANSWER):
    return t.link(spark.createDataFrame([(*c, "x") for c in calls], CALLS), spark.createDataFrame([(*r, "x") for r in results], RESULTS), schemas).collect()


def brute(rows):
    """The calls that turns_as_calls should make of (conv_id, turn, role, text), and their lines."""
    turns = {(c, n): (role, text) for c, n, role, text in rows}
    h = lambda text: zlib.crc32(text.encode())
    deps = {}
    for (c, n), (role, text) in turns.items():
        if role == "user":
            kind = h(text) % 6
            deps[c, n] = {0: n + 2, 1: n, 2: None}.get(kind, n - 2 if n >= 2 else None)
    levels, out = {}, []
    ordered = lambda c, n: [m for m in (deps[c, n],) if (c, m) in deps]
    for level in range(99):
        ready = [k for k in deps if k not in levels and all((k[0], m) in levels for m in ordered(*k))]
        levels |= dict.fromkeys(ready, level)
    late = {c for c, n in deps if any(m >= n for m in ordered(c, n))}
    for (c, n), (role, text) in turns.items():
        if role != "user":
            continue
        kind = h(text) // 6 % 8
        right = {"text": text, "turn": n}
        value, errors = {0: ({"text": text, "turn": str(n)}, ["$.turn: type"]), 1: ({"turn": n}, ["$.text: missing"]), 3: (right, ["unknown tool"])}.get(kind, (right, []))
        if kind == 2:
            value, errors = json.dumps(right, ensure_ascii=False, separators=(",", ":"))[:-1], ["broken arguments"]
        told = turns.get((c, n + 1))
        told = {"text": told[1]} if told and told[0] == "assistant" else None
        cyclic = (c, n) not in levels
        valid = not errors and not cyclic
        errors += ["unknown dependency"] * (deps[c, n] is not None and not ordered(c, n)) + ["cyclic dependency"] * cyclic
        step = levels.get((c, n)) if c in late else n
        line = json.dumps({"arguments": value, "id": f"{c}-{n}", "name": "search" if kind == 3 else "answer", "result": told}, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
        out += [(f"{c}-{n}", step, told is not None, valid, "; ".join(errors), line)] * (1 + (h(text) // 48 % 4 == 0))
    return sorted(out, key=str)


def test_conversations_against_brute_force(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    made = [(10**6 + c, n, ("user", "assistant")[n % 2], f"text {c} {n}") for c in range(60) for n in range(10)]
    rows = [tuple(r) for r in table.collect()] + made
    got = t.link(*t.turns_as_calls(spark.createDataFrame(rows, table.schema)), t.ANSWER).collect()
    want = brute(rows)
    assert sorted(((r.call_id, r.step, r.linked, r.valid, r.errors, r.json) for r in got), key=str) == want
    # every state comes up
    errors = {e for w in want for e in w[4].split("; ")}
    assert errors >= {"", "$.turn: type", "$.text: missing", "unknown tool", "broken arguments", "unknown dependency", "cyclic dependency"}
    assert any(w[1] is not None and w[1] != int(w[0].split("-")[1]) for w in want) and len(set(want)) < len(want)


def test_order_cycles_and_ties(spark):
    args = '{"turn":1, "text":"é"}'
    calls = [(1, 0, "a", "answer", args, ["b"]), (1, 1, "b", "answer", args, ["c", "c", "zz"]), (1, 2, "c", "answer", args, None), (2, 0, "a", "answer", args, ["b"]), (2, 1, "b", "answer", args, ["a"]), (2, 2, "c", "answer", args, ["a"]), (3, 5, "a", "answer", args, []), (3, 5, "a", "answer", args, [])]
    results = [(1, 9, "a", "2"), (1, 8, "a", "1"), (1, 8, "a", "0"), (3, 6, "a", "not json")]
    got = link(spark, calls, results)
    assert len(got) == len(calls)
    by = {(r.conv_id, r.call_id): r for r in got}
    assert [by[1, x].step for x in "abc"] == [2, 1, 0] and by[1, "b"].errors == "unknown dependency" and by[1, "b"].valid
    assert all(by[2, x].step is None and not by[2, x].valid for x in "abc")
    assert by[1, "a"].json == '{"arguments":{"text":"é","turn":1},"id":"a","name":"answer","result":0}'
    assert by[3, "a"].json.endswith('"result":"not json"}') and by[3, "a"].step == 5


def test_nulls_and_empty(spark):
    got = link(spark, [(None, None, None, None, None, None), (1, 1, "x", "answer", "{", None)], [(None, None, None, None), (1, 2, "x", None)])
    assert sorted((r.linked, r.valid, r.errors) for r in got) == [(False, False, "broken arguments"), (True, False, "broken arguments")]
    assert link(spark, [], []) == []
    assert len(link(spark, [(1, 1, "x", "answer", json.dumps({"text": "w " * 99999, "turn": 0}), [])], [])) == 1


@pytest.mark.parametrize(("arguments", "errors"), [('{"text":"","turn":1}', "$.text: length"), ('{"text":"a","turn":1.5}', "$.turn: type"), ('{"text":"a","turn":true}', "$.turn: type"), ('{"text":"a","turn":-1}', "$.turn: range"), ('{"turn":1}', "$.text: missing"), ('{"text":"a","turn":1,"z":2}', "$.z: unknown"), ('{"text":"a","text":"b","turn":1}', "broken arguments"), ("NaN", "broken arguments"), ("[]", "$: type"), ('{"turn":1.0,"text":"a"}', "")])
def test_schemas(arguments, errors):
    assert t.line(t.ANSWER, "i", "answer", arguments, None, 0, False)[1] == errors


def test_more_of_schemas():
    schema = {"type": "object", "properties": {"k": {"enum": ["a", 1]}, "l": {"type": "array", "items": {"type": ["integer", "null"]}, "maxItems": 2}}, "additionalProperties": {"type": "boolean"}}
    assert t.violations({"k": "a", "l": [1, None], "x": True}, schema) == []
    assert t.violations({"k": 2, "l": [1, "a", 3], "x": 0}, schema) == ["$.k: enum", "$.l: length", "$.l[1]: type", "$.x: type"]
    assert t.line({}, "i", "other", "{}", None, 0, False)[:2] == (False, "unknown tool")
