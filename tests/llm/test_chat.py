"""Tool calls: validation that never raises, text that Arrow can't hold, long chains and circles of references."""

import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stationwatch.llm import chat

KEYWORDS = "type enum const minimum maximum exclusiveMinimum multipleOf minLength maxLength pattern minItems maxItems uniqueItems items prefixItems properties patternProperties additionalProperties required minProperties allOf anyOf oneOf not $ref $defs".split()
ANY_JSON = st.recursive(
    st.none() | st.booleans() | st.integers(-9, 9) | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=4) | st.sampled_from(["object", "string", "#/$defs/a", "#", "["]),
    lambda inner: st.lists(inner, max_size=3) | st.dictionaries(st.sampled_from(KEYWORDS) | st.text(max_size=3), inner, max_size=4), max_leaves=12)


@settings(max_examples=400, deadline=None)
@given(ANY_JSON, ANY_JSON)
def test_validation_never_raises(value, schema):
    found = chat.violation(value, schema)
    assert found is None or isinstance(found, str)


@settings(max_examples=200, deadline=None)
@given(st.sampled_from(["assistant", "tool", "system", "user", None]), ANY_JSON)
def test_any_turn_is_read_and_written(role, value):
    text = json.dumps({"content": value, "tool_calls": [value, {"id": value, "name": value, "arguments": value}], "tool_call_id": value, "tools": [value, {"name": "f", "parameters": value}]})
    for kind, call_id, name, body, refs in chat.parts_of(role, text):
        for part in (kind, call_id or "", name or "", body or "", *refs):
            part.encode()  # Arrow holds it
        if kind in ("call", "schema"):
            assert chat.canonical(json.loads(body)) == body


@pytest.mark.parametrize("value, schema, found", [
    (5, {"exclusiveMinimum": 5}, "$: range"), (7, {"multipleOf": 2}, "$: multiple"), (0.3, {"multipleOf": 0.1}, None), ([1, 1.0], {"uniqueItems": True}, "$: repeated"),
    ([1, True], {"uniqueItems": True}, None), ([1, "x"], {"prefixItems": [{"type": "integer"}], "items": {"type": "integer"}}, "$[1]: type"),
    ({"ax": 1}, {"patternProperties": {"^a": {"type": "string"}}}, "$.ax: type"), ({"b": 1}, {"additionalProperties": {"type": "string"}}, "$.b: type"),
    (1, {"anyOf": [{"type": "string"}, {"type": "null"}]}, "$: none of anyOf"), (1, {"oneOf": [{"type": "integer"}, {"type": "number"}]}, "$: not one of oneOf"),
    (1, {"not": {"type": "integer"}}, "$: not allowed"), (1, {"allOf": [{"minimum": 0}, {"maximum": 0}]}, "$: range"), ({"x": "s"}, {"properties": {"x": {"$ref": "#/$defs/i"}}, "$defs": {"i": {"type": "integer"}}}, "$.x: type"),
    (1, {"$ref": "#"}, "$: schema reference"), (True, {"enum": [1]}, "$: value"), (1.0, {"const": 1}, None), ({}, {"required": None}, None), ("x", {"minLength": "3"}, None), (1, {"type": [{}]}, "$: type"), ({"a": 1}, False, "$: not allowed"),
])
def test_validation(value, schema, found):
    assert chat.violation(value, schema) == found


def test_slow_patterns_end(monkeypatch):
    monkeypatch.setattr(chat, "PATTERN_SECONDS", 0.05)
    assert chat.violation("a" * 60 + "!", {"pattern": "^(a|a)*(a|aa)*$"}) in ("$: pattern", "$: schema pattern")


def test_odd_texts_and_long_chains(spark):
    n = 40
    links = [{"id": f"c{i}", "name": "f", "arguments": {"x": {"$ref": f"c{i + 1}"}} if i + 1 < n else {}} for i in range(n)]
    behind = [{"id": "p", "arguments": {"$ref": "p"}}, {"id": "q", "arguments": {"$ref": "p"}}, {"id": "r", "arguments": {}}]
    rows = [
        (1, 0, "assistant", json.dumps({"tool_calls": links})), *((1, i + 1, "tool", json.dumps({"tool_call_id": f"c{i}", "content": i})) for i in range(n)),
        (2, 0, "assistant", json.dumps({"tool_calls": behind})), *((2, 1, "tool", json.dumps({"tool_call_id": k, "content": k})) for k in "pqr"),
        (3, 0, "assistant", json.dumps({"content": "\ud800", "tool_calls": [{"id": "\udfff", "name": "\ud801", "arguments": {"y": "\ud802"}}]})),
        (3, 1, "assistant", '{"tool_calls": [{"id": "n", "arguments": {"x": NaN}}]}'), (3, 2, "assistant", '{"tool_calls": [{"id": "n", "arguments": {"x": 1e999}}]}'),
        (3, 3, "assistant", '{"tool_calls": ' + "[" * 5000 + "]" * 5000 + "}"), (3, 4, "tool", '{"tool_call_id": null}'), (4, 0, "user", "long " * 400_000),
    ]
    random.Random(1).shuffle(rows)
    found = chat.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    chain = sorted((r for r in found if r.conv_id == 1), key=lambda r: r.place)
    at = {(r.kind, r.call_id): k for k, r in enumerate(chain)}
    for i in range(n):
        assert at["call", f"c{i}"] < at["result", f"c{i}"]
        assert i + 1 == n or at["result", f"c{i + 1}"] < at["call", f"c{i}"]
    assert {r.call_id: r.status for r in found if r.conv_id == 2 and r.kind == "call"} == {"p": "cyclic", "q": "cyclic", "r": "linked"}
    odd = sorted((r for r in found if r.conv_id == 3), key=lambda r: (r.turn, r.part))
    assert [r.kind for r in odd] == ["message", "call", "message", "message", "call", "result"]
    assert odd[1].message == '{"role":"assistant","tool_call":{"arguments":{"y":"\\ud802"},"id":"\ufffd","name":"\ufffd"}}'
    assert json.loads(odd[2].message) == {"role": "assistant", "content": '{"tool_calls": [{"id": "n", "arguments": {"x": NaN}}]}'} and odd[5].status == "orphan"
    assert [len(r.message) for r in found if r.conv_id == 4] == [len(json.dumps({"role": "user", "content": "long " * 400_000}, separators=(",", ":")))]
