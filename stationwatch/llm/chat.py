"""Chat formatting with linked tool calls.

Turns are read into parts: messages, calls, results and tool schemas. Calls and
results meet in a hash join on (conversation, call id); calls meet their schemas
in another, on (conversation, tool name), and their arguments are validated.
Parts are ordered topologically: a result never stands before its call, nor a
call before a result that its arguments refer to. The order is a key that each
part carries, so no conversation is gathered anywhere. Each part is serialised
as canonical JSON: sorted keys, no spaces, no escapes but those needed.

Text that is a JSON object is read as follows. By an assistant:
``{"content": ..., "tool_calls": [{"id", "name", "arguments"}, ...]}``; by a tool:
``{"tool_call_id": ..., "content": ...}``; by the system:
``{"content": ..., "tools": [{"name", "parameters": <schema>}, ...]}``. An argument
``{"$ref": "<call id>"}`` refers to that call's result. All else is a message, as
is text with numbers that JSON can't say (NaN, infinities).
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stage

_PART = "conv_id long, turn long, part long, role string, kind string, call_id string, name string, body string, refs array<string>"
#: Null turns stand before all others.
_LEAST = -(1 << 63)
_LONE = re.compile("[\ud800-\udfff]")


def canonical(value: object) -> str:
    """JSON with sorted keys and no spaces; a lone surrogate, which no encoding holds, stays escaped."""
    return _LONE.sub(lambda m: f"\\u{ord(m[0]):04x}", json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


def plain(text: str) -> str:
    """The text with U+FFFD for lone surrogates."""
    return _LONE.sub("\ufffd", text)


def _finite(text: str) -> float:
    value = float(text)
    if not math.isfinite(value):
        raise ValueError(text)
    return value


def parse(text: str) -> object:
    """Strict JSON: ValueError for all else, what Python's reader would let pass included."""
    try:
        return json.loads(text, parse_constant=_finite, parse_float=_finite)
    except RecursionError as e:
        raise ValueError("nested too deep") from e


def _object(text: str | None) -> dict | None:
    if not text or not text.lstrip().startswith("{"):
        return None
    try:
        value = parse(text)
        canonical(value)  # what is read can be written
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def _refs(value: object) -> list[str]:
    found, todo = set(), [value]
    while todo:
        x = todo.pop()
        if isinstance(x, dict):
            if isinstance(x.get("$ref"), str):
                found.add(x["$ref"])
            todo += x.values()
        elif isinstance(x, list):
            todo += x
    return sorted(found)


def _text(value: object) -> str:
    return plain(value) if isinstance(value, str) else canonical(value)


def parts_of(role: str | None, text: str | None) -> list[tuple[str, str | None, str | None, str | None, list[str]]]:
    """(kind, call id, tool name, body, references) of the parts of one turn, in order."""
    value = _object(text)
    said = [("message", None, None, _text(value["content"]), [])] if value is not None and value.get("content") is not None else []
    if value is not None and role == "assistant" and isinstance(value.get("tool_calls"), list):
        out = said
        for call in value["tool_calls"]:
            call = call if isinstance(call, dict) else {}
            arguments = call.get("arguments")
            if isinstance(arguments, str):
                arguments = _object(arguments) if _object(arguments) is not None else arguments
            name, key = call.get("name"), call.get("id")
            out.append(("call", None if key is None else _text(key), None if name is None else _text(name), canonical(arguments), [plain(r) for r in _refs(arguments)]))
        return out
    if value is not None and role == "tool" and "tool_call_id" in value:
        key = value["tool_call_id"]
        return [("result", None if key is None else _text(key), None, _text(value.get("content")), [])]
    if value is not None and role == "system" and isinstance(value.get("tools"), list):
        tools = [t for t in value["tools"] if isinstance(t, dict) and isinstance(t.get("name"), str)]
        return said + [("schema", None, plain(t["name"]), canonical(t.get("parameters", {})), []) for t in tools]
    return [("message", None, None, text or "", [])]


# ------------------------------------------------------------------ validation

_TYPES = {
    "object": lambda v: isinstance(v, dict), "array": lambda v: isinstance(v, list), "string": lambda v: isinstance(v, str), "null": lambda v: v is None,
    "boolean": lambda v: isinstance(v, bool), "integer": lambda v: isinstance(v, int) and not isinstance(v, bool) or isinstance(v, float) and v.is_integer(),
    "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
}
#: Seconds that one pattern may take on one string.
PATTERN_SECONDS = 2.0


def _same(x: object, y: object) -> bool:
    """Equal as JSON: true is not 1, but 1.0 is 1."""
    if isinstance(x, bool) or isinstance(y, bool):
        return x is y
    if isinstance(x, list) and isinstance(y, list):
        return len(x) == len(y) and all(map(_same, x, y))
    if isinstance(x, dict) and isinstance(y, dict):
        return x.keys() == y.keys() and all(_same(x[k], y[k]) for k in x)
    return type(x) in (int, float) and type(y) in (int, float) and x == y or type(x) is type(y) and x == y


def _matches(pattern: str, text: str) -> bool | None:
    """None where the pattern is no pattern or takes too long."""
    try:
        return regex.search(pattern, text, timeout=PATTERN_SECONDS) is not None
    except (regex.error, TimeoutError, RecursionError, OverflowError, MemoryError):
        return None


def _pointed(root: object, pointer: str) -> object:
    """What a local reference (#/a/b) points to; None if nothing."""
    at = root
    for step in [s.replace("~1", "/").replace("~0", "~") for s in pointer[1:].split("/")[1:]] if pointer.startswith("#") else ["?"]:
        at = at.get(step) if isinstance(at, dict) else at[int(step)] if isinstance(at, list) and step.isdecimal() and int(step) < len(at) else None
    return at


def violation(value: object, schema: object) -> str | None:
    """The first place where a value breaks a schema, or None. Never raises, whatever the JSON.

    Checked: type, enum, const, bounds, multipleOf, lengths, pattern, items and prefixItems, uniqueItems, properties,
    patternProperties, additionalProperties, required, counts of properties, allOf, anyOf, oneOf, not, local $ref, true and
    false. Keywords with values of a wrong kind and unknown ones say nothing; a reference to a result satisfies any schema.
    """
    try:
        return _violation(value, schema, "$", schema, 0)
    except RecursionError:
        return "$: nested too deep"


def _violation(value: object, schema: object, path: str, root: object, jumps: int) -> str | None:
    if schema is False:
        return f"{path}: not allowed"
    if not isinstance(schema, dict) or isinstance(value, dict) and set(value) == {"$ref"}:
        return None
    inner = lambda v, s, p: _violation(v, s, p, root, 0)
    number, count = _TYPES["number"], lambda key: schema.get(key) if _TYPES["integer"](schema.get(key)) else None
    if isinstance(schema.get("$ref"), str):
        if jumps > 64:  # only references, in a circle
            return f"{path}: schema reference"
        target = _pointed(root, schema["$ref"])
        found = f"{path}: schema reference" if target is None else _violation(value, target, path, root, jumps + 1)
        if found:
            return found
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if isinstance(kinds, list) and not any(_TYPES[k](value) for k in kinds if isinstance(k, str) and k in _TYPES):
        return f"{path}: type"
    if isinstance(schema.get("enum"), list) and not any(_same(value, x) for x in schema["enum"]) or "const" in schema and not _same(value, schema["const"]):
        return f"{path}: value"
    if number(value):
        bounds = ((k, schema[k]) for k in ("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum") if number(schema.get(k)))
        if any(value < b if k == "minimum" else value > b if k == "maximum" else value <= b if k == "exclusiveMinimum" else value >= b for k, b in bounds):
            return f"{path}: range"
        step = schema.get("multipleOf")
        if number(step) and step > 0 and not _multiple(value, step):
            return f"{path}: multiple"
    if isinstance(value, str):
        if (low := count("minLength")) is not None and len(value) < low or (high := count("maxLength")) is not None and len(value) > high:
            return f"{path}: length"
        if isinstance(schema.get("pattern"), str) and (fits := _matches(schema["pattern"], value)) is not True:
            return f"{path}: pattern" if fits is False else f"{path}: schema pattern"
    if isinstance(value, list):
        if (low := count("minItems")) is not None and len(value) < low or (high := count("maxItems")) is not None and len(value) > high:
            return f"{path}: length"
        if schema.get("uniqueItems") is True and len({canonical(_plain_numbers(x)) for x in value}) < len(value):
            return f"{path}: repeated"
        ahead = schema["prefixItems"] if isinstance(schema.get("prefixItems"), list) else []
        for i, x in enumerate(value):
            if found := inner(x, ahead[i] if i < len(ahead) else schema.get("items"), f"{path}[{i}]"):
                return found
    if isinstance(value, dict):
        known = schema["properties"] if isinstance(schema.get("properties"), dict) else {}
        shaped = schema["patternProperties"] if isinstance(schema.get("patternProperties"), dict) else {}
        if (low := count("minProperties")) is not None and len(value) < low or (high := count("maxProperties")) is not None and len(value) > high:
            return f"{path}: count"
        for name in schema["required"] if isinstance(schema.get("required"), list) else ():
            if isinstance(name, str) and name not in value:
                return f"{path}.{name}: missing"
        for name in sorted(value):
            fitting = [s for p, s in sorted(shaped.items()) if _matches(p, name)]
            fitting += [known[name]] if name in known else []
            rest = schema.get("additionalProperties")
            if not fitting and rest is False:
                return f"{path}.{name}: unknown"
            for s in fitting or [rest]:
                if found := inner(value[name], s, f"{path}.{name}"):
                    return found
    lists = {k: schema[k] for k in ("allOf", "anyOf", "oneOf") if isinstance(schema.get(k), list)}
    for s in lists.get("allOf", ()):
        if found := inner(value, s, path):
            return found
    if "anyOf" in lists and all(inner(value, s, path) for s in lists["anyOf"]):
        return f"{path}: none of anyOf"
    if "oneOf" in lists and sum(inner(value, s, path) is None for s in lists["oneOf"]) != 1:
        return f"{path}: not one of oneOf"
    if isinstance(schema.get("not"), (dict, bool)) and inner(value, schema["not"], path) is None:
        return f"{path}: not allowed"
    return None


def _multiple(value: float, step: float) -> bool:
    if isinstance(value, int) and isinstance(step, int):
        return value % step == 0
    try:
        times = value / step
    except OverflowError:
        return False
    return math.isfinite(times) and abs(times - round(times)) <= 1e-9 * max(1.0, abs(times))


def _plain_numbers(value: object) -> object:
    """The value with whole floats as integers, so that equal values are written alike."""
    if isinstance(value, list):
        return [_plain_numbers(x) for x in value]
    if isinstance(value, dict):
        return {k: _plain_numbers(x) for k, x in value.items()}
    return int(value) if isinstance(value, float) and value.is_integer() else value


def parts(turns: DataFrame) -> DataFrame:
    """The parts of all turns, one row each."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, _ in slices(batches, "text"):
            rows = []
            columns = (batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text"))
            for conv, turn, role, text in zip(*columns, strict=True):
                rows += [(conv, turn, i, role, *part) for i, part in enumerate(parts_of(role, text))]
            names = ("conv_id", "turn", "part", "role", "kind", "call_id", "name", "body", "refs")
            kinds = (pa.int64(), pa.int64(), pa.int64(), *[pa.string()] * 5, pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], list(names))

    return turns.select("conv_id", "turn", "role", "text").mapInArrow(read, _PART)


def _broken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Calls with what their arguments break of their schema, null where nothing or there is none."""
    for batch, _, _ in slices(batches, "body"):
        found = []
        for body, schema in zip(batch.column("body").to_pylist(), batch.column("schema").to_pylist(), strict=True):
            found.append(None if body is None or schema is None else violation(json.loads(body), json.loads(schema)))
        found = [None if x is None else plain(x) for x in found]
        yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in batch.schema.names} | {"broken": pa.array(found, pa.string())})


def link(turns: DataFrame) -> DataFrame:
    """One row for each part of ``turns`` (conv_id, turn, role, text): conv_id, turn, part, role, kind, call_id, name, status, place, message.

    ``status`` of a call is linked, unanswered, duplicate (a later call with an id
    that was used), invalid (with what its arguments break), unknown tool (its
    conversation has schemas, none of that name) or cyclic (its references run in
    a circle or depend on one; it keeps its own place); of a result linked, orphan
    or duplicate; of the rest null. ``place`` sorts a conversation's parts. Null
    ids, turns and call ids link with nothing and sort first; a null text is an
    empty message; repeated turns repeat their messages, and their calls are
    duplicates. Lone surrogates are U+FFFD in texts and ids, escaped in arguments.
    """
    found = stage(parts(turns).withColumn("uid", F.monotonically_increasing_id()), "parts")
    key = ["conv_id", "call_id"]
    usable = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()

    def ranked(kind: str) -> DataFrame:
        rows = found.where(F.col("kind") == kind)
        firsts = rows.where(usable).groupBy(*key).agg(F.min(F.struct("turn", "part", "body", "uid")).alias("least")).select(*key, F.col("least.uid").alias("first_uid"))
        nth = F.when(F.col("first_uid") == F.col("uid"), 1).when(F.col("first_uid").isNotNull(), 2)
        return rows.join(firsts.hint("shuffle_hash"), key, "left").withColumn("nth", nth).drop("first_uid")

    calls, results = stage(ranked("call"), "calls"), stage(ranked("result"), "results")
    columns = found.drop("uid").columns

    # schemas: the first of a name in a conversation
    schemas = found.where("kind = 'schema'").groupBy("conv_id", "name").agg(F.min_by("body", F.struct("turn", "part", "body")).alias("schema"))
    equipped = schemas.select("conv_id").distinct().withColumn("equipped", F.lit(True))
    answered = results.where("nth = 1").select(*key, F.lit(True).alias("answered"))
    checked = (
        calls.join(schemas.hint("shuffle_hash"), ["conv_id", "name"], "left").join(equipped.hint("shuffle_hash"), "conv_id", "left")
        .join(answered.hint("shuffle_hash"), key, "left")
    )
    own = F.array(F.coalesce("turn", F.lit(_LEAST)), "part", F.lit(0).cast("long"))
    checked = stage(checked.mapInArrow(_broken, checked.withColumn("broken", F.lit(None).cast("string")).schema).withColumn("own", own), "checked")

    # topological order: a call stands after the results it refers to, a result after its call
    after = lambda at: F.array(F.get(at, 0), F.get(at, 1), F.get(at, 2) + 1)
    later = lambda x, y: F.when(y.isNull() | (x >= y), x).otherwise(y)
    answers = stage(results.where("nth = 1").select(*key, own.alias("result_own")), "answers")
    needs = checked.where("nth = 1").select(*key, F.explode("refs").alias("needs")).join(
        answers.select("conv_id", F.col("call_id").alias("needs")), ["conv_id", "needs"], "left_semi")
    needs = stage(needs, "needs")
    # no chain of references is longer than the calls of its conversation that have any
    bounds = needs.groupBy("conv_id").agg(F.countDistinct("call_id").alias("bound"))
    at = stage(checked.where("nth = 1").join(bounds, "conv_id", "left").select(*key, "own", F.col("own").alias("at"), F.lit(0).cast("long").alias("hops"), F.coalesce("bound", F.lit(0)).alias("bound")), "order")
    moving = not needs.isEmpty()
    while moving:  # as many rounds as the longest chain that stands out of order, or circle's conversation, has calls
        ready = at.join(answers, key).select("conv_id", F.col("call_id").alias("needs"), later(F.col("result_own"), after(F.col("at"))).alias("ready"), "hops")
        push = needs.join(ready, ["conv_id", "needs"]).groupBy(*key).agg(F.max("ready").alias("ready"), F.max("hops").alias("before"))
        # too many hops for any chain: in a circle; what refers there is as well
        pushed = (F.col("hops") <= F.col("bound")) & F.col("ready").isNotNull() & ((after(F.col("ready")) > F.col("at")) | (F.col("before") > F.col("bound")))
        new = stage(at.join(push, key, "left").select(
            *key, "own", F.when(pushed, after(F.col("ready"))).otherwise(F.col("at")).alias("at"),
            F.when(pushed, F.greatest(F.col("hops"), F.col("before") + 1)).otherwise(F.col("hops")).alias("hops"), "bound", pushed.alias("pushed")), "order")
        at, moving = new.drop("pushed"), not new.where("pushed").isEmpty()
    at = at.select(*key, (F.col("hops") > F.col("bound")).alias("cyclic"), F.when(F.col("hops") > F.col("bound"), F.col("own")).otherwise(F.col("at")).alias("at"))
    placed = answers.join(at, key).select(*key, F.lit(1).alias("nth"), later(F.col("result_own"), after(F.col("at"))).alias("result_at"))
    status = (
        F.when(F.col("nth") > 1, "duplicate").when(F.col("cyclic"), "cyclic").when(F.col("schema").isNull() & F.col("equipped"), "unknown tool")
        .when(F.col("broken").isNotNull(), F.concat(F.lit("invalid "), F.col("broken"))).when(F.col("answered"), "linked").otherwise("unanswered")
    )
    calls = checked.join(at.withColumn("nth", F.lit(1)), [*key, "nth"], "left").withColumns({"status": status, "at": F.coalesce("at", "own")})
    results = results.join(placed, [*key, "nth"], "left").withColumns({
        "status": F.when(F.col("nth") > 1, "duplicate").when(F.col("result_at").isNull(), "orphan").otherwise("linked"), "at": F.coalesce("result_at", own)})
    rest = found.where("kind NOT IN ('call', 'result')").withColumns({"status": F.lit(None).cast("string"), "at": own})
    columns = [*columns, "status", "at"]
    return _serialised(calls.select(*columns).unionByName(results.select(*columns)).unionByName(rest.select(*columns)))


def _serialised(rows: DataFrame) -> DataFrame:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, _ in slices(batches, "body"):
            messages = []
            for role, kind, call_id, name, body in zip(*(batch.column(c).to_pylist() for c in ("role", "kind", "call_id", "name", "body")), strict=True):
                value: dict = {"role": role}
                if kind == "call":
                    value["tool_call"] = {"id": call_id, "name": name, "arguments": json.loads(body)}
                elif kind == "schema":
                    value["tool"] = {"name": name, "parameters": json.loads(body)}
                else:
                    value["content"] = body
                    if kind == "result":
                        value["tool_call_id"] = call_id
                messages.append(canonical(value))
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in batch.schema.names if c != "body"} | {"message": pa.array(messages, pa.string())})

    # a signed number as 16 digits that sort like it
    place = F.concat_ws(".", F.transform("at", lambda x: F.lpad(F.hex(x.bitwiseXOR(F.lit(_LEAST))), 16, "0")))
    rows = rows.select("conv_id", "turn", "part", "role", "kind", "call_id", "name", "status", place.alias("place"), "body")
    return rows.mapInArrow(write, rows.drop("body").withColumn("message", F.lit("")).schema)
