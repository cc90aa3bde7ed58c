"""Chat formatting with linked tool calls.

An assistant's turn may be JSON with ``tool_calls``, a list of {id, name, arguments, depends_on} or
{id, type, function: {name, arguments}} (arguments as an object or as JSON text), beside
``content``; a turn of role ``tool`` may be JSON with ``tool_call_id`` and ``content``. Identifiers
are texts or whole numbers, which count as their digits. Any other text is plain content. Calls and
results meet in a hash join on conversation and identifier. A conversation's calls are ordered
topologically: a call comes after those that it names in ``depends_on`` or whose results its
arguments refer to as "$id"; among calls that are free, the order of the turns holds. Arguments are
checked against the tool's schema, and the conversation is written as canonical JSON: keys sorted,
no spaces, non-ASCII as it is, and nothing that a strict parser refuses.

Statuses of a call: ok; unanswered (no result); unknown_tool; invalid_arguments; malformed (no
identifier or name, or not an object: its JSON is kept as the arguments, and what it lacks is
null); cyclic (in or behind a cycle: after all others, in the order of turns); duplicate (an
identifier seen before: the first call keeps the result). All but ok are counted as faulty. Results
without a call are counted as orphans and stay turns of the conversation; of several results the
one of the earliest turn answers.

Texts are shuffled once, to bring a conversation's turns together; the join has identifiers and
places only.

Defined cases: a null conv_id is left out; null turns come first; null roles and texts are empty;
equal turns are ordered by role and text, and rows that repeat are kept; malformed JSON, and JSON
with NaN, an infinite number, lone surrogates or too deep nesting, is plain text; an empty table
gives no rows; columns other than conv_id, turn, role and text are not read.
"""

from __future__ import annotations

import heapq
import json
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ship import ship
from ._shared import written

#: Schemas of the tools, in the part of JSON Schema that valid() knows.
TOOLS: dict[str, dict] = {
    "search": {"type": "object", "required": ["query"], "properties": {"query": {"type": "string", "minLength": 1}, "limit": {"type": "integer", "minimum": 1, "maximum": 100}}, "additionalProperties": False},
    "calculate": {"type": "object", "required": ["expression"], "properties": {"expression": {"type": "string"}}, "additionalProperties": False},
    "fetch": {"type": "object", "required": ["url"], "properties": {"url": {"type": "string"}, "headers": {"type": "object"}}},
}

_KINDS = {"string": str, "object": dict, "array": list, "boolean": bool, "null": type(None)}
#: Words of a schema that valid() checks, and those that say nothing about validity.
_CHECKED = {"type", "enum", "const", "required", "properties", "additionalProperties", "items", "minimum", "maximum", "minLength", "maxLength"}
_SAID = {"title", "description", "default", "examples", "$schema", "$id", "$comment"}
DEEPEST = 200


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def known(schema) -> None:
    """Raises ValueError for a schema with words that valid() doesn't check."""
    if not isinstance(schema, (dict, bool)):
        raise ValueError(f"not a schema: {schema!r}")
    if isinstance(schema, dict):
        if odd := set(schema) - _CHECKED - _SAID:
            raise ValueError(f"unknown words in a schema: {sorted(odd)}")
        kinds = schema.get("type", [])
        if odd := set(kinds if isinstance(kinds, list) else [kinds]) - set(_KINDS) - {"integer", "number"}:
            raise ValueError(f"unknown types in a schema: {sorted(odd)}")
        for s in [*schema.get("properties", {}).values(), schema.get("items", True), schema.get("additionalProperties", True)]:
            known(s)


def _is(value, kind: str) -> bool:
    if kind in ("integer", "number"):
        number = isinstance(value, (int, float)) and not isinstance(value, bool)
        return number and (kind == "number" or isinstance(value, int) or math.isfinite(value) and value == int(value))
    return isinstance(value, _KINDS[kind])


def _same(a, b) -> bool:
    """JSON's equality: true isn't 1."""
    return isinstance(a, bool) == isinstance(b, bool) and a == b


def valid(value, schema) -> bool:
    """Whether value satisfies type (or one of a list), enum, const, required, properties, additionalProperties, items, bounds and lengths."""
    if isinstance(schema, bool):
        return schema
    kinds = schema.get("type")
    if kinds is not None and not any(_is(value, k) for k in (kinds if isinstance(kinds, list) else [kinds])):
        return False
    if "enum" in schema and not any(_same(value, x) for x in schema["enum"]) or "const" in schema and not _same(value, schema["const"]):
        return False
    if _is(value, "number"):
        return schema.get("minimum", value) <= value <= schema.get("maximum", value)
    if isinstance(value, str):
        return schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value))
    if isinstance(value, list):
        return all(valid(x, schema.get("items", True)) for x in value)
    if isinstance(value, dict):
        own, other = schema.get("properties", {}), schema.get("additionalProperties", True)
        return all(k in value for k in schema.get("required", ())) and all(valid(x, own.get(k, other)) for k, x in value.items())
    return True


def _no_constant(name: str):
    raise ValueError(f"{name} is no JSON")


def _depth(value) -> int:
    level, n = [value], 0
    while level:
        level = [y for x in level for y in (x.values() if isinstance(x, dict) else x if isinstance(x, list) else ())]
        n += 1
    return n


def _object(text: str | None):
    if not text or not text.lstrip().startswith("{"):
        return None
    try:
        value = json.loads(text, parse_constant=_no_constant)
        if _depth(value) > DEEPEST:
            return None
        canonical(value).encode()  # infinite numbers and lone surrogates can't be written
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def _identifier(value) -> str | None:
    if isinstance(value, int) and not isinstance(value, bool):
        return str(value)
    return value if isinstance(value, str) and value else None


def calls_of(value: dict) -> list[dict]:
    """The calls in an assistant's turn; one without an identifier or a name is malformed, and its arguments are all of it."""
    out = []
    for c in value["tool_calls"]:
        of = c if isinstance(c, dict) else {}
        inner = of["function"] if isinstance(of.get("function"), dict) else of
        name, identifier = inner.get("name"), _identifier(of.get("id"))
        if identifier is None or not isinstance(name, str):
            out.append({"id": identifier, "name": name if isinstance(name, str) else None, "arguments": canonical(c), "needs": [], "malformed": True})
            continue
        arguments = inner.get("arguments", {})
        if isinstance(arguments, str):
            parsed = _object(arguments)
            arguments = arguments if parsed is None else parsed
        listed = of.get("depends_on")
        needs = {d for x in (listed if isinstance(listed, list) else ()) if (d := _identifier(x)) is not None}
        out.append({"id": identifier, "name": name, "arguments": canonical(arguments), "needs": sorted(needs | _references(arguments)), "malformed": False})
    return out


def _references(value) -> set[str]:
    stack, found = [value], set()
    while stack:
        v = stack.pop()
        if isinstance(v, str) and len(v) > 1 and v[0] == "$":
            found.add(v[1:])
        elif isinstance(v, dict):
            stack += v.values()
        elif isinstance(v, list):
            stack += v
    return found


def ordered(calls: list[tuple[str | None, list[str]]]) -> tuple[list[int], int]:
    """Topological order of (id, needed ids), free calls first come first; and how many come before cycles. Ids that aren't calls are not waited for."""
    at: dict[str, int] = {}
    for i, (name, _) in enumerate(calls):
        if name is not None:
            at.setdefault(name, i)
    waits = [{at[n] for n in needs if n in at} for _, needs in calls]
    behind: list[list[int]] = [[] for _ in calls]
    for i, w in enumerate(waits):
        for j in w:
            behind[j].append(i)
    free = [i for i, w in enumerate(waits) if not w]
    heapq.heapify(free)
    out = []
    while free:
        i = heapq.heappop(free)
        out.append(i)
        for j in behind[i]:
            waits[j].discard(i)
            if not waits[j]:
                heapq.heappush(free, j)
    done = set(out)
    return out + [i for i in range(len(calls)) if i not in done], len(out)


_CALL = "array<struct<id:string,name:string,arguments:string,needs:array<string>,malformed:boolean>>"
_RESULT = "struct<id:string,content:string>"
_TURN = f"struct<role:string,calls:{_CALL},result:{_RESULT},content:string>"


def _parsed_turn(role: str, text: str) -> dict:
    row = {"role": role, "calls": [], "result": None, "content": text}
    value = _object(text) if role in ("assistant", "tool") else None
    if value is not None and role == "assistant" and isinstance(value.get("tool_calls"), list):
        row["calls"] = calls_of(value)
        row["content"] = value["content"] if isinstance(value.get("content"), str) else ""
    elif value is not None and role == "tool" and (identifier := _identifier(value.get("tool_call_id"))) is not None:
        content = value.get("content")
        row["result"] = {"id": identifier, "content": content if isinstance(content, str) else canonical(content)}
    return row


def _parsed(turns: pa.Array) -> pa.Array:
    """Each conversation's turns, parsed."""
    call = pa.struct([("id", pa.string()), ("name", pa.string()), ("arguments", pa.string()), ("needs", pa.list_(pa.string())), ("malformed", pa.bool_())])
    kind = pa.struct([("role", pa.string()), ("calls", pa.list_(call)), ("result", pa.struct([("id", pa.string()), ("content", pa.string())])), ("content", pa.string())])
    return pa.array([[_parsed_turn(t["role"], t["text"]) for t in c] for c in turns.to_pylist()], pa.list_(kind))


def _formatted(turns: list[dict], links: dict[tuple[int, int], int | None], tools: dict[str, dict]) -> tuple[int, int, int, int, str]:
    """links: for the first call of each identifier, by its place (turn, number in it), the turn that answers it, or None."""
    calls = [(n, k, c) for n, t in enumerate(turns) for k, c in enumerate(t["calls"])]
    order, before = ordered([(c["id"] if (n, k) in links else None, c["needs"] or []) for n, k, c in calls])
    out, bad = [], 0
    for place, i in enumerate(order):
        n, k, c = calls[i]
        arguments, answer = json.loads(c["arguments"]), links.get((n, k))
        schema = tools.get(c["name"])
        if c["malformed"]:
            status = "malformed"
        elif (n, k) not in links:
            status = "duplicate"
        elif place >= before:
            status = "cyclic"
        elif schema is None:
            status = "unknown_tool"
        elif not valid(arguments, schema):
            status = "invalid_arguments"
        else:
            status = "unanswered" if answer is None else "ok"
        bad += status != "ok"
        entry = {"id": c["id"], "name": c["name"], "arguments": arguments, "status": status, "turn": n}
        if answer is not None:
            entry["result"] = turns[answer]["result"]["content"]
        out.append(entry)
    # a result that a call holds is no turn of its own
    answers, names = {m for m in links.values() if m is not None}, {calls[i][2]["id"] for i in range(len(calls)) if calls[i][:2] in links}
    kept = [{"role": t["role"], "content": t["content"] if t["result"] is None else t["result"]["content"]} for n, t in enumerate(turns) if n not in answers]
    orphans = sum(t["result"] is not None and t["result"]["id"] not in names for t in turns)
    return len(turns), len(out), bad, orphans, canonical({"messages": kept, "tool_calls": out})


def _written(tools: dict[str, dict]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, turns, links in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows.append((conv, *_formatted(turns, {(x["n"], x["k"]): x["m"] for x in links or ()}, tools)))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), *[pa.int32()] * 4, pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["conv_id", "turns", "calls", "faulty_calls", "orphan_results", "formatted"])

    return run


def formatted(conversations: DataFrame, tools: dict[str, dict] | None = None) -> DataFrame:
    """conv_id, turns, calls, faulty_calls, orphan_results, formatted (canonical JSON) of each conversation.

    tools: schemas by name; one with words that valid() doesn't check is a ValueError.
    """
    ship(conversations.sparkSession)
    tools = TOOLS if tools is None else tools
    for schema in tools.values():
        known(schema)
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.coalesce(F.col("turn").cast("long"), F.lit(-(2**62))).alias("turn"), "role", "text"))).alias("all"))
    parse = F.arrow_udf(_parsed, f"array<{_TURN}>").asNondeterministic()
    whole = written(whole.select("conv_id", parse(F.transform("all", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))).alias("all")), "turns")
    turns = whole.select("conv_id", F.posexplode("all").alias("n", "t"))
    calls = turns.select("conv_id", "n", F.posexplode("t.calls").alias("k", "c")).where("not c.malformed").select("conv_id", "n", "k", F.col("c.id").alias("id"))
    heads = calls.groupBy("conv_id", "id").agg(F.min(F.struct("n", "k")).alias("head"))
    results = turns.where("t.result is not null").groupBy("conv_id", F.col("t.result.id").alias("id")).agg(F.min("n").alias("m"))
    linked = heads.join(results.hint("shuffle_hash"), ["conv_id", "id"], "left").select("conv_id", F.struct("head.n", "head.k", "m").alias("link"))
    links = linked.groupBy(F.col("conv_id").alias("c")).agg(F.collect_list("link").alias("links"))
    both = whole.join(links, F.col("conv_id") == F.col("c"), "left").select("conv_id", "all", "links")
    return both.mapInArrow(_written(tools), "conv_id long, turns int, calls int, faulty_calls int, orphan_results int, formatted string")


#: Conversations without tool calls, as in the given tables, need no more than this.
SQL = """
SELECT conv_id, CAST(count(*) AS INTEGER) AS turns, CAST(0 AS INTEGER) AS calls, CAST(0 AS INTEGER) AS faulty_calls, CAST(0 AS INTEGER) AS orphan_results,
       '{"messages":[' || string_agg('{"content":' || CAST(to_json(coalesce(text, '')) AS VARCHAR) || ',"role":' || CAST(to_json(coalesce(role, '')) AS VARCHAR) || '}',
                                     ',' ORDER BY coalesce(turn, -4611686018427387904), coalesce(role, ''), coalesce(text, '')) || '],"tool_calls":[]}' AS formatted
FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
"""
