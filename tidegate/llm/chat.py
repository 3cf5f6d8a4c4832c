"""Chat formatting with linked tool calls.

Input: one row per message.  An assistant's text that is a JSON object with
`tool_calls` makes calls: [{"id", "name", "arguments": {...}, "needs": [ids]}];
a `tool` message whose text is a JSON object with `tool_call_id` is the result
of one.  Calls and results are joined by (conversation, identifier); calls are
ordered topologically by what they need, level by level; arguments are validated
against the tool's schema; each message becomes one canonical JSON text (sorted
keys, no spaces).  Messages stay rows of their own, so a conversation of any
length is never gathered in one task; (order_turn, level, turn) is the order in
which a conversation is read: a result stands right after its call, whatever turn
it came in.

A level joins only the calls placed in the one before with the needs still open,
so a call's needs are met once each.

Defined cases: text that is no such JSON is content as it is (NaN, Infinity and
numbers beyond double precision's range are no JSON), null content is JSON null;
halves of surrogate pairs stand escaped, as \\ud800; a call id that repeats in a
conversation belongs to its first call (smallest turn, null last, then the
message's own order, then place), others count as repeated; several messages of
one turn are told apart, and of equal rows one is the first; results without a
call are orphans and keep their turn; calls that need a missing call or lie in a
cycle have level -1; a tool without a schema makes a call invalid if schemas are
given, and parts of a schema that aren't of their form are left out; messages
without a conversation link with nothing; very long texts are read whole; other
columns are not carried on, whatever their names; an empty table gives an empty
result.
"""

from __future__ import annotations

import json
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import table

_KINDS = {"string": str, "boolean": bool, "object": dict, "array": list, "null": type(None)}
_HALF = re.compile("[\ud800-\udfff]")


def whole(text: str | None) -> str | None:
    """text with halves of surrogate pairs escaped, so that it is valid Unicode."""
    return text if text is None or text.isascii() else _HALF.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def canonical(value) -> str:
    return whole(json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False))


def _finite(text: str) -> float:
    x = float(text)
    if not math.isfinite(x):
        raise ValueError(f"{text} is beyond the numbers of JSON texts")
    return x


def _no_constant(text: str):
    raise ValueError(f"{text} is not JSON")


def _is(value, kind) -> bool:
    if kind in ("integer", "number"):
        integral = isinstance(value, int) or isinstance(value, float) and value.is_integer()
        return not isinstance(value, bool) and (integral if kind == "integer" else isinstance(value, (int, float)))
    return not isinstance(kind, str) or kind not in _KINDS or isinstance(value, _KINDS[kind])


def _number(x) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def violations(value, schema: dict, at: str = "$") -> list[str]:
    """Where a value breaks a JSON schema (type, enum, required, properties, additionalProperties, items, minimum, maximum)."""
    of = lambda key, kind, other: schema[key] if isinstance(schema.get(key), kind) else other
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else of("type", list, [])
    if kinds and not any(_is(value, k) for k in kinds):
        return [f"{at}: type"]
    out = [f"{at}: enum"] if isinstance(schema.get("enum"), list) and canonical(value) not in map(canonical, schema["enum"]) else []
    if isinstance(value, dict):
        own = of("properties", dict, {})
        out += [f"{at}.{k}: missing" for k in of("required", list, []) if k not in value]
        for k, v in value.items():
            if isinstance(own.get(k), dict):
                out += violations(v, own[k], f"{at}.{k}")
            elif k not in own and schema.get("additionalProperties") is False:
                out.append(f"{at}.{k}: unknown")
    if isinstance(value, list) and of("items", dict, {}):
        out += [x for i, v in enumerate(value) for x in violations(v, schema["items"], f"{at}[{i}]")]
    if _number(value):
        low, high = schema.get("minimum"), schema.get("maximum")
        out += [f"{at}: minimum"] if _number(low) and value < low else []
        out += [f"{at}: maximum"] if _number(high) and value > high else []
    return out


def parse(role: str | None, text: str | None) -> dict:
    """calls, result id and the message's canonical JSON."""
    body = None
    if text and role in ("assistant", "tool") and text.lstrip()[:1] == "{":
        try:
            body = json.loads(text, parse_constant=_no_constant, parse_float=_finite)
        except (ValueError, RecursionError):
            body = None
    calls, answers, message = [], None, {"role": role, "content": text}
    try:
        if isinstance(body, dict) and role == "assistant" and isinstance(body.get("tool_calls"), list):
            listed = [c for c in body["tool_calls"] if isinstance(c, dict) and isinstance(c.get("id"), str) and isinstance(c.get("name"), str)]
            shown = [{"id": c["id"], "type": "function", "function": {"name": c["name"], "arguments": canonical(c.get("arguments", {}))}} for c in listed]
            made = canonical({"role": role, "content": body.get("content"), "tool_calls": shown})
            return {"calls": listed, "answers": None, "json": made}
        if isinstance(body, dict) and role == "tool" and isinstance(body.get("tool_call_id"), str):
            made = canonical({"role": role, "content": body.get("content"), "tool_call_id": body["tool_call_id"]})
            return {"calls": [], "answers": whole(body["tool_call_id"]), "json": made}
    except RecursionError:  # nested too deep to be written again: content as it is
        calls, answers = [], None
    return {"calls": calls, "answers": answers, "json": canonical(message)}


def _levels(first: DataFrame) -> DataFrame:
    """conv_id, id, level of every call that can be placed; first: conv_id, id, needs."""
    key = ["conv_id", "id"]
    placed = table(first.where("size(needs) = 0").select(*key, F.lit(0).alias("level")), "level")
    open_ = table(first.select(*key, F.explode("needs").alias("need")), "needs")
    parts, level = [placed], 0
    while open_.take(1):
        level += 1
        done = placed.select("conv_id", F.col("id").alias("need"))
        met = table(open_.join(done, ["conv_id", "need"]), "met")
        if not met.take(1):
            break
        left = table(open_.join(done, ["conv_id", "need"], "left_anti"), "needs")
        placed = table(met.select(*key).distinct().join(left.select(*key), key, "left_anti").withColumn("level", F.lit(level)), "level")
        parts.append(placed)
        open_ = left
        if len(parts) == 32:  # a long chain: one table again
            parts = [table(_union(parts), "levels")]
    return _union(parts)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def format_chat(messages: DataFrame, schemas: dict[str, dict] | None = None) -> DataFrame:
    """conv_id, turn, role, order_turn, level, n_calls, n_answered, n_invalid, n_repeated, orphan, message (canonical JSON)."""

    def read(batches):
        kind = pa.list_(pa.struct([("id", pa.string()), ("name", pa.string()), ("bad", pa.bool_()), ("needs", pa.list_(pa.string()))]))
        for batch in batches:
            calls, answers, shown = [], [], []
            for role, text in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True):
                got = parse(role, text)
                own = []
                for c in got["calls"]:
                    arguments = c.get("arguments", {})
                    bad = [] if schemas is None else violations(arguments, schemas[c["name"]]) if c["name"] in schemas else ["$: no schema"]
                    needs = c["needs"] if isinstance(c.get("needs"), list) else []
                    own.append({"id": whole(c["id"]), "name": whole(c["name"]), "bad": bool(bad), "needs": sorted({whole(x) if isinstance(x, str) else canonical(x) for x in needs})})
                calls.append(own)
                answers.append(got["answers"])
                shown.append(got["json"])
            yield pa.record_batch([batch.column("row"), batch.column("conv_id"), batch.column("turn"), batch.column("role"), pa.array(calls, kind), pa.array(answers, pa.string()), pa.array(shown, pa.string())], names=["row", "conv_id", "turn", "role", "calls", "answers", "message"])

    base = messages.select(F.monotonically_increasing_id().alias("row"), F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    read_rows = table(base.mapInArrow(read, "row long, conv_id long, turn long, role string, calls array<struct<id:string,name:string,bad:boolean,needs:array<string>>>, answers string, message string"), "messages")
    key = ["conv_id", "id"]
    late = F.coalesce("turn", F.lit(2**63 - 1)).alias("late")
    # one row for each identifier: the first call that has it
    each = read_rows.where("conv_id is not null and size(calls) > 0").select("conv_id", late, F.xxhash64("message").alias("own"), "row", F.posexplode("calls").alias("place", "c")).select("conv_id", "late", "own", "row", "place", "c.*")
    first = table(each.groupBy(key).agg(F.min(F.struct("late", "own", "row", "place", "needs")).alias("f")).select(*key, "f.row", "f.place", "f.needs", "f.late"), "calls")
    answered = read_rows.where("conv_id is not null and answers is not null").select("conv_id", F.col("answers").alias("id")).distinct().withColumn("answered", F.lit(True))
    known = first.join(_levels(first), key, "left").join(answered, key, "left").withColumn("level", F.coalesce("level", F.lit(-1)))
    known = table(known.select(*key, F.col("row").alias("first_row"), F.col("place").alias("first_place"), F.col("late").alias("call_late"), "level", F.coalesce("answered", F.lit(False)).alias("answered")), "known")
    linked = each.join(known, key).withColumn("mine", (F.col("row") == F.col("first_row")) & (F.col("place") == F.col("first_place")))
    counted = linked.groupBy("row").agg(
        F.count_if(F.col("mine") & F.col("answered")).alias("n_answered"),
        F.count_if("bad").alias("n_invalid"),
        F.count_if(~F.col("mine")).alias("n_repeated"),
        F.min("level").alias("low"),
        F.max("level").alias("high"),
    )
    call_of = known.select("conv_id", F.col("id").alias("answers"), "call_late", F.col("level").alias("call_level"))
    joined = read_rows.join(counted, "row", "left").join(call_of, ["conv_id", "answers"], "left")
    alone = F.col("conv_id").isNull()
    bad_alone = F.size(F.filter("calls", lambda c: c["bad"]))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return joined.select(
        "conv_id",
        "turn",
        "role",
        F.when(F.col("call_late") < 2**63 - 1, F.col("call_late")).otherwise(F.when(F.col("call_late").isNull(), F.col("turn"))).alias("order_turn"),
        F.coalesce("call_level", F.when(F.size("calls") > 0, F.when(alone | (F.col("low") < 0), -1).otherwise(F.col("high"))), F.lit(0)).cast("int").alias("level"),
        F.size("calls").cast("long").alias("n_calls"),
        zero("n_answered").alias("n_answered"),
        F.when(alone, bad_alone).otherwise(zero("n_invalid")).cast("long").alias("n_invalid"),
        zero("n_repeated").alias("n_repeated"),
        (F.col("answers").isNotNull() & F.col("call_level").isNull()).alias("orphan"),
        "message",
    )
