"""Tool calls and damage planted by rule into conversations that hold none."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: What an assistant's message calls, by (7 * conv_id + turn) mod 8; {c}, {t}, {p}: its conversation, its turn, the turn two before.
#: Nothing; one call; one that needs the other; a limit below the minimum; a need of an earlier turn; a cycle, one without
#: its argument; an identifier that may repeat; a tool without a schema with two needs.
CALLS = [
    "",
    '{"id":"c{t}","name":"search","arguments":{"query":"w{c}","limit":2}}',
    '{"id":"c{t}b","name":"search","arguments":{"query":"x"},"needs":["c{t}"]},{"id":"c{t}","name":"calculate","arguments":{"expression":"1+{t}"}}',
    '{"id":"c{t}","name":"search","arguments":{"query":"w","limit":0}}',
    '{"id":"c{t}","name":"search","arguments":{"query":"w"},"needs":["c{p}"]}',
    '{"id":"c{t}","name":"calculate","arguments":{},"needs":["c{t}b"]},{"id":"c{t}b","name":"calculate","arguments":{"expression":"2"},"needs":["c{t}"]}',
    '{"id":"c1","name":"search","arguments":{"query":"w"}}',
    '{"id":"c{t}","name":"paint","arguments":{"colour":"red"},"needs":["c{p}","c1"]}',
]


def plant_calls(conversations: DataFrame) -> DataFrame:
    """conversations whose assistants call tools; two thirds of the calls named after their turn have a result, a message of the
    same turn, and messages that call nothing are followed by a result that nobody asked for."""
    kind = F.pmod(7 * F.col("conv_id") + F.col("turn"), F.lit(len(CALLS)))
    text = F.element_at(F.array(*map(F.lit, CALLS)), (kind + 1).cast("int"))
    for slot, value in (("{c}", F.col("conv_id")), ("{t}", F.col("turn")), ("{p}", F.col("turn") - 2)):
        text = F.replace(text, F.lit(slot), value.cast("string"))
    content = F.to_json(F.struct(F.col("text").alias("content")), {"ignoreNullFields": "false"})
    calling = F.concat(F.expr("substring(content, 1, length(content) - 1)"), F.lit(',"tool_calls":['), "calls", F.lit("]}"))
    rows = conversations.withColumns({"kind": F.when(F.col("role") == "assistant", kind), "calls": text, "content": content})
    said = rows.withColumn("text", F.when(F.col("kind") > 0, calling).otherwise(F.col("text"))).select("conv_id", "turn", "role", "text")
    asked = F.when(F.col("kind") == 0, F.lit("zz")).otherwise("c")
    result = F.concat(F.lit('{"tool_call_id":"'), asked, F.col("turn").cast("string"), F.lit('","content":"r'), F.col("turn").cast("string"), F.lit('"}'))
    results = rows.where((F.col("kind") != 6) & (F.pmod(F.col("conv_id") + F.col("turn"), F.lit(3)) != 0)).select("conv_id", "turn", F.lit("tool").alias("role"), result.alias("text"))
    return said.unionByName(results)


def damage(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, present) of damaged conversations; nulls of role and text are one space.

    By crc32 of conv_id:turn modulo 20: 0 takes a row out (present is false), 1 empties its text, 2 takes its .!? out,
    3 repeats it, 4 makes its role user.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    role = F.when(kind == 4, "user").otherwise(F.coalesce("role", F.lit(" ")))
    text = F.coalesce("text", F.lit(" "))
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    times = F.when(kind == 3, F.array(F.lit(True), F.lit(True))).otherwise(F.array(kind != 0))
    return conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("present"))
