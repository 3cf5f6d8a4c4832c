"""Repair of conversations: the cheapest edits after which roles follow (system? (user assistant)+)?.

Every turn is kept (0), given another role (2) or deleted (3, blank and repeated
turns must be); an empty user or assistant turn may be inserted before any turn and
at the end (2); a truncated turn that stays adds 1.  Conversations are dealt by hash;
a task hands batches of them to a recursive DuckDB query in which each recursion
advances one turn for all conversations of the batch and keeps, for each grammar
state, the least cost and among its audits the least.  Two inserts in a row are
never cheapest, so one is tried before each turn.

Conversations of more than LONG turns are cut into runs of at most LONG turns in
their order over all tasks.  The same query finds, for each run, what it costs from
each state to each state; a fold over these small tables picks the states between
runs, and runs are repaired apart and joined.  No two audits of one cost and one place are a proper
prefix of each other, so comparing them run by run is exact.  A conversation's digest and its audit are one
value, so the texts of its repaired runs (not its rows) pass one task as a stream.

Defined cases: null roles and texts are one space; a null turn comes first; turns
that tie go by role, then text; rows of a null id are one conversation; a
conversation of which no row is present has zeros, an empty audit and the digest of
an empty text; an empty table gives an empty result; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import parts_for, table

#: Turns above which a conversation is cut, and rows and bytes that a batch of the query holds.
LONG, BATCH_ROWS, BATCH_BYTES = 512, 20_000, 16 << 20
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: State (last role) -> what may follow.
FOLLOWS = {"": "su", "s": "u", "u": "a", "a": "u"}
#: What an end in each state still needs.
ENDING = {"": (0, ""), "a": (0, ""), "u": (INSERT, "I"), "s": (2 * INSERT, "II")}
COUNTS = ("blank", "duplicate", "truncated", "illegal")


def moves() -> list[tuple]:
    """(state, role initial, edits, next state, cost, deletes) for everything that may be done at one turn."""
    out = []
    for state, then in FOLLOWS.items():
        inserted = (then[-1], INSERT, "I")  # the last of what may follow is never s
        for mid, cost, edit in ((state, 0, ""), inserted):
            for role in "sua-":
                out.append((state, role, edit + "D", mid, cost + DELETE, True))
                if role in FOLLOWS[mid]:
                    out.append((state, role, edit + "K", role, cost + KEEP, False))
                out += [(state, role, edit + "R", to, cost + REROLE, False) for to in "ua" if to != role and to in FOLLOWS[mid]]
    return out


_TURNS = r"""
CREATE OR REPLACE TEMP TABLE turns AS
WITH a AS (
  SELECT c, row_number() OVER (PARTITION BY c ORDER BY pos) AS n, turn, role, text, left(role, 1) AS i,
    rtrim(text, E' \t\n\x0B\x0C\r') AS shown, coalesce(again, row_number() OVER (PARTITION BY c, role, text ORDER BY pos) > 1) AS again
  FROM given WHERE present
)
SELECT c, n, turn, role, text, i, CASE WHEN i IN ('s', 'u', 'a') THEN i ELSE '-' END AS kind, shown = '' AS blank, shown <> '' AND again AS duplicate,
  shown <> '' AND NOT again AND right(shown, 1) NOT IN ('.', '!', '?') AS truncated, lag(i) OVER (PARTITION BY c ORDER BY n) AS i_before
FROM a
"""
_WALK = """
CREATE OR REPLACE TEMP TABLE walked AS
WITH RECURSIVE ends AS (SELECT c, max(n) AS n FROM turns GROUP BY c),
walk(c, start, state, n, cost, audit) USING KEY (c, start, state) AS (
  SELECT c, s.state, s.state, 0::BIGINT, 0::BIGINT, '' FROM ends, starts s
  UNION ALL
  SELECT c, start, state, n, w.cost, w.audit FROM (
    SELECT w.c, w.start, m.dst AS state, w.n + 1 AS n, min({'cost': w.cost + m.cost + CASE WHEN t.truncated AND NOT m.deletes THEN %d ELSE 0 END, 'audit': w.audit || m.edit}) AS w
    FROM walk w JOIN turns t ON t.c = w.c AND t.n = w.n + 1 JOIN moves m ON m.src = w.state AND m.kind = t.kind AND (m.deletes OR NOT (t.blank OR t.duplicate))
    GROUP BY w.c, w.start, w.n, m.dst
  )
)
SELECT c, start, state, cost, audit FROM walk JOIN ends USING (c, n)
""" % TRUNCATED
_COUNTED = """
SELECT c, count_if(blank) AS blank, count_if(duplicate) AS duplicate, count_if(truncated) AS truncated, count_if(i_before IS NOT NULL AND i_before || i NOT IN ('su', 'ua', 'au')) AS illegal,
  min(turn) AS low, max(turn) AS high, count(DISTINCT turn) AS different, arg_min(coalesce(i, ''), n) AS first_i, arg_max(coalesce(i, ''), n) AS last_i
FROM turns GROUP BY c
"""
#: chosen(c, start, audit) -> repaired texts
_SPOKEN = """
WITH e AS (SELECT c, start, unnest(string_split(audit, '')) AS x, unnest(range(1, length(audit) + 1)) AS j FROM chosen WHERE audit <> ''),
f AS (SELECT *, count(*) FILTER (x <> 'I') OVER p AS n, count(*) FILTER (x <> 'D') OVER p AS o FROM e WINDOW p AS (PARTITION BY c ORDER BY j)),
g AS (SELECT f.*, t.role, t.text, t.kind FROM f LEFT JOIN turns t ON t.c = f.c AND t.n = f.n AND f.x <> 'I' WHERE x <> 'D'),
h AS (SELECT *, o - coalesce(max(CASE WHEN o = 1 AND x = 'K' AND kind = 's' THEN 1 END) OVER (PARTITION BY c), 0) + CASE start WHEN 'u' THEN 1 ELSE 0 END AS k FROM g)
SELECT c, string_agg(CASE WHEN x = 'K' THEN role WHEN k % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN x = 'I' THEN '' ELSE text END, chr(10) ORDER BY j) AS repaired FROM h GROUP BY c
"""


def _engine():
    import duckdb

    con = duckdb.connect(config={"threads": 1, "memory_limit": "600MB"})
    con.execute("CREATE TEMP TABLE moves (src VARCHAR, kind VARCHAR, edit VARCHAR, dst VARCHAR, cost BIGINT, deletes BOOLEAN)")
    con.executemany("INSERT INTO moves VALUES (?, ?, ?, ?, ?, ?)", moves())
    con.execute("CREATE TEMP TABLE ending (state VARCHAR, cost BIGINT, edit VARCHAR)")
    con.executemany("INSERT INTO ending VALUES (?, ?, ?)", [(s, *e) for s, e in ENDING.items()])
    return con


def _runs(table_: pa.Table, keys: list[str]) -> np.ndarray:
    """Where each run of equal keys begins, and the number of rows."""
    cuts = {0, table_.num_rows}
    for k in keys:
        col = pc.run_end_encode(table_.column(k).combine_chunks())
        for chunk in col.chunks if isinstance(col, pa.ChunkedArray) else [col]:
            cuts |= set(chunk.run_ends.to_pylist())
    return np.array(sorted(cuts))


def whole_groups(batches, keys: list[str]):
    """Tables of whole groups (rows of equal keys follow one another), with the number of the group in `c` and of the row in `pos`."""
    held: list[pa.RecordBatch] = []

    def cut(last: bool):
        rows = pa.Table.from_batches(held)
        bounds = _runs(rows, keys)
        done = rows.num_rows if last else int(bounds[-2])
        held[:] = rows.slice(done).to_batches()
        if done:
            ends = bounds if last else bounds[:-1]
            c = pa.array(np.repeat(np.arange(len(ends) - 1), np.diff(ends)))
            return rows.slice(0, done).append_column("c", c).append_column("pos", pa.array(np.arange(done)))

    for batch in batches:
        at = 0
        while at < batch.num_rows:
            step = max(1, min(BATCH_ROWS, batch.num_rows * BATCH_BYTES // max(1, batch.nbytes)))
            held.append(batch.slice(at, step))
            at += step
            if sum(b.num_rows for b in held) >= BATCH_ROWS or sum(b.nbytes for b in held) >= BATCH_BYTES:
                if (out := cut(False)) is not None:
                    yield out
    if held and (out := cut(True)) is not None:
        yield out


def _firsts(rows: pa.Table, keys: list[str], made: pa.Table) -> list[pa.Array]:
    """The keys of groups made.c."""
    at = np.searchsorted(rows.column("c").to_numpy(), made.column("c").to_numpy())
    return [rows.column(k).combine_chunks().take(pa.array(at)) for k in keys]


_ROW = "turn long, role string, text string, present boolean, again boolean"
_REPAIRED = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired string"


def _repair_short(rows: DataFrame, parts: int) -> DataFrame:
    """One row a conversation, each of at most LONG turns."""

    def repair(batches):
        con = _engine()
        con.execute("CREATE TEMP TABLE starts AS SELECT '' AS state")
        for given in whole_groups(batches, ["k"]):
            con.register("given", given.drop_columns(["k"]))
            con.execute(_TURNS)
            con.execute(_WALK)
            con.execute(
                "CREATE OR REPLACE TEMP TABLE chosen AS SELECT c, '' AS start, w.cost, w.audit FROM"
                " (SELECT c, min({'cost': walked.cost + e.cost, 'audit': audit || e.edit}) AS w FROM walked JOIN ending e USING (state) GROUP BY c)"
            )
            # range of turns in 128 bits, so that no span overflows
            made = con.sql(
                f"SELECT g.c, CASE WHEN high IS NULL THEN 0 ELSE least(high::HUGEINT - low + 1 - different, 9223372036854775807) END::BIGINT AS gaps, {', '.join(f'coalesce(n.{x}, 0)::BIGINT AS {x}' for x in COUNTS)},"
                f" coalesce(h.cost, 0) AS cost, coalesce(h.audit, '') AS audit, coalesce(s.repaired, '') AS repaired"
                f" FROM (SELECT DISTINCT c FROM given) g LEFT JOIN ({_COUNTED}) n USING (c) LEFT JOIN chosen h USING (c) LEFT JOIN ({_SPOKEN}) s USING (c) ORDER BY g.c"
            ).to_arrow_table()
            con.unregister("given")
            yield from pa.Table.from_arrays([*_firsts(given, ["k"], made), *[made.column(x).combine_chunks() for x in made.column_names[1:]]], names=["k", *made.column_names[1:]]).to_batches()

    order = [F.col("k").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text"]
    dealt = rows.repartition(parts, "k").sortWithinPartitions(*order)
    kind = rows.schema["k"].dataType.simpleString()
    return dealt.mapInArrow(repair, f"k {kind}, {_REPAIRED}")


# ------------------------------------------------------------------ conversations of many turns
def _ordered(rows: DataFrame, run: int, parts: int) -> DataFrame:
    """rows with the number of the run they belong to, and whether the same was said before in the conversation."""
    digest = F.sha2(F.concat_ws("\x01", "role", "text"), 256)
    numbered = table(rows.withColumns({"digest": digest, "place": F.monotonically_increasing_id()}), "long-turns")
    order = [F.col("k").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text", "place"]
    ranged = [F.col("k").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "digest", "place"]
    # ranges by digest keep short keys in the samples; inside (k, turn, role) texts must be in order, so ties of turn and role are sorted again below
    tied = numbered.groupBy("k", "turn", "role").agg(F.min("digest").alias("a"), F.max("digest").alias("b"), F.count("*").alias("n")).where("a <> b")
    if tied.take(1):
        ranged = order
    dealt = numbered.repartitionByRange(parts, *ranged).sortWithinPartitions(*order)
    placed = table(dealt.withColumn("g", F.monotonically_increasing_id()), "ordered-turns")
    first = placed.groupBy(F.col("k").alias("k0"), F.col("digest").alias("d0")).agg(F.min("g").alias("first"), F.count("*").alias("n")).where("n > 1")
    met = placed.join(first, F.col("k").eqNullSafe(F.col("k0")) & (F.col("digest") == F.col("d0")), "left")
    again = F.coalesce(F.col("g") > F.col("first"), F.lit(False))
    return table(met.select("k", (F.shiftright("g", 33) * (1 << 33) + F.floor(F.col("g").bitwiseAND((1 << 33) - 1) / run)).cast("long").alias("run"), "g", "turn", "role", "text", F.lit(True).alias("present"), again.alias("again")), "runs")


def _by_run(rows: DataFrame, parts: int) -> DataFrame:
    return rows.repartition(parts, "k", "run").sortWithinPartitions(F.col("k").asc_nulls_first(), "run", "g")


_WAYS = "blank long, duplicate long, truncated long, illegal long, low long, high long, different long, first_i string, last_i string, ways array<struct<start:string,state:string,cost:bigint,audit:string>>"


def _ways(rows: DataFrame, parts: int) -> DataFrame:
    """For each run: counts, and cost and audit from each state to each state."""

    def walk(batches):
        con = _engine()
        con.execute("CREATE TEMP TABLE starts AS SELECT state FROM ending")
        for given in whole_groups(batches, ["k", "run"]):
            con.register("given", given.drop_columns(["k", "run"]))
            con.execute(_TURNS)
            con.execute(_WALK)
            made = con.sql(
                f"SELECT * FROM ({_COUNTED}) JOIN (SELECT c, list({{'start': start, 'state': state, 'cost': cost, 'audit': audit}}) AS ways FROM walked GROUP BY c) USING (c) ORDER BY c"
            ).to_arrow_table()
            con.unregister("given")
            schema = pa.schema([("k", given.schema.field("k").type), ("run", pa.int64()), *[(n, pa.int64()) for n in made.column_names[1:8]], ("first_i", pa.string()), ("last_i", pa.string()), ("ways", pa.list_(pa.struct([("start", pa.string()), ("state", pa.string()), ("cost", pa.int64()), ("audit", pa.string())])))])
            yield from pa.Table.from_arrays([*_firsts(given, ["k", "run"], made), *[made.column(n).combine_chunks() for n in made.column_names[1:]]], names=schema.names).cast(schema).to_batches()

    kind = rows.schema["k"].dataType.simpleString()
    return _by_run(rows, parts).mapInArrow(walk, f"k {kind}, run long, {_WAYS}")


class _Fold:
    """What is known of one conversation after some of its runs: for each state the least cost and the rank of its audit."""

    def __init__(self):
        self.reached = {"": (0, 0)}
        self.back: list[tuple[int, dict[str, tuple[str, str]]]] = []
        self.counts = dict.fromkeys(COUNTS, 0)
        self.low = self.high = self.turn = self.said = None
        self.different = 0

    def add(self, r: dict) -> None:
        best: dict[str, tuple] = {}
        for w in r["ways"]:
            if w["start"] in self.reached:
                cost, rank = self.reached[w["start"]]
                got = (cost + w["cost"], rank, w["audit"], w["start"])
                if w["state"] not in best or got < best[w["state"]]:
                    best[w["state"]] = got
        ranks = {a: i for i, a in enumerate(sorted({(b[1], b[2]) for b in best.values()}))}
        self.reached = {s: (b[0], ranks[b[1], b[2]]) for s, b in best.items()}
        self.back.append((r["run"], {s: (b[3], b[2]) for s, b in best.items()}))
        for n in COUNTS:
            self.counts[n] += r[n]
        self.counts["illegal"] += self.said is not None and self.said + r["first_i"] not in ("su", "ua", "au")
        self.said = r["last_i"]
        if r["low"] is not None:
            self.different += r["different"] - (self.high == r["low"])
            self.low, self.high = r["low"] if self.low is None else self.low, r["high"]

    def choice(self):
        """(run, state before, audit) in order, and the whole cost."""
        cost, _, edit, state = min((c + ENDING[s][0], r, ENDING[s][1], s) for s, (c, r) in self.reached.items())
        out = []
        for run, back in reversed(self.back):
            before, audit = back[state]
            out.append((run, before, audit + edit))
            state, edit = before, ""
        return out[::-1], cost


def _choose(ways: DataFrame, parts: int) -> DataFrame:
    """For each run the state before it and its audit; the conversation's counts and cost stand beside its last run."""
    kind = ways.schema["k"].dataType.simpleString()

    def fold(batches):
        key, state = None, None

        def done():
            path, cost = state.choice()
            gaps = 0 if state.low is None else min(state.high - state.low + 1 - state.different, (1 << 63) - 1)
            total = [gaps, *state.counts.values(), cost]
            for at in range(0, len(path), BATCH_ROWS):
                some = path[at : at + BATCH_ROWS]
                rows = [(key, *p, *(total if at + i == len(path) - 1 else [None] * 6)) for i, p in enumerate(some)]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        types, names = None, ["k", "run", "start", "audit", "gaps", *COUNTS, "cost"]
        for batch in batches:
            types = types or [batch.schema.field("k").type, pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 6]
            for r in batch.to_pylist():
                if state is None or r["k"] != key:
                    if state is not None:
                        yield from done()
                    key, state = r["k"], _Fold()
                state.add(r)
        if state is not None:
            yield from done()

    dealt = ways.repartition(parts, "k").sortWithinPartitions(F.col("k").asc_nulls_first(), "run")
    return dealt.mapInArrow(fold, f"k {kind}, run long, start string, audit string, gaps long, {', '.join(f'{n} long' for n in COUNTS)}, cost long")


def _speak(rows: DataFrame, chosen: DataFrame, parts: int) -> DataFrame:
    """k, run, repaired: the repaired text of each run."""
    kind = rows.schema["k"].dataType.simpleString()
    told = chosen.select(F.col("k").alias("k1"), F.col("run").alias("run1"), "start", "audit")
    met = rows.join(told, F.col("k").eqNullSafe(F.col("k1")) & (F.col("run") == F.col("run1"))).drop("k1", "run1")

    def speak(batches):
        con = _engine()
        for given in whole_groups(batches, ["k", "run"]):
            con.register("given", given.drop_columns(["k", "run"]))
            con.execute(_TURNS)
            con.execute("CREATE OR REPLACE TEMP TABLE chosen AS SELECT c, any_value(start) AS start, any_value(audit) AS audit FROM given GROUP BY c")
            made = con.sql(f"SELECT c, coalesce(repaired, '') AS repaired FROM chosen LEFT JOIN ({_SPOKEN}) USING (c) ORDER BY c").to_arrow_table()
            con.unregister("given")
            yield from pa.Table.from_arrays([*_firsts(given, ["k", "run"], made), made.column("repaired").combine_chunks()], names=["k", "run", "repaired"]).to_batches()

    return _by_run(met, parts).mapInArrow(speak, f"k {kind}, run long, repaired string")


def _join_runs(spoken: DataFrame, chosen: DataFrame, parts: int) -> DataFrame:
    """One row a conversation: its audit and the digest of its text, both from its runs in order, as a stream."""
    kind = spoken.schema["k"].dataType.simpleString()
    told = chosen.withColumnsRenamed({"k": "k1", "run": "run1"}).drop("start")
    rows = spoken.join(told, F.col("k").eqNullSafe(F.col("k1")) & (F.col("run") == F.col("run1"))).drop("k1", "run1")
    names = ["gaps", *COUNTS, "cost"]

    def stream(batches):
        key, open_, digest, audit = None, False, hashlib.sha256(), []
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["repaired"]:
                    digest.update((("\n" if open_ else "") + r["repaired"]).encode())
                    open_ = True
                audit.append(r["audit"])
                if r["cost"] is not None:  # the last run
                    out.append((r["k"], *[r[n] for n in names], "".join(audit), digest.hexdigest()))
                    open_, digest, audit = False, hashlib.sha256(), []
            if out:
                types = [batch.schema.field("k").type, *[pa.int64()] * 6, pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=["k", *names, "audit", "repaired_sha256"])

    dealt = rows.repartition(parts, "k").sortWithinPartitions(F.col("k").asc_nulls_first(), "run")
    return dealt.select("k", "run", "repaired", "audit", *names).mapInArrow(stream, f"k {kind}, {', '.join(f'{n} long' for n in names)}, audit string, repaired_sha256 string")


def _repair_long(rows: DataFrame, run: int, parts: int) -> DataFrame:
    rows = _ordered(rows, run, parts)
    chosen = table(_choose(_ways(rows, parts), parts), "run-states")
    return _join_runs(_speak(rows, chosen, parts), chosen, parts)


def repair_conversations(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", present_col: str | None = None, with_text: bool = False, long_from: int = LONG) -> DataFrame:
    """One row a conversation: id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    present_col: a boolean column; where it is false, a row only names its conversation.
    with_text: also `repaired`, lines of role:text; null for conversations of more than long_from turns.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    src = rows.select(F.col(id_col).alias("k"), F.col(turn_col).cast("long").alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"), (F.coalesce(present_col, F.lit(True)) if present_col else F.lit(True)).alias("present"))
    src = src.withColumn("again", F.lit(None).cast("boolean"))
    parts = parts_for(src, 16 << 20)  # of the input; what is estimated after joins grows with their product
    sizes = src.groupBy("k").agg(F.count_if("present").alias("n"))
    long = table(sizes.where(F.col("n") > long_from).select(F.col("k").alias("k0")), "long-conversations")
    some = bool(long.take(1))
    here = src.join(long, F.col("k").eqNullSafe(F.col("k0")), "left_anti") if some else src
    gone = here.where("not present").groupBy("k").agg(F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(False).alias("present"), F.lit(None).cast("boolean").alias("again"))
    short = here.where("present").unionByName(gone)
    out = _repair_short(short, parts).withColumn("repaired_sha256", F.sha2("repaired", 256))
    if some:
        own = src.where("present").join(long, F.col("k").eqNullSafe(F.col("k0")), "left_semi")
        out = out.unionByName(_repair_long(own, long_from, parts), allowMissingColumns=True)
    kept = ["gaps", *COUNTS, "cost", "audit", "repaired_sha256"] + ["repaired"] * with_text
    return out.select(F.col("k").alias(id_col), *kept)
