"""Sessions under a cap: isolated state for each session, the least recently used one dropped when there are too many.

Sessions are dealt to shards, and a shard keeps at most `most` of them beside the
default session, which is never dropped; one shard is an exact global order of use.
A stream keeps a shard's sessions and their sources as entries of two maps, so that
a response reads and writes its own entries only.  An entry of a source is valid while
the session it was born in lives: dropping a session is dropping one entry, and what
it leaves behind runs out with the time to live.

The state of a stream can be read from its checkpoint as a table (stored_sessions)
and be the start of another stream, with other shards if wanted.

Defined cases: a null or empty session is the default one; equal seq go by session
and key; a null key is a source of its own; an empty table decides nothing; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, MutableMapping

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..config import DefenseConfig
from .adaptive import OUT, Session, columns_of, decided, records

DEFAULT = "default"
SHARDED = OUT + ", opened boolean"
SESSION = "alert int, events long, threats long, used long, born long"
SOURCE = "suspicion double, events long, threats long, quarantined boolean, born long"
SAVED = "session string, alert int, events long, threats long, used long, source string, suspicion double, source_events long, source_threats long, quarantined boolean"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Entry:
    """What a shard keeps of one session: its machine, when it was last used and when it was opened."""

    def __init__(self, config: DefenseConfig, sources: MutableMapping, alert: int = 0, events: int = 0, threats: int = 0, used: int = 0, born: int = 0):
        self.machine = Session(config)
        self.machine.sources = sources
        self.machine.alert, self.machine.events, self.machine.threats = alert, events, threats
        self.used, self.born = used, born

    def values(self) -> tuple:
        m = self.machine
        return m.alert, m.events, m.threats, self.used, self.born


class Shard:
    """Open sessions by use; batch and stream decide with it."""

    def __init__(self, config: DefenseConfig, most: int, sources_of=lambda session, born: {}):
        self.config, self.most, self.sources_of = config, most, sources_of
        self.open: dict[str, _Entry] = {}
        self.dropped: set[str] = set()
        self.clock = 0

    def put(self, session: str, alert: int, events: int, threats: int, used: int, born: int, sources: MutableMapping | None = None) -> None:
        kept = self.sources_of(session, born) if sources is None else sources
        self.open[session] = _Entry(self.config, kept, alert, events, threats, used, born)
        self.clock = max(self.clock, used)

    def decide(self, row: dict) -> dict:
        session = row["session"] or DEFAULT
        self.clock += 1
        opened = session not in self.open
        if opened:
            self.open[session] = _Entry(self.config, self.sources_of(session, self.clock), born=self.clock)
            self.dropped.discard(session)
        self.open[session].used = self.clock
        others = [s for s in self.open if s != DEFAULT]
        if len(others) > self.most:
            oldest = min(others, key=lambda s: self.open[s].used)
            del self.open[oldest]
            self.dropped.add(oldest)
        return decided(self.open[session].machine, session, row) | {"opened": opened}


class _Sources(MutableMapping):
    """The sources of one session over the shard's map state: read when asked for, written back at the end."""

    def __init__(self, state, session: str, born: int):
        self.state, self.session, self.born = state, session, born
        self.read: dict = {}
        self.gone: set = set()

    def __getitem__(self, key):
        if key not in self.read:
            at = (self.session, key)
            got = self.state.getValue(at) if key not in self.gone and self.state.containsKey(at) else None
            self.read[key] = list(got[:4]) if got is not None and got[4] == self.born else None
        if self.read[key] is None:
            raise KeyError(key)
        return self.read[key]

    def __setitem__(self, key, value):
        self.read[key] = value

    def __delitem__(self, key):
        self[key]  # raises where there is nothing
        self.read[key] = None
        self.gone.add(key)

    def __iter__(self):
        return (k for k, v in self.read.items() if v is not None)

    def __len__(self):
        return sum(1 for _ in self)

    def write(self) -> None:
        for key in self.gone:
            self.state.removeKey((self.session, key))
        for key in self:
            s = self.read[key]
            self.state.updateValue((self.session, key), (float(s[0]), int(s[1]), int(s[2]), bool(s[3]), self.born))


class CappedSessions(StatefulProcessor):
    """The state machine of one shard of sessions, for transformWithStateInPandas."""

    def __init__(self, config: DefenseConfig, most: int, idle_ms: int):
        self.config, self.most, self.idle_ms = config, most, idle_ms

    def init(self, handle) -> None:
        self.sessions = handle.getMapState("sessions", "session string", SESSION, self.idle_ms)
        self.sources = handle.getMapState("sources", "session string, source string", SOURCE, self.idle_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        shard = Shard(self.config, self.most, lambda session, born: _Sources(self.sources, session, born))
        for name, value in list(self.sessions.iterator()):
            shard.put(name[0], *value)
        before = {name: entry.used for name, entry in shard.open.items()}
        frame = pd.concat(list(rows), ignore_index=True).sort_values(["seq", "session", "key"], kind="stable", na_position="first")
        out = [shard.decide(row) for row in records(frame)]
        for name in shard.dropped & before.keys():
            self.sessions.removeKey((name,))
        for name, entry in shard.open.items():
            if before.get(name) != entry.used:
                self.sessions.updateValue((name,), entry.values())
                entry.machine.sources.write()
        yield pd.DataFrame(out, columns=columns_of(SHARDED))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for row in records(initialState):
            self.sessions.updateValue((row["session"],), (int(row["alert"]), int(row["events"]), int(row["threats"]), int(row["used"]), 0))
            if row["suspicion"] is not None:
                value = (float(row["suspicion"]), int(row["source_events"]), int(row["source_threats"]), bool(row["quarantined"]), 0)
                self.sources.updateValue((row["session"], row["source"]), value)

    def close(self) -> None:
        pass


def shard_of(session, shards: int) -> Column:
    name = F.col(session) if isinstance(session, str) else session
    return F.pmod(F.xxhash64(F.coalesce(F.nullif(name, F.lit("")), F.lit(DEFAULT))), F.lit(shards)).cast("int")


def decide_capped(config: DefenseConfig, statistics: DataFrame, most: int = 99, shards: int = 1, shard: Column | None = None) -> DataFrame:
    """Decisions as decide_in_order gives them, with `opened` where a session starts anew; a task holds one shard's open sessions."""
    dealt = statistics.withColumn("_shard", shard_of("session", shards) if shard is None else shard)

    def run(frames):
        now, state = object(), None
        for frame in frames:
            out = []
            for row in records(frame):
                if row["_shard"] != now:
                    now, state = row["_shard"], Shard(config, most, lambda session, born: {})
                out.append(state.decide(row))
            yield pd.DataFrame(out, columns=columns_of(SHARDED))

    return dealt.repartition("_shard").sortWithinPartitions("_shard", "seq", "session", "key").mapInPandas(run, SHARDED)


def decide_capped_stream(config: DefenseConfig, statistics: DataFrame, most: int = 99, shards: int = 1, idle_ms: int = 24 * 3600 * 1000, saved: DataFrame | None = None) -> DataFrame:
    """The same over a stream.  saved: a table of stored_sessions() that a new checkpoint starts from.

    Needs the RocksDB state store, which is set on the session here.  Sessions and sources
    without events for idle_ms are forgotten.
    """
    statistics.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    start = None if saved is None else saved.withColumn("_shard", shard_of("session", shards)).groupBy("_shard")
    dealt = statistics.withColumn("_shard", shard_of("session", shards)).groupBy("_shard")
    return dealt.transformWithStateInPandas(CappedSessions(config, most, idle_ms), SHARDED, "append", "processingTime", start)


def stored_sessions(spark: SparkSession, checkpoint: str) -> DataFrame:
    """A stopped stream's state from its checkpoint: one row for each session and source, null source values for a session without any."""

    def entries(name: str, *value: str) -> DataFrame:
        kept = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", name).load()
        inner = F.col("user_map_value.value") if "value" in kept.schema["user_map_value"].dataType.names else F.col("user_map_value")
        return kept.select(F.col("key._shard").alias("_shard"), "user_map_key.*", *[inner[v].alias(v) for v in value])

    sessions = entries("sessions", "alert", "events", "threats", "used", "born")
    sources = entries("sources", "suspicion", "events", "threats", "quarantined", "born").withColumnsRenamed({"events": "source_events", "threats": "source_threats"})
    return sessions.join(sources, ["_shard", "session", "born"], "left").select(*columns_of(SAVED))
