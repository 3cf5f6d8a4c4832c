"""Sessions under a cap: batch and stream against a plain ordered dictionary, eviction, restored state."""

import glob
import os
import random
from collections import OrderedDict

import pytest

from tidegate.config import DefenseConfig
from tidegate.streaming import adaptive as ad, sessions as ss

STATS = "session string, seq long, key string, domain string, modality string, tool string, risk double, accept double, reject double, evidence boolean, residual double, remaining int, removed int, empty boolean, ok boolean, control string"
C = DefenseConfig()


def rows(n=160, names=9):
    rnd = random.Random(3)
    hot = [rnd.choice(["s0", "s0", "s1", None, *[f"s{i}" for i in range(names)]]) for _ in range(n)]
    return [(s, i, f"k{rnd.randrange(3)}", None, "web", None, rnd.random(), 0.3, 0.7, False, 0.1, 5, 0, i % 13 == 0, i % 17 != 3, "release" if i % 41 == 5 else None) for i, s in enumerate(hot)]


def expected(data, most):
    """An ordered dictionary of machines, the plain way."""
    names, open_, out = [c.split()[0] for c in STATS.split(", ")], OrderedDict(default=ad.Session(C)), {}
    fresh = {"default"}
    for row in data:
        row = dict(zip(names, row))
        name = row["session"] or "default"
        opened = name not in open_ or name in fresh
        fresh.discard(name)
        machine = open_.pop(name, None) or ad.Session(C)
        open_[name] = machine
        while len(open_) > most + 1:
            del open_[next(k for k in open_ if k != "default")]
        got = machine.step(row)
        out[row["seq"]] = (name, got["action"], got["level"], got["rules"], machine.sources.get(row["key"], [0.0])[0], machine.alert, opened)
    return out


def seen(df):
    return {r.seq: (r.session, r.action, r.level, r.rules, r.suspicion, r.session_alert, r.opened) for r in df.collect()}


@pytest.mark.parametrize("most", [1, 3, 99])
def test_batch(spark, most):
    data = rows()
    assert seen(ss.decide_capped(C, spark.createDataFrame(data, STATS), most)) == expected(data, most)


def test_one_too_many_drops_the_oldest(spark):
    order = ["a", "b", "c", "a", "d", "b", "c", "a"]  # three are kept: d drops b, b drops c, c drops a, a drops d
    data = [(s, i, "k", None, "web", None, 0.9, 0.3, 0.7, False, 0.1, 5, 0, False, True, None) for i, s in enumerate(order)]
    got = seen(ss.decide_capped(C, spark.createDataFrame(data, STATS), 3))
    assert [got[i][-1] for i in range(8)] == [True, True, True, False, True, True, True, True]
    assert ss.decide_capped(C, spark.createDataFrame([], STATS), 3).count() == 0


def play(spark, tmp_path, parts, most, tag, saved=None, shards=1):
    src = tmp_path / f"in-{tag}"
    for part in parts:
        spark.createDataFrame(part, STATS).coalesce(1).write.mode("append").parquet(str(src))
    assert len(glob.glob(f"{src}/*.parquet")) == len(parts)
    stream = spark.readStream.schema(STATS).option("maxFilesPerTrigger", 1).parquet(str(src))
    q = ss.decide_capped_stream(C, stream, most, shards, saved=saved).writeStream.format("memory").queryName(f"capped_{tag}").outputMode("append")
    q = q.option("checkpointLocation", str(tmp_path / f"cp-{tag}")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return seen(spark.table(f"capped_{tag}"))


@pytest.fixture
def store(spark):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


def test_stream_and_restored_state(spark, tmp_path, store):
    """Two batches are the batch fold; the state read from the checkpoint is one entry a source; a new stream goes on from it."""
    data = rows()
    want = expected(data, 3)
    first = play(spark, tmp_path, [data[:50], data[50:100]], 3, "first")
    assert first == {k: v for k, v in want.items() if k < 100}
    saved = ss.stored_sessions(spark, str(tmp_path / "cp-first"))
    kept = saved.collect()
    assert len({r.session for r in kept} - {"default"}) == 3 and len({(r.session, r.source) for r in kept}) == len(kept)
    assert os.path.isdir(tmp_path / "cp-first" / "state")
    rest = play(spark, tmp_path, [data[100:130], data[130:]], 3, "rest", spark.createDataFrame(kept, saved.schema))
    assert rest == {k: v for k, v in want.items() if k >= 100}
