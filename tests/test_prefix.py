"""Running sums over ranges, and the rankings built on them, against brute force over continuous scores."""

import random

from pyspark.sql import functions as F

from tidegate.operators import metrics as m
from tidegate.operators.prefix import running_sums


def table(spark, n=3_000):
    """One group holds most rows; one group's key is null; scores are continuous with some ties."""
    rng = random.Random(4)
    rows = [(rng.choice(["big"] * 8 + ["small", None]), rng.choice([rng.random(), round(rng.random(), 2), None]), rng.randint(0, 1), i) for i in range(n)]
    return rows, spark.createDataFrame(rows, "g string, s double, y int, k long").repartition(7)


def test_running_sums(spark):
    rows, df = table(spark)
    counts = df.where("s is not null").groupBy("g", "s").agg(F.sum("y").alias("y"), F.count("*").alias("n"))
    for order, sign in ((F.col("s"), 1), (F.desc("s"), -1)):
        got = {(r.g, r.s): (r.a, r.b, r.a_all, r.b_all) for r in running_sums(counts, order, {"a": "y", "b": "n"}, ["g"]).collect()}
        for (g, s), have in got.items():
            own = [r for r in rows if r[0] == g and r[1] is not None]
            upto = [r for r in own if sign * r[1] <= sign * s]
            assert have == (sum(r[2] for r in upto), len(upto), sum(r[2] for r in own), len(own))
    assert running_sums(counts.limit(0), F.col("s"), {"a": "y"}).count() == 0


def test_a_large_group_is_several_ranges(spark):
    """No window takes a whole group: the plan's windows go by range, and a group of 20,000 scores is dealt over several."""
    df = spark.range(20_000).select(F.lit("one").alias("g"), F.col("id").cast("double").alias("s"), (F.col("id") % 2).cast("int").alias("y"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = m.cumulative(df, "y", "s", ["g"])
        plan = out._jdf.queryExecution().toString()
        assert "SinglePartition" not in plan and "_range" in plan
        top = out.orderBy("score").first()
        assert (top.tp, top.fp) == (10_000, 10_000)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_rankings(spark):
    rows, df = table(spark, 1_500)
    some = [r for r in rows if r[1] is not None]
    ranks = {r.k: r.avg_rank for r in m.average_ranks(df.where("s is not null"), "s", "k").collect()}
    scores = sorted(r[1] for r in some)
    assert ranks == {r[3]: scores.index(r[1]) + (scores.count(r[1]) + 1) / 2 for r in some}
    for r in m.roc_auc(df, "y", "s", ["g"]).collect():
        own = [x for x in some if x[0] == r.g]
        pos, neg = [x[1] for x in own if x[2]], [x[1] for x in own if not x[2]]
        assert abs(r.auc - sum((p > q) + (p == q) / 2 for p in pos for q in neg) / (len(pos) * len(neg))) < 1e-9
    for r in m.index_quantiles(df, "s", ["g"]).collect():
        own = sorted(x[1] for x in some if x[0] == r.g)
        assert (r.p50, r.p95, r.max, r.n) == (own[len(own) // 2], own[max(0, int(0.95 * len(own)) - 1)], own[-1], len(own))


def test_merged_runs_equal_the_step_machine(spark):
    """A source with nine tenths of the events, repeated rows, ties, nulls in key and threat: as event by event, in many ranges."""
    import random

    from tidegate.config import DefenseConfig
    from tidegate.streaming import adaptive as ad

    rnd = random.Random(5)
    rows = [("hot" if rnd.random() < 0.9 else rnd.choice(["a", "b", None]), rnd.randrange(2000), i // 2, rnd.choice(["ACCEPT"] * 6 + ["SANITIZE", "REJECT", None])) for i in range(6000)]
    rows += [("calm", i, i, "ACCEPT") for i in range(50)] + [("burst", i, i, "REJECT" if i < 7 else "ACCEPT") for i in range(6000)] + rows[:20]
    events = spark.createDataFrame(rows, "key string, ts long, event_id long, threat string")
    for c in (DefenseConfig(), DefenseConfig(suspicion_decay=0.0), DefenseConfig(suspicion_decay=0.999)):
        machines: dict = {}
        for key, _, _, threat in sorted(rows, key=lambda r: (r[1], r[2], r[3] or "")):
            machines.setdefault(key, ad.Session(c)).record(key, threat if threat is not None else "ACCEPT")
        got = {r.key: r for r in ad.source_states(c, events).collect()}
        assert set(got) == set(machines)
        for key, r in got.items():
            s, n, threats, quarantined = machines[key].sources[key]
            assert abs(r.suspicion - s) < 1e-9 and (r.events, r.threats, r.quarantined) == (n, threats, quarantined), (key, r, machines[key].sources)
        alerts = {r.key: (r.session_alert, r.session_events, r.session_threats) for r in ad.session_states(c, events, "key").collect()}
        assert alerts == {k: (x.alert, x.events, x.threats) for k, x in machines.items()}


def test_no_task_holds_a_hot_source(spark):
    """Ranges cut a group: the ordered fold of one single key is spread over ranges, and an empty table folds to nothing."""
    from tidegate.operators.prefix import ordered_fold

    df = spark.range(20000).select(F.lit("k").alias("key"), "id")
    one = F.struct(F.col("id").alias("first"), F.col("id").alias("last"), F.lit(1).cast("long").alias("n"), F.lit(True).alias("joined"))

    def both(a, b):
        return F.struct(a["first"].alias("first"), b["last"].alias("last"), (a["n"] + b["n"]).alias("n"), (a["joined"] & b["joined"] & (a["last"] + 1 == b["first"])).alias("joined"))

    got = ordered_fold(df, "key", ["id"], one, both, 64).collect()
    assert [tuple(r.one) for r in got] == [(0, 19999, 20000, True)]
    assert ordered_fold(df.where("id < 0"), "key", ["id"], one, both).count() == 0
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranges = df.repartitionByRange("key", "id").groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(ranges) == 4 and max(r["count"] for r in ranges) < 10_000
