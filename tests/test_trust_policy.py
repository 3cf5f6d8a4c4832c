import json

import pytest
from pyspark.sql import functions as F

from tidegate.config import DefenseConfig, TrustConfig, from_json, with_overrides
from tidegate.functions import policy, trust
from tidegate.streaming import adaptive as ad


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def test_fusion_and_risk_by_hand(spark):
    t, v, none = F.lit(0.7), F.lit(0.4), F.lit(None).cast("double")
    r = one(spark, o=trust.fuse(t, v), m=trust.fuse(t, v, mode="max"), w=trust.fuse(t, v, mode="weighted_mean"), n=trust.fuse(none, none), s=trust.fuse(none, v), risk=trust.contextual_risk(F.lit(0.5), F.lit(0.0), 0.5), same=trust.contextual_risk(F.lit(0.5), none, 0.5), nothing=trust.contextual_risk(none, F.lit(0.1), 0.5))
    assert [round(x, 9) for x in (r.o, r.m, r.w, r.s, r.risk, r.same)] == [0.82, 0.7, 0.55, 0.4, 0.625, 0.5]
    assert r.n is None and r.nothing is None


def test_bands(spark):
    rows = spark.createDataFrame([(x,) for x in (0.0, 0.2999, 0.30, 0.6999, 0.70, 1.0, None)], "r double")
    assert [x[0][0] for x in rows.select(trust.band("r", 0.3, 0.7)).collect()] == list("AASSRRS")


def test_probability_outside_stops(spark):
    with pytest.raises(Exception, match="outside"):
        spark.range(1).select(trust.clean_probability(F.lit(1.2), "x")).collect()


def test_with_assessment_equals_assess(spark):
    df = spark.createDataFrame([("web", 0.2, None, 0.4, True), ("image", None, 0.9, None, False), ("pdf", None, None, None, True), ("web", 0.9, 0.1, 0.0, False)], "d string, t double, v double, a double, h boolean")
    c = TrustConfig()
    df = df.withColumn("x", trust.assess(c, "d", "t", "v", F.col("a"), F.col("h")))
    df = trust.with_assessment(df, c, "y", "d", "t", "v", F.col("a"), F.col("h"))
    for r in df.collect():
        assert (r.x.risk, r.x.decision) == (r.y.risk, r.y.decision)


def test_thresholds_never_cross(spark):
    r = spark.range(1).select(policy.effective_thresholds(DefenseConfig(), F.lit(0.2), F.lit(0.25), F.lit("high")).alias("x")).first().x
    assert r.accept_below == 0.05 and abs(r.reject_at_or_above - 0.1) < 1e-9


def test_post_check_rules(spark):
    c = DefenseConfig()
    check = lambda residual, left, removed: policy.post_check(c, F.lit("SANITIZE"), F.lit(False), F.lit(0.3), F.lit(0.7), F.lit(residual).cast("double"), F.lit(left), F.lit(removed))
    r = one(spark, a=check(0.5, 9, 1), b=check(0.5, 9, 0), c=check(None, 9, 1), d=check(0.0, 0, 1))
    assert list(r) == ["REJECT", "SANITIZE", "SANITIZE", "REJECT"]


def test_escalation_and_quarantine():
    s, levels = ad.Session(DefenseConfig()), []
    for _ in range(6):
        levels.append(s.level("k", None))
        s.record("k", "REJECT")
    # the alert lifts the first level for later ones too
    assert [ad.Session.level(ad.Session(DefenseConfig(session_alert_events=0), None), "k", None)] == ["normal"]
    assert levels == ["normal", "elevated", "elevated", "high", "high", "high"] and s.sources["k"][3]
    row = {"key": "k", "accept": 0.3, "reject": 0.7, "risk": 0.0, "remaining": 1}
    assert s.step(row)["rules"] == "R2"
    s.release("k")
    assert s.step(row)["rules"] != "R2"


def test_failures_are_not_evidence():
    s = ad.Session(DefenseConfig())
    assert s.step({"key": "k", "ok": False})["action"] == "REJECT" and s.events == 0
    assert ad.Session(DefenseConfig(), s.dump()).dump() == s.dump()


STATS = "session string, seq long, key string, domain string, modality string, tool string, risk double, accept double, reject double, evidence boolean, residual double, remaining int, removed int, empty boolean, ok boolean, control string"


def _stats(n=60):
    return [(f"s{i % 2}", i, f"k{i % 3}", None, "web", None, (i * 37 % 100) / 100, 0.3, 0.7, i % 11 == 0, 0.1, 5, 0, i % 13 == 0, i % 17 != 3, None) for i in range(n)]


def test_stream_equals_batch(spark, tmp_path):
    c = DefenseConfig()
    rows = _stats()
    batch = {r.seq: r.asDict() for r in ad.decide_in_order(c, spark.createDataFrame(rows, STATS)).collect()}
    src = tmp_path / "in"
    for part in (rows[:25], rows[25:]):
        spark.createDataFrame(part, STATS).coalesce(1).write.mode("append").parquet(str(src))
    import glob
    import os

    files = sorted(glob.glob(f"{src}/*.parquet"), key=os.path.getmtime)
    assert len(files) == 2
    stream = spark.readStream.schema(STATS).option("maxFilesPerTrigger", 1).parquet(str(src))
    q = ad.decide_stream(c, stream).writeStream.format("memory").queryName("folded").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.seq: r.asDict() for r in spark.table("folded").collect()}
    assert got == batch


def test_source_fold_matches_session_machine(spark):
    events = [(i % 3, i, ("REJECT", "SANITIZE", "ACCEPT")[i * 7 % 3]) for i in range(40)]
    got = {r.key: r for r in ad.source_states(DefenseConfig(), spark.createDataFrame(events, "key int, ts int, threat string").withColumn("event_id", F.col("ts"))).collect()}
    s = ad.Session(DefenseConfig())
    for k, _, t in events:
        s.record(k, t)
    for k, r in got.items():
        assert abs(r.suspicion - s.sources[k][0]) < 1e-9 and [r.events, r.threats, r.quarantined] == s.sources[k][1:]


def test_config_checks():
    assert from_json(TrustConfig, json.dumps({"_comment": "x", "w_text": 0.5, "profiles": {"image": {"w_text": 0.4}}})).resolve("image").w_text == 0.4
    assert with_overrides(TrustConfig(), ["align_lambda=0.1", "fusion_mode=max"]).fusion_mode == "max"
    for bad in ({"w_text": 2}, {"nope": 1}, {"accept_below": 0.8}):
        with pytest.raises(ValueError):
            from_json(TrustConfig, json.dumps(bad))


def test_saved_states_go_on(spark, tmp_path):
    """Folding in two halves with saved states is folding once; a new start keeps reputation and clears the alert."""
    from tidegate.sources.records import load_state, save_state

    c, rows = DefenseConfig(), _stats(120)
    whole = {r.seq: r.asDict() for r in ad.decide_in_order(c, spark.createDataFrame(rows, STATS)).collect()}
    early, late = (spark.createDataFrame(part, STATS) for part in (rows[:70], rows[70:]))
    save_state(ad.session_dumps(c, early), str(tmp_path / "state"))
    saved = load_state(spark, str(tmp_path / "state"))
    got = {r.seq: r.asDict() for half in (ad.decide_in_order(c, early), ad.decide_in_order(c, late, saved)) for r in half.collect()}
    assert got == whole
    last = {r.session: json.loads(r.saved) for r in ad.session_dumps(c, late.where("session = 's1'"), saved).collect()}
    assert set(last) == {"s0", "s1"} and last["s1"]["sources"] == json.loads(ad.session_dumps(c, spark.createDataFrame(rows, STATS)).where("session = 's1'").first().saved)["sources"]
    cleared = {r.session: json.loads(r.saved) for r in ad.new_sessions(c, saved).collect()}
    assert all(cleared[k]["alert"] == cleared[k]["events"] == 0 and cleared[k]["sources"] for k in ("s0", "s1"))


def test_blocklist_of_any_size(spark):
    df = spark.range(3000).selectExpr("id", "concat('h', id, '.test') as domain")
    listed = spark.range(0, 3000, 2).selectExpr("concat('H', id, '.test') as domain")
    got = policy.with_blocked(df, listed, "domain", "rule").collect()
    assert len(got) == 3000 and all((r.rule == "R1") == (r.id % 2 == 0) for r in got)
