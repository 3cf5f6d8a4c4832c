import random

from pyspark.sql import functions as F

from tidegate.operators import datasets as ds, metrics as m
from tidegate.sources import records as src


def test_confusion_by_hand(spark):
    df = spark.createDataFrame(list(zip([1, 1, 1, 0, 0, 0, 0, 1], [1, 1, 0, 0, 0, 1, 0, 1], strict=True)), "y int, p int")
    r = m.binary_metrics(df).first()
    assert (r.tn, r.fp, r.fn, r.tp) == (3, 1, 1, 3) and r.precision == r.recall == r.f1 == 0.75


def test_auc_and_ap_against_pairs(spark):
    rng = random.Random(2)
    rows = [(rng.randint(0, 1), rng.randint(0, 8) / 8) for _ in range(120)]
    df = spark.createDataFrame(rows, "y int, score double")
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert abs(m.roc_auc(df).first().auc - want) < 1e-9
    ap, tp, seen = 0.0, 0, 0
    for s in sorted({s for _, s in rows}, reverse=True):
        k = sum(1 for y, x in rows if x == s and y)
        tp, seen = tp + k, seen + sum(1 for _, x in rows if x == s)
        ap += k / len(pos) * tp / seen
    assert abs(m.average_precision(df).first().average_precision - ap) < 1e-9
    assert m.roc_auc(df.where("y = 1")).first().auc is None


def test_sweep_equals_filters(spark):
    df = spark.createDataFrame([(i % 2, (i * 7 % 20) / 20) for i in range(60)], "y int, s double")
    for r in m.sweep(df, "y", "s", [0.1, 0.5, 0.9]).collect():
        assert r.tp == df.where((F.col("s") >= r.threshold) & (F.col("y") == 1)).count()


def test_group_split_has_no_leaks(spark):
    df = spark.createDataFrame([(i, f"k{i % 90}", i % 2) for i in range(300)], "line int, sha256 string, label int")
    s = ds.group_split(df)
    n = {r.split: r.n for r in s.groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert n == {"train": 72, "validation": 8, "test": 10} and ds.leaks(s).count() == 0


def test_conflicts_balance_subset(spark):
    df = spark.createDataFrame([(i, f"t{i % 10}", i % 3 % 2, "web") for i in range(90)], "doc_id long, text string, label int, domain string")
    kept = ds.remove_conflicts(df)
    assert all(len({x.label for x in kept.where(F.col("text") == t).collect()}) <= 1 for t in ("t0", "t1"))
    b = ds.balance_classes(df, most=20)
    assert {r.label: r.n for r in b.groupBy("label").agg(F.count("*").alias("n")).collect()} == {0: 20, 1: 20}
    assert ds.stratified_subset(df, 30).count() == 30 and ds.stratified_subset(df, 500).count() == 90


def test_loaders_keep_label_rules_apart(spark):
    rows = [(i, x) for i, x in enumerate(['{"label":1,"context":"a"}', '{"label":true,"context":"b"}', '{"label":1.0,"context":"c"}', '{"label":"1","context":"d","text":"d"}', '{"label":-1,"text":"e"}', "{bad", '{"text":"f"}', '{"label":1.9,"text":"g"}'])]
    lines = spark.createDataFrame(rows, "n int, line string")
    good, bad = src.pdf_records(lines)
    assert {r.n for r in good.collect()} == {0, 1, 2} and {r.n: r.reason for r in bad.collect()}[5] == "not_json"
    assert {r.n for r in src.combined_records(lines, "pdf")[0].collect()} == {3, 4, 7}
    assert {r.n: r.reason for r in src.training_records(lines)[1].collect()}[4] == "bad_label"


def test_audit_has_no_content(spark):
    df = spark.createDataFrame([("secret", "s", 1)], "raw_content string, secure_content string, seq int")
    assert set(src.audit_rows(df).columns) == {"seq", "content_sha256", "content_chars"}
