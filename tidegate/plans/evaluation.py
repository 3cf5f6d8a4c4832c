"""Queries of evaluation: metrics, rankings, sweeps, grids, trust and outcomes."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..config import RUNTIME_TRUST, TrustConfig
from ..functions import trust
from ..functions.detect import align, noisy_or
from ..operators import metrics as m
from .registry import assessed, load, query, rounded, scored

RATES = """, (tp + tn) / nullif(tp + tn + fp + fn, 0)::DOUBLE AS acc0, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END AS p0, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END AS r0"""


def rates(keys: str, source: str) -> str:
    k = f"{keys}, " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    return f""", c AS (SELECT {k}count(*) FILTER (y = 0 AND p = 0) AS tn, count(*) FILTER (y = 0 AND p = 1) AS fp, count(*) FILTER (y = 1 AND p = 0) AS fn, count(*) FILTER (y = 1 AND p = 1) AS tp FROM ({source}) {group}),
e AS (SELECT *{RATES} FROM c)
SELECT {k}tn, fp, fn, tp, round(coalesce(acc0, 0), 6) AS accuracy, round(p0, 6) AS precision, round(r0, 6) AS recall, round(CASE WHEN p0 + r0 > 0 THEN 2 * p0 * r0 / (p0 + r0) ELSE 0 END, 6) AS f1 FROM e"""


AT_HALF = "SELECT *, CASE WHEN t >= 0.5 THEN 1 ELSE 0 END AS p FROM scored WHERE t IS NOT NULL"


def _half(spark, d):
    return scored(spark, d).where("t is not null").withColumn("p", (F.col("t") >= 0.5).cast("int"))


@query("agg01_confusion_matrix", rates("", AT_HALF))
def _(spark, d):
    return rounded(m.binary_metrics(_half(spark, d)))


@query("agg02_domain_metrics", rates("domain", AT_HALF))
def _(spark, d):
    return rounded(m.binary_metrics(_half(spark, d), by=["domain"]))


@query("agg03_category_metrics", f", h AS ({AT_HALF}) SELECT category, count(*) AS n, bool_or(y = 1) AS malicious, arg_min(y = 1, doc_id) AS first_malicious, count(*) FILTER (y = p) AS right_n, round(count(*) FILTER (y = p) / count(*)::DOUBLE, 6) AS score FROM h GROUP BY category")
def _(spark, d):
    h = _half(spark, d)
    first = m.category_metrics(h, order="doc_id").select("category", F.col("malicious").alias("first_malicious"))
    return rounded(m.category_metrics(h).join(first, "category").withColumnRenamed("right", "right_n"))


@query("agg04_argmax_metrics", rates("", "SELECT y, CASE WHEN t > 1 - t THEN 1 ELSE 0 END AS p FROM scored WHERE t IS NOT NULL"))
def _(spark, d):
    return rounded(m.binary_metrics(scored(spark, d).where("t is not null").withColumn("p", m.predicted_class(F.array(1 - F.col("t"), "t")))))


@query("agg05_classification_report", f""", h AS ({AT_HALF}), k AS (SELECT unnest([0, 1]) AS k),
e AS (SELECT k::VARCHAR AS name, count(*) FILTER (y = k AND p = k) AS hit, count(*) FILTER (p = k) AS said, count(*) FILTER (y = k) AS support FROM h, k GROUP BY k),
f AS (SELECT name, CASE WHEN said > 0 THEN hit / said::DOUBLE ELSE 0 END AS pr, CASE WHEN support > 0 THEN hit / support::DOUBLE ELSE 0 END AS re, support FROM e),
g AS (SELECT name, pr, re, CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END AS f1, support FROM f),
u AS (SELECT * FROM g UNION ALL SELECT 'macro avg', avg(pr), avg(re), avg(f1), sum(support) FROM g UNION ALL SELECT 'weighted avg', sum(pr * support) / sum(support), sum(re * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM g)
SELECT name, round(pr, 6) AS precision, round(re, 6) AS recall, round(f1, 6) AS f1, support::BIGINT AS support FROM u""")
def _(spark, d):
    return rounded(m.classification_report(_half(spark, d)))


AUC = """, s AS (SELECT {k}r AS score, y FROM decided WHERE r IS NOT NULL),
q AS (SELECT *, rank() OVER ({p}ORDER BY score) + (count(*) OVER (PARTITION BY {k}score) - 1) / 2.0 AS rk FROM s),
g AS (SELECT {k}sum(CASE WHEN y = 1 THEN rk END)::DOUBLE AS rs, count(*) FILTER (y = 1) AS n_pos, count(*) FILTER (y = 0) AS n_neg FROM q {g})
SELECT {k}n_pos, n_neg, round(CASE WHEN n_pos > 0 AND n_neg > 0 THEN (rs - n_pos * (n_pos + 1) / 2.0::DOUBLE) / (n_pos * n_neg) END, 6) AS auc FROM g"""


@query("agg06_roc_auc", AUC.format(k="domain, ", p="PARTITION BY domain ", g="GROUP BY domain"))
def _(spark, d):
    return rounded(m.roc_auc(assessed(spark, d), score="r", by=["domain"]))


@query("agg07_average_precision", """, s AS (SELECT domain, r AS score, count(*) FILTER (y = 1) AS pos, count(*) AS n FROM decided WHERE r IS NOT NULL GROUP BY ALL),
c AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS n_above FROM s WINDOW w AS (PARTITION BY domain ORDER BY score DESC))
SELECT domain, sum(pos)::BIGINT AS n_pos, round(sum(pos * tp / n_above::DOUBLE) / sum(pos), 6) AS average_precision FROM c GROUP BY domain""")
def _(spark, d):
    return rounded(m.average_precision(assessed(spark, d), score="r", by=["domain"]))


@query("agg15_noisy_or", ", s AS (SELECT category, t FROM scored WHERE t IS NOT NULL) SELECT category, round(1 - product(1 - t), 6) AS threat FROM s GROUP BY category")
def _(spark, d):
    each = scored(spark, d).where("t is not null").groupBy("category").agg((1 - F.product(1 - F.col("t"))).alias("threat"))
    return rounded(each)


@query("agg15_noisy_or_in_row", "SELECT doc_id, round(1 - (1 - coalesce(t, 0)) * (1 - coalesce(v, 0)), 6) AS threat FROM scored")
def _(spark, d):
    parts = F.filter(F.array("t", "v"), lambda x: x.isNotNull())
    return scored(spark, d).select("doc_id", F.round(noisy_or(parts), 6).alias("threat"))


OUTCOME = """SELECT {k}count(*) FILTER (y = 0 AND action = 'ACCEPT') AS benign_accept, count(*) FILTER (y = 0 AND action = 'SANITIZE') AS benign_sanitize, count(*) FILTER (y = 0 AND action = 'REJECT') AS benign_reject,
 count(*) FILTER (y = 1 AND action = 'ACCEPT') AS malicious_accept, count(*) FILTER (y = 1 AND action = 'SANITIZE') AS malicious_sanitize, count(*) FILTER (y = 1 AND action = 'REJECT') AS malicious_reject,
 round(coalesce(count(*) FILTER (y = 1 AND action <> 'ACCEPT') / nullif(count(*) FILTER (action <> 'ACCEPT'), 0)::DOUBLE, 0), 6) AS flag_precision,
 round(coalesce(count(*) FILTER (y = 1 AND action <> 'ACCEPT') / nullif(count(*) FILTER (y = 1), 0)::DOUBLE, 0), 6) AS flag_recall,
 round(coalesce(count(*) FILTER (y = 1 AND action = 'REJECT') / nullif(count(*) FILTER (action = 'REJECT'), 0)::DOUBLE, 0), 6) AS block_precision,
 round(coalesce(count(*) FILTER (y = 1 AND action = 'REJECT') / nullif(count(*) FILTER (y = 1), 0)::DOUBLE, 0), 6) AS block_recall
FROM {f} {g}"""


@query("agg16_outcome_table", OUTCOME.format(k="domain, ", f="decided", g="GROUP BY domain"))
def _(spark, d):
    return rounded(m.outcome_table(assessed(spark, d), by=["domain"]))


@query("agg17_decisions_by_label", "SELECT y, action, count(*) AS n FROM decided GROUP BY y, action")
def _(spark, d):
    return assessed(spark, d).groupBy("y", "action").agg(F.count("*").alias("n"))


@query("agg18_latency_quantiles", """, e AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, min(value) FILTER (i = n // 2) AS p50, min(value) FILTER (i = greatest(0, n * 95 // 100 - 1)) AS p95, max(value) AS max, max(n) AS n FROM e GROUP BY event_type""")
def _(spark, d):
    return m.index_quantiles(load(spark, d, "events"), "value", ["event_type"])


@query("agg19_salvage_summary", ", s AS (SELECT * FROM decided WHERE action = 'REJECT' AND domain <> 'image') SELECT domain, count(*) AS salvaged, round(max(r), 6) AS max_residual, round(avg(length(text)), 6) AS mean_chars FROM s GROUP BY domain")
def _(spark, d):
    s = assessed(spark, d).where("action = 'REJECT' and domain <> 'image'")
    return rounded(s.groupBy("domain").agg(F.count("*").alias("salvaged"), F.max("r").alias("max_residual"), F.avg(F.length("text")).alias("mean_chars")))


@query("agg20_attempts", """, e AS (SELECT category, action, (row_number() OVER (PARTITION BY category ORDER BY doc_id) - 1) % 5 + 1 AS attempt FROM decided)
SELECT attempt, count(*) FILTER (action = 'ACCEPT') AS accept, count(*) FILTER (action = 'SANITIZE') AS sanitize, count(*) FILTER (action = 'REJECT') AS reject, round(count(*) FILTER (action <> 'REJECT') / count(*)::DOUBLE, 4) AS delivered FROM e GROUP BY attempt""")
def _(spark, d):
    order = Window.partitionBy("category").orderBy("doc_id")
    e = assessed(spark, d).select("category", "action", "doc_id").withColumn("attempt", ((F.row_number().over(order) - 1) % 5 + 1).cast("long"))
    count = lambda a: F.count_if(F.col("action") == a).alias(a.lower())
    return e.groupBy("attempt").agg(count("ACCEPT"), count("SANITIZE"), count("REJECT"), F.round(F.count_if(F.col("action") != "REJECT") / F.count("*"), 4).alias("delivered"))


@query("win02_average_ranks", ", s AS (SELECT doc_id, r FROM decided WHERE r IS NOT NULL) SELECT doc_id, round(r, 6) AS r, (rank() OVER (ORDER BY r) + (count(*) OVER (PARTITION BY r) - 1) / 2.0)::DOUBLE AS avg_rank FROM s")
def _(spark, d):
    return m.average_ranks(assessed(spark, d).where("r is not null"), "r", "doc_id").select("doc_id", F.round("r", 6).alias("r"), "avg_rank")


@query("win03_cumulative_counts", ", s AS (SELECT domain, t AS score, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM scored WHERE t IS NOT NULL GROUP BY ALL) SELECT domain, score, pos, neg, (sum(pos) OVER w)::BIGINT AS tp, (sum(neg) OVER w)::BIGINT AS fp FROM s WINDOW w AS (PARTITION BY domain ORDER BY score DESC)")
def _(spark, d):
    return m.cumulative(scored(spark, d), score="t", by=["domain"])


@query("win06_attempt_numbers", "SELECT doc_id, category, (row_number() OVER w - 1) // 5 AS sequence, (row_number() OVER w - 1) % 5 + 1 AS attempt FROM scored WINDOW w AS (PARTITION BY category ORDER BY doc_id)")
def _(spark, d):
    n = F.row_number().over(Window.partitionBy("category").orderBy("doc_id")) - 1
    return scored(spark, d).select("doc_id", "category", F.floor(n / 5).alias("sequence"), (n % 5 + 1).cast("long").alias("attempt"))


@query("win07_alternation", "SELECT doc_id, CASE WHEN (row_number() OVER (PARTITION BY category ORDER BY doc_id) - 1) % 2 = 0 THEN 'alert' ELSE 'calm' END AS mode FROM scored")
def _(spark, d):
    n = F.row_number().over(Window.partitionBy("category").orderBy("doc_id")) - 1
    return scored(spark, d).select("doc_id", F.when(n % 2 == 0, "alert").otherwise("calm").alias("mode"))


# ------------------------------------------------------------------ trust
@query("scr01_threat_fusion", """SELECT doc_id, round(fused, 6) AS noisy_or, round(CASE WHEN t IS NULL AND v IS NULL THEN NULL ELSE greatest(coalesce(0.8::DOUBLE * t, -1), coalesce(v, -1)) END, 6) AS max,
 round(CASE WHEN t IS NULL AND v IS NULL THEN NULL ELSE (coalesce(0.8::DOUBLE * t, 0) + coalesce(v, 0)) / (CASE WHEN t IS NULL THEN 0 ELSE 0.8::DOUBLE END + CASE WHEN v IS NULL THEN 0 ELSE 1 END) END, 6) AS weighted_mean FROM decided""")
def _(spark, d):
    fuse = lambda mode, w=0.8: F.round(trust.fuse("t", "v", w, 1.0, mode), 6).alias(mode)
    return scored(spark, d).select("doc_id", fuse("noisy_or", 1.0), fuse("max"), fuse("weighted_mean"))


@query("scr02_contextual_risk", "SELECT doc_id, round(r, 6) AS risk, round(r - fused, 6) AS uplift FROM decided")
def _(spark, d):
    s = scored(spark, d).withColumn("b", trust.fuse("t", "v")).withColumn("risk", trust.contextual_risk("b", "a", 0.5))
    return rounded(s.select("doc_id", "risk", (F.col("risk") - F.col("b")).alias("uplift")))


@query("scr03_trust", "SELECT doc_id, round((1 - r) * 100, 7) AS trust_percent FROM decided")
def _(spark, d):
    return assessed(spark, d).select("doc_id", F.round(trust.trust_from_risk("r") * 100, 7).alias("trust_percent"))


@query("scr04_band_decision", "SELECT doc_id, action FROM decided")
def _(spark, d):
    return assessed(spark, d).select("doc_id", "action")


@query("scr05_explanation")
def _(spark, d):
    x = trust.assess(TrustConfig(), "domain", "t", "v", F.col("a"))
    return scored(spark, d).select("doc_id", x.alias("x")).select("doc_id", trust.explain(TrustConfig(), "x").alias("reason"))


@query("scr06_probability_cleaning", "SELECT doc_id, t AS p FROM scored")
def _(spark, d):
    return scored(spark, d).select("doc_id", trust.clean_probability(F.coalesce("t", F.lit(float("nan")))).alias("p"))


@query("scr07_text_availability", "SELECT doc_id, CASE WHEN length(text) % 2 = 0 THEN t END AS text_threat, CASE WHEN length(text) % 2 = 0 THEN a END AS alignment FROM scored")
def _(spark, d):
    x = trust.assess(TrustConfig(), "domain", "t", "v", F.col("a"), F.length("text") % 2 == 0)
    return scored(spark, d).select("doc_id", x.alias("x")).select("doc_id", "x.text_threat", "x.alignment")


@query("scr08_alignment", """, e AS (SELECT vec_id, vec_id // 5 AS k, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
q AS (SELECT * FROM e WHERE vec_id % 5 = 0), c AS (SELECT e.k, e.vec_id, list_sum(list_transform(list_zip(q.v, e.v), lambda p: p[1] * p[2])) AS cos FROM q JOIN e USING (k) WHERE e.vec_id % 5 <> 0)
SELECT k, round(avg(cos), 6) AS cos_mean, round(max(cos), 6) AS cos_max, round(min(cos), 6) AS cos_min, arg_min(vec_id, cos) AS weakest, round(greatest(0, least(1, avg(cos))), 6) AS alignment FROM c GROUP BY k""")
def _(spark, d):
    e = load(spark, d, "embeddings").withColumn("k", F.floor(F.col("vec_id") / 5)).withColumn("v", F.transform("embedding", lambda x: x.cast("double")))
    q = e.where("vec_id % 5 = 0").select("k", F.col("v").alias("q"))
    return rounded(align(q, e.where("vec_id % 5 <> 0").select("k", F.col("vec_id").alias("chunk"), "v"), "k"))


@query("scr09_combined_alignment", "SELECT doc_id, round(CASE WHEN a IS NULL AND v IS NULL THEN NULL ELSE (coalesce(0.7::DOUBLE * a, 0) + coalesce(0.3::DOUBLE * v, 0)) / (CASE WHEN a IS NULL THEN 0 ELSE 0.7::DOUBLE END + CASE WHEN v IS NULL THEN 0 ELSE 0.3::DOUBLE END) END, 6) AS alignment FROM scored")
def _(spark, d):
    return rounded(scored(spark, d).select("doc_id", trust.combined_alignment("a", "v").alias("alignment")))


@query("scr10_assessment", "SELECT doc_id, round(fused, 6) AS fused, round(r, 7) AS risk, action AS decision FROM decided")
def _(spark, d):
    return assessed(spark, d).select("doc_id", F.round("fused", 6).alias("fused"), F.round("r", 7).alias("risk"), F.col("action").alias("decision"))


@query("scr11_batch_with_profiles", """, p AS (SELECT *, CASE WHEN domain = 'image' THEN 0.4::DOUBLE ELSE 1 END AS w, CASE WHEN domain = 'image' THEN 0.85::DOUBLE ELSE 0.7::DOUBLE END AS rj FROM scored),
f AS (SELECT *, CASE WHEN t IS NULL AND v IS NULL THEN NULL ELSE 1 - (1 - w * coalesce(t, 0)) * (1 - coalesce(v, 0)) END AS b FROM p), g AS (SELECT *, CASE WHEN b IS NULL THEN NULL ELSE least(1, b + 0.5 * (1 - coalesce(a, 1)) * b * (1 - b)) END AS rr FROM f)
SELECT domain, CASE WHEN rr IS NULL THEN 'SANITIZE' WHEN rr < 0.3 THEN 'ACCEPT' WHEN rr >= rj THEN 'REJECT' ELSE 'SANITIZE' END AS decision, count(*) AS n FROM g GROUP BY ALL""")
def _(spark, d):
    x = trust.assess(RUNTIME_TRUST, "domain", "t", "v", F.col("a"))
    return scored(spark, d).select("domain", x["decision"].alias("decision")).groupBy("domain", "decision").agg(F.count("*").alias("n"))


METHODS = "SELECT 'text' AS method, y, CASE WHEN t >= 0.5 THEN 1 ELSE 0 END AS p FROM scored WHERE t IS NOT NULL UNION ALL SELECT 'visual', y, CASE WHEN v >= 0.5 THEN 1 ELSE 0 END FROM scored WHERE v IS NOT NULL UNION ALL SELECT 'reject', y, CASE WHEN action = 'REJECT' THEN 1 ELSE 0 END FROM decided UNION ALL SELECT 'flag', y, CASE WHEN action <> 'ACCEPT' THEN 1 ELSE 0 END FROM decided"


@query("scr12_method_comparison", rates("method", METHODS))
def _(spark, d):
    over = lambda c: F.when(F.col(c).isNotNull(), (F.col(c) >= 0.5).cast("int"))
    wide = assessed(spark, d).select("y", over("t").alias("text"), over("v").alias("visual"), (F.col("action") == "REJECT").cast("int").alias("reject"), (F.col("action") != "ACCEPT").cast("int").alias("flag"))
    return rounded(m.binary_metrics(wide.unpivot("y", ["text", "visual", "reject", "flag"], "method", "p").where("p is not null"), by=["method"]))


SWEEP = "SELECT th / 100::DOUBLE AS threshold, y, CASE WHEN r >= th / 100::DOUBLE THEN 1 ELSE 0 END AS p FROM decided, range(5, 100, 5) q(th) WHERE r IS NOT NULL"
THRESHOLDS = [i / 100 for i in range(5, 100, 5)]


@query("scr13_threshold_sweep", rates("threshold", SWEEP))
def _(spark, d):
    return rounded(m.sweep(assessed(spark, d), "y", "r", THRESHOLDS))


GRID = """, grid AS (SELECT wt, lam, th FROM (SELECT unnest([0.5::DOUBLE, 1]) AS wt), (SELECT unnest([0::DOUBLE, 0.5]) AS lam), (SELECT unnest([0.4::DOUBLE, 0.6, 0.8]) AS th)),
b AS (SELECT wt, lam, th, y, a, CASE WHEN t IS NULL AND v IS NULL THEN NULL ELSE 1 - (1 - wt * coalesce(t, 0)) * (1 - coalesce(v, 0)) END AS b FROM scored, grid),
pr AS (SELECT wt, lam, th, y, CASE WHEN b + lam * (1 - coalesce(a, 1)) * b * (1 - b) >= th THEN 1 ELSE 0 END AS p FROM b WHERE b IS NOT NULL)"""


def _grid(spark, d, top=None):
    grid = m.literal_grid(spark, wt=[0.5, 1.0], lam=[0.0, 0.5], th=[0.4, 0.6, 0.8])
    rows = scored(spark, d).where("t is not null or v is not null").select("y", "t", "v", "a")
    decide = lambda: (trust.contextual_risk(trust.fuse("t", "v", F.col("wt")), "a", F.col("lam")) >= F.col("th")).cast("int")
    return m.grid_search(rows, "y", decide, grid, top)


@query("scr14_grid_search", GRID + rates("wt, lam, th", "SELECT * FROM pr"))
def _(spark, d):
    return rounded(_grid(spark, d))


@query("smp08_grid_top", GRID + rates("wt, lam, th", "SELECT * FROM pr") + " ORDER BY f1 DESC, fn, wt, lam, th LIMIT 5")
def _(spark, d):
    return rounded(_grid(spark, d, 5))


@query("smp09_best_threshold", rates("threshold", SWEEP) + " ORDER BY f1 DESC, fn, threshold LIMIT 1")
def _(spark, d):
    return rounded(m.best_threshold(m.sweep(assessed(spark, d), "y", "r", THRESHOLDS)))


@query("smp11_first_errors", ", e AS (SELECT doc_id, y, action, CASE WHEN y = 0 AND action = 'REJECT' THEN 'FP' WHEN y = 1 AND action <> 'REJECT' THEN 'FN' END AS kind FROM decided) SELECT doc_id, y, action, kind FROM e WHERE kind IS NOT NULL ORDER BY doc_id LIMIT 20")
def _(spark, d):
    kind = F.when((F.col("y") == 0) & (F.col("action") == "REJECT"), "FP").when((F.col("y") == 1) & (F.col("action") != "REJECT"), "FN")
    return assessed(spark, d).select("doc_id", "y", "action", kind.alias("kind")).where("kind is not null").orderBy("doc_id").limit(20)


@query("flt13_subsets", "SELECT count(*) AS all_n, count(*) FILTER (t IS NOT NULL) AS with_text, count(*) FILTER (v IS NOT NULL) AS with_visual, count(*) FILTER (t IS NOT NULL AND v IS NOT NULL) AS with_both, count(*) FILTER (a IS NOT NULL) AS with_alignment FROM scored")
def _(spark, d):
    there = lambda *c: F.count_if(F.expr(" and ".join(f"{x} is not null" for x in c)))
    return scored(spark, d).agg(F.count("*").alias("all_n"), there("t").alias("with_text"), there("v").alias("with_visual"), there("t", "v").alias("with_both"), there("a").alias("with_alignment"))


@query("jon04_base_vs_variant", ", v2 AS (SELECT doc_id, CASE WHEN r IS NULL THEN 'SANITIZE' WHEN r < 0.2 THEN 'ACCEPT' WHEN r >= 0.6 THEN 'REJECT' ELSE 'SANITIZE' END AS variant FROM decided) SELECT action, variant, count(*) AS n FROM decided JOIN v2 USING (doc_id) GROUP BY ALL")
def _(spark, d):
    base = assessed(spark, d).select("doc_id", "action", "r")
    variant = base.select("doc_id", trust.band("r", 0.2, 0.6).alias("variant"))
    return base.join(variant, "doc_id").groupBy("action", "variant").agg(F.count("*").alias("n"))


@query("jon05_grid_cross", ", th AS (SELECT unnest(range(1, 10)) AS i) SELECT (i / 10::DOUBLE) AS threshold, count(*) FILTER (t >= i / 10::DOUBLE) AS n FROM scored, th GROUP BY i")
def _(spark, d):
    return m.sweep(scored(spark, d).withColumn("y", F.lit(1)), "y", "t", [i / 10 for i in range(1, 10)]).select("threshold", F.col("tp").alias("n"))


@query("jon08_profile_lookup", "SELECT domain, CASE WHEN domain = 'image' THEN 0.4::DOUBLE ELSE 1 END AS w_text, CASE WHEN domain = 'image' THEN 0.85::DOUBLE ELSE 0.7::DOUBLE END AS reject_at_or_above, count(*) AS n FROM scored GROUP BY ALL")
def _(spark, d):
    own = {n: trust.per_domain(RUNTIME_TRUST, "domain", n).alias(n) for n in ("w_text", "reject_at_or_above")}
    return scored(spark, d).select("domain", *own.values()).groupBy("domain", *own).agg(F.count("*").alias("n"))


@query("run06_policy_variants", """SELECT doc_id, action AS no_salvage, CASE WHEN action = 'REJECT' AND domain <> 'image' THEN 'SANITIZE' ELSE action END AS salvage,
 CASE WHEN action = 'REJECT' AND domain <> 'image' AND coalesce(t, 0) >= 0.7 THEN 'REJECT' WHEN action = 'REJECT' AND domain <> 'image' THEN 'SANITIZE' ELSE action END AS lenient FROM decided""")
def _(spark, d):
    can = (F.col("action") == "REJECT") & (F.col("domain") != "image")
    salvage = F.when(can, "SANITIZE").otherwise(F.col("action"))
    lenient = F.when(can & (F.coalesce("t", F.lit(0.0)) >= 0.7), "REJECT").otherwise(salvage)
    return assessed(spark, d).select("doc_id", F.col("action").alias("no_salvage"), salvage.alias("salvage"), lenient.alias("lenient"))
