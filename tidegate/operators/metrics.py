"""Evaluation: confusion matrices, rankings, sweeps, grids and outcome tables.

Everything is a group-by or a join on a key.  Rankings first sum rows by score, then
take running sums over ranges of scores (operators/prefix.py), so no task holds all
scores of a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import _c
from .prefix import running_sums


def ratio(a, b) -> Column:
    """a / b as a double, 0 where b is 0."""
    return F.when(_c(b) > 0, _c(a) / _c(b)).otherwise(F.lit(0.0))


def confusion(y="y", p="p") -> list[Column]:
    """tn, fp, fn, tp of 0/1 labels and predictions."""
    y, p = _c(y), _c(p)
    return [F.count_if((y == a) & (p == b)).alias(n) for n, a, b in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))]


def with_rates(df: DataFrame, *keys: str) -> DataFrame:
    """accuracy, precision, recall and f1 from tn, fp, fn, tp."""
    precision, recall = ratio("tp", F.col("tp") + F.col("fp")), ratio("tp", F.col("tp") + F.col("fn"))
    out = df.withColumn("accuracy", ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn"))).withColumn("precision", precision).withColumn("recall", recall)
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).select(*keys, "tn", "fp", "fn", "tp", "accuracy", "precision", "recall", "f1")


def binary_metrics(df: DataFrame, y: str = "y", p: str = "p", by: Sequence[str] = ()) -> DataFrame:
    return with_rates(df.groupBy(*by).agg(*confusion(y, p)), *by)


def category_metrics(df: DataFrame, y: str = "y", p: str = "p", category: str = "category", order: str | None = None) -> DataFrame:
    """Per category: n, whether it is malicious (any label 1, or the first label by `order`), and the share predicted right."""
    kind = F.bool_or(_c(y) == 1) if order is None else F.min_by(_c(y) == 1, _c(order))
    return df.groupBy(category).agg(F.count("*").alias("n"), kind.alias("malicious"), F.count_if(_c(y) == _c(p)).alias("right")).withColumn("score", ratio("right", "n"))


def classification_report(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """precision, recall, f1 and support of each class, and their macro and weighted means."""
    sides = df.select(F.explode(F.array(F.struct(_c(y).cast("string").alias("k"), F.lit(1).alias("is"), (_c(y) == _c(p)).alias("hit")), F.struct(_c(p).cast("string").alias("k"), F.lit(0).alias("is"), F.lit(False).alias("hit")))).alias("s")).select("s.*")
    each = sides.groupBy(F.col("k").alias("name")).agg(F.count_if("hit").alias("tp"), F.sum("is").alias("support"), F.count_if(F.col("is") == 0).alias("said"))
    each = each.withColumn("precision", ratio("tp", "said")).withColumn("recall", ratio("tp", "support")).withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    cols = ["precision", "recall", "f1"]
    macro = each.agg(*[F.avg(c).alias(c) for c in cols], F.sum("support").alias("support")).select(F.lit("macro avg").alias("name"), *cols, "support")
    weighted = each.agg(*[F.try_divide(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(c) for c in cols], F.sum("support").alias("support")).select(F.lit("weighted avg").alias("name"), *cols, "support")
    return each.select("name", *cols, "support").unionByName(macro).unionByName(weighted)


def _by_score(df: DataFrame, y: str, score: str, by: Sequence[str]) -> DataFrame:
    return df.where(_c(score).isNotNull()).groupBy(*by, _c(score).alias("score")).agg(F.count_if(_c(y) == 1).alias("pos"), F.count_if(_c(y) == 0).alias("neg"))


def roc_auc(df: DataFrame, y: str = "y", score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve by average ranks; null where a class is missing."""
    each = running_sums(_by_score(df, y, score, by), F.col("score"), {"upto": "neg"}, by).withColumn("won", F.col("pos") * (F.col("upto") - F.col("neg") + F.col("neg") / 2.0))
    return each.groupBy(*by).agg(F.sum("won").alias("won"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg")).select(*by, "n_pos", "n_neg", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("won") / (F.col("n_pos") * F.col("n_neg"))).alias("auc"))


def cumulative(df: DataFrame, y: str = "y", score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """For each score from the highest down: tp and fp so far, and tp before it."""
    each = running_sums(_by_score(df, y, score, by), F.desc("score"), {"tp": "pos", "fp": "neg"}, by)
    return each.select(*by, "score", "pos", "neg", "tp", "fp")


def average_precision(df: DataFrame, y: str = "y", score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """Step-wise average precision, equal scores taken together; null without positives."""
    each = cumulative(df, y, score, by)
    return each.groupBy(*by).agg(F.sum("pos").alias("n_pos"), F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("s")).select(*by, "n_pos", F.when(F.col("n_pos") > 0, F.col("s") / F.col("n_pos")).alias("average_precision"))


def average_ranks(df: DataFrame, score: str, key: str) -> DataFrame:
    """key, score and the rank that equal scores share, computed over distinct scores and joined back."""
    counts = running_sums(df.groupBy(score).agg(F.count("*").alias("n")), F.col(score), {"upto": "n"})
    ranks = counts.select(score, (F.col("upto") - F.col("n") + (F.col("n") + 1) / 2.0).alias("avg_rank"))
    return df.select(key, score).join(ranks, score).select(key, score, "avg_rank")


def sweep(df: DataFrame, y: str, score: str, thresholds: Sequence[float]) -> DataFrame:
    """Metrics at each threshold: rows are counted by how many thresholds they reach, so each is read once."""
    marks = F.array(*[F.lit(float(t)) for t in sorted(thresholds)])
    reached = F.size(F.filter(marks, lambda t: _c(score) >= t))
    counts = df.where(_c(score).isNotNull()).groupBy(reached.alias("r")).agg(F.count_if(_c(y) == 1).alias("pos"), F.count_if(_c(y) == 0).alias("neg"))
    each = counts.select(F.posexplode(marks).alias("i", "threshold"), "r", "pos", "neg")
    above = F.col("r") > F.col("i")
    zero = lambda c, k: F.coalesce(F.sum(F.when(k, F.col(c))), F.lit(0)).cast("long")
    return with_rates(each.groupBy("threshold").agg(zero("neg", ~above).alias("tn"), zero("neg", above).alias("fp"), zero("pos", ~above).alias("fn"), zero("pos", above).alias("tp")), "threshold")


def best_threshold(swept: DataFrame) -> DataFrame:
    """The sweep's row with the largest f1, then fewest misses, then smallest threshold."""
    return swept.orderBy(F.desc("f1"), "fn", "threshold").limit(1)


def grid_search(df: DataFrame, y: str, decide, grid: DataFrame, top: int | None = None) -> DataFrame:
    """Metrics of decide(row, settings) -> 0/1 for every row of a small literal grid; one aggregate after a broadcast of the grid."""
    keys = grid.columns
    met = df.crossJoin(F.broadcast(grid)).withColumn("_p", decide())
    out = with_rates(met.groupBy(*keys).agg(*confusion(y, "_p")), *keys)
    return out.orderBy(F.desc("f1"), "fn", *keys).limit(top) if top else out


def literal_grid(spark: SparkSession, **values: Sequence) -> DataFrame:
    """All combinations of a few settings, as literals; their number is bounded by the call."""
    out = spark.range(1).select(*[F.lit(None).alias("_")]).drop("_")
    for name, options in values.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in options])))
    return out


def outcome_table(df: DataFrame, y: str = "y", action: str = "action", by: Sequence[str] = ()) -> DataFrame:
    """ACCEPT, SANITIZE and REJECT counts by label, with the metrics of flagging (not ACCEPT) and of blocking (REJECT)."""
    count = lambda a, b: F.count_if((_c(y) == a) & (_c(action) == b))
    names = [(f"{n}_{d.lower()}", v, d) for n, v in (("benign", 0), ("malicious", 1)) for d in ("ACCEPT", "SANITIZE", "REJECT")]
    out = df.groupBy(*by).agg(*[count(v, d).alias(n) for n, v, d in names])
    ma, ms, mr, ba, bs, br = (F.col(x) for x in ("malicious_accept", "malicious_sanitize", "malicious_reject", "benign_accept", "benign_sanitize", "benign_reject"))
    return out.withColumns({"flag_precision": ratio(ms + mr, ms + mr + bs + br), "flag_recall": ratio(ms + mr, ma + ms + mr), "block_precision": ratio(mr, mr + br), "block_recall": ratio(mr, ma + ms + mr)})


def index_quantiles(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """p50 (element n // 2), p95 (element int(0.95 n) - 1, at least the first) and max, by exact place in order.

    Values are counted first, so running sums go over distinct values.
    """
    counts = df.where(_c(value).isNotNull()).groupBy(*by, _c(value).alias("v")).agg(F.count("*").alias("c"))
    placed = running_sums(counts, F.col("v"), {"hi": "c"}, by).withColumnRenamed("hi_all", "n")
    at = lambda k: F.min(F.when(F.col("hi") > k, F.col("v")))
    n = F.col("n")
    return placed.groupBy(*by).agg(at(F.floor(n / 2)).alias("p50"), at(F.greatest(F.lit(0), F.floor(n * 95 / 100) - 1)).alias("p95"), F.max("v").alias("max"), F.max("n").alias("n"))


def predicted_class(logits) -> Column:
    """The index of the largest value of an array (the first of equals)."""
    return (F.array_position(_c(logits), F.array_max(_c(logits))) - 1).cast("int")
