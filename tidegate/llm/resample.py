"""Importance resampling towards a target: hashed features, weights by a target's and the corpus's counts, an exact draw.

Every text becomes an array of buckets of its runs of words.  Counts by bucket (of
the corpus and of the target) give each bucket's gain; a document's weight is the
mean gain over its array, and a seeded Gumbel term turns the k largest scores into
a draw without replacement in proportion to the weights.  Scores are integers, so
an exact histogram of them, summed from above, gives the rank at which each score
begins and the score at which the draw ends; inside a score rows are numbered by id.

What reaches the driver is bounded: counts of `buckets` buckets, and a histogram
whose scores lie within the range that gains and the Gumbel term can take (some
10^5 values, however many documents there are).  All else is JVM expressions.

Defined cases: null and empty texts, and texts without a word, have no feature and
weight 0; an id that is null is hashed as an empty string and comes before all others; rows of one
id are ranked each for itself, in the order of their weights' features; an empty
corpus gives an empty result; an empty target counts 0 everywhere; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import parts_for, table

#: Letters and digits of ASCII and everything beyond it.
WORD_CHARS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def feature_buckets(text: Column, longest: int, buckets: int) -> Column:
    """array<int>: the bucket of every run of 1 to `longest` consecutive words of a text."""
    words = F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(WORD_CHARS), 0)
    bucket = lambda run: (F.crc32(run.cast("binary")) % buckets).cast("int")
    if longest == 1:
        return F.transform(words, bucket)

    def of_length(w, n: int) -> Column:
        starts = F.sequence(F.lit(1), F.size(w) - (n - 1))
        made = F.transform(starts, lambda i: bucket(F.array_join(F.slice(w, i, n), " ")))
        return F.when(F.size(w) >= n, made).otherwise(F.array().cast("array<int>"))

    return F.transform(F.array(words), lambda w: F.concat(*[of_length(w, n) for n in range(1, longest + 1)]))[0]


def bucket_counts(features: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs: summed in every task before it is sent, one row for each bucket on the driver."""
    out = np.zeros(buckets, np.int64)
    for row in features.select(F.explode("features").alias("b")).groupBy("b").count().collect():
        out[row.b] = row["count"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> list[int]:
    """floor(1000 ln) of the target's smoothed frequency of each bucket over the corpus's."""
    s_all, t_all, n = int(corpus.sum()), int(target.sum()), len(corpus)
    return [math.floor(1000 * math.log((t + 1) * (s_all + n) / ((s + 1) * (t_all + n)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)]


def gumbel(id_text: Column, seed: int) -> Column:
    """A document's seeded term: floor(-1000 ln(-ln u)), u in (0, 1) by its id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_text, F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def weigh(docs: DataFrame, target: DataFrame, id_col: str, text_col: str, target_text: str, longest: int, buckets: int, seed: int) -> DataFrame:
    """id, n_features, weight, score of every row.  Texts are read once: their arrays are written, counted and then scored."""
    own = table(docs.select(F.col(id_col).alias("id"), feature_buckets(F.col(text_col), longest, buckets).alias("features")), "features")
    aim = target.select(feature_buckets(F.col(target_text), longest, buckets).alias("features"))
    gain = gains(bucket_counts(own, buckets), bucket_counts(aim, buckets))
    known = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<bigint>")  # one constant, folded before it runs
    total = F.aggregate("features", F.lit(0).cast("long"), lambda acc, b: acc + known[b])
    n = F.size("features").cast("long")
    weight = F.when(n > 0, F.floor(total / n)).otherwise(0).cast("long")
    return own.select("id", n.alias("n_features"), weight.alias("weight"), (weight + gumbel(F.col("id").cast("string"), seed)).cast("long").alias("score"))


def resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text: str = "text",
    longest: int = 1,
    buckets: int = 10_000,
    percent: int = 10,
    least_features: int = 20,
    seed: int = 2024,
) -> DataFrame:
    """id, n_features, weight, score, rank of every row; rank is null where the row isn't drawn.

    Of the rows with at least least_features features, percent % (rounded down)
    with the highest scores are drawn, equal scores in the order of ids.
    """
    scored = table(weigh(docs, target, id_col, text_col, target_text, longest, buckets, seed), "scored")
    may = scored.where(F.col("n_features") >= least_features)
    bars = sorted(((r.score, r["count"]) for r in may.groupBy("score").count().collect()), reverse=True)
    left = want = percent * sum(n for _, n in bars) // 100
    begins: list[tuple[int, int]] = []
    for score, n in bars:
        if left <= 0:
            break
        begins.append((score, want - left))
        left -= n
    drawn_from = begins[-1][0] if begins else None
    may_be = F.lit(False) if drawn_from is None else (F.col("n_features") >= least_features) & (F.col("score") >= drawn_from)
    rest = scored.where(~may_be).withColumn("rank", F.lit(None).cast("long"))
    begin = scored.sparkSession.createDataFrame(begins, "at long, before long")
    # the histogram has a row for each integer in a fixed range, so it is always small enough to send
    top = scored.where(may_be).join(F.broadcast(begin), F.col("score") == F.col("at")).drop("at")
    by_id = Window.partitionBy("score").orderBy(F.col("id").asc_nulls_first(), "n_features", "weight")
    rank = F.col("before") + F.row_number().over(by_id)
    top = top.repartition(parts_for(scored, 8 << 20), "score").withColumn("rank", F.when(rank <= want, rank).cast("long")).drop("before")
    return rest.unionByName(top).withColumnRenamed("id", id_col)
