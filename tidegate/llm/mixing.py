"""Mixing sources to target weights by capped water-filling.

Every source gets a share of the mix in proportion to its weight, but no more
than max_epochs times its own size.  Sources above that are clamped, and what
they can't take is shared among the others by weight, round after round, until
none is above.  A source then holds `target / size` epochs: all its documents are
repeated a whole number of times, and the fraction that remains goes to documents
in a seeded order until it is used up; the document in which it ends is taken in
part, so that a source's words come to its target to within a word.

Defined cases: null or empty texts have size 0 and are taken 0 times as words; a
null source is a source of its own, the last; very long texts are counted whole
and taken like others; an empty table gives an empty result; repeated doc_ids are
documents of their own, ordered by size, and each comes as often as the most
taken of them; other columns stay as they are in expand_mix whatever their names
(one named like `copies` too), and aren't carried on by mix_sources.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .common import fresh, n_words, table

#: Places of the seeded order into which a source's documents are summed first, and how many of them are summed in one row.
CELLS, ROW = 65_536, 256


def _lot(doc, seed: int):
    """A seeded number below 2^32 for a document."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc.cast("string"), F.lit("")))), 1, 8), 16, 10).cast("long")


def numbered(rows: DataFrame, key: str) -> DataFrame:
    """rows with `place`: 0, 1, ... by code point of a string key, null last; no task sorts more than its range."""
    spark = rows.sparkSession
    ranged = table(rows.withColumn("_null", F.col(key).isNull()).repartitionByRange(F.col("_null"), F.col(key)).sortWithinPartitions("_null", key).withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()), "ranged")
    sizes = sorted((r["_part"], r["n"]) for r in ranged.groupBy("_part").agg(F.count("*").alias("n")).collect())  # a number for each partition
    before, starts = 0, []
    for part, n in sizes:
        starts.append((part, before))
        before += n
    offsets = spark.createDataFrame(starts, "_part int, _start long")
    return ranged.join(F.broadcast(offsets), "_part").withColumn("place", F.col("_start") + F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_row", "_start", "_null")


def water_fill(sources: DataFrame, max_epochs: int) -> DataFrame:
    """sources (source, size, weight) with `target`; each round is one aggregate over the sources.

    A round clamps every source whose share is above its cap, so rounds are few
    even for very many sources; only three sums of a round reach the driver.
    """
    cap = (F.lit(max_epochs) * F.col("size")).cast("double")
    now = sources.withColumn("clamped", F.lit(False))
    total, held = sources.agg(F.sum("size")).first()[0] or 0, -1
    while True:
        sums = now.agg(F.sum(F.when(~F.col("clamped"), F.col("weight"))).alias("w"), F.sum(F.when(F.col("clamped"), F.col("size"))).alias("s"), F.count_if("clamped").alias("n")).first()
        left, weight = float(total - max_epochs * (sums["s"] or 0)), float(sums["w"] or 1)
        share = F.col("weight").cast("double") * F.lit(left) / F.lit(weight)
        if sums["n"] == held:
            return now.withColumn("target", F.when(F.col("clamped"), cap).otherwise(share)).drop("clamped")
        held = sums["n"]
        now = table(now.withColumn("clamped", F.col("clamped") | (share > cap)), "clamped")


def mix_sources(docs: DataFrame, weights=(5, 2, 1), max_epochs: int = 3, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target, taken, copies for every document.

    taken: words the mix takes, repeats counted.  copies: the same in whole
    documents, the one taken in part rounded to the nearer whole number.
    """
    sized = table(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size")), "sizes").withColumn("lot", _lot(F.col("doc_id"), seed))
    stats = sized.groupBy("source").agg(F.sum("size").alias("size"))
    placed = numbered(stats, "source")
    by_turn = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    filled = water_fill(placed.withColumn("weight", by_turn), max_epochs)
    plan = table(
        filled.withColumn("epochs", F.when(F.col("size") > 0, F.col("target") / F.col("size")).otherwise(F.lit(0.0)))
        .withColumn("whole", F.least(F.lit(max_epochs), F.floor("epochs")).cast("long"))
        .withColumn("need", F.round(F.col("target") - F.col("whole") * F.col("size")).cast("long"))
        .select(F.coalesce(F.col("source"), F.lit("")).alias("k"), F.col("source").isNull().alias("nil"), F.col("size").alias("source_size"), "target", "whole", "need"),
        "plan",
    )
    keyed = sized.withColumn("k", F.coalesce(F.col("source"), F.lit(""))).withColumn("nil", F.col("source").isNull()).withColumn("cell", F.floor(F.col("lot") / (2**32 // CELLS)).cast("int"))
    # how many words lie before each cell of a source: those of earlier rows of cells, and those of earlier cells of its row
    cells = keyed.groupBy("k", "nil", "cell").agg(F.sum("size").alias("in_cell")).withColumn("row", F.floor(F.col("cell") / ROW).cast("int"))
    lines = cells.groupBy("k", "nil", "row").agg(F.sum("in_cell").alias("in_row"))
    earlier = lambda key, order, n: F.coalesce(F.sum(n).over(Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lines = lines.select("k", "nil", "row", earlier(["k", "nil"], "row", "in_row").alias("above"))
    cells = cells.withColumn("before", earlier(["k", "nil", "row"], "cell", "in_cell")).join(lines, ["k", "nil", "row"]).join(plan, ["k", "nil"])
    cells = cells.withColumn("before", F.col("before") + F.col("above")).drop("row", "above")
    cells = table(cells.withColumn("cut", (F.col("before") < F.col("need")) & (F.col("before") + F.col("in_cell") > F.col("need"))), "cells")
    met = keyed.join(cells, ["k", "nil", "cell"])
    inside = Window.partitionBy("k", "nil", "cell").orderBy("lot", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    cut = met.where("cut").withColumn("before", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = met.where("not cut").unionByName(cut)
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("need") - F.col("before")))
    return rows.select(
        "doc_id",
        "source",
        F.col("size").cast("long").alias("size"),
        F.col("source_size").cast("long").alias("source_size"),
        F.col("target").cast("double").alias("target"),
        (F.col("whole") * F.col("size") + part).cast("long").alias("taken"),
        (F.col("whole") + F.when(2 * part >= F.greatest(F.col("size"), F.lit(1)), 1).otherwise(0)).cast("int").alias("copies"),
    )


def expand_mix(docs: DataFrame, plan: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents themselves, each as often as plan's `copies` says (rows of one id: the largest); one of no copies goes."""
    i, n, r = (fresh(docs, name) for name in ("mix_id", "mix_n", "mix_r"))
    times = plan.groupBy(F.col("doc_id").alias(i)).agg(F.max("copies").alias(n)).where(F.col(n) > 0)
    met = docs.join(times, F.col(id_col).eqNullSafe(F.col(i)))
    return met.withColumn(r, F.explode(F.sequence(F.lit(1), F.col(n)))).drop(i, n, r)
