"""Dataset work: standard texts, content keys, leak-free splits, conflicts, balance, samples and reports.

Random choices are functions of (seed, key), so reruns agree and no task needs a
global order: ranks are taken within cells of the seeded order.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed
from ..functions.text import _c, content_key, strip


# ------------------------------------------------------------------ standard texts
def pdf_text(intent, context) -> Column:
    i, c = strip(F.coalesce(_c(intent), F.lit(""))), strip(F.coalesce(_c(context), F.lit("")))
    return strip(F.when(i != "", F.concat(F.lit(f"{fixed.PDF_INTENT} "), i, F.lit(f" {fixed.PDF_CONTENT} "), c)).otherwise(F.concat(F.lit(f"{fixed.PDF_CONTENT} "), c)))


def web_text(text) -> Column:
    return strip(F.concat(F.lit(f"{fixed.WEB_CONTENT} "), _c(text)))


def image_text(extracted) -> Column:
    x = strip(F.coalesce(_c(extracted), F.lit("")))
    return F.when(x != "", F.concat(F.lit(f"{fixed.IMAGE_CONTENT} "), x)).otherwise(fixed.IMAGE_CONTENT)


def strip_prefix(text) -> Column:
    """Without one leading domain prefix, whatever its case."""
    return strip(F.regexp_replace(F.coalesce(_c(text), F.lit("")), r"(?U)(?i)^\s*(Image content|Web content|Document content):\s*", ""))


def split_pdf(text) -> Column:
    """struct of intent (null if none) and body of a PDF's standard text."""
    pattern = r"(?s)(?U)^\s*User intent:\s*(.*?)\s*Document content:\s*(.*)$"
    x = F.coalesce(_c(text), F.lit(""))
    fits = F.regexp_like(x, F.lit(pattern))
    return F.struct(
        F.when(fits, F.nullif(strip(F.regexp_extract(x, pattern, 1)), F.lit(""))).alias("intent"),
        F.when(fits, strip(F.regexp_extract(x, pattern, 2))).otherwise(strip_prefix(x)).alias("body"),
    )


def label_from_path(path) -> Column:
    """0 under a benign folder, 1 under a malicious one, -1 otherwise."""
    parts = F.transform(F.split(_c(path), "/"), F.lower)
    return F.when(F.array_contains(parts, "benign"), 0).when(F.array_contains(parts, "malicious"), 1).otherwise(-1)


def record_context(domain, text, extracted=None, ocr_status=None) -> Column:
    """struct of intent, content and has_text of a record."""
    d, pdf = _c(domain), split_pdf(text)
    none = F.lit(None).cast("string")
    words = strip(F.coalesce(_c(extracted) if extracted is not None else none, F.lit("")))
    status = _c(ocr_status) if ocr_status is not None else none
    readable = (words != "") & (status.isNull() | (status == "text_found"))
    content = F.when(d == "image", F.when(readable, words)).when(d == "pdf", pdf["body"]).otherwise(strip_prefix(text))
    return F.struct(F.when(d == "pdf", pdf["intent"]).alias("intent"), F.nullif(content, F.lit("")).alias("content"), F.when(d == "image", readable).otherwise(F.coalesce(content, F.lit("")) != "").alias("has_text"))


def drop_reason(domain, text, extracted=None, ocr_status=None) -> Column:
    """Why the combined set leaves a record out, or null."""
    t = strip(F.coalesce(_c(text), F.lit("")))
    none = F.lit(None).cast("string")
    words = strip(F.coalesce(_c(extracted) if extracted is not None else none, F.lit("")))
    status = F.coalesce(_c(ocr_status) if ocr_status is not None else none, F.lit(""))
    empty_image = (_c(domain) == "image") & ((status == "no_text") | (words == "") | t.isin(fixed.IMAGE_CONTENT, fixed.IMAGE_CONTENT.rstrip(":")))
    return F.when(empty_image, "empty_ocr_text").when(t == "", "empty_text")


# ------------------------------------------------------------------ seeded order
def lot(seed: int, *keys) -> Column:
    """A row's place in the seeded order."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *[_c(k).cast("string") for k in keys]), 256)


def seeded_rank(df: DataFrame, by: Sequence[str], key: str, seed: int, name: str = "rank") -> DataFrame:
    """df with each row's place (from 1) in the seeded order of its group.

    A group is counted in 4,096 cells of the order and rows are ranked within
    their cell, so a group with a third of all rows is no single task.
    """
    keyed = df.withColumn("_lot", lot(seed, key)).withColumn("_cell", F.substring("_lot", 1, 3))
    counts = keyed.groupBy(*by, "_cell").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*by, "_cell").orderBy("_lot", key)
    on = reduce(lambda a, b: a & b, [keyed[c].eqNullSafe(starts[c]) for c in (*by, "_cell")])
    met = keyed.join(starts, on).select(keyed["*"], starts["_start"])
    return met.withColumn(name, F.col("_start") + F.row_number().over(inside)).drop("_lot", "_cell", "_start")


def seeded_shuffle(df: DataFrame, key: str, seed: int) -> DataFrame:
    return df.orderBy(lot(seed, key), key)


def group_split(records: DataFrame, seed: int = 42, key: str = "sha256", label: str = "label", order: str = "line") -> DataFrame:
    """key, label, split of each different content: 80/10/10 within each label, so equal contents never part.

    A content's label is that of its first record.  The join back is an equi-join on the key.
    """
    contents = records.groupBy(key).agg(F.min_by(label, order).alias(label))
    sizes = contents.groupBy(label).agg(F.count("*").alias("_size"))
    ranked = seeded_rank(contents, [label], key, seed).join(F.broadcast(sizes), label)  # one row per label
    train, both = F.bround(F.col("_size") * 0.8), F.bround(F.col("_size") * 0.9)
    return ranked.select(key, label, F.when(F.col("rank") <= train, "train").when(F.col("rank") <= both, "validation").otherwise("test").alias("split"))


def assign_split(records: DataFrame, splits: DataFrame, key: str = "sha256") -> DataFrame:
    return records.join(splits.select(key, "split"), key)


def remove_conflicts(records: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    """Without the texts that occur with more than one label; texts are compared by hash, so the shuffle carries no texts twice."""
    keyed = records.withColumn("_k", content_key(text))
    bad = keyed.groupBy("_k").agg(F.min(label).alias("lo"), F.max(label).alias("hi")).where("lo <> hi").select("_k")
    return keyed.join(bad, "_k", "left_anti").drop("_k")


def conflict_audit(records: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    each = records.groupBy(content_key(text).alias("k")).agg(F.count("*").alias("n"), (F.min(label) != F.max(label)).alias("bad"))
    return each.agg(F.count_if("bad").alias("conflicting_texts"), F.coalesce(F.sum(F.when(F.col("bad"), F.col("n"))), F.lit(0)).alias("dropped_records"))


def balance_classes(records: DataFrame, by: str = "domain", label: str = "label", key: str = "doc_id", most: int | None = None, seed: int = 42) -> DataFrame:
    """As many benign as malicious records in each domain: the smaller class's number, at most `most`."""
    counts = records.groupBy(by).agg(F.least(F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1), F.lit(most if most is not None else 2**62)).alias("_each"))
    ranked = seeded_rank(records.where(F.col(label).isin(0, 1)), [by, label], key, seed)
    return ranked.join(counts, by).where(F.col("rank") <= F.col("_each")).drop("rank", "_each")


def balance_audit(records: DataFrame, by: str = "domain", label: str = "label", most: int | None = None) -> DataFrame:
    b, m = F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)
    each = F.least(b, m, F.lit(most if most is not None else 2**62))
    return records.groupBy(by).agg(b.alias("original_benign"), m.alias("original_malicious"), each.alias("balanced_per_class"), (2 * each).alias("total_balanced"))


def stratified_subset(records: DataFrame, size: int, label: str = "label", key: str = "doc_id", seed: int = 42) -> DataFrame:
    """`size` records in the labels' proportions by largest remainders; all, if there are no more."""
    counts = records.groupBy(label).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    share = counts.crossJoin(F.broadcast(total)).withColumn("exact", F.col("n") * F.lit(size) / F.col("total")).withColumn("base", F.floor("exact"))
    spare = share.agg((F.lit(size) - F.sum("base")).alias("spare"))
    order = Window.orderBy(F.desc(F.col("exact") - F.col("base")), label)
    quota = share.withColumn("r", F.row_number().over(order)).crossJoin(F.broadcast(spare)).select(label, F.when(F.col("total") <= size, F.col("n")).otherwise(F.col("base") + (F.col("r") <= F.col("spare")).cast("int")).alias("quota"))
    return seeded_rank(records, [label], key, seed).join(F.broadcast(quota), label).where(F.col("rank") <= F.col("quota")).drop("rank", "quota")


def papers_split(papers: DataFrame, category: str = "category", key: str = "paper", seed: int = 42) -> DataFrame:
    """70/15/15 within each category, at least one each for validation and test (halves round to even)."""
    sizes = papers.groupBy(category).agg(F.greatest(F.lit(1), F.bround(F.count("*") * 0.15)).cast("long").alias("k"))
    ranked = seeded_rank(papers, [category], key, seed).join(sizes, category)
    return ranked.withColumn("split", F.when(F.col("rank") <= F.col("k"), "validation").when(F.col("rank") <= 2 * F.col("k"), "test").otherwise("train")).drop("rank", "k")


# ------------------------------------------------------------------ reports
def duplicate_summary(records: DataFrame, key: str = "sha256") -> DataFrame:
    each = records.groupBy(key).agg(F.count("*").alias("n"))
    return each.agg(F.count("*").alias("unique_groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count_if(F.col("n") > 1).alias("duplicate_groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_copies"))


def value_counts(records: DataFrame, column: str) -> DataFrame:
    return records.groupBy(column).agg(F.count("*").alias("n"))


def split_label_stats(records: DataFrame, *by: str, label: str = "label") -> DataFrame:
    return records.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(F.col(label) == 0).alias("benign"), F.count_if(F.col(label) == 1).alias("malicious"))


def leaks(splits: DataFrame, key: str = "sha256", split: str = "split") -> DataFrame:
    """Contents that stand in more than one split; there must be none."""
    return splits.groupBy(key).agg(F.min(split).alias("a"), F.max(split).alias("b")).where("a <> b")


def as_map(counts: DataFrame, key: str, value: str = "n") -> DataFrame:
    """One row with a map, sorted by key; for groups whose number is bounded."""
    return counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value)))).alias("counts"))
