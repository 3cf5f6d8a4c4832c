"""Running sums in an order that spans all rows, without a window over all of them.

Rows are dealt by ranges of (group, order) and written with the number of their
range.  Sums by range are small: a row for each range that a group lies in.  Summed
from the first range on they give what comes before each range; inside a range a
window does the rest.  So no task holds more than one range, however large a group
is and however many different values it has.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.tables import cut


def running_sums(df: DataFrame, order: Column, sums: dict[str, str], by: Sequence[str] = ()) -> DataFrame:
    """df with, for each out -> column of `sums`, the column's sum up to and with each row (out), and over the whole group (out_all).

    Rows must differ in (by, order); a null in `by` is a group of its own.  Columns
    _range and those made here must be free; an empty table stays empty.
    """
    placed = cut(df.repartitionByRange(*by, order).withColumn("_range", F.spark_partition_id()), "ranges")
    ranges = placed.groupBy("_range", *by).agg(*[F.sum(c).alias(f"_{out}") for out, c in sums.items()])
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))  # without groups: one row for each range
    earlier = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = ranges.select(
        F.col("_range").alias("_r"), *[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)],
        *[F.coalesce(F.sum(f"_{out}").over(earlier), F.lit(0)).alias(f"_{out}") for out in sums], *[F.sum(f"_{out}").over(group).alias(f"{out}_all") for out in sums],
    )
    same = F.col("_range") == F.col("_r")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    met = placed.join(before, same)
    inside = Window.partitionBy("_range", *by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = met.withColumns({out: F.col(f"_{out}") + F.sum(c).over(inside) for out, c in sums.items()})
    return out.select(*df.columns, *sums, *[f"{out}_all" for out in sums])


def ordered_fold(df: DataFrame, by: str, order: Sequence[str], one: Column, both: Callable[[Column, Column], Column], width: int = 256) -> DataFrame:
    """(by, one): for each group the merged summary of its rows in order, for a merge that is associative but not commutative.

    one: a row's own summary, a struct.  both(earlier, later): the summary of both, of the same type.
    Rows are dealt by ranges of (by, order), so a group with most of the rows is many tasks.
    Summaries merge in a tree: rows in blocks of `width`, blocks in a range, ranges in a group,
    so no list is longer than `width`, a range's blocks, or the number of ranges.
    Rows that agree in (by, order) are taken in the order of their summaries; a null in `by` is
    a group of its own; other columns are ignored; an empty table gives no rows.
    """
    rows = df.select(by, F.struct(*order).alias("_at"), one.alias("_one")).repartitionByRange(by, "_at").withColumn("_range", F.spark_partition_id())
    place = F.row_number().over(Window.partitionBy("_range", by).orderBy("_at", "_one"))
    out = rows.withColumn("_at", place).withColumn("_block", F.floor((F.col("_at") - 1) / width))
    for keys, at in ((("_range", by, "_block"), "_at"), (("_range", by), "_block"), ((by,), "_range")):
        listed = F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), F.col("_one").alias("one"))))
        ones = F.transform(F.col("_listed"), lambda e: e["one"])
        merged = F.aggregate(F.slice(ones, F.lit(2), F.size(ones)), F.element_at(ones, 1), both)
        out = out.groupBy(*keys).agg(listed.alias("_listed")).select(*keys, merged.alias("_one"))
    return out.withColumnRenamed("_one", "one")
