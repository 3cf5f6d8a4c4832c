"""Distributed connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import table


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def connected_components(links: DataFrame, src: str, dst: str) -> DataFrame:
    """(node, component): every linked node with the smallest node reachable from it.

    links: any rows of two long columns; nulls and self-links are left out, and a
    node without a link to another has no row.  The minimum of each neighbourhood
    is combined before the shuffle; a node with very many links is split by
    adaptive skew joins.  Each round is written to the shared folder, so nothing
    of the graph reaches the driver but a row count and a checksum.
    """
    e = links.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst))).distinct()
    e = table(e, "links")
    mark = _mark(e)
    while mark[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = table(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "stars")
        mark, before = _mark(e), mark
        if mark == before:
            break
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
