"""Near duplicates among embeddings: random-hyperplane signs, exact cosine, connected components.

Identical vectors form one class, so copies cost one comparison.  Classes fall
into buckets by the signs of `bits` random hyperplanes, in several tables; the
bits grow with the logarithm of the number of classes, so a bucket of unrelated
vectors keeps its size, and the number of tables follows from the miss
probability asked for at the threshold.  A bucket above BLOCK rows is cut into
blocks, and every pair of blocks is one group, so no task holds a large bucket.
Within a group all cosines come from one matrix product in double precision; a
pair that meets in several tables counts in the first.  Only counts and a
spanning set of links leave a group, never all its pairs.

Defined cases: vectors that are null, empty, zero or hold null, NaN or infinite
components link with nothing, nor do rows without an id (component null); vectors
of unlike length never link; rows that share an id are one node, and each counts
the links of its own vector; other columns are not carried on, whatever their
names; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import table
from .graph import connected_components

BLOCK, BUCKET = 1_024, 256


def plan_tables(classes: int, threshold: float, miss: float) -> tuple[int, int]:
    """(bits, tables): buckets of about BUCKET unrelated vectors, and a pair at the threshold missed with probability `miss`."""
    bits = min(62, max(4, math.ceil(math.log2(max(2, classes) / BUCKET))))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log1p(-same)))


def _packed(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and the vector's bytes as doubles (null where it takes no part)."""

    def pack(batches):
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            offsets = column.offsets.to_numpy()
            flat = np.asarray(column.values.to_numpy(zero_copy_only=False), np.float64)
            out = []
            for ok, a, b in zip(column.is_valid().to_pylist(), offsets[:-1], offsets[1:], strict=True):
                v = flat[a:b]
                size = float(np.abs(v).max()) if ok and b > a else 0.0
                out.append(v.tobytes() if math.isfinite(size) and size > 0 else None)
            yield pa.record_batch([ids, pa.array(out, pa.binary())], names=["id", "vec"])

    kind = df.schema[vector_col].dataType.elementType
    vector = F.col(vector_col) if kind.typeName() == "double" else F.transform(vector_col, lambda v: v.cast("double"))
    return df.select(F.col(id_col).cast("long").alias("id"), vector.alias("v")).mapInArrow(pack, "id long, vec binary")


def near_duplicates(df: DataFrame, id_col: str, vector_col: str, threshold: float = 0.9, miss: float = 1e-3, seed: int = 11) -> DataFrame:
    """id, n_links, component_id, kept for every row."""
    rows = table(_packed(df, id_col, vector_col), "vectors")
    able = rows.where("id is not null and vec is not null")
    classes = table(able.groupBy("vec").agg(F.min("id").alias("least"), F.count("*").alias("m")).withColumn("rep", F.monotonically_increasing_id()), "classes")
    bits, tables = plan_tables(classes.count(), threshold, miss)

    def sign(batches):
        planes: dict[int, np.ndarray] = {}
        power = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            codes = []
            for raw in batch.column("vec").to_pylist():
                v = np.frombuffer(raw)
                if len(v) not in planes:
                    planes[len(v)] = np.random.default_rng([seed, len(v)]).standard_normal((len(v), tables * bits))
                codes.append((((v / np.abs(v).max()) @ planes[len(v)] > 0).reshape(tables, bits) @ power))
            flat = np.concatenate(codes) if codes else np.zeros(0, np.int64)
            listed = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, tables), pa.int32()), pa.array(flat, pa.int64()))
            yield pa.record_batch([batch.column("vec"), batch.column("rep"), batch.column("m"), listed], names=["vec", "rep", "m", "codes"])

    signed = table(classes.mapInArrow(sign, "vec binary, rep long, m long, codes array<long>"), "signed")
    placed = signed.select("*", F.posexplode("codes").alias("t", "code"), F.length("vec").alias("dim"))
    key = ["dim", "t", "code"]
    full = placed.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    met = placed.join(full, key).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    met = met.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))

    schema = pa.schema([("rep", pa.int64()), ("n", pa.int64()), ("root", pa.int64())])

    def compare(key, group):
        t = key[1].as_py()
        i, j = key[3].as_py(), key[4].as_py()
        group = group.combine_chunks()
        rep, m, side = (group[c].to_numpy() for c in ("rep", "m", "own"))
        x = np.frombuffer(b"".join(group["vec"].to_pylist())).reshape(len(rep), -1)
        x = x / np.abs(x).max(axis=1, keepdims=True)
        x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
        codes = group["codes"].chunk(0).flatten().to_numpy().reshape(len(rep), -1)
        left, right = np.flatnonzero(side == i), np.flatnonzero(side == j)
        near = x[left] @ x[right].T >= threshold
        if i == j:
            near = np.triu(near, 1)
        a, b = np.nonzero(near)
        a, b = left[a], right[b]
        new = np.ones(len(a), bool)
        for s in range(t):  # met before, in an earlier table
            new &= codes[a, s] != codes[b, s]
        a, b = a[new], b[new]
        n = np.bincount(a, m[b], len(rep)).astype(np.int64) + np.bincount(b, m[a], len(rep)).astype(np.int64)
        root = rep.copy()
        while len(a):  # smallest rep that these links reach
            least = root.copy()
            np.minimum.at(least, a, root[b])
            np.minimum.at(least, b, root[a])
            if (least == root).all():
                break
            root = least
        use = n > 0
        return pa.table({"rep": rep[use], "n": n[use], "root": root[use]}, schema=schema)

    found = met.select(*key, "i", "j", "own", "vec", "rep", "m", "codes").groupBy(*key, "i", "j").applyInArrow(compare, "rep long, n long, root long")
    found = table(found, "found")
    members = table(able.join(classes.select("vec", "rep"), "vec").select("id", "rep"), "members")
    # rows that share an id but not a vector: their classes are one node
    several = members.groupBy("id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high").select("id", "low")
    shared = members.join(several, "id").where("low < rep").select("rep", F.col("low").alias("root"))
    groups = connected_components(found.select("rep", "root").unionByName(shared), "rep", "root")
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    named = classes.select("rep", "least", "m").join(groups, F.col("rep") == F.col("node"), "left").select("rep", "least", "m", F.coalesce("component", "rep").alias("g"))
    smallest = named.groupBy("g").agg(F.min("least").alias("component"))
    known = named.join(smallest, "g").join(counts, "rep", "left").select("rep", (F.col("m") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component")
    alone = rows.where("id is null or vec is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    linked = members.join(known, "rep").select("id", "n_links", F.col("component").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
