"""Exact top-k search by inner product: an impact-ordered index read score at a time.

Rows are dealt into shards of bounded size.  Each shard keeps, for every
dimension, its postings cut into segments of equal quantised impact.  A query
reads segments from the largest possible gain down and adds exact gains to the
accumulators of the rows met.  After every slice of segments it bounds what each
row can still gain; it stops only when the rows that could still reach the k-th
best exact score are few, and rescores exactly those.  A shard whose bounds never
separate is read to its end, so results never depend on the bounds.

Defined cases: vectors that are null or hold null, NaN or infinite components,
and rows without an id, take no part.  Rows that repeat an id are rows of their
own: each is a candidate, and each is a query where its id is asked for, whose
candidates are all rows but itself.  Vectors of unlike length share their common
dimensions.  Equal scores go to the smaller id.  Scaled components and scores are
64-bit integers: components from 2^53 on saturate, and sums beyond 2^63 wrap.
Other columns are ignored, whatever their names.  An empty table gives an empty
result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import table

#: Rows in a shard and queries in a block: the bounds on what one task holds.
SHARD_ROWS, QUERY_ROWS = 16_384, 4_096
LEVELS, CHECKS, SEEN_BITS = 16, 16, 12


class ImpactIndex:
    """Segments of one shard: rows x dimensions of int64."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, levels: int = LEVELS, rows: np.ndarray | None = None):
        self.ids, self.values, self.rows = ids, values, ids if rows is None else rows
        n, dims = values.shape
        self.order = np.argsort(values, axis=0, kind="stable").T.copy()  # by dimension
        self.sorted = np.take_along_axis(values, self.order.T, axis=0).T
        self.low, self.high = self.sorted[:, 0], self.sorted[:, -1]
        self.largest = float(np.abs(values).max(initial=0))
        self.small = self.largest < 2**52
        self.floats = values.astype(np.float64) if self.small else None
        lo, hi, dim = [], [], []
        for d in range(dims):
            step = max(1, -(-(int(self.high[d]) - int(self.low[d]) + 1) // levels))
            cut = np.unique(np.searchsorted(self.sorted[d], int(self.low[d]) + step * np.arange(1, levels)))
            cut = np.unique(np.concatenate(([0], cut, [n])))
            lo.append(cut[:-1]), hi.append(cut[1:]), dim.append(np.full(len(cut) - 1, d))
        self.lo, self.hi, self.dim = map(np.concatenate, (lo, hi, dim))
        self.least, self.most = self.sorted[self.dim, self.lo], self.sorted[self.dim, self.hi - 1]

    def _exact(self, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Inner products; in floating point where that is exact."""
        if self.small and float(np.abs(query).max(initial=0)) * self.largest * len(query) < 2**53:
            return (self.floats[rows] @ query.astype(np.float64)).astype(np.int64)
        return self.values[rows] @ query

    def search(self, query: np.ndarray, own_row, k: int):
        """(ids, scores) of the k best rows other than own_row, best first."""
        n, dims = self.values.shape
        floor = np.where(query >= 0, query * self.low, query * self.high)  # least that a dimension adds
        q = query[self.dim]
        impact = np.where(q >= 0, q * self.most, q * self.least) - floor[self.dim]
        use = np.flatnonzero(impact > 0)
        use = use[np.argsort(-impact[use], kind="stable")]
        packed = np.zeros(n)
        own = self.rows == own_row
        base = int(floor.sum())
        length = self.hi - self.lo
        postings, read = int(length[use].sum()), 0
        every = max(1, -(-len(use) // CHECKS))
        maybe = np.flatnonzero(~own)
        if dims >= 1 << SEEN_BITS or float(impact[use].sum()) >= 2 ** (52 - SEEN_BITS):
            use = use[:0]  # sums would not be exact: every row is a possible member
        for at in range(0, len(use), every):
            now = use[at : at + every]
            rows = np.concatenate([self.order[d, a:b] for d, a, b in zip(self.dim[now], self.lo[now], self.hi[now], strict=True)])
            value = np.concatenate([self.sorted[d, a:b] for d, a, b in zip(self.dim[now], self.lo[now], self.hi[now], strict=True)])
            each = length[now]
            value = value * np.repeat(q[now], each) - np.repeat(floor[self.dim[now]], each)
            packed += np.bincount(rows, value * (1 << SEEN_BITS) + 1, n)  # gains and the number of dimensions seen
            read += len(rows)
            whole = packed.astype(np.int64)
            gain, seen = whole >> SEEN_BITS, whole & ((1 << SEEN_BITS) - 1)
            rest = np.zeros(dims, np.int64)
            left = use[at + every :]
            np.maximum.at(rest, self.dim[left], impact[left])
            still = np.concatenate(([0], np.cumsum(-np.sort(-rest))))
            bound = base + gain + still[dims - seen]
            bound[own] = np.iinfo(np.int64).min
            pool = np.argpartition(-bound, 4 * k)[: 4 * k] if n > 4 * k else np.arange(n)
            pool = pool[~own[pool]]
            if len(pool) < k:
                continue
            kth = np.sort(self._exact(pool, query))[-k]
            maybe = np.flatnonzero((bound >= kth) & ~own)
            if len(maybe) * dims <= postings - read:  # proof: no other row can be among the k best, and these cost less than reading on
                break
        score = self._exact(maybe, query)
        best = np.lexsort((self.ids[maybe], -score))[:k]
        return self.ids[maybe][best], score[best]


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    out = np.zeros((len(column), dims), np.int64)
    at = 0
    for chunk in column.chunks:
        length = np.diff(chunk.offsets.to_numpy())
        row = np.repeat(np.arange(len(length)), length)
        place = np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)
        out[at + row, place] = chunk.flatten().to_numpy(zero_copy_only=False)
        at += len(chunk)
    return out


def _dims(column: pa.ChunkedArray) -> int:
    return max((int(np.diff(c.offsets.to_numpy()).max()) for c in column.chunks if len(c)), default=0)


def top_k(rows: DataFrame, id_col: str, vector_col: str, queries, k: int = 10, scale: int = 1024) -> DataFrame:
    """query_id, rank (from 1), id, score: the k best other rows of every row for which `queries` (a Column over the id) holds.

    Scores are inner products of floor(scale * component).
    """
    x = F.col(vector_col)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    base = (
        rows.where(x.isNotNull() & F.col(id_col).isNotNull() & ~F.coalesce(bad, F.lit(False)))
        .select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v.cast("double"))).alias("v"))
    )
    base = table(base.withColumn("row", F.monotonically_increasing_id()), "vectors")  # numbered once, read by both sides
    n = base.count()
    shards = max(1, math.ceil(n / SHARD_ROWS))
    asked = base.where(queries(F.col("id")))
    blocks = max(1, math.ceil(asked.count() / QUERY_ROWS))
    spread = lambda m, seed: F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(m)).cast("int")
    placed = base.withColumn("shard", spread(shards, 1)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    posed = asked.withColumn("block", spread(blocks, 2)).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def answer(own: pa.Table, posed: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if own.num_rows and posed.num_rows:
            dims = max(_dims(own["v"]), _dims(posed["v"]), 1)
            index = ImpactIndex(own["id"].to_numpy(), _matrix(own["v"], dims), rows=own["row"].to_numpy())
            for q, row, vector in zip(posed["id"].to_pylist(), posed["row"].to_pylist(), _matrix(posed["v"], dims), strict=True):
                ids, scores = index.search(vector, row, k)
                found.append((np.full(len(ids), q), np.full(len(ids), row), ids, scores))
        cols = [np.concatenate(c) if found else np.zeros(0, np.int64) for c in (zip(*found) if found else [()] * 4)]
        names = ["query_id", "query_row", "id", "score"]
        return pa.table(dict(zip(names, cols, strict=True)), schema=pa.schema([(c, pa.int64()) for c in names]))

    local = placed.groupBy("shard", "block").cogroup(posed.groupBy("shard", "block")).applyInArrow(answer, "query_id long, query_row long, id long, score long")
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "id")
    return local.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
