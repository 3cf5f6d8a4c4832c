"""Near duplicates among documents: MinHash bands, sequential Bayesian verification, exact check.

A document's set holds its distinct shingles of `size` words (all its words as
one shingle if it has fewer).  Documents with equal sets form one class, kept by
its smallest id; all later steps work on classes.

Candidates come from bands of the classes' MinHash signatures.  Their signatures
are compared a batch of values at a time; after each batch a pair goes if the
posterior probability that its similarity reaches the threshold, given the
matches so far, is below the miss probability.  What is left is checked exactly,
on full sets computed again from whole texts.

A band's classes are never expanded into rows of pairs.  Each class is compared
with the band's first and last class, and the links found are joined into
components; a band of up to three classes is done then.  In larger bands that
still hold several components, classes of different components are compared
block by block as arrays: the same sequential test on signatures, for each pair
in the first band that it shares, and then exact intersections of full sets by
products of incidence matrices.  Only ids and the links that hold leave a block,
so no link that could join two components is left out.

Defined cases: null or wordless texts have an empty set and link with nothing;
rows that share an id are one node, linked with what any of their texts is near
to; rows without an id link with nothing, their component is null and they are
kept; very long texts are read whole, a set's memory being that of its text;
other columns are not carried on, whatever their names; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import grams, table, text_slices, words
from .graph import connected_components

#: 32 bands of 4 values: a pair at similarity 0.8 shares no band with probability 5e-8.
BANDS, ROWS = 32, 4
#: Signature values compared at a time.
BATCH = 16
#: Classes of a block in large bands, and shingles in all of a block's sets (about 32 MB).
BLOCK, BLOCK_SHINGLES = 512, 4_000_000
#: Ids are sent to every executor only up to this many; beyond it they are joined by shuffle.
SENT_IDS = 1_000_000

_rng = np.random.Generator(np.random.PCG64(7))
_A = (_rng.integers(1, 2**32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1))[:, None]
_B = _rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)[:, None]


def shingle_set(word: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text's words."""
    return np.unique(grams(word, min(size, len(word)))) if len(word) else np.zeros(0, np.uint64)


def _print(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits by which equal sets are known."""
    with np.errstate(over="ignore"):
        return int(shingles.sum()), int((shingles * (shingles >> np.uint64(29) | np.uint64(1))).sum())


def signature(shingles: np.ndarray) -> np.ndarray:
    """MinHash values; the set is read in pieces that stay in cache."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(_A), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 2048):
        np.minimum(out, (_A * x[at : at + 2048] + _B).min(axis=1), out=out)
    return out


def least_matches(threshold: float, miss: float) -> list[int]:
    """For each number of batches compared, the fewest matches with which a pair stays.

    With a uniform prior, P(similarity >= t | m of n match) = P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in range(BATCH, BANDS * ROWS + 1, BATCH):
        below = 0.0
        for m in range(n + 2):
            below += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if below >= miss:
                break
        out.append(m)
    return out


def _sketches(docs: DataFrame, size: int, lower: bool) -> DataFrame:
    """id, n, f1, f2 (128 bits of the set), sig for each row; sig is null for an empty set."""

    def sketch(batches):
        for batch in batches:
            n, f, sigs = [], [], []
            for _, offsets, data in text_slices(batch.column(1)):
                word, bounds = words(offsets, data, lower)
                for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                    s = shingle_set(word[a:b], size)
                    n.append(len(s))
                    f.append(_print(s))
                    sigs.append(signature(s).tobytes() if len(s) else None)
            prints = np.array(f, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(prints[:, 0]), pa.array(prints[:, 1]), pa.array(sigs, pa.binary())], names=["id", "n", "f1", "f2", "sig"])

    return docs.mapInArrow(sketch, "id long, n long, f1 long, f2 long, sig binary")


def _bands(classes: DataFrame) -> DataFrame:
    """rep, key, band and w, the shingles of its set, for every band of every class."""

    def cut(batches):
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, BANDS, ROWS).astype(np.uint64)
            with np.errstate(over="ignore"):
                key = np.arange(BANDS, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
                for r in range(ROWS):
                    key = (key ^ sig[:, :, r]) * np.uint64(0xBF58476D1CE4E5B9)
                    key = key ^ (key >> np.uint64(31))
            rep = np.repeat(batch.column(0).to_numpy(), BANDS)
            band = np.tile(np.arange(BANDS, dtype=np.int32), len(sig))
            w = np.repeat(batch.column(2).to_numpy(), BANDS)
            yield pa.record_batch([pa.array(rep), pa.array(key.ravel().view(np.int64)), pa.array(band), pa.array(w)], names=["rep", "key", "band", "w"])

    return classes.select("rep", "sig", "n").mapInArrow(cut, "rep long, key long, band int, w long")


def _likely(pairs: DataFrame, classes: DataFrame, threshold: float, miss: float) -> DataFrame:
    """Pairs (a, b) whose signatures leave similarity >= threshold probable enough."""
    need = least_matches(threshold, miss)

    def verify(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, BANDS * ROWS) for c in ("sa", "sb"))
            alive, matches = np.arange(len(x)), np.zeros(len(x), np.int64)
            for i, least in enumerate(need):
                part = slice(i * BATCH, (i + 1) * BATCH)
                matches[alive] += (x[alive, part] == y[alive, part]).sum(axis=1)
                alive = alive[matches[alive] >= least]
            yield pa.record_batch([batch.column("a").take(pa.array(alive)), batch.column("b").take(pa.array(alive))], names=["a", "b"])

    sigs = classes.select("rep", "sig")
    met = pairs.join(sigs.select(F.col("rep").alias("a"), F.col("sig").alias("sa")), "a").join(sigs.select(F.col("rep").alias("b"), F.col("sig").alias("sb")), "b")
    return met.select("a", "b", "sa", "sb").mapInArrow(verify, "a long, b long")


def _sets(docs: DataFrame, ids: DataFrame, size: int, lower: bool) -> DataFrame:
    """id, s: full sets of the documents with these ids, made again from whole texts; a set for each different text of an id."""

    def shingled(batches):
        for batch in batches:
            sets = []
            for _, offsets, data in text_slices(batch.column(1)):
                word, bounds = words(offsets, data, lower)
                sets += [shingle_set(word[a:b], size) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            cuts = pa.array(np.cumsum([0, *map(len, sets)]), pa.int32())
            prints = np.array([_print(s) for s in sets], np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.record_batch([batch.column(0), pa.array(prints[:, 0]), pa.array(prints[:, 1]), pa.ListArray.from_arrays(cuts, pa.array(flat))], names=["id", "f1", "f2", "s"])

    ids = table(ids.distinct(), "ids")
    small = ids.count() <= SENT_IDS
    wanted = docs.join(F.broadcast(ids) if small else ids, "id", "left_semi")
    made = wanted.select("id", "text").mapInArrow(shingled, "id long, f1 long, f2 long, s array<long>").where("size(s) > 0")
    return table(made.groupBy("id", "f1", "f2").agg(F.first("s").alias("s")).select("id", "s"), "sets")


def _exact(docs: DataFrame, pairs: DataFrame, size: int, lower: bool, threshold: float) -> DataFrame:
    """The pairs whose full sets reach the threshold."""
    sets = _sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")), size, lower)
    met = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    share = round(threshold * 100)
    return met.withColumn("i", both).where(100 * F.col("i") >= share * (F.size("sa") + F.size("sb") - F.col("i"))).select("a", "b").distinct()


def _sift(rest: DataFrame, classes: DataFrame, threshold: float, miss: float) -> DataFrame:
    """key, i, j, rep, c, own: classes of open bands that some class of another component may still be linked with."""
    need = least_matches(threshold, miss)

    def sift(key, group):
        band = key[1].as_py()
        group = group.combine_chunks()
        rep, comp, own = (group[c].to_numpy() for c in ("rep", "c", "own"))
        sig = np.frombuffer(b"".join(group["sig"].to_pylist()), np.uint32).reshape(len(rep), BANDS * ROWS)
        left, right = np.flatnonzero(own == key[2].as_py()), np.flatnonzero(own == key[3].as_py())
        involved = np.zeros(len(rep), bool)
        for at in range(0, len(left), 64):
            part = left[at : at + 64]
            a, b = np.nonzero(comp[part][:, None] != comp[right][None, :])
            a, b = part[a], right[b]
            if key[2] == key[3]:
                a, b = a[a < b], b[a < b]
            for before in range(band):  # compared in an earlier band
                own_values = slice(before * ROWS, (before + 1) * ROWS)
                new = (sig[a, own_values] != sig[b, own_values]).any(axis=1)
                a, b = a[new], b[new]
            matches = np.zeros(len(a), np.int64)
            for i, least in enumerate(need):
                values = slice(i * BATCH, (i + 1) * BATCH)
                matches += (sig[a, values] == sig[b, values]).sum(axis=1)
                a, b, matches = a[matches >= least], b[matches >= least], matches[matches >= least]
            involved[a] = involved[b] = True
        keep = np.flatnonzero(involved)
        return group.select(["key", "i", "j", "rep", "c", "own"]).take(pa.array(keep))

    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.least("n", F.ceil(F.col("total") / BLOCK_SHINGLES))).cast("int")
    placed = rest.withColumn("own", F.pmod(F.xxhash64("rep"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    placed = placed.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).join(classes.select("rep", "sig"), "rep")
    return placed.select("key", "band", "i", "j", "rep", "c", "own", "sig").groupBy("key", "band", "i", "j").applyInArrow(sift, "key long, i int, j int, rep long, c long, own int")


def _exact_blocks(docs: DataFrame, sifted: DataFrame, size: int, lower: bool, threshold: float) -> DataFrame:
    """(a, b): links between components, from exact intersections of all sets of a block pair."""
    share = round(threshold * 100)

    def meet(key, group):
        group = group.combine_chunks()
        rep, comp, own = (group[c].to_numpy() for c in ("rep", "c", "own"))
        sets = group["s"].combine_chunks()
        sets = sets.chunk(0) if isinstance(sets, pa.ChunkedArray) else sets
        n = np.diff(sets.offsets.to_numpy())
        value, row = sets.flatten().to_numpy(), np.repeat(np.arange(len(rep)), n)
        left, right = np.flatnonzero(own == key[1].as_py()), np.flatnonzero(own == key[2].as_py())
        values, column, times = np.unique(value, return_inverse=True, return_counts=True)
        use = times[column] > 1  # what one set alone holds is in no intersection
        row, column = row[use], column[use]
        both = np.zeros((len(left), len(right)), np.float32)
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        _, column = np.unique(column, return_inverse=True)
        width = int(column[-1]) + 1 if len(column) else 0
        for at in range(0, width, 4096):
            a, b = np.searchsorted(column, [at, at + 4096])
            m = np.zeros((len(rep), min(4096, width - at)), np.float32)
            m[row[a:b], column[a:b] - at] = 1
            both += m[left] @ m[right].T
        either = n[left][:, None] + n[right][None, :] - both
        a, b = np.nonzero((100 * both >= share * either) & (comp[left][:, None] != comp[right][None, :]))
        return pa.table({"a": rep[left[a]], "b": rep[right[b]]})

    sets = _sets(docs, sifted.select(F.col("rep").alias("id")), size, lower).withColumnRenamed("id", "rep")
    return sifted.join(sets, "rep").groupBy("key", "i", "j").applyInArrow(meet, "a long, b long")


def near_duplicates(docs: DataFrame, size: int = 5, threshold: float = 0.8, miss: float = 1e-6, lower: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row; links hold where 100 * |both| >= 100 * threshold * |either|."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketches = table(_sketches(rows, size, lower), "sketches")
    able = sketches.where("id is not null and n > 0")
    classes = table(able.groupBy("n", "f1", "f2").agg(F.min("id").alias("rep"), F.first("sig").alias("sig")), "classes")
    bands = table(_bands(classes), "bands")
    ends = table(bands.groupBy("key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi"), "ends")
    full = table(bands.join(ends, "key"), "full")
    star = full.select(F.col("lo").alias("a"), F.col("rep").alias("b")).unionByName(full.select(F.col("rep").alias("a"), F.col("hi").alias("b"))).where("a < b").distinct()
    star = table(_likely(star, classes, threshold, miss), "likely")
    links = [table(_exact(rows, star, size, lower, threshold), "links")]
    # rows that share an id but not a class: their classes are one node
    own = F.struct("n", "f1", "f2")
    several = table(able.groupBy("id").agg(F.min(own).alias("lo"), F.max(own).alias("hi")).where("lo < hi").select("id"), "several")
    if several.take(1):
        named = table(able.join(several, "id").join(classes.select("n", "f1", "f2", "rep"), ["n", "f1", "f2"]).select("id", "rep").distinct(), "named")
        links.append(named.join(named.groupBy("id").agg(F.min("rep").alias("a")), "id").where("a < rep").select("a", F.col("rep").alias("b")))
    groups = connected_components(reduce(DataFrame.unionByName, links), "a", "b")
    # bands of more than three classes that hold several components
    known = full.select("key", "band", "rep", "w").join(groups, F.col("rep") == F.col("node"), "left").select("key", "band", "rep", "w", F.coalesce("component", "rep").alias("c"))
    open_keys = known.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.count("*").alias("n"), F.sum("w").alias("total")).where("c0 < c1 and n > 3").select("key", "n", "total")
    sifted = table(_sift(known.join(open_keys, "key"), classes, threshold, miss), "sifted")
    if sifted.take(1):
        links.append(table(_exact_blocks(rows, sifted, size, lower, threshold), "more"))
        groups = connected_components(reduce(DataFrame.unionByName, links), "a", "b")
    named = classes.join(groups, F.col("rep") == F.col("node"), "left").select("n", "f1", "f2", F.coalesce("component", "rep").alias("component"))
    mine = able.select("id", "n", "f1", "f2").join(named, ["n", "f1", "f2"]).select("id", "n", F.col("component").alias("component_id"))
    alone = sketches.where("id is null or n = 0").select("id", "n", F.col("id").alias("component_id"))
    out = mine.unionByName(alone)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
