"""Shared pieces: intermediate tables in the shared folder, and word arrays over Arrow text buffers."""

from __future__ import annotations

import atexit
import math
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: A word is a maximal run of characters other than space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"

_written: list[tuple[SparkSession, str]] = []


# --------------------------------------------------------------- intermediate tables
def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where that is unset (tests in local mode) a folder is made and set.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        told = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = told.get() if told.isDefined() else None
    if not at:
        at = tempfile.mkdtemp(prefix="tidegate-")
        spark.sparkContext.setCheckpointDir(at)
    return at


def table(df: DataFrame, name: str) -> DataFrame:
    """Write df into the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidegate-{uuid.uuid4().hex}-{name}"
    if not _written:
        atexit.register(release)
    _written.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Delete every table that table() wrote; results that still read them must be consumed first."""
    while _written:
        spark, path = _written.pop()
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001  the session may be gone at exit
            return


def input_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of df's size, from file sizes for scans."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def parts_for(df: DataFrame, bytes_each: int = 32 << 20) -> int:
    """A number of partitions in proportion to df's input, at least the session's."""
    asked = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = input_bytes(df)
    return max(asked, min(1_000_000, math.ceil(size / bytes_each))) if size < 1 << 60 else asked


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def n_words(text) -> F.col:
    """Words in a text column; null: 0.  JVM only."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


# --------------------------------------------------------------- words over Arrow buffers
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_MULT = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.ones(1024, np.uint64)
with np.errstate(over="ignore"):
    for _k in range(1, len(_POWERS)):
        _POWERS[_k] = _POWERS[_k - 1] * _MULT


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def text_slices(column: pa.Array, most_bytes: int = 1 << 20):
    """(first row, offsets, bytes) for runs of rows of about most_bytes; a longer text comes alone. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most_bytes, "right")) - 1)
        yield at, offsets[at : to + 1] - offsets[at], data[offsets[at] : offsets[to]]
        at = to


def words(offsets: np.ndarray, data: np.ndarray, lower: bool = False):
    """Words of several texts laid end to end.

    Returns (hash of each word, bounds): bounds[i]:bounds[i+1] are the words of
    text i.  Hashes are 64-bit values of the word's bytes; with lower, A-Z count
    as a-z.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    solid = ~SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[cuts < n]
    first[cuts] = solid[cuts]
    starts = np.flatnonzero(first)
    bounds = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), bounds
    kept = np.flatnonzero(solid)
    begin = np.searchsorted(kept, starts)
    length = np.diff(np.append(begin, len(kept)))
    place = np.arange(len(kept)) - np.repeat(begin, length)
    with np.errstate(over="ignore"):
        value = (_BYTE_LOWER if lower else _BYTE)[data[kept]]
        if int(length.max()) <= len(_POWERS):
            value *= _POWERS[place]
        else:  # a power for every place of the longest word
            power = np.full(int(length.max()), _MULT, np.uint64)
            power[0] = 1
            value *= np.multiply.accumulate(power)[place]
        return mix(np.add.reduceat(value, begin) + length.astype(np.uint64)), bounds


def grams(word: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive words: len(word) - k + 1 values (none if fewer)."""
    n = len(word) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(n, np.uint64)
        for i in range(k):
            out = out * _MULT + word[i : i + n]
        return mix(out)
