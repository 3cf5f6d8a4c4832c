"""Detectors: signatures, instruction cues, stand-in scorers, lexical embeddings and alignment."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from . import fixed, scan
from .text import _c, any_of


def noisy_or(scores) -> Column:
    """1 - product(1 - x) over an array; 0 for an empty one."""
    return 1 - F.aggregate(_c(scores), F.lit(1.0), lambda p, x: p * (1 - x))


def signature_hits(text, signatures=fixed.SIGNATURES, normalise: bool = True, folded: bool = False) -> Column:
    """array of (id, category, severity, match): the first match of each signature that fires, in the folded text."""
    return scan.hits_column(_c(text), tuple(signatures), not folded, normalise)


def signature_score(text, signatures=fixed.SIGNATURES, normalise: bool = True, folded: bool = False) -> Column:
    """Noisy-or of the severities that fire; 0 if none does.  folded: the text has been folded."""
    return scan.score_column(_c(text), tuple(signatures), not folded, normalise)


def signatures_found(text, signatures=fixed.SIGNATURES, normalise: bool = True, folded: bool = False) -> Column:
    """array of (id, severity) of the signatures that fire, in one reading of the text; ids and score follow from it."""
    return scan.found_column(_c(text), tuple(signatures), not folded, normalise)


def signature_ids(text, signatures=fixed.SIGNATURES, normalise: bool = True, folded: bool = False) -> Column:
    return F.transform(signatures_found(text, signatures, normalise, folded), lambda x: x["id"])


def categories(hits) -> Column:
    return F.array_sort(F.array_distinct(F.transform(_c(hits), lambda h: h["category"])))


def signature_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, c, s, d) for i, c, s, _, d in fixed.SIGNATURES], "id string, category string, severity double, description string")


def instruction_cues(text, normalise: bool = True) -> Column:
    """Names of the cues in a text; empty: it doesn't read like an instruction."""
    return scan.cues_column(_c(text), True, normalise)


# ------------------------------------------------------------------ scorers: name -> column of P(malicious)
ATTACK_WORDS = "ignore all previous instructions|reveal your system prompt|exfiltrate|you are now"
HEDGE_WORDS = "instructions|override"


def keyword_score(text) -> Column:
    """Stand-in text model: attack words 0.97, hedge words 0.55, else 0.03."""
    x = F.lower(_c(text))
    return F.when(_c(text).isNull(), None).when(any_of(x, ATTACK_WORDS), 0.97).when(any_of(x, HEDGE_WORDS), 0.55).otherwise(0.03)


def hash_score(value, salt: str = "") -> Column:
    """Stand-in score in [0, 1], a function of the value alone, on a grid of thousandths."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), _c(value).cast("string"))), 1, 8), 16, 10).cast("long") % 1001 / 1000.0


SCORERS: dict[str, Callable[..., Column]] = {"keyword": keyword_score, "hash": hash_score}
#: Scorers that are plain column expressions: they run inside higher-order functions, without rows of windows.
IN_ROW = {"keyword", "hash"}


def register_scorer(name: str, build: Callable[..., Column]) -> None:
    """Add a scorer: a function from a text column to a probability column, such as an iterator pandas UDF around a model."""
    SCORERS[name] = build


def score_distinct(df: DataFrame, text_col: str, out_col: str, scorer: str = "keyword") -> DataFrame:
    """df with a score of each text; every different text is scored once, however often it occurs."""
    keyed = df.withColumn("_digest", F.coalesce(F.sha2(text_col, 256), F.lit("")))
    scored = keyed.groupBy("_digest").agg(F.first(text_col).alias("_text")).select("_digest", SCORERS[scorer](F.col("_text")).alias(out_col))
    return keyed.join(scored, "_digest", "left").drop("_digest")


# ------------------------------------------------------------------ embeddings
EMBED_DIMS = 2048
_TOKENS = r"[a-z0-9]+"


@lru_cache(200_000)
def _slots(word: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and weights of what a word adds: itself, and its pieces of four letters with # at either end."""
    if word in fixed.STOP_WORDS:
        return np.zeros(0, np.uint64), np.zeros(0)
    pieces = [f"#{word}#"[i : i + 4] for i in range(len(word) - 1)]
    names = [f"w:{word}", *map("c:{}".format, pieces)]
    hashes = np.frombuffer(b"".join(hashlib.blake2b(n.encode(), digest_size=8).digest() for n in names), ">u8").astype(np.uint64)
    return hashes, np.array([1.0] + [0.5] * len(pieces))


def lexical_vectors(texts: pd.Series, dims: int = EMBED_DIMS) -> np.ndarray:
    """Signed feature hashing of words and four-letter pieces, a row of length 1 for each text (zero without words).

    The words of a batch are one column, and each different one is hashed once.
    """
    words = texts.reset_index(drop=True).fillna("").str.lower().str.findall(_TOKENS).explode().dropna()
    text = words.index.to_numpy()
    code, names = pd.factorize(words)
    made = [_slots(w) for w in names]
    size = np.array([len(h) for h, _ in made], np.int64)
    start = np.cumsum(size) - size
    hashes = np.concatenate([h for h, _ in made] or [np.zeros(0, np.uint64)])
    signed = np.concatenate([w for _, w in made] or [np.zeros(0)]) * np.where(hashes >> np.uint64(63), 1.0, -1.0)
    slot = (hashes % np.uint64(dims)).astype(np.int64)
    times = size[code]
    feature = np.repeat(start[code] - np.cumsum(times) + times, times) + np.arange(int(times.sum()))
    out = np.bincount(np.repeat(text, times) * dims + slot[feature], signed[feature], len(texts) * dims).reshape(len(texts), dims).astype(np.float32)
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, length, out=out, where=length > 0)


@F.pandas_udf(T.ArrayType(T.FloatType()))
def lexical_embedding(text: pd.Series) -> pd.Series:
    parts = [lexical_vectors(text.iloc[at : at + 512]) for at in range(0, len(text), 512)]
    return pd.Series([row for part in parts for row in part])


EMBEDDERS: dict[str, Callable[..., Column]] = {"lexical": lexical_embedding}


def register_embedder(name: str, build: Callable[..., Column]) -> None:
    EMBEDDERS[name] = build


def embedder(name: str = "auto") -> Callable[..., Column]:
    """A registered embedder; auto takes a registered sentence model, else the lexical one."""
    return EMBEDDERS[next((n for n in EMBEDDERS if n != "lexical"), "lexical") if name == "auto" else name]


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def rescale(cosine, floor: float = 0.0, ceil: float = 1.0) -> Column:
    return F.when(_c(cosine).isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (_c(cosine) - floor) / (ceil - floor))))


def align(queries: DataFrame, chunk_rows: DataFrame, key: str, how: str = "mean", floor: float = 0.0, ceil: float = 1.0) -> DataFrame:
    """key, alignment, cos_mean, cos_max, cos_min, weakest: unit query vectors (key, q) against unit chunk vectors (key, chunk, v).

    One equi-join on the key; chunk cosines are combined before the shuffle.  A key without chunks has no row.
    """
    met = queries.join(chunk_rows, key).withColumn("cos", dot("q", "v"))
    out = met.groupBy(key).agg(F.avg("cos").alias("cos_mean"), F.max("cos").alias("cos_max"), F.min("cos").alias("cos_min"), F.min_by("chunk", F.struct("cos", "chunk")).alias("weakest"))
    return out.withColumn("alignment", rescale(F.col(f"cos_{how}"), floor, ceil))
