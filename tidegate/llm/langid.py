"""Language identification by hyperdimensional profiles.

Every letter of every script has a random vector of +1 and -1, a function of its
code point.  An n-gram's vector binds (by product) its letters' vectors, each
permuted (by rotation) by its place; a text's
vector bundles (sums) its n-grams' vectors, and a language's prototype bundles
the unit vectors of all labelled texts.  The mean of all prototypes is taken from
each, so that what languages share doesn't count.  A text gets the language whose
prototype has the largest cosine.

Texts are read whole.  Sums over n-grams are matrix products of n-gram counts
with n-gram vectors, so they are exact and don't depend on how texts are cut.
Prototypes are sums as well: each task sends one partial vector per language.

Defined cases: `und` with score 0 for texts that are null or have no letter
(n_letters 0), and for every text where there is nothing to learn from; ties go to
the language first by code point; rows without an id are predicted, never learned
from; rows that repeat are learned from as often as they stand there; very long
texts are read in pieces with the same result; columns named lang_pred, score,
held_out and n_letters are replaced, all others stay as they are whatever their
names; an empty table gives an empty result.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import fresh, mix, text_slices
from .tokencount import code_points

#: Dimensions, letters of an n-gram, and the most languages that may be learned.
DIMS, GRAM, MOST_LANGUAGES = 1_024, 3, 1_000
#: Bytes of text handled at once, n-grams in one matrix product, and numbers of n-grams that are counted in a table.
BYTES, BLOCK, DENSE = 1 << 18, 4_096, 1 << 22


def letter_table() -> np.ndarray:
    """The lower-case letter of every code point: 0 for what is not a letter."""
    out = np.zeros(0x110000, np.int32)
    for point in range(0x110000):
        c = chr(point)
        if unicodedata.category(c)[0] == "L":
            out[point] = ord(c.lower()[0])
    return out


class Profiles:
    """Letter vectors and what is made of them; the same in every process."""

    def __init__(self, seed: int = 5):
        self.seed, self.letters = np.uint64(seed), letter_table()

    def letter_vectors(self, points: np.ndarray) -> np.ndarray:
        """A vector for each code point, from 64-bit hashes of seed, letter and place; the space between words has one as well."""
        with np.errstate(over="ignore"):
            at = (points.astype(np.uint64) << np.uint64(8))[:, None] + np.arange(DIMS // 64, dtype=np.uint64)[None, :]
            bits = np.unpackbits(mix(at * np.uint64(0x9E3779B97F4A7C15) + self.seed).astype("<u8").view(np.uint8), axis=1)
        return (2 * bits.astype(np.int8)) - 1

    def gram_vectors(self, letters: np.ndarray, grams: np.ndarray) -> np.ndarray:
        """Vectors of n-grams given as numbers over these letters."""
        out = np.ones((len(grams), DIMS), np.int8)
        for i in range(GRAM):
            placed = np.roll(letters, GRAM - 1 - i, axis=1)
            out *= placed[grams // len(letters) ** (GRAM - 1 - i) % len(letters)]
        return out.astype(np.float32)

    def bundle(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(vectors, letters) of texts given as UTF-8."""
        bounds, points = code_points(offsets, data)
        n = len(bounds) - 1
        symbol = self.letters[points]
        text = np.repeat(np.arange(n), np.diff(bounds))
        letters = np.bincount(text, symbol > 0, n).astype(np.int64)
        # one space stands for each run of what is not a letter; none is left at a text's end
        keep = np.ones(len(symbol), bool)
        keep[1:] = (symbol[1:] > 0) | (symbol[:-1] > 0)
        keep &= (symbol > 0) | np.append(symbol[1:] > 0, False)
        symbol, text = symbol[keep], text[keep]
        m = len(symbol) - GRAM + 1
        out = np.zeros((n, DIMS), np.float32)
        if m <= 0:
            return out, letters
        # letters of these texts by number
        number = np.zeros(int(symbol.max()) + 1, np.int64)
        number[symbol] = 1
        there = np.flatnonzero(number)
        number[there] = np.arange(len(there))
        symbol, k = number[symbol], len(there)
        vectors = self.letter_vectors(there)
        gram = sum(symbol[i : m + i] * k ** (GRAM - 1 - i) for i in range(GRAM))
        whole = text[:m] == text[GRAM - 1 :]
        gram, text = gram[whole], text[:m][whole]
        if k**GRAM <= DENSE:
            met = np.flatnonzero(np.bincount(gram, minlength=1))
            place = np.zeros(k**GRAM, np.int64)
            place[met] = np.arange(len(met))
            gram = place[gram]
        else:
            met, gram = np.unique(gram, return_inverse=True)
        for at in range(0, len(met), BLOCK):
            part = met[at : at + BLOCK]
            mine = (gram >= at) & (gram < at + len(part))
            counts = np.bincount(text[mine] * len(part) + gram[mine] - at, minlength=n * len(part)).reshape(n, len(part))
            out += counts.astype(np.float32) @ self.gram_vectors(vectors, part)
        return out, letters

    def units(self, column: pa.Array):
        """(first row, unit vectors, letters) of the texts of an Arrow column, in runs."""
        for at, offsets, data in text_slices(column, BYTES):
            v, letters = self.bundle_long(offsets, data)
            size = np.sqrt((v * v).sum(axis=1, keepdims=True))
            yield at, v / np.maximum(size, 1e-9), letters

    def bundle_long(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """bundle, for one very long text in pieces cut at spaces."""
        if len(offsets) > 2 or len(data) <= 8 * BYTES:
            return self.bundle(offsets, data)
        total, letters, at = np.zeros((1, DIMS), np.float32), np.zeros(1, np.int64), 0
        while at < len(data):
            to = min(len(data), at + 8 * BYTES)
            space = np.flatnonzero(data[to - 4096 : to] == 32) if to < len(data) else []
            step = to - 4096 + int(space[-1]) if len(space) else to
            while step < len(data) and data[step] & 0xC0 == 0x80:
                step += 1
            end = min(len(data), step + 1)  # the space ends this piece and begins the next
            v, n = self.bundle(np.array([0, end - at if data[end - 1] == 32 else step - at]), data[at : end if data[end - 1] == 32 else step])
            total, letters, at = total + v, letters + n, step
        return total, letters


_own: list[Profiles] = []


def profiles() -> Profiles:
    if not _own:
        _own.append(Profiles())
    return _own[0]


def learn(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages by code point and their centred unit prototypes, from all rows (text, lang).

    What comes to the driver is one vector per language; more than MOST_LANGUAGES
    languages are an error.
    """

    def partial(batches):
        sums: dict[str, np.ndarray] = {}
        own = profiles()
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            for at, units, _ in own.units(batch.column(0)):
                mine = langs[at : at + len(units)]
                for lang in set(mine):
                    sums[lang] = sums.get(lang, 0) + units[mine == lang].sum(axis=0, dtype=np.float64)
            if len(sums) > MOST_LANGUAGES:
                raise ValueError(f"more than {MOST_LANGUAGES} languages")
        # rounded, so that sums don't depend on their order
        flat = [np.rint(v * 2**20).astype(np.int64) for v in sums.values()]
        yield pa.record_batch([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in flat], pa.list_(pa.int64()))], names=["lang", "v"])

    parts = labelled.select("text", "lang").mapInArrow(partial, "lang string, v array<long>")
    total = parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x")).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))
    rows = sorted(total.limit(MOST_LANGUAGES + 1).collect(), key=lambda r: r["lang"])
    if len(rows) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not rows:
        return [], np.zeros((0, DIMS), np.float32)
    v = np.array([[x["x"] for x in r["v"]] for r in rows], np.float64)
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    if len(rows) > 1:
        v -= v.mean(axis=0)
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    return [r["lang"] for r in rows], v.astype(np.float32)


def held_out(doc_id):
    """Documents that are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs with held_out, lang_pred, score (the cosine, at least 0) and n_letters, learned from the rows not held out."""
    text, lang = F.col(text_col), F.col(lang_col)
    labelled = docs.where(text.isNotNull() & lang.isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).select(text.alias("text"), lang.cast("string").alias("lang"))
    names, prototypes = learn(labelled)
    sent = docs.sparkSession.sparkContext.broadcast((names, prototypes))

    def predict(batches):
        own = profiles()
        names, prototypes = sent.value
        for batch in batches:
            best, score, seen = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for at, units, letters in own.units(batch.column(0)):
                rows = slice(at, at + len(units))
                seen[rows] = letters
                if len(names):
                    cosine = units @ prototypes.T
                    best[rows], score[rows] = cosine.argmax(axis=1), np.clip(cosine.max(axis=1), 0, 1)
            found = (seen > 0) & (len(names) > 0)
            labels = np.array([*names, "und"], object)[np.where(found, best, len(names))]
            cols = [batch.column(i) for i in range(batch.num_columns)]
            yield pa.record_batch([*cols, pa.array(labels, pa.string()), pa.array(np.where(found, score, 0.0)), pa.array(seen)], names=[*batch.schema.names, "lang_pred", "score", "n_letters"])

    own_text = fresh(docs, "text")
    others = [c for c in docs.columns if c not in (text_col, "lang_pred", "score", "held_out", "n_letters")]
    rows = docs.select(text.alias(own_text), *others)
    schema = T.StructType([*rows.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("n_letters", T.LongType())])
    return rows.mapInArrow(predict, schema).withColumnRenamed(own_text, text_col).withColumn("held_out", held_out(F.col(id_col)))
