"""Token ids of a corpus in ORC files, and readers of them.

One row a document, in ascending order of ids over all files: its token ids with
an end id, where its ids begin among those of its file, and their number.  ORC
keeps integers in run-length encoded streams by stripes; every stripe has an index
with least and greatest values for each few thousand rows and Bloom filters on
document ids.  So readers share files out by stripes, and a look-up of documents
skips what can't hold them.

Encoding takes the tokenizers library.  A text is cut at single ASCII blanks and
before the marks that end a word, where this vocabulary's words end anyway, and each different piece is
encoded once for some megabytes of texts; so memory is bounded by a batch, not by the
library's records of a very long text.

Defined cases: null and empty texts have the end id alone; null ids come first;
rows of one id follow one another in an order that depends on their texts, and many
rows of one id are dealt over several files; an empty table gives one empty file and no rows; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from .bpe import byte_alphabet
from .common import _written, parts_for, shared_dir, text_slices

#: The marks after a word's last letter are a word of their own; only letters that stay one letter in lower case.
TAIL = r"([A-Za-z0-9\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}])([.,;:!?]+)$"
#: Pieces that the library gets at once, those that a worker remembers, and bytes of texts encoded together.
AT_ONCE, REMEMBERED, SLICE = 2_000, 1_000_000, 8 << 20
#: A piece of small letters alone is one word whatever the normal form and the pattern: it goes straight to the library's merges.
PLAIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+").fullmatch
BYTES = {c: "".join(byte_alphabet()[b] for b in chr(c).encode()) for c in range(0xDF, 0x100)}
_TO_SPACE = np.arange(256, dtype=np.uint8)
_TO_SPACE[[0x09, 0x0A, 0x0D]] = 0x20
_known: dict[str, "_Words"] = {}


class _Words:
    """A worker's tokenizer, and the ids of the pieces that it has encoded."""

    def __init__(self, content: str):
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_str(content)
        self.own.no_truncation()
        self.own.no_padding()
        self.merge = self.own.model.tokenize
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.int32)
        self.ends = np.zeros(1, np.int64)

    def numbers(self, stems: list[str], tails: list[str]) -> np.ndarray:
        """The number of each piece, stems first; its ids are ids[ends[number] : ends[number + 1]]."""
        pieces = list(dict.fromkeys([*stems, *tails]))
        if len(self.number) + len(pieces) > REMEMBERED + len(pieces) * (not self.number):
            self.forget()
        known = self.number
        fresh = [p for p in pieces if p not in known]
        sizes, made = [], []
        plain = [p for p in fresh if PLAIN(p)]
        for p in plain:
            ids = [t.id for t in self.merge(p if p.isascii() else p.translate(BYTES))]
            made += ids
            sizes.append(len(ids))
        if len(plain) < len(fresh):
            other = [p for p in fresh if not PLAIN(p)]
            for at in range(0, len(other), AT_ONCE):
                for e in self.own.encode_batch_fast(other[at : at + AT_ONCE], add_special_tokens=False):
                    ids = e.ids
                    made += ids
                    sizes.append(len(ids))
            plain += other
        known.update(zip(plain, range(len(known), len(known) + len(plain)), strict=True))
        used = int(self.ends[-1])
        if used + len(made) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(made)), np.int32)])
        self.ids[used : used + len(made)] = made
        self.ends = np.concatenate([self.ends, used + np.cumsum(np.array(sizes, np.int64))])
        return np.array([known[p] for p in [*stems, *tails]], np.int64)


def _spread(ids: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """ids[first : first + size] of each, end to end."""
    ends = np.cumsum(size)
    return ids[np.repeat(first - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]


def _encode(offsets: np.ndarray, data: np.ndarray, words: _Words) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts end to end, their numbers): every different piece once."""
    texts = pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(_TO_SPACE[data])])
    pieces = pc.split_pattern(texts, pattern=" ")
    bounds = pieces.offsets.to_numpy() - pieces.offsets[0].as_py()
    coded = pieces.flatten().dictionary_encode()
    whole = coded.dictionary
    stem = pc.replace_substring_regex(whole, pattern=TAIL, replacement=r"\1")
    n_stem, n_whole = pc.binary_length(stem).to_numpy(zero_copy_only=False), pc.binary_length(whole).to_numpy(zero_copy_only=False)
    marked = np.flatnonzero(n_stem < n_whole)
    tail = pc.replace_substring_regex(whole.take(pa.array(marked)), pattern=r"(?s)^.*[^.,;:!?]", replacement="").dictionary_encode()
    lower = pc.if_else(pc.match_substring(stem, "<|"), stem, pc.ascii_lower(stem))  # special tokens are told by case
    stems = lower.dictionary_encode()
    different = stems.dictionary.to_pylist()
    number = words.numbers(different, tail.dictionary.to_pylist())
    own = number[: len(different)][stems.indices.to_numpy(zero_copy_only=False)]
    of_tail = number[len(different) :][tail.indices.to_numpy(zero_copy_only=False)]
    # each different word is one or two pieces
    two = np.zeros(len(whole), np.int64)
    two[marked] = 1
    at = np.arange(len(whole)) + np.cumsum(two) - two
    parts = np.zeros(len(whole) + len(marked), np.int64)
    parts[at], parts[at[marked] + 1] = own, of_tail
    size = words.ends[parts + 1] - words.ends[parts]
    flat = _spread(words.ids, words.ends[parts], size)
    word_ends = np.concatenate([[0], np.cumsum(size)])
    first, last = word_ends[at], word_ends[at + 1 + two]
    code = coded.indices.to_numpy(zero_copy_only=False)
    times = (last - first)[code]
    ids = _spread(flat, first[code], times)
    return ids, np.diff(np.concatenate([[0], np.cumsum(times)])[bounds])


def _encoder(docs: DataFrame, path: str, end_id: int):
    """A function for mapInArrow over (id, text, ...): id, begin, n, ids and the columns after text.

    The tokenizer's file is read on the driver and sent; it bounds its own size.
    """
    with open(path, encoding="utf-8") as f:
        content = f.read()
    key = hashlib.sha256(content.encode()).hexdigest()
    sent = docs.sparkSession.sparkContext.broadcast(content)

    def encode(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if key not in _known:
            _known[key] = _Words(sent.value)
        before = 0
        for batch in batches:
            for at, offsets, data in text_slices(batch.column(1), SLICE):
                ids, n = _encode(offsets, data, _known[key])
                with_end = np.insert(ids, np.cumsum(n), end_id).astype(np.int32)
                ends = np.concatenate([[0], np.cumsum(n + 1)])
                rows = batch.slice(at, len(n))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(with_end))
                yield pa.record_batch([rows.column(0), pa.array(before + ends[:-1]), pa.array(n + 1), lists, *rows.columns[2:]], names=["id", "begin", "n", "ids", *rows.schema.names[2:]])
                before += int(ends[-1])

    return encode


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))


def encode_ids(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ids (array of int, end id last) of every row."""
    rows = _rows(docs, id_col, text_col)
    return rows.mapInArrow(_encoder(docs, path, end_id), f"id {rows.schema['id'].dataType.simpleString()}, begin long, n long, ids array<int>").select("id", "ids")


def write_ids(docs: DataFrame, tokenizer: str, end_id: int, path: str, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = 64 << 20) -> None:
    """Encode docs into ORC files at path: ids in ascending order over the files, which are numbered in the column `file`.

    Rows are dealt by ranges of (id, digest, place), so no id, however often it
    occurs, must fit one file; they are encoded where they are written.
    """
    rows = _rows(docs, id_col, text_col).withColumns({"digest": F.xxhash64("text"), "place": F.monotonically_increasing_id()})
    order = [F.col("id").asc_nulls_first(), F.col("digest"), F.col("place")]
    dealt = rows.repartitionByRange(parts_for(docs, file_bytes), *order).sortWithinPartitions(*order)
    kind = rows.schema["id"].dataType.simpleString()
    made = dealt.select("id", "text", F.spark_partition_id().alias("file")).mapInArrow(_encoder(docs, tokenizer, end_id), f"id {kind}, begin long, n long, ids array<int>, file int")
    options = {"orc.bloom.filter.columns": "id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "orc.row.index.stride": "1000", "orc.stripe.size": str(8 << 20), "compression": "zstd"}
    made.write.options(**options).orc(path)


def read_ids(spark: SparkSession, path: str, among: list[int] | None = None) -> DataFrame:
    """id, file, begin, n, ids; with among, of those documents alone: stripes and row groups that can't hold them aren't read."""
    rows = spark.read.orc(path)
    return rows if among is None else rows.where(F.col("id").isin(among))


def file_starts(rows: DataFrame) -> DataFrame:
    """file, before: the ids in all files before each.  One row a file comes to the driver; column `ids` isn't read."""
    sizes = sorted((r.file, r.n) for r in rows.groupBy("file").agg(F.sum("n").alias("n")).collect())
    before = np.concatenate([[0], np.cumsum([n for _, n in sizes])]).astype(int).tolist()
    return rows.sparkSession.createDataFrame([(f, b) for (f, _), b in zip(sizes, before, strict=False)], "file int, before long")


def checksums(rows: DataFrame) -> DataFrame:
    """id, file, begin, n, ids_crc32: of ids as little-endian unsigned 32-bit integers."""

    def sums(batches):
        for batch in batches:
            ids = batch.column(4)
            at = ids.offsets.to_numpy()
            raw = memoryview(ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.record_batch([*batch.columns[:4], pa.array(crc, pa.int64())], names=["id", "file", "begin", "n", "ids_crc32"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "file", "begin", "n", "ids").mapInArrow(sums, f"id {kind}, file int, begin long, n long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """id, start, n_tokens, ids_crc32 of every row, read from the files that are written for it.

    path: where the files go and stay; without it they go to the shared folder until release().
    """
    spark = docs.sparkSession
    if path is None:
        path = f"{shared_dir(spark)}/tidegate-{uuid.uuid4().hex}-token-ids"
        _written.append((spark, path))
    write_ids(docs, tokenizer, end_id, path, id_col, text_col)
    rows = read_ids(spark, path)
    out = checksums(rows).join(file_starts(rows), "file")
    return out.select(F.col("id").alias(id_col), (F.col("before") + F.col("begin")).alias("start"), F.col("n").alias("n_tokens"), "ids_crc32")
