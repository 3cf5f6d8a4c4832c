"""Byte-level BPE encoding and decoding.

A text is cut at special tokens and by the byte-level word pattern; each word is
merged by a priority queue of (rank, place) over a doubly linked list of symbols,
where an entry whose pair has gone or changed is skipped.  Words met before come
from a bounded memo of the worker.  Decoding concatenates the vocabulary's byte
strings of the ids.

Defined cases: null and empty texts have no tokens; an empty table gives an empty
result; special tokens inside a text are encoded as themselves; repeated rows are
encoded each; a text is one task's work, however long, and a word of n symbols takes
n log n steps; of the columns to keep, one that is named like a column made here
gets _ before its name, and none is lost.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import fresh, text_slices

#: Words kept in each of the memo's two generations.
MEMO_WORDS = 100_000
#: Bytes of texts whose ids are held before they are handed on.
AT_ONCE = 1 << 20
_SPACES = r"\t-\r \x85\xa0  -     　"
#: Fixed value: the public word pattern of byte-level BPE, with white space spelled out.
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACES}\p{{L}}\p{{N}}]+|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+"

#: What PATTERN is over ASCII, for the quicker matcher.
ASCII_PATTERN = PATTERN.replace(r" ?\p{L}+", " ?[A-Za-z]+").replace(r" ?\p{N}+", " ?[0-9]+").replace(r"\p{L}\p{N}", "A-Za-z0-9")


def byte_alphabet() -> dict[int, str]:
    """Byte -> the visible character that stands for it in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Codec:
    def __init__(self, spec: dict):
        import regex

        vocab, merges = spec["vocab"], spec["merges"]
        to_byte = {c: b for b, c in byte_alphabet().items()}
        self.specials = {t: i for t, i in spec["specials"]}
        self.strings = {i: bytes(to_byte[c] for c in s) for s, i in vocab.items()} | {i: t.encode() for t, i in self.specials.items()}
        self.of_byte = [vocab[c] for _, c in sorted(byte_alphabet().items())]
        self.rank = {vocab[a] << 32 | vocab[b]: r << 32 for r, (a, b) in enumerate(merges)}
        self.of_bytes = [self.rank.get(a << 32 | b, -1) for a in self.of_byte for b in self.of_byte]  # of a word's neighbours before any merge
        self.name = {i: str(i) for i in self.strings}
        self.made = [vocab[a + b] for a, b in merges]
        self.find, self.find_ascii = regex.compile(PATTERN).findall, re.compile(ASCII_PATTERN).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")").split if self.specials else lambda t: [t]
        self.young: dict[str, tuple] = {}
        self.old: dict[str, tuple] = {}

    def merge(self, word: bytes) -> list[int]:
        ids = [*map(self.of_byte.__getitem__, word)]
        n = len(ids)
        pairs = self.of_bytes
        now = [pairs[a << 8 | b] for a, b in zip(word, word[1:])]  # rank, shifted, of the pair that begins at each place
        queue = [r | i for i, r in enumerate(now) if r >= 0]
        if not queue:
            return ids
        heapify(queue)
        now.append(-1)
        rank, made = self.rank.get, self.made
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        while queue:
            top = heappop(queue)
            i = top & 0xFFFFFFFF
            if now[i] | i != top:
                continue  # stale
            j = after[i]
            ids[i] = new = made[top >> 32]
            ids[j] = now[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                now[i] = x = rank(new << 32 | ids[k], -1)
                if x >= 0:
                    heappush(queue, x | i)
            else:
                now[i] = -1
            h = before[i]
            if h >= 0:
                now[h] = x = rank(ids[h] << 32 | new, -1)
                if x >= 0:
                    heappush(queue, x | h)
        return [x for x in ids if x >= 0]

    def decode(self, ids) -> bytes:
        strings = self.strings
        return b"".join([strings[i] for i in ids])

    def word(self, word: str) -> tuple:
        """(ids, ids as text, decoded bytes) of a word not in the young memo."""
        got = self.old.get(word)
        if got is None:
            ids = tuple(self.merge(word.encode()))  # no list: the collector need not look at what holds only numbers and strings
            got = ids, ",".join(map(self.name.__getitem__, ids)), self.decode(ids)
        if len(word) < 64:
            if len(self.young) >= MEMO_WORDS:
                self.young, self.old = {}, self.young
            self.young[word] = got
        return got

    def parts(self, text: str) -> list[tuple]:
        out: list[tuple] = []
        for piece in self.cut(text) if self.specials else [text]:
            if piece in self.specials:
                i = self.specials[piece]
                out.append(((i,), str(i), self.strings[i]))
            elif piece:
                words = self.find_ascii(piece) if piece.isascii() else self.find(piece)
                known = self.young.get
                out += [known(w) or self.word(w) for w in words]
        return out

    def encode(self, text: str) -> list[int]:
        return [i for p in self.parts(text) for i in p[0]]

    def text(self, ids) -> str:
        return self.decode(ids).decode("utf-8", "replace")


def read_spec(path: str) -> dict:
    """What a tokenizers file of byte-level BPE holds: vocab, merges, special tokens."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["model"]["merges"]]
    return {"vocab": model["model"]["vocab"], "merges": merges, "specials": [(t["content"], t["id"]) for t in model["added_tokens"]]}


_codecs: dict[str, Codec] = {}


def codec(key: str, spec: dict) -> Codec:
    if key not in _codecs:
        _codecs[key] = Codec(spec)
    return _codecs[key]


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 of every row, its ids as an array if with_ids, and the columns to keep (see the cases above).

    The vocabulary is read on the driver and sent to executors; its file bounds its size.
    """
    spec = read_spec(path)
    key = hashlib.sha256(json.dumps(spec, sort_keys=True).encode()).hexdigest()
    sent = docs.sparkSession.sparkContext.broadcast(spec)

    def encode(batches):
        own = codec(key, sent.value)
        for batch in batches:
            for at, offsets, _ in text_slices(batch.column(1), AT_ONCE):  # results leave in pieces as bounded as the texts
                some = batch.slice(at, len(offsets) - 1)
                counts, flat, hashes, decoded = [], array("i"), [], []
                for text in some.column(1):
                    parts = own.parts(text.as_py() or "")
                    counts.append(sum([len(p[0]) for p in parts]))
                    hashes.append(hashlib.sha256(",".join([p[1] for p in parts]).encode()).hexdigest())
                    back = b"".join([p[2] for p in parts]).decode("utf-8", "replace")
                    decoded.append(hashlib.sha256(back.encode()).hexdigest())
                    if with_ids:
                        for p in parts:
                            flat.extend(p[0])
                cols = [*some.columns[2:], some.column(0), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())]
                if with_ids:
                    ends = pa.array(np.concatenate([[0], np.cumsum(np.array(counts, np.int64))]), pa.int32())
                    cols.append(pa.ListArray.from_arrays(ends, pa.array(np.array(flat, np.int32))))
                yield pa.record_batch(cols, names=[*some.schema.names[2:], *made])
            pa.default_memory_pool().release_unused()

    made = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids
    taken, named = {c.lower() for c in [*made, *keep]}, {}
    for c in keep:
        if c != id_col:
            name = c
            while name.lower() in {m.lower() for m in made} or (name != c and name.lower() in taken):
                name = "_" + name
            taken.add(name.lower())
            named[c] = name
    key, text = fresh(docs, "key"), fresh(docs, "encoded_text")
    rows = docs.select(F.col(id_col).alias(key), F.col(text_col).alias(text), *[F.col(c).alias(n) for c, n in named.items()])
    kinds = [rows.schema[key].dataType, T.LongType(), T.StringType(), T.StringType()] + [T.ArrayType(T.IntegerType())] * with_ids
    schema = T.StructType([*rows.schema.fields[2:], *[T.StructField(n, k) for n, k in zip(made, kinds, strict=True)]])
    return rows.mapInArrow(encode, schema)
