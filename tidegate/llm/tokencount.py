"""Token counts by a compiled finite-state transducer.

A subword vocabulary with merge priorities is compiled into a deterministic
transducer over characters.  Its states say what a prefix of a text leaves open:
the ends of the text that begin some longer piece, each with the last token
before it and the tokens counted since; a transition carries the change in the
number of tokens.  It rests on two facts about merging by priority: a token
sequence is the encoding of a text exactly if each two neighbours, encoded alone,
stay as they are; so the last token of a prefix follows from the encodings of
shorter prefixes.  Transitions are compiled when first met and kept in a table.

Texts are cut into chunks and all chunks of a batch advance in lockstep, one
character a step, by array lookups.  A chunk's state map sends an entry state to
an end state and a count.  Between two characters that stand together in no piece
every state behaves as the root, so a map is constant from the first such place
on.  Other chunks' maps are made for the entry states that can reach them.  Maps
are composed by a parallel prefix scan in log rounds, and the heads before the
constant places are then run from their entry states.

Defined cases: null and empty texts have 0 tokens; an empty table gives an empty
result; rows that repeat are counted each; very long texts are read whole, also
without any place where all is settled; characters outside the vocabulary count
their UTF-8 bytes; other columns are not carried on, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import text_slices

#: Characters in a chunk; columns of the dense table; states kept before the table is begun anew.
CHUNK, WIDE, MOST_STATES = 1_024, 176, 200_000
#: Characters from which a chunk's entry state is guessed, and guessed entry states of a chunk.
GUESS, MOST_ENTRIES = 64, 64
_BIAS = 32  # added to a transition's count, which is kept in 6 bits


class Transducer:
    def __init__(self, scores: dict[str, float], space: str = "▁"):
        self.scores, self.space = scores, space
        self.prefixes = {p[:i] for p in scores for i in range(1, len(p))}
        self.pairs = {p[i : i + 2] for p in scores for i in range(len(p) - 1)}
        self.lefts = {x[0] for x in self.pairs}
        alone = {p for p in scores if len(p) == 1}
        if {c for p in scores for c in p} - alone:
            raise ValueError("every character of a piece must be a piece")
        self.chars = sorted(alone)
        # classes: 0-3 are unknown characters by UTF-8 length, then the space and the vocabulary's by code point, Latin letters first
        self.chars.sort(key=lambda c: (c != space, not c.isascii(), not ("À" <= c <= "ÿ"), c))
        top = 0x110000
        self.class_of = np.zeros(top, np.int16)
        self.class_of[0x80:] = 1
        self.class_of[0x800:] = 2
        self.class_of[0x10000:] = 3
        self.class_of[[ord(c) for c in self.chars]] = np.arange(4, 4 + len(self.chars))
        self.class_of[ord(" ")] = self.class_of[ord(space)]
        self.class_char = [None] * 4 + self.chars
        n = len(self.class_char)
        left = np.zeros((n, n), bool)
        for x in self.pairs:
            left[self.class_of[ord(x[0])], self.class_of[ord(x[1])]] = True
        self.joined = left
        self._compat: dict = {}
        self._whole: dict = {}
        self.reset()

    def reset(self) -> None:
        self.states = {("", ((0, None, 0),)): 0}
        self.keys = [("", ((0, None, 0),))]
        self.table = np.full((1024, WIDE), -1, np.int32)
        self.rare: dict[int, int] = {}
        value = self._compile(0, int(self.class_of[ord(self.space)]))
        self.begin = value >> 6  # after the space that stands before every text
        self.begin_count = (value & 63) - _BIAS

    def merge(self, text: str) -> list[str]:
        """The encoding of a short text by its definition: best score first, leftmost of equals."""
        s = list(text)
        while True:
            best, at = None, -1
            for i in range(len(s) - 1):
                score = self.scores.get(s[i] + s[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                return s
            s[at : at + 2] = [s[at] + s[at + 1]]

    def _fits(self, last, token: str) -> bool:
        if last is None:
            got = self._whole.get(token)
            if got is None:
                got = self._whole[token] = len(self.merge(token)) == 1
            return got
        got = self._compat.get((last, token))
        if got is None:
            got = self._compat[last, token] = self.merge(last + token) == [last, token]
        return got

    def _compile(self, state: int, cls: int) -> int:
        """The transition, as target << 6 | count + _BIAS."""
        char = self.class_char[cls]
        if char is None:
            target, gain = 0, cls + 1
        else:
            window, ends = self.keys[state]
            n = len(window)
            found = gain = None
            for length, last, count in ends:
                token = window[n - length :] + char
                if token in self.scores and self._fits(last, token):
                    found, gain = token, count + 1
                    break
            if found is None:
                raise AssertionError(f"no token ends at {window + char!r}")
            live = []
            for length, last, count in ends:
                token = window[n - length :] + char
                if token in self.prefixes:
                    if length == 0 and last is not None and last[-1] + char not in self.pairs:
                        last = None
                    live.append((length + 1, last, count - gain))
            live.append((0, found if found[-1] in self.lefts else None, 0))
            key = ((window + char)[n + 1 - live[0][0] :], tuple(live))
            target = self.states.get(key)
            if target is None:
                target = self.states[key] = len(self.keys)
                self.keys.append(key)
                if target >= len(self.table):
                    self.table = np.concatenate((self.table, np.full_like(self.table, -1)))
        value = target << 6 | (gain + _BIAS)
        if cls < WIDE:
            self.table[state, cls] = value
        else:
            self.rare[state << 12 | cls] = value
        return value

    def run(self, classes: np.ndarray, start: np.ndarray, length: np.ndarray, state: np.ndarray):
        """(end state, tokens) of each lane: `length` characters from `start`, entered in `state`."""
        order = np.argsort(-length, kind="stable")
        start, length = start[order], length[order]
        state, total = state[order].astype(np.int64), np.zeros(len(order), np.int64)
        live = len(order) - np.searchsorted(length[::-1], np.arange(int(length.max(initial=0))), "right")
        for t, k in enumerate(live.tolist()):
            cls = classes[start[:k] + t]
            now = state[:k]
            narrow = cls < WIDE
            value = self.table.ravel().take(now * WIDE + np.where(narrow, cls, 0))
            if not narrow.all():
                for i in np.flatnonzero(~narrow).tolist():
                    got = self.rare.get(int(now[i]) << 12 | int(cls[i]))
                    value[i] = self._compile(int(now[i]), int(cls[i])) if got is None else got
            if value.min() < 0:
                new = np.flatnonzero(value < 0)
                made: dict[tuple, int] = {}
                for i, s, c in zip(new.tolist(), now[new].tolist(), cls[new].tolist(), strict=True):
                    got = made.get((s, c))
                    if got is None:
                        got = made[s, c] = self._compile(s, c)
                    value[i] = got
            state[:k] = value >> 6
            total[:k] += (value & 63) - _BIAS
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return state[back], total[back]

    def scan(self, classes: np.ndarray, start: np.ndarray, length: np.ndarray, opens: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry state, end state) of chunks in which no map is constant; opens: a chunk whose entry state is known, the others follow the one before.

        A chunk's map holds the entry states that can reach it: the known one, one guessed from the characters before the
        chunk, and what the map of the chunk before sends on; such a state is tried in all chunks, so that those of a text
        that repeats itself are there after a few rounds.  All pairs (chunk, entry) found in a round are run at once.  Then maps are composed in
        log2(n) rounds.  A chunk whose guesses reach MOST_ENTRIES takes no more of them, only the true one.
        """
        n = len(start)
        guess = np.zeros(n, np.int64)
        far = np.minimum(GUESS, start)
        guess, _ = self.run(classes, start - far, far, guess)
        maps: list[dict[int, int]] = [{} for _ in range(n)]
        new = {(i, int(s)) for i, s in enumerate(np.where(opens, known, guess).tolist())}
        true = np.where(opens, known, -1).tolist()  # entry states known to be the true ones
        tried: set[int] = set()
        while new:
            pairs = np.array(sorted(new), np.int64)
            out, _ = self.run(classes, start[pairs[:, 0]], length[pairs[:, 0]], pairs[:, 1])
            for (i, s), o in zip(pairs.tolist(), out.tolist(), strict=True):
                maps[i][s] = o
            new = set()
            for i, o in zip(pairs[:, 0].tolist(), out.tolist(), strict=True):
                j = i + 1
                if j < n and not opens[j] and o not in maps[j] and len(maps[j]) < MOST_ENTRIES:
                    new.add((j, o))
            for o in {o for _, o in new} - tried if len(tried) < MOST_ENTRIES else ():
                tried.add(o)  # what one chunk sends on, others may: a text that repeats itself has few states
                new.update((j, o) for j in range(n) if not opens[j] and o not in maps[j])
            if not new:  # the true path, where guesses were given up
                for j in range(1, n):
                    if not opens[j] and true[j] < 0 and true[j - 1] >= 0:
                        o = maps[j - 1][true[j - 1]]
                        true[j] = o
                        if o not in maps[j]:
                            new.add((j, o))
                            break
        # composition: entries as numbers, maps as rows of a table that send a number to one of the next chunk
        names = [sorted(m) for m in maps]
        wide = max(map(len, names))
        to = np.zeros((n, wide), np.int64)
        for j in range(1, n):
            if not opens[j]:
                place = {s: k for k, s in enumerate(names[j])}
                for k, s in enumerate(names[j - 1]):
                    to[j, k] = place.get(maps[j - 1][s], 0)
        fixed = opens.copy()
        to[opens] = np.array([names[j].index(int(known[j])) for j in np.flatnonzero(opens)], np.int64)[:, None]
        step = 1
        while not fixed.all():  # to[j] sends an entry of chunk j - step to one of chunk j
            back = np.maximum(np.arange(n) - step, 0)
            joined = np.take_along_axis(to, to[back], axis=1)
            to = np.where(fixed[:, None], to, joined)
            fixed |= fixed[back]
            step *= 2
        enter = np.array([m[k] for m, k in zip(names, to[:, 0].tolist(), strict=True)], np.int64)
        return enter, np.array([m[s] for m, s in zip(maps, enter.tolist(), strict=True)], np.int64)

    def count(self, offsets: np.ndarray, points: np.ndarray) -> np.ndarray:
        """Tokens of each text; text i is points[offsets[i]:offsets[i + 1]]."""
        if len(self.keys) > MOST_STATES:
            self.reset()
        classes = self.class_of[points].astype(np.int64)
        size = np.diff(offsets)
        chunks = -(-size // CHUNK)
        text = np.repeat(np.arange(len(size)), chunks)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
        start = offsets[text] + nth * CHUNK
        end = np.minimum(start + CHUNK, offsets[text + 1])
        first = nth == 0
        # the first place in each later chunk before which nothing is left open
        free = np.flatnonzero(~self.joined[classes[:-1], classes[1:]]) + 1 if len(classes) > 1 else np.zeros(0, np.int64)
        near = np.searchsorted(free, start)
        sync = np.where(near < len(free), free[np.minimum(near, len(free) - 1)] if len(free) else end, end)
        sync = np.where(first, start, np.minimum(sync, end))
        constant = (sync < end) | first
        state = np.where(first, self.begin, 0)
        state, tokens = self.run(classes, sync, end - sync, state)
        tokens[first] += self.begin_count
        # scan: what enters a chunk is what leaves the one before
        enter = np.concatenate(([0], state[:-1]))
        through = np.flatnonzero(~constant)
        if len(through):
            before = constant[through - 1]
            enter[through], state[through] = self.scan(classes, start[through], end[through] - start[through], before, np.where(before, enter[through], -1))
            enter[1:] = state[:-1]
        rest = np.flatnonzero(~first)
        _, more = self.run(classes, start[rest], sync[rest] - start[rest], enter[rest])
        tokens[rest] += more
        return np.bincount(text, tokens, len(size)).astype(np.int64)


_compiled: dict[str, Transducer] = {}


def transducer(key: str, scores: dict[str, float]) -> Transducer:
    """The worker's transducer for a vocabulary: what one task has compiled, the next one uses."""
    if key not in _compiled:
        _compiled[key] = Transducer(scores)
    return _compiled[key]


def piece_scores(model_path: str) -> dict[str, float]:
    """Pieces and scores of a sentencepiece BPE model, without control, unknown and byte pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    plain = (i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)))
    return {sp.id_to_piece(i): sp.get_score(i) for i in plain}


def code_points(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and code points of texts given as UTF-8."""
    try:
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    except UnicodeDecodeError:
        texts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        return np.cumsum([0, *map(len, texts)]), np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    before = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    return before[offsets], points


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens, over_limit of every row; the vocabulary file bounds what is sent to executors."""
    scores = piece_scores(model_path)
    key = hashlib.sha256(repr(sorted(scores.items())).encode()).hexdigest()
    sent = docs.sparkSession.sparkContext.broadcast(scores)

    def count(batches):
        machine = transducer(key, sent.value)
        for batch in batches:
            found = np.zeros(batch.num_rows, np.int64)
            for at, offsets, data in text_slices(batch.column(1), 8 << 20):
                found[at : at + len(offsets) - 1] = machine.count(*code_points(offsets, data))
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(found)], names=["id", "n_bytes", "n_tokens"])

    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), size.alias("n_bytes"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.select("id", "text", "n_bytes").mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
