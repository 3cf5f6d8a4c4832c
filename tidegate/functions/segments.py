"""Texts cut into sentences, lines and code blocks, without loss.

A text is read as an array of code points.  Its white space falls into runs; a run
is a boundary if it holds a newline or stands between the end of a sentence and
what can begin one.  Code blocks are whole, with a boundary at either end.  All
this is done on arrays, so a segment is a pair of offsets until it is sliced out.
"""

from __future__ import annotations

import re
from itertools import batched

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

from . import fixed
from .decoding import decode_text_inline, fold_text, plain_text


def _table(chars) -> np.ndarray:
    out = np.zeros(0x110000, bool)
    out[[ord(c) for c in chars]] = True
    return out


_WHITE = _table(c for c in map(chr, range(0x3001)) if c.isspace())
_STOPS, _CLOSERS, _OPENERS = _table(fixed.SENTENCE_STOPS), _table(fixed.SENTENCE_CLOSERS), _table(fixed.SENTENCE_OPENERS)
_MARKER, _BLANK_LINE = re.compile(fixed.LIST_MARKER), re.compile(fixed.BLANK_LINE)
#: The least part of a segment's limit at which it may be cut.
_CUT_FROM = 0.6
#: Characters of texts that are read at once.
SCAN = 1_000_000


def strength(sep: str) -> int:
    """3 for a blank line, 2 for a newline, 1 for other white space, 0 for none."""
    return 3 * bool(_BLANK_LINE.search(sep)) or 2 * ("\n" in sep) or len(sep[:1])


def _fences(text: str, at: int, stop: int):
    """(from, to) of each code block of text[at:stop]; one that isn't closed goes on to where the text ends but for white space."""
    at = text.find("```", at, stop)
    while at >= 0:
        closed = text.find("```", at + 3, stop)
        to = closed + 3 if closed >= 0 else at + len(text[at:stop].rstrip())
        yield at, to
        at = text.find("```", to, stop) if closed >= 0 else -1


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of a mask begin and end."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return edge[::2], edge[1::2]


def _bounds(text: str, starts: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end) of each segment of any length, and which places are white space; texts begin at `starts`, a newline before each."""
    point = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    white = _WHITE[point]
    stops = [a - 1 for a in starts[1:]] + [len(text)]
    blocks = [block for a, b in zip(starts, stops, strict=True) for block in _fences(text, a, b)] if "```" in text else []
    outer = white.copy()
    for a, b in blocks:
        outer[a:b] = False
    begin, end = _runs(outer)
    lines = np.concatenate(([0], np.cumsum(point == 10)))
    before = lambda k: point[np.maximum(begin - k, 0)]
    ended = (begin > 0) & (_STOPS[before(1)] | ((begin > 1) & _CLOSERS[before(1)] & _STOPS[before(2)]))
    opens = (end < len(point)) & _OPENERS[point[np.minimum(end, len(point) - 1)]] if len(point) else ended
    at_block = np.isin(begin, [b for _, b in blocks]) | np.isin(end, [a for a, _ in blocks])
    cut = (lines[end] > lines[begin]) | (ended & opens) | (begin == 0) | (end == len(point)) | at_block
    edge = np.zeros(len(point) + 1, np.int8)  # +1 and -1 where separators begin and end
    edge[begin[cut]] += 1
    edge[end[cut]] -= 1
    separator = np.cumsum(edge[:-1], dtype=np.int8) > 0
    begin, end = _runs(~separator)
    inner = [x for x in sorted({x for block in blocks for x in block}) if 0 < x < len(point) and not separator[x - 1 : x + 1].any()]  # blocks without white space beside them
    return np.sort(np.concatenate((begin, inner))).astype(np.int64), np.sort(np.concatenate((end, inner))).astype(np.int64), white


def _limited(begin: np.ndarray, end: np.ndarray, white: np.ndarray, text: str, limit: int):
    """The segments cut at the last space of their last two fifths, or at the limit, until none is longer."""
    solid = np.flatnonzero(~white)
    for a, b in zip(begin.tolist(), end.tolist(), strict=True):
        while b - a > limit:
            at = text.rfind(" ", a + int(limit * _CUT_FROM), a + limit)
            at = a + limit if at < 0 else at
            yield a, at
            k = int(np.searchsorted(solid, at))
            a = int(solid[k]) if k < len(solid) else b
        if a < b:
            yield a, b


def _listed(text: str, spans: list[tuple[int, int]], limit: int) -> list[tuple[str, str]]:
    """The segments of one text; a list marker stays with what it marks."""
    joined: list[list[int]] = []
    for a, b in spans:
        if joined:
            x, y = joined[-1]
            if y - x <= 5 and b - x <= limit and _MARKER.fullmatch(text, x, y) and strength(text[y:a]) < 3:
                joined[-1][1] = b
                continue
        joined.append([a, b])
    ends = [joined[0][0], *(b for _, b in joined)] if joined else []
    return [(text[a:b], text[last:a]) for (a, b), last in zip(joined, ends, strict=False)]


def segment_all(texts: list[str | None], limit: int = 400) -> list[list[tuple[str, str]]]:
    """segment() of many texts, read as one array a million characters at a time."""
    out, at = [], 0
    while at < len(texts):
        part, starts, size = [], [], 0
        while at < len(texts) and (not part or size + len(texts[at] or "") <= SCAN):
            part.append(texts[at] or "")
            starts.append(size)
            size += len(part[-1]) + 1
            at += 1
        text = "\n".join(part)
        begin, end, white = _bounds(text, starts)
        spans = [[] for _ in part]
        owner, k = starts[1:] + [len(text) + 1], 0
        for a, b in _limited(begin, end, white, text, limit):
            while a >= owner[k]:
                k += 1
            spans[k].append((a, b))
        out += [_listed(text, own, limit) for own in spans]
    return out


def segment(text: str | None, limit: int = 400) -> list[tuple[str, str]]:
    """(text, separator before it) of each sentence, line or code block; put together they give the stripped text back."""
    return segment_all([text], limit)[0]


def group(parts: list[tuple[str, str]], most: int = 2000) -> list[tuple[str, str]]:
    """Consecutive segments merged so that at most `most` remain; where nothing stands between two, a space does."""
    if not most or len(parts) <= most:
        return parts
    return [(run[0][0] + "".join((sep or " ") + body for body, sep in run[1:]), run[0][1]) for run in batched(parts, -(-len(parts) // most))]


def segments(text, limit: int = 400, most: int = 2000) -> Column:
    """array of (text, sep) as an Arrow UDF."""

    @F.pandas_udf("array<struct<text:string,sep:string>>")
    def cut(x: pd.Series) -> pd.Series:
        return pd.Series([[{"text": b, "sep": s} for b, s in group(parts, most)] for parts in segment_all(x.tolist(), limit)])

    return cut(F.col(text) if isinstance(text, str) else text)


def segment_view(text: str) -> str:
    """What detectors read of one segment: without obfuscation, decoded in place."""
    return decode_text_inline(plain_text(text))


def viewed_segments(text, limit: int = 400, most: int = 2000) -> Column:
    """array of (text, sep, view, folded): segments with what the model and the signatures read of them."""

    @F.pandas_udf("array<struct<text:string,sep:string,view:string,folded:string>>")
    def cut(x: pd.Series) -> pd.Series:
        def read(body: str, sep: str) -> dict:
            view = segment_view(body)
            return {"text": body, "sep": sep, "view": view, "folded": fold_text(view)}

        return pd.Series([[read(b, s) for b, s in group(parts, most)] for parts in segment_all(x.tolist(), limit)])

    return cut(F.col(text) if isinstance(text, str) else text)
