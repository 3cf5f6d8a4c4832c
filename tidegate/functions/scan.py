"""Signatures and cues of whole batches of texts, in Arrow buffers.

All patterns are one automaton: their union runs over each text once, and only
texts in which it stops are read again, by each pattern alone.  The automaton knows
words of ASCII; letters of other scripts are shown to it as letters (_), white
space as blanks, so that words end where they do for people.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

from . import fixed
from .decoding import _LATIN, _NARROW, _NOISE, _UNSEEN, _UNSEEN_OR_BIDI, fold_text
from .segments import group, segment_all, segment_view

_LETTERS = r"[\x{AA}\x{B2}\x{B3}\x{B5}\x{B9}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}\x{370}-\x{1FFF}\x{2C00}-\x{D7FF}]"
_BLANKS = r"[\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: Characters of a match that are reported.
SHOWN = 120


def texts_of(column: pa.Array) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def folded(texts: pa.Array, normalise: bool) -> pa.Array:
    """For matching only, as text.fold(); texts of ASCII are not touched."""
    odd = pc.invert(pc.string_is_ascii(texts))
    if not pc.any(odd).as_py():
        return texts
    form = (lambda x: unicodedata.normalize("NFKC", x)) if normalise else (lambda x: x)
    new = [_UNSEEN_OR_BIDI.sub("", form(x)).translate(_LATIN) for x in texts.filter(odd).to_pylist()]
    return pc.replace_with_mask(texts, odd, pa.array(new, pa.large_string()))


def shown_to_automaton(texts: pa.Array) -> pa.Array:
    if not pc.all(pc.string_is_ascii(texts)).as_py():
        texts = pc.replace_substring_regex(texts, pattern=_LETTERS, replacement="_")
    return pc.replace_substring_regex(texts, pattern=_BLANKS, replacement=" ")


def _part(pattern: str) -> str:
    """A pattern with the flags at its front as a group of its own."""
    flags = re.match(r"\(\?([a-z]+)\)", pattern)
    return f"(?{flags[1]}:{pattern[flags.end() :]})" if flags else f"(?:{pattern})"


def matches(texts: pa.Array, patterns: tuple[str, ...], ignore_case: bool) -> np.ndarray:
    """Which pattern is found in which text: a row for each text."""
    out = np.zeros((len(texts), len(patterns)), bool)
    some = pc.match_substring_regex(texts, "|".join(map(_part, patterns)), ignore_case=ignore_case)
    rows = np.flatnonzero(some.to_numpy(zero_copy_only=False))
    if len(rows):
        left = texts.take(pa.array(rows))
        for k, p in enumerate(patterns):
            out[rows, k] = pc.match_substring_regex(left, p, ignore_case=ignore_case).to_numpy(zero_copy_only=False)
    return out


@lru_cache
def _patterns(signatures: tuple) -> tuple[str, ...]:
    return tuple(s[3] for s in signatures)


@lru_cache
def _compiled(signatures: tuple) -> list[re.Pattern]:
    return [re.compile(s[3], re.IGNORECASE) for s in signatures]


def fired(texts: pa.Array, signatures: tuple) -> np.ndarray:
    return matches(shown_to_automaton(texts), _patterns(signatures), True)


def scores(found: np.ndarray, signatures: tuple) -> np.ndarray:
    """Noisy-or of the severities that fire."""
    quiet = np.ones(len(found))
    for k, s in enumerate(signatures):
        quiet *= np.where(found[:, k], 1.0 - s[2], 1.0)
    return 1 - quiet


def first_match(text: str, pattern: re.Pattern) -> str:
    m = pattern.search(text) or pattern.search(shown_to_automaton(pa.array([text], pa.large_string()))[0].as_py())
    return text[m.start() : m.end()][:SHOWN] if m else ""


def cues(texts: pa.Array) -> np.ndarray:
    return matches(shown_to_automaton(pc.utf8_trim_whitespace(texts)), tuple(p for _, p in fixed.CUES), False)


def relisted(lists: pa.Array, values: pa.Array) -> pa.Array:
    """values in lists of the same lengths as before."""
    n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), values)


def _named(found: np.ndarray, values: pa.Array) -> pa.Array:
    """For each row the values of what is found in it."""
    _, which = np.nonzero(found)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(found.sum(1))]), pa.int32()), values.take(pa.array(which)))


# ------------------------------------------------------------------ columns
def score_column(text: Column, signatures: tuple, fold: bool, normalise: bool) -> Column:
    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        texts = texts_of(column)
        return pa.array(scores(fired(folded(texts, normalise) if fold else texts, signatures), signatures))

    return score(text)


def found_column(text: Column, signatures: tuple, fold: bool, normalise: bool) -> Column:
    """array of (id, severity)."""

    @F.arrow_udf("array<struct<id:string,severity:double>>")
    def find(column: pa.Array) -> pa.Array:
        texts = texts_of(column)
        each = pa.array([{"id": s[0], "severity": s[2]} for s in signatures], pa.struct([("id", pa.string()), ("severity", pa.float64())]))
        return _named(fired(folded(texts, normalise) if fold else texts, signatures), each)

    return find(text)


def hits_column(text: Column, signatures: tuple, fold: bool, normalise: bool) -> Column:
    """array of (id, category, severity, match)."""

    @F.arrow_udf("array<struct<id:string,category:string,severity:double,match:string>>")
    def find(column: pa.Array) -> pa.Array:
        texts = texts_of(column)
        texts = folded(texts, normalise) if fold else texts
        found = fired(texts, signatures)
        row, which = np.nonzero(found)
        own = dict(zip(np.unique(row).tolist(), texts.take(pa.array(np.unique(row))).to_pylist(), strict=True))
        each = [{"id": signatures[k][0], "category": signatures[k][1], "severity": signatures[k][2], "match": first_match(own[r], _compiled(signatures)[k])} for r, k in zip(row.tolist(), which.tolist(), strict=True)]
        kind = pa.struct([("id", pa.string()), ("category", pa.string()), ("severity", pa.float64()), ("match", pa.string())])
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(found.sum(1))]), pa.int32()), pa.array(each, kind))

    return find(text)


def cues_column(text: Column, fold: bool, normalise: bool) -> Column:
    """Names of the cues in a text."""

    @F.arrow_udf("array<string>")
    def find(column: pa.Array) -> pa.Array:
        texts = texts_of(column)
        return _named(cues(folded(texts, normalise) if fold else texts), pa.array([n for n, _ in fixed.CUES]))

    return find(text)


def segment_scores(texts: Column, signatures: tuple, with_cues: bool = False) -> Column:
    """array of (p, cued) for an array of folded texts: score of the signatures, and whether any cue is found (null unless asked for)."""

    @F.arrow_udf("array<struct<p:double,cued:boolean>>")
    def score(lists: pa.Array) -> pa.Array:
        flat = texts_of(lists.flatten())
        p = pa.array(scores(fired(flat, signatures), signatures))
        cued = pa.array(cues(flat).any(1)) if with_cues else pa.nulls(len(flat), pa.bool_())
        return relisted(lists, pa.StructArray.from_arrays([p, cued], names=["p", "cued"]))

    return score(texts)


def scored_segments(text, signatures: tuple, limit: int = 400, most: int = 2000) -> Column:
    """array of (text, sep, view, p): segments, what the model reads of them and the score of the signatures, in one reading."""

    @F.arrow_udf("array<struct<text:string,sep:string,view:string,p:double>>")
    def read(column: pa.Array) -> pa.Array:
        cuts = [list(group(parts, most)) for parts in segment_all(column.to_pylist(), limit)]
        views = [segment_view(body) for c in cuts for body, _ in c]
        p = scores(fired(pa.array([fold_text(v) for v in views], pa.large_string()), signatures), signatures)
        each = [pa.array([body for c in cuts for body, _ in c], pa.string()), pa.array([sep for c in cuts for _, sep in c], pa.string()), pa.array(views, pa.string()), pa.array(p)]
        ends = np.cumsum([0, *map(len, cuts)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(each, names=["text", "sep", "view", "p"]))

    return read(F.col(text) if isinstance(text, str) else text)


_PARTS = "struct<delivery:string,detection:string,smuggled:string,obfuscated:boolean>"
_TAGS, _BIDI = re.compile("[\U000e0000-\U000e007f]"), re.compile(f"[{fixed.BIDI}]")


def _taken_apart(text: str) -> tuple[str, str, str, bool]:
    delivery = _NARROW.sub("", _NOISE.sub("", text))
    tags = _TAGS.findall(text)
    smuggled = "".join(chr(ord(c) - 0xE0000) for c in tags if 0xE0020 <= ord(c) <= 0xE007E)
    return delivery, _UNSEEN.sub("", unicodedata.normalize("NFKC", delivery)), smuggled, bool(tags or _BIDI.search(text) or _NARROW.search(text))


def _all_apart(column: pa.Array) -> pa.StructArray:
    texts = texts_of(column)
    odd = pc.invert(pc.string_is_ascii(texts))  # texts of ASCII are not touched
    made = [_taken_apart(x) for x in texts.filter(odd).to_pylist()]
    delivery, detection, smuggled, obfuscated = zip(*made, strict=True) if made else ((), (), (), ())
    put = lambda whole, new, kind: pc.replace_with_mask(whole, odd, pa.array(new, kind))
    none, no = pa.array([""] * len(texts), pa.large_string()), pa.array(np.zeros(len(texts), bool))
    columns = [put(texts, delivery, pa.large_string()), put(texts, detection, pa.large_string()), put(none, smuggled, pa.large_string())]
    return pa.StructArray.from_arrays([*[c.cast(pa.string()) for c in columns], put(no, obfuscated, pa.bool_())], names=["delivery", "detection", "smuggled", "obfuscated"])


def unicode_parts(text) -> Column:
    """struct of delivery, detection, smuggled, obfuscated as text.unicode_report() and text.detection_text() have them, in one reading."""

    @F.arrow_udf(_PARTS)
    def take_apart(column: pa.Array) -> pa.Array:
        return _all_apart(column)

    return take_apart(F.col(text) if isinstance(text, str) else text)


def scored_detection(text, signatures: tuple) -> Column:
    """struct of detection, as unicode_parts() has it, and of p, the score of the signatures in it, in one reading."""

    @F.arrow_udf("struct<detection:string,p:double>")
    def read(column: pa.Array) -> pa.Array:
        detection = _all_apart(column).field("detection")
        p = scores(fired(folded(texts_of(detection), True), signatures), signatures)
        return pa.StructArray.from_arrays([detection, pa.array(p)], names=["detection", "p"])

    return read(F.col(text) if isinstance(text, str) else text)
