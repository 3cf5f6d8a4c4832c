"""Pages cut into what a reader sees, what is hidden and comments.

A page becomes a flat list of marks: opening and closing tags, pieces of text,
comments.  From the marks each element gets a span (the places of its opening and
closing mark); spans are nested or apart, so what is hidden is the union of the
outermost spans with a reason, and every piece of text is placed by comparing its
place with them.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import functions as F, types as T

from . import fixed

_BLOCKS, _VOIDS = frozenset(fixed.BLOCK_TAGS), frozenset(fixed.VOID_TAGS)
_STYLES = [(name, re.compile(pattern)) for name, pattern in fixed.HIDING_STYLES]
_BOX, _OVERFLOW = re.compile(fixed.ZERO_BOX), re.compile(fixed.OVERFLOW_HIDDEN)


@lru_cache(65_536)
def why_hidden(tag: str, bare: bool, kind: str, style: str, classes: str) -> str | None:
    """The first reason in the order of the rules; pages repeat few combinations, so each is judged once."""
    listed = sorted(c for c in fixed.HIDING_CLASSES if c in classes.lower().split())
    reasons = {f"<{tag}>": tag in fixed.NON_CONTENT_TAGS, "hidden attribute": bare, "type=hidden": kind.lower() == "hidden"}
    reasons |= {name: pattern.search(style) for name, pattern in _STYLES}
    reasons |= {"zero-size box": _BOX.search(style) and _OVERFLOW.search(style)} | {f"class={c}": True for c in listed}
    return next((reason for reason, holds in reasons.items() if holds), None)


class _Marks(HTMLParser):
    """The marks of a page in order, as columns."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.kind, self.value, self.reason = bytearray(), [], []
        self.feed(html)
        self.close()

    def _add(self, kind: bytes, value: str, reason: str | None = None):
        self.kind += kind
        self.value.append(value)
        self.reason.append(reason)

    def handle_starttag(self, tag, attrs):
        own = dict(attrs)
        if tag == "img" and own.get("alt"):
            self._add(b"a", f" {own['alt']} ")
        plain = [own.get(name) or "" for name in ("type", "style", "class")]
        self._add(b"(", tag, None if tag in _VOIDS else why_hidden(tag, "hidden" in own, *plain))

    def handle_endtag(self, tag):
        self._add(b")", tag)

    def handle_data(self, data):
        self._add(b"t", data)

    def handle_comment(self, data):
        self._add(b"c", data)


def _spans(kind: bytes, value: list[str]) -> tuple[np.ndarray, set[int]]:
    """(closing place of every opening mark, closing marks that close something).

    A closing tag ends the nearest open element of its name and all that were opened after it; what is never closed ends
    with the page.
    """
    end = np.full(len(kind), len(kind))
    chain: list[int] = []  # places of open elements
    by_name: dict[str, list[int]] = {}  # depths of open elements of each name
    used = set()
    for place, (k, name) in enumerate(zip(kind, value, strict=True)):
        if k == 40 and name not in _VOIDS:
            by_name.setdefault(name, []).append(len(chain))
            chain.append(place)
        elif k == 41 and name not in _VOIDS and by_name.get(name):
            depth = by_name[name][-1]
            for closed in chain[depth:]:
                by_name[value[closed]].pop()
                end[closed] = place
            del chain[depth:]
            used.add(place)
    return end, used


def _calm(text: str) -> str:
    """Blanks within lines collapsed, at most one blank line between lines."""
    lines = "\n".join(re.sub(r"[ \t\f\v]+", " ", line).strip() for line in text.splitlines())
    return re.sub(r"\n{3,}", "\n\n", lines).strip()


def split_page(html: str | None) -> dict:
    """visible text, hidden elements (reason, tag, text; outermost ones with text to read) and comments."""
    marks = _Marks(html or "")
    end, used = _spans(marks.kind, marks.value)
    # outermost hidden spans: opened after all that came before have ended
    hidden, free = [], -1
    for place in (i for i, reason in enumerate(marks.reason) if reason):
        if place >= free:
            free = int(end[place])
            hidden.append(place)
    cover = np.zeros(len(marks.kind) + 1, np.int32)
    for n, place in enumerate(hidden, 1):
        cover[place + 1 : end[place]] = n  # the marks themselves stand outside
    texts: list[list[str]] = [[] for _ in range(len(hidden) + 1)]
    for place, (k, value) in enumerate(zip(marks.kind, marks.value, strict=True)):
        if k == 116:
            texts[cover[place]].append(value)
        elif k == 97 and not cover[place]:
            texts[0].append(value)
        elif value in _BLOCKS and (k == 40 or place in used):
            texts[cover[place]].append("\n")
    found = [{"reason": marks.reason[p], "tag": marks.value[p], "text": " ".join("".join(t).split())} for p, t in zip(hidden, texts[1:], strict=True)]
    remarks = [" ".join(v.split()) for k, v in zip(marks.kind, marks.value, strict=True) if k == 99]
    return {"visible": _calm("".join(texts[0])), "hidden": [x for x in found if x["text"] and x["tag"] not in fixed.SILENT_TAGS], "comments": [r for r in remarks if r]}


_HIDDEN = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("reason", "tag", "text")]))
_PARTS = T.StructType([T.StructField("visible", T.StringType()), T.StructField("hidden", _HIDDEN), T.StructField("comments", T.ArrayType(T.StringType()))])


@F.pandas_udf(_PARTS)
def page_parts(html: pd.Series) -> pd.DataFrame:
    """visible text, hidden elements and comments of a page."""
    return pd.DataFrame([split_page(x) for x in html], columns=["visible", "hidden", "comments"])
