"""Single texts as detectors read them, for Arrow batches: normal form, look-alikes, encoded payloads in place."""

from __future__ import annotations

import binascii
import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F, types as T

from . import fixed

_NARROW = re.compile(f"(?<=[A-Za-z0-9])[{fixed.ZERO_WIDTH}]+(?=[A-Za-z0-9])")
_NOISE = re.compile(f"[{fixed.BIDI}\U000e0000-\U000e007f\U000e0100-\U000e01ef]")
_UNSEEN = re.compile(f"[{fixed.INVISIBLE}]")
_UNSEEN_OR_BIDI = re.compile(f"[{fixed.INVISIBLE}{fixed.BIDI}]")
_LATIN = str.maketrans(*fixed.LOOK_ALIKES)
_RUN = re.compile(fixed.BASE64_RUN)


def plain_text(text: str) -> str:
    """Without obfuscation, in compatibility form, without any invisible character."""
    if text.isascii():
        return text
    return _UNSEEN.sub("", unicodedata.normalize("NFKC", _NARROW.sub("", _NOISE.sub("", text))))


def fold_text(text: str) -> str:
    """For matching only: compatibility form, no invisible characters, look-alikes as Latin."""
    return text if text.isascii() else _UNSEEN_OR_BIDI.sub("", unicodedata.normalize("NFKC", text)).translate(_LATIN)


def payload(run: str) -> str | None:
    """The text that a base64 run holds, if it is one for people to read."""
    try:
        text = binascii.a2b_base64(run, strict_mode=True).decode()
    except ValueError:
        return None
    part = lambda of: sum(map(of, text)) / max(1, len(text))
    long_enough = len(text) >= fixed.READABLE_LENGTH and " " in text
    return text if long_enough and part(str.isalpha) >= fixed.READABLE_LETTERS and part(lambda c: c.isprintable() or c in "\n\t") >= fixed.READABLE_PRINTABLE else None


def decode_text_inline(text: str) -> str:
    """Readable base64 runs replaced, in place, by what they hold between spaces."""
    pieces, last = [], 0
    for m in _RUN.finditer(text):
        held = payload(m[1])
        if held is not None:
            pieces += [text[last : m.start(1)], f" {held} "]
            last = m.end(1)
    return "".join([*pieces, text[last:]]) if pieces else text


@F.pandas_udf(T.StringType())
def decode_inline(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else decode_text_inline(x))


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))
