"""Files as text: paragraphs from boxes, hidden spans, pluggable readers and OCR; libraries are optional."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import _c, flatten

READERS: dict[str, Callable[[bytes], str]] = {}


def register_reader(kind: str, read: Callable[[bytes], str]) -> None:
    """Add a reader of bytes for pdf or image (OCR), run inside an Arrow UDF."""
    READERS[kind] = read


def decode_text(data: bytes) -> str:
    for encoding in ("utf-8", "utf-16"):
        try:
            return data.decode(encoding)
        except UnicodeDecodeError:
            pass
    return data.decode("utf-8", "replace")


def is_docx(data: bytes) -> bool:
    try:
        return "word/document.xml" in zipfile.ZipFile(io.BytesIO(data)).namelist()
    except zipfile.BadZipFile:
        return False


def read_docx(data: bytes) -> str:
    """Paragraphs that are not empty, with blank lines between them, from the archive itself."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    tree = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
    paragraphs = ("".join(t.text or "" for t in p.iter(f"{w}t")).strip() for p in tree.iter(f"{w}p"))
    return "\n\n".join(p for p in paragraphs if p)


def file_text(kind, data) -> Column:
    """struct of text and status (ok, no_text, no_reader, error) of files."""

    @F.pandas_udf("text string, status string")
    def read(kinds: pd.Series, files: pd.Series) -> pd.DataFrame:
        out = []
        for k, raw in zip(kinds, files, strict=True):
            own = {"docx": read_docx, "text": decode_text, "web": decode_text, **READERS}.get(k)
            try:
                text = own(bytes(raw)) if own else None
                out.append((text, "no_reader" if own is None else "ok" if (text or "").strip() else "no_text"))
            except Exception:  # noqa: BLE001  a bad file is a row's status, not the query's end
                out.append((None, "error"))
        return pd.DataFrame(out, columns=["text", "status"])

    return read(_c(kind), _c(data))


def data_uri(data, mime) -> Column:
    return F.concat(F.lit("data:"), _c(mime), F.lit(";base64,"), F.base64(_c(data)))


def norm_rect(rect, page) -> Column:
    """A rectangle [x0, y0, x1, y1] in parts of its page, within [0, 1], to four places."""
    r, p = _c(rect), _c(page)
    w, h = (F.when(p[i + 2] == p[i], F.lit(1.0)).otherwise(p[i + 2] - p[i]) for i in (0, 1))
    return F.array(*[F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (r[i] - p[i % 2]) / (w if i % 2 == 0 else h))), 4) for i in range(4)])


def join_paragraphs(boxes: DataFrame, doc: str = "doc", page: str = "page") -> DataFrame:
    """doc, page, para, text from boxes (seq, text, x0, y0, y1, height): a box goes on the paragraph before it if it
    lies closely below, its lines are about as high and it begins at the same edge; a hyphen at a line's end is kept."""
    order = Window.partitionBy(doc, page).orderBy("seq")
    before = {c: F.lag(c).over(order) for c in ("x0", "y1", "height")}
    gap = F.col("y0") - before["y1"]
    goes_on = (gap > -0.5 * before["height"]) & (gap < 0.3 * before["height"]) & (F.abs(F.col("height") - before["height"]) < 1.5) & (F.abs(F.col("x0") - before["x0"]) < 3)
    placed = boxes.withColumn("_new", (~F.coalesce(goes_on, F.lit(False))).cast("int")).withColumn("para", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    parts = placed.groupBy(doc, page, "para").agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("p"))
    joined = F.aggregate("p", F.lit(""), lambda a, x: F.when(a == "", x["text"]).when(F.endswith(a, F.lit("-")), F.concat(a, x["text"])).otherwise(F.concat(a, F.lit(" "), x["text"])))
    return parts.select(doc, page, "para", flatten(joined).alias("text"))


def merge_hidden_spans(spans: DataFrame, doc: str = "doc") -> DataFrame:
    """Neighbouring hidden spans of the same page, block and reason as one finding."""
    order = Window.partitionBy(doc).orderBy("seq")
    same = F.lit(True)
    for c in ("page", "block", "reason"):
        same = same & F.col(c).eqNullSafe(F.lag(c).over(order))
    placed = spans.withColumn("_new", (~same | (F.row_number().over(order) == 1)).cast("int")).withColumn("run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    out = placed.groupBy(doc, "run", "page", "block", "reason").agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("p"))
    return out.select(doc, "run", "page", "block", "reason", flatten(F.array_join(F.transform("p", lambda x: x["text"]), " ")).alias("text"))


def locate(snippet, page_texts) -> Column:
    """The first page (from 1) whose flattened text holds the snippet, its first 70 or its first 35 characters; 0 if none."""
    s, pages = flatten(snippet), _c(page_texts)
    at = lambda probe: F.array_position(F.transform(pages, lambda p: F.contains(flatten(p), probe)), True)
    whole, long, short = at(s), at(F.substring(s, 1, 70)), at(F.substring(s, 1, 35))
    return F.when(whole > 0, whole).when(long > 0, long).otherwise(short)
