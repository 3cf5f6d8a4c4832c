"""Line dedup by overlapping windows of three lines.

A text's lines are cut at newlines; blank lines stand outside windows and stay.
Three consecutive lines of a document, each without white space around it, make
one window, known by a hash of 128 bits.  A window's first occurrence is the one
in the smallest document, earliest in it; every later occurrence covers its three
lines, and covered lines go.  A line that the first occurrence of the same window
covers in the same document stays, so a document's own repeats never erase
themselves.

All steps are DataFrame operations: windows are combined by hash before the
shuffle, and only windows that occur again are joined back.  Work on a document
grows in proportion to its lines.

Defined cases: null texts stay null; texts of fewer than three lines lose nothing;
very long texts and texts of very many lines are read whole; rows without an id
are neither changed nor counted; rows that share an id are told apart by their
text, and of equal rows each keeps the same lines; columns named n_lines and
n_removed are replaced, all others stay as they are whatever their names; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import fresh

LINES = 3


def _solid(text):
    """(s, pos) of each line that is not blank: without white space around it, and its place among all lines."""
    lines = F.transform(F.split(text, "\n"), lambda s, i: F.struct(F.regexp_replace(s, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "").alias("s"), i.alias("pos")))
    return F.filter(lines, lambda x: x["s"] != "")


def _covered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, t, gone: places of lines that go."""
    base = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("t"), _solid(F.col(text_col)).alias("w"))
    starts = F.sequence(F.lit(0), F.size("w") - LINES)
    line = lambda i, k: F.col("w")[i + k]
    window = lambda i: F.struct(
        F.xxhash64(*[line(i, k)["s"] for k in range(LINES)]).alias("h"), F.xxhash64(F.lit("again"), *[line(i, k)["s"] for k in reversed(range(LINES))]).alias("h2"), F.array(*[line(i, k)["pos"] for k in range(LINES)]).alias("pos")
    )
    windows = base.where(F.size("w") >= LINES).select("id", "t", F.posexplode(F.transform(starts, window)).alias("at", "x")).select("id", "t", "at", "x.*")
    first = windows.groupBy("h", "h2").agg(F.min(F.struct("id", "t", "at")).alias("first"), F.count("*").alias("n")).where("n > 1").select("h", "h2", "first")
    same = (F.col("id") == F.col("first.id")) & (F.col("t") == F.col("first.t"))
    later = windows.join(first, ["h", "h2"]).where(~same | (F.col("at") > F.col("first.at")))
    # lines that the first occurrence covers, where both overlap
    own = F.when(same, F.greatest(F.lit(0), F.col("first.at") + LINES - F.col("at"))).otherwise(0)
    spans = later.select("id", "t", F.slice("pos", own + 1, F.lit(LINES)).alias("pos"))
    return spans.groupBy("id", "t").agg(F.array_distinct(F.flatten(F.collect_list("pos"))).alias("gone"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with repeated windows taken out of the text, and the columns n_lines (not blank), n_removed."""
    i, t, g = (fresh(docs, n) for n in ("id", "t", "gone"))
    gone = _covered(docs, id_col, text_col).withColumnsRenamed({"id": i, "t": t, "gone": g})
    met = docs.join(gone, (F.col(id_col).cast("long") == F.col(i)) & (F.xxhash64(text_col) == F.col(t)), "left")
    # a lambda's variable is made once; a column would be cut into lines again for every line
    left = lambda lines: F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(g)), lambda p: lines[p])
    text = F.when(F.col(g).isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(F.array(F.split(text_col, "\n")), left)[0], "\n"))
    lines = F.coalesce(F.regexp_count(text_col, F.lit(r"[^\x20\x09-\x0D][^\n]*")), F.lit(0)).cast("long")  # one match in each line that is not blank
    return met.withColumns({text_col: text, "n_lines": lines, "n_removed": F.coalesce(F.size(F.col(g)), F.lit(0)).cast("long")}).drop(i, t, g)
