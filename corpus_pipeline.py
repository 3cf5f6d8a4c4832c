"""The corpus pipeline: five stages over documents, each the input of the next.

language_id    rejects documents in which no language can be told (no letter); where lang is null, what was predicted stands there
line_dedup     takes out repeated windows of three lines; a document that loses every line goes
minhash_dedup  keeps the document of smallest id of each group of near copies (five words, 0.8)
mix_sources    repeats or leaves out documents so that sources come to their weights
bpe            adds token ids, their number and the round trip's digest

Every stage takes null, empty and very long texts, repeated rows and further
columns, whatever their names; an empty table stays empty.  All but the last
return the columns they got.  Where no row has a language to learn from, none is
predicted and none is rejected for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidegate.llm import bpe, langid, linededup, minhash, mixing
from tidegate.llm.common import fresh, load, table

#: The rows of run() hold predictions of a trained model and token ids, which SQL can't express.
ORACLE_SQL = None

_OWN = ("doc_id", "text", "lang", "source")


def _narrow(docs: DataFrame) -> DataFrame:
    """The columns that operators read, and all others in one struct, so that no name clashes."""
    rest = [c for c in docs.columns if c not in _OWN]
    return docs.select(*[c for c in docs.columns if c in _OWN], F.struct(F.lit(0).alias(fresh(docs, "none")), *rest).alias("rest"))


def _wide(rows: DataFrame, docs: DataFrame, **changed) -> DataFrame:
    """The columns of docs again, some of them changed."""
    now = lambda c: changed[c] if c in changed else F.col(c) if c in _OWN else F.col("rest")[c]
    return rows.select(*[now(c).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    told = langid.identify(_narrow(docs)).where("n_letters > 0")
    lang = F.coalesce("lang", F.when(F.col("lang_pred") != "und", F.col("lang_pred")))
    return _wide(told, docs, lang=lang)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(_narrow(docs)).where("n_removed = 0 or n_removed < n_lines")
    chars = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("rest.n_chars")) if "n_chars" in docs.columns else None
    return _wide(out, docs, text=F.col("text"), n_chars=chars)


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without an id all stay.  Rows that share an id are told apart, so that different texts under one id stay."""
    keyed = docs.where("doc_id is not null")
    repeated = keyed.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    if not repeated.take(1):
        kept = minhash.near_duplicates(keyed.select("doc_id", "text")).where("kept").select(F.col("doc_id").alias("kept_id"))
        met = _narrow(keyed).join(kept, F.col("doc_id").cast("long") == F.col("kept_id"), "left_semi")
    else:
        rows = table(_narrow(keyed).withColumn("nth_row", F.monotonically_increasing_id()), "numbered")
        groups = minhash.near_duplicates(rows, id_col="nth_row").select("nth_row", "component_id")
        first = rows.select("nth_row", "doc_id").join(groups, "nth_row").groupBy("component_id").agg(F.min(F.struct("doc_id", "nth_row")).alias("first"))
        met = rows.join(first.select(F.col("first.nth_row").alias("nth_row")), "nth_row", "left_semi")
    return _wide(met, docs).unionByName(docs.where("doc_id is null"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _narrow(docs)
    return _wide(mixing.expand_mix(rows, mixing.mix_sources(rows)), docs)


def bpe_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_texts(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True, keep=tuple(docs.columns))


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("minhash_dedup", minhash_dedup), ("mix_sources", mix_sources), ("bpe_encode", bpe_encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written to the shared folder for the next."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
