"""Model predictions for every modality in one plan, and the trust that follows from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..config import TrustConfig
from ..functions import detect, trust
from ..functions.text import strip
from ..operators import datasets as ds

CUT_OFF = 0.5


def _score(df: DataFrame, text: str, out: str, scorer: str) -> DataFrame:
    """df with `out`, the scorer's probability of a text; null where the text is null."""
    if scorer in detect.IN_ROW:
        return df.withColumn(out, detect.SCORERS[scorer](F.col(text)))
    some = detect.score_distinct(df.where(F.col(text).isNotNull()), text, out, scorer)
    return some.unionByName(df.where(F.col(text).isNull()).withColumn(out, F.lit(None).cast("double")))


def predict(records: DataFrame, text_scorer: str = "keyword", image_scorer: str = "hash") -> DataFrame:
    """records with `result`, what the model of their modality says.

    records hold domain, text, user_intent, image_path and ocr_text.  A PDF is judged by
    its standard text with the intent, a page by its own, an image by its picture
    and, where words were read in it, by those too.  Probabilities have four
    places; the prediction is 1 from 0.5 up.  A missing text has no probability.
    """
    d, image = F.col("domain"), F.col("domain") == "image"
    words = F.when(strip(F.coalesce("ocr_text", F.lit(""))) != "", strip(F.col("ocr_text")))
    body = F.when(d == "pdf", ds.pdf_text(F.coalesce("user_intent", F.lit("")), strip(F.col("text")))).when(d == "web", ds.web_text("text")).when(image, F.when(words.isNotNull(), ds.image_text(words))).otherwise(F.col("text"))
    df = records.withColumn("_body", F.when(image | F.col("text").isNotNull(), body)).withColumn("_picture", F.when(image, F.col("image_path")))
    df = _score(_score(df, "_body", "_t", text_scorer), "_picture", "_v", image_scorer)
    t, v = F.round("_t", 4), F.round("_v", 4)
    own = F.when(image, v).otherwise(t)
    made = F.struct(
        "domain", own.alias("malicious_probability"), (own >= CUT_OFF).cast("int").alias("prediction"), F.when(~image, F.col("text")).alias("content"),
        F.struct(words.isNotNull().alias("has_text"), F.when(image, t).alias("malicious_probability"), F.when(image, words).alias("extracted_text")).alias("text_branch"), F.struct(v.alias("malicious_probability")).alias("visual_branch"),
    )
    return df.withColumn("result", made).drop("_body", "_picture", "_t", "_v")


def assess_predictions(predicted: DataFrame, config: TrustConfig | None = None, alignment: str | None = None) -> DataFrame:
    """predicted with `signals` (what counts of `result`) and `trust` (risk, trust, decision); alignment names a column."""
    df = predicted.withColumn("signals", trust.model_signals(F.col("result")))
    a = F.col(alignment) if alignment else F.lit(None).cast("double")
    return trust.with_assessment(df, config or TrustConfig(), "trust", "domain", "signals.text_threat", "signals.visual_threat", a, F.col("signals.has_text"))
