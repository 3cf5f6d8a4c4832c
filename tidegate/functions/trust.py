"""Trust: fuse threats, adjust by alignment, decide.  Null is missing evidence throughout, never zero."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..config import TrustConfig
from .text import _c


def clean_probability(x, name: str = "score") -> Column:
    """NaN becomes null; a value outside [0, 1] stops the query."""
    v = F.when(F.isnan(_c(x).cast("double")), None).otherwise(_c(x).cast("double"))
    return F.when((v < 0) | (v > 1), F.raise_error(F.concat(F.lit(f"{name} outside [0, 1]: "), v.cast("string"))).cast("double")).otherwise(v)


#: Fusion rules over an array of (w, s) that is not empty; register more by name.
FUSIONS: dict[str, Callable[[Column], Column]] = {
    "noisy_or": lambda items: 1 - F.aggregate(items, F.lit(1.0), lambda p, x: p * (1 - x["w"] * x["s"])),
    "max": lambda items: F.array_max(F.transform(items, lambda x: x["w"] * x["s"])),
    "weighted_mean": lambda items: F.coalesce(F.try_divide(F.aggregate(items, F.lit(0.0), lambda a, x: a + x["w"] * x["s"]), F.aggregate(items, F.lit(0.0), lambda a, x: a + x["w"])), F.lit(0.0)),
}


def fuse(text_threat, visual_threat, w_text=1.0, w_visual=1.0, mode: str = "noisy_or") -> Column:
    """The fused threat of the signals that are there, in [0, 1]; null if there are none."""
    lit = lambda w: w if isinstance(w, Column) else F.lit(float(w))
    items = F.filter(F.array(F.struct(lit(w_text).alias("w"), _c(text_threat).alias("s")), F.struct(lit(w_visual).alias("w"), _c(visual_threat).alias("s"))), lambda x: x["s"].isNotNull())
    return F.when(F.size(items) > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), FUSIONS[mode](items))))


def signals_used(text_threat, visual_threat) -> Column:
    return F.filter(F.array(F.when(_c(text_threat).isNotNull(), F.lit("text")), F.when(_c(visual_threat).isNotNull(), F.lit("visual"))), lambda x: x.isNotNull())


def contextual_risk(fused, alignment, weight=0.5) -> Column:
    """R = B + weight (1 - A) B (1 - B), at most 1; without alignment R = B."""
    b, a = _c(fused), F.coalesce(_c(alignment), F.lit(1.0))
    return F.when(b.isNotNull(), F.least(F.lit(1.0), b + weight * (1 - a) * b * (1 - b)))


def trust_from_risk(risk) -> Column:
    return 1 - _c(risk)


def band(risk, accept_below, reject_at_or_above, no_evidence: str = "SANITIZE") -> Column:
    lit = lambda w: w if isinstance(w, Column) else F.lit(float(w))
    return F.when(_c(risk).isNull(), no_evidence).when(_c(risk) < lit(accept_below), "ACCEPT").when(_c(risk) >= lit(reject_at_or_above), "REJECT").otherwise("SANITIZE")


def per_domain(config: TrustConfig, domain, name: str) -> Column:
    """A setting as a column: the modality's own value where its profile has one."""
    out = F.lit(float(getattr(config, name)))
    for own in config.profiles:
        out = F.when(_c(domain) == own, F.lit(float(getattr(config.resolve(own), name)))).otherwise(out)
    return out


def combined_alignment(task, reference, w_task: float = 0.7, w_reference: float = 0.3) -> Column:
    """Weighted mean of the alignments that are there; null if none is."""
    items = F.filter(F.array(F.struct(F.lit(w_task).alias("w"), _c(task).alias("s")), F.struct(F.lit(w_reference).alias("w"), _c(reference).alias("s"))), lambda x: x["s"].isNotNull())
    return F.try_divide(F.aggregate(items, F.lit(0.0), lambda a, x: a + x["w"] * x["s"]), F.aggregate(items, F.lit(0.0), lambda a, x: a + x["w"]))


def assess(config: TrustConfig, domain, text_threat, visual_threat, alignment=None, has_text=None) -> Column:
    """struct of text_threat, visual_threat, alignment, fused, uplift, risk, trust, decision, signals, accept_below, reject_at_or_above.

    Where has_text is false, the text score and the alignment don't count.
    """
    can_read = F.coalesce(has_text, F.lit(True)) if has_text is not None else F.lit(True)
    t = F.when(can_read, clean_probability(text_threat, "text_threat"))
    v = clean_probability(visual_threat, "visual_threat")
    a = F.when(can_read, clean_probability(alignment, "alignment")) if alignment is not None else F.lit(None).cast("double")
    own = {n: per_domain(config, domain, n) for n in ("w_text", "w_visual", "align_lambda", "accept_below", "reject_at_or_above")}
    fused = fuse(t, v, own["w_text"], own["w_visual"], config.fusion_mode)
    risk = contextual_risk(fused, a, own["align_lambda"])
    return F.struct(
        t.alias("text_threat"), v.alias("visual_threat"), a.alias("alignment"), fused.alias("fused"), (risk - fused).alias("uplift"), risk.alias("risk"), trust_from_risk(risk).alias("trust"),
        band(risk, own["accept_below"], own["reject_at_or_above"], config.no_evidence_decision).alias("decision"), signals_used(t, v).alias("signals"), own["accept_below"].alias("accept_below"), own["reject_at_or_above"].alias("reject_at_or_above"),
    )


def with_assessment(df: DataFrame, config: TrustConfig, out: str, domain, text_threat, visual_threat, alignment, has_text) -> DataFrame:
    """assess as a column `out` of df, step by step, so that no step's expression is repeated inside the next."""
    d = _c(domain)
    df = df.withColumns({"_t": F.when(has_text, clean_probability(text_threat, "text_threat")), "_v": clean_probability(visual_threat, "visual_threat"), "_a": F.when(has_text, clean_probability(alignment, "alignment"))})
    df = df.withColumns({f"_{n}": per_domain(config, d, n) for n in ("w_text", "w_visual", "align_lambda", "accept_below", "reject_at_or_above")})
    df = df.withColumn("_fused", fuse("_t", "_v", F.col("_w_text"), F.col("_w_visual"), config.fusion_mode))
    df = df.withColumn("_risk", contextual_risk("_fused", "_a", F.col("_align_lambda")))
    made = F.struct(F.col("_fused").alias("fused"), F.col("_risk").alias("risk"), (1 - F.col("_risk")).alias("trust"), band("_risk", F.col("_accept_below"), F.col("_reject_at_or_above"), config.no_evidence_decision).alias("decision"), F.col("_accept_below").alias("accept_below"), F.col("_reject_at_or_above").alias("reject_at_or_above"))
    return df.withColumn(out, made).drop("_t", "_v", "_a", "_fused", "_risk", "_w_text", "_w_visual", "_align_lambda", "_accept_below", "_reject_at_or_above")


def explain(config: TrustConfig, assessed) -> Column:
    """One sentence on why: the threats, the alignment and the band that decided."""
    x = _c(assessed)
    level = lambda s: F.when(s >= config.explain_high_threat, "high").otherwise("low")
    threat = lambda s, n: F.when(s.isNotNull(), F.format_string(f"%s {n} threat (%.2f)", level(s), s))
    a = x["alignment"]
    aligned = (
        F.when(a.isNull(), "alignment unknown")
        .when(a < config.explain_low_alignment, F.format_string("low task alignment (%.2f)", a))
        .when(a >= config.explain_high_alignment, F.format_string("high task alignment (%.2f)", a))
        .otherwise(F.format_string("moderate task alignment (%.2f)", a))
    )
    why = F.when(x["risk"] < x["accept_below"], F.format_string("risk %.2f is below %.2f", x["risk"], x["accept_below"])).when(x["risk"] >= x["reject_at_or_above"], F.format_string("risk %.2f is at least %.2f", x["risk"], x["reject_at_or_above"])).otherwise(F.format_string("risk %.2f lies from %.2f to %.2f", x["risk"], x["accept_below"], x["reject_at_or_above"]))
    said = F.concat_ws("; ", F.concat_ws(", ", threat(x["text_threat"], "text"), threat(x["visual_threat"], "visual")), aligned, why)
    return F.when(x["risk"].isNull(), F.concat(F.lit("no threat signal; fail-safe "), x["decision"])).otherwise(said)


def model_signals(result) -> Column:
    """(text_threat, visual_threat, content, has_text) from a model's nested output; for images the text score counts only with text."""
    x = _c(result)
    image = x["domain"] == "image"
    has_text = F.coalesce(x["text_branch"]["has_text"], F.lit(False))
    return F.struct(
        F.when(~image, x["malicious_probability"]).when(has_text, x["text_branch"]["malicious_probability"]).alias("text_threat"),
        F.when(image, x["visual_branch"]["malicious_probability"]).alias("visual_threat"),
        F.when(~image, x["content"]).when(has_text, x["text_branch"]["extracted_text"]).alias("content"),
        F.when(image, has_text).otherwise(True).alias("has_text"),
    )


def require_probability(result) -> Column:
    """Stops the query where a model's output has no probability."""
    x = _c(result)
    probe = F.when(x["domain"] == "image", x["visual_branch"]["malicious_probability"]).otherwise(x["malicious_probability"])
    return F.when(probe.isNull(), F.raise_error(F.lit("model output without malicious_probability")).cast("double")).otherwise(probe)
