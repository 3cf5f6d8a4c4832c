"""Policy rules as column expressions; the state they read comes from streaming.adaptive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..config import LEVELS, DefenseConfig
from .text import _c
from .trust import band


def _rank(level) -> Column:
    return F.array_position(F.array(*map(F.lit, LEVELS)), _c(level))


def max_level(*levels) -> Column:
    return F.element_at(F.array(*map(F.lit, LEVELS)), F.greatest(*[_rank(x) for x in levels]).cast("int"))


def source_level(config: DefenseConfig, suspicion) -> Column:
    s = F.coalesce(_c(suspicion), F.lit(0.0))
    return F.when(s >= config.high_at, "high").when(s >= config.elevated_at, "elevated").otherwise("normal")


def tool_level(config: DefenseConfig, tool) -> Column:
    out = F.lit("normal")
    for name, level in config.min_level_by_tool.items():
        out = F.when(_c(tool) == name, level).otherwise(out)
    return out


def level(config: DefenseConfig, suspicion, session_alert, tool) -> Column:
    """The highest of the source's level, elevated while the session is on alert, and the tool's least level."""
    if not config.adaptive:
        return F.lit("normal")
    return max_level(source_level(config, suspicion), F.when(F.coalesce(_c(session_alert), F.lit(0)) > 0, "elevated").otherwise("normal"), tool_level(config, tool))


def effective_thresholds(config: DefenseConfig, accept, reject, level) -> Column:
    """struct of accept_below, reject_at_or_above after the level's shift."""
    shift = F.lit(0.0)
    for name, by in config.level_shift.items():
        shift = F.when(_c(level) == name, F.lit(float(by))).otherwise(shift)
    a = F.greatest(F.lit(config.min_accept_below), _c(accept) - shift)
    r = F.least(F.lit(1.0), F.greatest(a + config.min_threshold_gap, _c(reject) - shift))
    return F.struct(a.alias("accept_below"), r.alias("reject_at_or_above"))


def with_blocked(df: DataFrame, blocklist: DataFrame, key: str, out: str) -> DataFrame:
    """df with R1 where its host is on a blocklist that is a table of any size."""
    listed = blocklist.select(F.col(key).alias("_listed")).where("_listed is not null").distinct()
    met = df.join(listed, F.lower(key) == F.lower("_listed"), "left")
    return met.withColumn(out, F.when(F.col("_listed").isNotNull(), "R1")).drop("_listed")


def pre_check(config: DefenseConfig, domain, quarantined) -> Column:
    """R1 or R2 where a response is turned away before any detector runs, else null."""
    listed = F.lower(_c(domain)).isin(*config.blocklist) if config.blocklist else F.lit(False)
    return F.when(F.coalesce(listed, F.lit(False)), "R1").when(F.coalesce(_c(quarantined), F.lit(False)) & F.lit(config.adaptive), "R2")


def decide(config: DefenseConfig, risk, accept, reject, level, pattern_score, concealed, obfuscated, domain, no_evidence: str = "SANITIZE") -> Column:
    """struct of action, threat (before salvage), base_action, accept_below, reject_at_or_above, salvaged, rules."""
    own = effective_thresholds(config, accept, reject, level)
    first = band(risk, own["accept_below"], own["reject_at_or_above"], no_evidence)
    evidence = (_c(pattern_score) >= config.escalate_pattern_score) | F.coalesce(_c(concealed), F.lit(False))
    if config.escalate_on_obfuscation:
        evidence = evidence | F.coalesce(_c(obfuscated), F.lit(False))
    raised = (first == "ACCEPT") & F.coalesce(evidence, F.lit(False))
    threat = F.when(raised, "SANITIZE").otherwise(first)
    can = {"always": F.lit(True), "never": F.lit(False), "normal_level": _c(level) == "normal"}[config.salvage_rejects]
    salvaged = (threat == "REJECT") & _c(domain).isin(*config.salvage_domains) & can
    rules = F.filter(F.array(F.when(_c(level) != "normal", F.lit("R3")), F.lit("R4"), F.when(raised, F.lit("R5")), F.when(salvaged, F.lit("R6"))), lambda x: x.isNotNull())
    return F.struct(
        F.when(salvaged, "SANITIZE").otherwise(threat).alias("action"), threat.alias("threat"), F.when(_c(risk).isNull(), no_evidence).otherwise(band(risk, accept, reject, no_evidence)).alias("base_action"),
        own["accept_below"].alias("accept_below"), own["reject_at_or_above"].alias("reject_at_or_above"), salvaged.alias("salvaged"), rules.alias("rules"),
    )


def post_check(config: DefenseConfig, action, salvaged, accept, reject, residual, remaining_chars, removed) -> Column:
    """The action after sanitising: REJECT if nothing is left or too much risk remains."""
    found = {"spec": F.lit(True), "lenient": F.lit(False), "evidence_aware": _c(removed) > 0}[config.post_check_mode]
    limit = F.when(_c(salvaged) | found, _c(accept)).otherwise(_c(reject))
    return F.when(_c(remaining_chars) == 0, "REJECT").when(_c(residual).isNull(), _c(action)).when(_c(residual) >= limit, "REJECT").otherwise(_c(action))


def verdict(config: DefenseConfig, model_score, pattern_score, cues=None, gated: bool = False) -> Column:
    """removed, flagged or retained for one segment; a gate keeps what only the model objects to and no cue supports."""
    score = F.greatest(_c(pattern_score), F.coalesce(_c(model_score), F.lit(0.0)))
    only_model = (_c(pattern_score) <= config.segment_remove_above) & (F.size(_c(cues)) == 0) if gated else F.lit(False)
    return F.when((score > config.segment_remove_above) & ~only_model, "removed").when(score >= config.segment_retain_below, "flagged").otherwise("retained")


def notice(config: DefenseConfig, action, removed, hidden) -> Column:
    """What the agent is told beside the content; a caution where nothing was taken out."""
    nothing = (F.coalesce(_c(removed), F.lit(0)) == 0) & (F.coalesce(_c(hidden), F.lit(0)) == 0)
    return F.when(_c(action) == "REJECT", config.reject_notice).when((_c(action) == "SANITIZE") & nothing, config.caution_notice).when(_c(action) == "SANITIZE", config.sanitize_notice)


def agent_view(action, content, told) -> Column:
    return F.when(_c(action) == "REJECT", _c(told)).when(_c(action) == "SANITIZE", F.concat_ws("\n\n", _c(content), _c(told))).otherwise(_c(content))
