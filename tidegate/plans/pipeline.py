"""The triage of tool responses: wide stateless features, then a narrow ordered fold, then delivery.

Everything that reads text is stateless and parallel: content filter, windows,
scores, segments, sanitised text, residual risk.  None of it depends on the
session's level, so the fold sees a row of numbers for each response.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, functions as F

from ..config import MODALITIES, RUNTIME_TRUST, DefenseConfig, TrustConfig
from ..functions import detect, hosts, policy, scan, text as tx, trust
from ..functions.fixed import SIGNATURES as _SIGNATURES
from ..sources.tables import cut, discard
from ..streaming.adaptive import decide_in_order

SIGNATURES = tuple(_SIGNATURES)
#: The number of a response, given where its features are first written.
ROW = "_response"
RESPONSE = "seq long, session string, content string, modality string, tool_name string, source_url string, image_path string, visual_threat double, alignment double"


#: What a text is mostly equal to, in the order in which texts are put back.
COPIES = {"delivery_text": "content", "detection_lines": "delivery_text", "sanitised": "delivery_text"}


def without_copies(df: DataFrame) -> DataFrame:
    """df for a table: a text that is the same as the one it was made from is null there, and `_same_<text>` says so."""
    held = {t: w for t, w in COPIES.items() if t in df.columns}
    same = df.withColumns({f"_same_{t}": F.col(t).eqNullSafe(F.col(w)) for t, w in held.items()})
    return same.withColumns({t: F.when(~F.col(f"_same_{t}"), F.col(t)) for t in held})


def with_copies(df: DataFrame) -> DataFrame:
    """The inverse of without_copies()."""
    for t, w in COPIES.items():
        if t in df.columns:
            df = df.withColumn(t, F.when(F.col(f"_same_{t}"), F.col(w)).otherwise(F.col(t))).drop(f"_same_{t}")
    return df


def apart(df: DataFrame, name: str) -> DataFrame:
    """df, planned apart from what follows: each column is worked out once for a row, not wherever it is used.  Its rows are counted on the way; nothing is written."""
    return df.observe(f"{name}-{uuid.uuid4().hex}", F.count(F.lit(1)).alias("rows"))


def input_status(modality, image_path) -> Column:
    """ok, bad_modality or no_image_path; what isn't ok goes to a dead-letter table."""
    m = tx._c(modality)
    return F.when(m.isNull() | ~m.isin(*MODALITIES), "bad_modality").when((m == "image") & F.coalesce(tx._c(image_path), F.lit("")).isin(""), "no_image_path").otherwise("ok")


def filter_content(df: DataFrame, content: str = "content", modality: str = "modality") -> DataFrame:
    """df with delivery_text, detection_text, concealed_text, n_hidden, n_comments, obfuscated, is_html.

    The HTML parser runs on pages alone: they are split off before it.
    """
    page = (F.col(modality) == "web") & tx.looks_like_html(content)
    shown = df.where(page).withColumn("_p", tx.page_parts(content))
    shown = shown.withColumns({"_visible": F.col("_p.visible"), "_all": tx.strip_tags(content), "_hidden": F.transform("_p.hidden", lambda h: h["text"]), "_comments": F.col("_p.comments"), "is_html": F.lit(True)}).drop("_p")
    none = F.array().cast("array<string>")
    plain = df.where(~page).withColumns({"_visible": F.coalesce(content, F.lit("")), "_all": F.coalesce(content, F.lit("")), "_hidden": none, "_comments": none, "is_html": F.lit(False)})
    both = shown.unionByName(plain).withColumns({"_u": scan.unicode_parts("_visible"), "_f": scan.unicode_parts("_all")})
    both = both.withColumns({"_seen": F.col("_u.detection"), "detection_lines": F.col("_f.detection")})
    decoded = F.transform(tx.encoded_payloads("_seen"), lambda p: p["decoded"])
    parts = F.filter(F.concat("_hidden", "_comments", F.array("_f.smuggled"), decoded), lambda x: tx.strip(x) != "")
    out = both.withColumns(
        {
            "delivery_text": F.when(F.col("is_html"), tx.tidy("_u.delivery")).otherwise(F.col("_u.delivery")),
            "detection_text": tx.flatten("detection_lines"),
            "concealed_text": F.array_join(parts, "\n"),
            "n_hidden": F.size("_hidden"),
            "n_comments": F.size("_comments"),
            "obfuscated": F.col("_u.obfuscated") | F.col("_f.obfuscated"),
        }
    )
    return out.drop("_visible", "_all", "_hidden", "_comments", "_u", "_f", "_seen")


def _windows(flat, domain, config: DefenseConfig) -> Column:
    several = tx.token_windows(F.split(flat, " "), config.window_tokens, config.window_stride, config.max_windows)
    return F.when(tx._c(domain).isin(*config.window_domains), F.transform(several, lambda w: F.array_join(w, " "))).otherwise(F.array(flat))


def with_threat(df: DataFrame, key: str, text: str, domain: str, config: DefenseConfig, scorer: str, out: str) -> DataFrame:
    """df with the largest score over a text's windows; null without text.

    Column scorers run inside the row; for others windows become rows, equal ones
    are scored once, and the maximum is joined back.
    """
    if scorer in detect.IN_ROW:
        df = df.withColumn("_flat", tx.flatten(text)).withColumn("_windows", _windows(F.col("_flat"), domain, config))
        return df.withColumn(out, F.when(F.col("_flat") != "", F.array_max(F.transform("_windows", detect.SCORERS[scorer])))).drop("_flat", "_windows")
    df = cut(df, "threat")
    return df.join(text_threat(df, key, text, domain, config, scorer, out), key, "left")


def with_gated_threat(df: DataFrame, key: str, text: str, domain: str, config: DefenseConfig, scorer: str, out: str) -> DataFrame:
    """with_threat after the instruction gate: what only the model objects to and no cue supports is left out and the rest scored again."""
    df = with_threat(df, key, text, domain, config, scorer, "_raw")
    if not config.instruction_gate_domains or scorer not in detect.IN_ROW:
        return df.withColumnRenamed("_raw", out)
    df = df.withColumn("_segs", tx.viewed_segments(text, config.hard_split_chars, config.max_segments))
    df = df.withColumn("_scan", scan.segment_scores(F.transform("_segs", lambda s: s["folded"]), SIGNATURES, with_cues=True))
    doubt = lambda s, i: (detect.SCORERS[scorer](s["text"]) >= config.instruction_gate_min_score) & (F.col("_scan")[i]["p"] <= config.segment_remove_above) & ~F.col("_scan")[i]["cued"]
    df = df.withColumn("_parts", F.transform("_segs", lambda s, i: F.struct(s["text"].alias("text"), s["sep"].alias("sep"), (~doubt(s, i)).alias("keep"))))
    df = df.withColumns({"_left": F.exists("_parts", lambda s: ~s["keep"]), "_remainder": tx.reconstruct("_parts")})
    df = with_threat(df, key, "_remainder", domain, config, scorer, "_gated")
    gate = F.col(domain).isin(*config.instruction_gate_domains) & (F.col("_raw") >= config.min_accept_below) & F.col("_left")
    return df.withColumn(out, F.when(gate, F.least("_raw", F.coalesce("_gated", F.lit(0.0)))).otherwise(F.col("_raw"))).drop("_raw", "_segs", "_scan", "_parts", "_left", "_remainder", "_gated")


def text_threat(df: DataFrame, key: str, text: str, domain: str, config: DefenseConfig, scorer: str = "keyword", out: str = "t") -> DataFrame:
    """key and the largest score over overlapping windows; for other domains the whole text; null without text.

    Equal windows are scored once.
    """
    if scorer in detect.IN_ROW:
        return with_threat(df, key, text, domain, config, scorer, out).where(F.col(out).isNotNull()).select(key, out)
    flat = tx.flatten(text)
    rows = df.where(flat != "").select(key, F.explode(_windows(flat, domain, config)).alias("_w"))
    return detect.score_distinct(rows, "_w", "_s", scorer).groupBy(key).agg(F.max("_s").alias(out))


def with_sanitised(df: DataFrame, key: str, text: str, domain: str, config: DefenseConfig, scorer: str) -> DataFrame:
    """df with sanitised, n_segments, n_removed, n_flagged; column scorers run inside the row."""
    if scorer not in detect.IN_ROW or config.instruction_gate_domains:
        df = cut(df, "segments")
        return df.join(sanitise(df, key, text, domain, config, scorer), key, "left")
    use_model = tx._c(domain).isin(*config.segment_model_domains)
    df = df.withColumn("_segs", scan.scored_segments(text, SIGNATURES, config.hard_split_chars, config.max_segments)).withColumn("_use", use_model)
    score = lambda s: F.struct(s["text"].alias("text"), s["sep"].alias("sep"), s["p"].alias("p"), F.when(F.col("_use"), detect.SCORERS[scorer](s["view"])).alias("m"))
    df = df.withColumn("_scored", F.transform("_segs", score))
    df = df.withColumn("_judged", F.transform("_scored", lambda s: F.struct(s["text"].alias("text"), s["sep"].alias("sep"), policy.verdict(config, s["m"], s["p"]).alias("v"))))
    count = lambda v: F.size(F.filter("_judged", lambda s: s["v"] == v))
    kept = F.transform("_judged", lambda s: F.struct(s["text"].alias("text"), s["sep"].alias("sep"), (s["v"] != "removed").alias("keep")))
    return df.withColumns({"sanitised": tx.reconstruct(kept), "n_removed": count("removed"), "n_flagged": count("flagged"), "n_segments": F.size("_segs")}).drop("_segs", "_use", "_scored", "_judged")


def sanitise(df: DataFrame, key: str, text: str, domain: str, config: DefenseConfig, scorer: str = "keyword") -> DataFrame:
    """key, sanitised, n_segments, n_removed, n_flagged.  For scorers that are no columns segments are rows while they are scored, one array while they are joined."""
    if scorer in detect.IN_ROW and not config.instruction_gate_domains:
        return with_sanitised(df, key, text, domain, config, scorer).select(key, "sanitised", "n_segments", "n_removed", "n_flagged")
    parts = df.select(key, domain, F.posexplode(tx.segments(text, config.hard_split_chars, config.max_segments)).alias("pos", "seg"))
    view = tx.decode_inline(tx.detection_text(tx.unicode_report("seg.text")["delivery"]))
    parts = parts.withColumn("_view", view).withColumn("_pattern", detect.signature_score("_view"))
    scored = detect.score_distinct(parts, "_view", "_model", scorer)
    model = F.when(F.col(domain).isin(*config.segment_model_domains), F.col("_model"))
    gated = bool(config.instruction_gate_domains)
    cues = F.when(F.col(domain).isin(*config.instruction_gate_domains), detect.instruction_cues("_view")).otherwise(F.array(F.lit("off"))) if gated else None
    scored = scored.withColumn("_verdict", policy.verdict(config, model, "_pattern", cues, gated))
    listed = F.array_sort(F.collect_list(F.struct("pos", F.col("seg.text").alias("text"), F.col("seg.sep").alias("sep"), (F.col("_verdict") != "removed").alias("keep"))))
    return scored.groupBy(key).agg(tx.reconstruct(listed).alias("sanitised"), F.count("*").alias("n_segments"), F.count_if(F.col("_verdict") == "removed").alias("n_removed"), F.count_if(F.col("_verdict") == "flagged").alias("n_flagged"))


def features(responses: DataFrame, config: DefenseConfig, trust_config: TrustConfig, scorer: str = "keyword", steps: list[str] | None = None, texts: bool = True) -> DataFrame:
    """One row of statistics and texts for each response; nothing here depends on what came before it.

    With scorers inside rows a response goes through all steps at once and nothing is written.
    Others join on the response's number, so there are tables between the steps: each holds a
    text once and goes when the next one is written.
    steps: gets the path of the last one, for discard() after the features are written.
    texts: False leaves out the texts, which no decision reads.
    """
    steps, past = [] if steps is None else steps, []
    whole = scorer in detect.IN_ROW and not config.instruction_gate_domains
    number = F.monotonically_increasing_id()
    meta = hosts.metadata("source_url", "modality", "tool_name", "content")
    base = responses.select(*[c.split()[0] for c in RESPONSE.split(", ")]).withColumn("meta", meta).withColumn("key", hosts.source_key("meta.domain", "tool_name")).withColumn("domain", F.col("meta.domain")).drop("meta")
    base = base.withColumn("empty", F.coalesce(F.col("modality") != "image", F.lit(True)) & ~F.coalesce("content", F.lit("")).rlike(r"(?U)\S"))
    blank = ["seq", "session", "key", "domain", "modality", "tool_name", "source_url", "image_path", "empty"] + ["content"] * texts
    if whole:
        shown = filter_content(base.where("not empty")).drop("detection_text", "n_comments", "is_html", *["content"] * (not texts))
        full, nothing = apart(shown, "filtered"), base.where("empty").select(blank)
    else:  # numbered where it is written, so that a number stays what it is however often the table is read
        blank = [ROW, *blank]
        known = with_copies(cut(without_copies(filter_content(base).drop("detection_text").withColumn(ROW, number)), "filtered", past))
        full, nothing = known.where("not empty"), known.where("empty").select(blank)
    full = full.withColumn("detection_text", tx.flatten("detection_lines"))
    full = full.withColumns({"pattern": detect.signature_score("detection_text"), "hidden_pattern": detect.signature_score("concealed_text")})
    full = with_gated_threat(full, ROW, "detection_lines", "modality", config, scorer, "t")
    full = with_threat(full, ROW, "concealed_text", "modality", config, scorer, "hidden_t")
    full = full.withColumn("concealed", (F.col("concealed_text") != "") & ((F.col("hidden_pattern") >= config.concealed_pattern_threshold) | (F.coalesce("hidden_t", F.lit(0.0)) >= config.concealed_model_threshold)))
    full = trust.with_assessment(full, trust_config, "x", "modality", "t", "visual_threat", F.col("alignment"), F.col("detection_text") != "")
    full = full.withColumn("_hidden", F.col("concealed_text") != "").drop("detection_lines", "detection_text", "concealed_text", "n_comments", "is_html", "visual_threat")
    full = with_sanitised(full, ROW, "delivery_text", "modality", config, scorer)
    if whole:
        full = apart(full.drop("n_segments", "n_flagged", *["delivery_text"] * (not texts)), "sanitised")
    else:
        known = cut(without_copies(full).unionByName(nothing, allowMissingColumns=True), "sanitised", steps)
        discard(past)
        full, nothing = with_copies(known.where("not empty")), known.where("empty").select(blank)
    full = full.withColumn("_read", scan.scored_detection("sanitised", SIGNATURES)).withColumns({"_rest": F.col("_read.detection"), "p_post": F.col("_read.p")}).drop("_read")
    full = with_gated_threat(full, ROW, "_rest", "modality", config, scorer, "t_post")
    full = trust.with_assessment(full, trust_config, "y", "modality", "t_post", F.lit(None).cast("double"), F.col("alignment"), tx.strip(F.col("_rest")) != "")
    injection = F.greatest("t", "pattern", F.when(F.col("_hidden"), F.col("hidden_t")), F.when(F.col("_hidden"), F.col("hidden_pattern")))
    full = full.withColumns(
        {
            "risk": F.col("x.risk"), "accept": F.col("x.accept_below"), "reject": F.col("x.reject_at_or_above"), "injection": injection, "residual": F.when(F.col("y.risk").isNotNull(), F.greatest("y.risk", "p_post")), "post_trust": F.col("y.trust"), "trust": F.col("x.trust"),
            "evidence": (F.col("pattern") >= config.escalate_pattern_score) | F.col("concealed") | (F.col("obfuscated") & F.lit(config.escalate_on_obfuscation)), "remaining": F.length(tx.strip(F.coalesce("sanitised", F.lit("")))), "removed": F.coalesce("n_removed", F.lit(0)) + F.col("concealed").cast("int"),
        }
    )
    kept = [*blank, "risk", "accept", "reject", "evidence", "residual", "remaining", "removed", "trust", "post_trust", "injection", "n_hidden", "n_removed"] + ["delivery_text", "sanitised"] * texts
    every = full.select(kept).unionByName(nothing, allowMissingColumns=True)
    return every.withColumn(ROW, number) if whole else every


def _decided(responses: DataFrame, config: DefenseConfig, trust_config: TrustConfig, scorer: str, texts: bool) -> tuple[DataFrame, DataFrame]:
    """The features as a table, and what the fold decides on them."""
    steps: list[str] = []
    full = cut(without_copies(features(responses, config, trust_config, scorer, steps, texts)), "features")  # texts are read and judged once; the fold reads numbers
    discard(steps)
    alone = F.coalesce("session", F.concat(F.lit("\x00"), F.col(ROW).cast("string")))
    stats = full.select(ROW, "seq", alone.alias("session"), "key", "domain", "modality", F.col("tool_name").alias("tool"), "empty", "risk", "accept", "reject", "evidence", "residual", "remaining", "removed", F.lit(True).alias("ok"), F.lit(None).cast("string").alias("control"), F.lit(trust_config.no_evidence_decision).alias("no_evidence"))
    return full, decide_in_order(config, stats, row=ROW)


def decisions(responses: DataFrame, config: DefenseConfig | None = None, trust_config: TrustConfig = RUNTIME_TRUST, scorer: str = "keyword") -> DataFrame:
    """seq, key, action, threat, level, rules of triage()'s deliveries, for who needs no text: none is kept for it."""
    _, decided = _decided(responses, config or DefenseConfig(), trust_config, scorer, texts=False)
    return decided.select("seq", "key", "action", "threat", "level", "rules")


def triage(responses: DataFrame, config: DefenseConfig | None = None, trust_config: TrustConfig = RUNTIME_TRUST, scorer: str = "keyword") -> DataFrame:
    """Deliveries: seq, session, key, action, threat, level, rules, trust_score, injection_score, secure_content, agent_notice, original_source, image_forwarded, raw_content.

    One delivery for each response, whatever sessions number alike and whatever rows
    repeat: a response goes by a number of its own.  A response without a session is a
    session of its own; an empty table has no deliveries; further columns are ignored.
    """
    config = config or DefenseConfig()
    full, decided = _decided(responses, config, trust_config, scorer, texts=True)
    decided = decided.select(ROW, "action", "threat", "level", "rules")
    out = with_copies(full.join(decided, ROW))
    clean = F.contains("rules", F.lit("R7"))
    content = F.when(F.col("action") == "ACCEPT", F.coalesce("delivery_text", F.lit(""))).when(F.col("action") == "SANITIZE", F.col("sanitised")).otherwise("")
    told = policy.notice(config, "action", "n_removed", "n_hidden")
    image = F.col("modality") == "image"
    return out.select(
        "seq", "session", "key", "action", "threat", "level", "rules", F.round(F.when(F.col("action") == "SANITIZE", F.when(clean, F.col("post_trust")).otherwise(F.col("trust"))).otherwise(F.col("trust")) * 100, 2).alias("trust_score"),
        F.round("injection", 4).alias("injection_score"), content.alias("secure_content"), told.alias("agent_notice"), F.coalesce("source_url", "tool_name").alias("original_source"), F.when(image, F.col("action") == "ACCEPT").alias("image_forwarded"), F.col("content").alias("raw_content"),
    )


def inspect(spark, content: str | None, modality: str = "text", **known) -> dict:
    """One response, as a dict; for tools and tests, not for volume."""
    row = {"seq": 1, "session": "one", "content": content, "modality": modality} | known
    names = [f.split()[0] for f in RESPONSE.split(", ")]
    if unknown := set(row) - set(names):
        raise ValueError(f"unknown response fields: {sorted(unknown)}")
    if modality not in MODALITIES or (modality == "image" and not row.get("image_path")):
        raise ValueError("modality must be web, pdf, image or text; an image needs image_path")
    df = spark.createDataFrame([tuple(row.get(n) for n in names)], RESPONSE)
    return triage(df).first().asDict()


def guard(spark, modality: str = "text"):
    """Decorator: what a tool returns passes triage before its caller sees it."""

    def wrap(tool):
        def guarded(*args, **kwargs):
            got = inspect(spark, tool(*args, **kwargs), modality, tool_name=tool.__name__)
            return {"REJECT": got["agent_notice"], "SANITIZE": f"{got['secure_content']}\n\n{got['agent_notice']}"}.get(got["action"], got["secure_content"])

        return guarded

    return wrap
