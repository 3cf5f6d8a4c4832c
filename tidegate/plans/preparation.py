"""Queries of dataset work: reading, standard texts, filters, joins, samples, splits, reports."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import fixed
from ..functions.text import flatten, full_windows, token_windows
from ..operators import datasets as ds
from ..sources import documents as files, records as src
from .registry import load, query, scored

# ------------------------------------------------------------------ reading
LINES = """, jl AS (
  SELECT doc_id, CASE WHEN doc_id % 20 = 7 THEN '   ' WHEN doc_id % 50 = 9 THEN '{"label": 1, "text"' WHEN doc_id % 33 = 5 THEN '{"label":"1","text":' || to_json(text)::VARCHAR || ',"context":"c","source":"s"}'
    WHEN doc_id % 33 = 6 THEN '{"label":7,"text":"x","context":"c"}' WHEN doc_id % 33 = 7 THEN '{"label":true,"text":"","context":"c","user_intent":"i"}' WHEN doc_id % 33 = 8 THEN '{"text":"no label"}'
    ELSE '{"label":' || (doc_id % 2)::VARCHAR || ',"text":' || to_json(text)::VARCHAR || ',"context":' || to_json(source || chr(10) || text)::VARCHAR || ',"user_intent":"' || CASE WHEN doc_id % 3 = 0 THEN 'look' ELSE '' END || '","source":' || to_json(source)::VARCHAR || '}' END AS line
  FROM documents
), ln AS (SELECT *, TRY_CAST(line AS JSON) AS j FROM jl WHERE trim(line) <> '')"""


def lines(spark, d):
    """A JSON line of each whole document, some of them blank, broken or without a good label by rule."""
    i = F.col("doc_id")
    mod = lambda n, k: F.pmod(i, F.lit(n)) == k
    record = F.struct(F.pmod(i, F.lit(2)).alias("label"), "text", F.concat("source", F.lit("\n"), "text").alias("context"), F.when(mod(3, 0), "look").otherwise("").alias("user_intent"), "source")
    line = (
        F.when(mod(20, 7), "   ").when(mod(50, 9), '{"label": 1, "text"').when(mod(33, 5), F.to_json(F.struct(F.lit("1").alias("label"), "text", F.lit("c").alias("context"), F.lit("s").alias("source"))))
        .when(mod(33, 6), '{"label":7,"text":"x","context":"c"}').when(mod(33, 7), '{"label":true,"text":"","context":"c","user_intent":"i"}').when(mod(33, 8), '{"text":"no label"}')
        .otherwise(F.to_json(record))
    )
    return load(spark, d, "documents").select("doc_id", line.alias("line")).where(F.trim("line") != "")


ZERO_ONE = "CASE WHEN json_type(j, '$.label') IN ('BIGINT', 'UBIGINT') AND (j->>'$.label') IN ('0', '1') THEN (j->>'$.label')::INTEGER WHEN json_type(j, '$.label') = 'BOOLEAN' THEN CASE WHEN (j->>'$.label') = 'true' THEN 1 ELSE 0 END END"
ANY_INT = "CASE WHEN json_type(j, '$.label') = 'BOOLEAN' THEN CASE WHEN (j->>'$.label') = 'true' THEN 1 ELSE 0 END ELSE TRY_CAST(j->>'$.label' AS INTEGER) END"


@query("src01_pdf_lines", LINES + f", r AS (SELECT doc_id, j, {ZERO_ONE} AS label FROM ln) SELECT doc_id, label, sha256(j->>'$.context') AS context, j->>'$.user_intent' AS user_intent, coalesce(j->>'$.source', 'unknown') AS source FROM r WHERE label IS NOT NULL")
def _(spark, d):
    return src.pdf_records(lines(spark, d))[0].select("doc_id", "label", F.sha2("context", 256).alias("context"), "user_intent", "source")


@query("src01_corrupt_lines", LINES + f", r AS (SELECT j, {ZERO_ONE} AS label FROM ln) SELECT CASE WHEN j IS NULL THEN 'not_json' ELSE 'bad_label' END AS reason, count(*) AS n FROM r WHERE label IS NULL GROUP BY ALL")
def _(spark, d):
    return src.pdf_records(lines(spark, d))[1].groupBy("reason").agg(F.count("*").alias("n"))


@query("src02_folder_labels", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 0 WHEN doc_id % 3 = 1 THEN 1 ELSE -1 END AS label, source AS category FROM documents")
def _(spark, d):
    folder = F.element_at(F.array(F.lit("benign"), F.lit("malicious"), F.lit("other")), (F.pmod("doc_id", F.lit(3)) + 1).cast("int"))
    path = F.concat(F.lit("/data/web/"), folder, F.lit("/"), F.col("source"), F.lit(".jsonl"))
    rows = load(spark, d, "documents").select("doc_id", path.alias("file"), F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"), "text")).alias("line"))
    read = src.web_records(rows)
    return read.select(F.col("raw_id").cast("long").alias("doc_id"), "label", "category")


@query("src05_combined_loader", LINES + f", r AS (SELECT doc_id, regexp_replace(regexp_replace(coalesce(j->>'$.text', ''), '^\\s+', ''), '\\s+$', '') AS text, {ANY_INT} AS label FROM ln WHERE j IS NOT NULL) SELECT doc_id, sha256(text) AS text, label, 'pdf' AS domain FROM r WHERE label IS NOT NULL AND text <> ''")
def _(spark, d):
    return src.combined_records(lines(spark, d), "pdf")[0].select("doc_id", F.sha2("text", 256).alias("text"), "label", "domain")


TRAIN = LINES + f", r AS (SELECT doc_id, CASE WHEN j IS NULL THEN 'not_json' WHEN json_type(j, '$.label') IS NULL THEN 'missing_label' WHEN coalesce({ANY_INT} NOT IN (0, 1), true) THEN 'bad_label' WHEN NOT regexp_matches(coalesce(j->>'$.text', ''), '\\S') THEN 'empty_text' END AS reason FROM ln)"


@query("src06_training_loader", TRAIN + " SELECT doc_id FROM r WHERE reason IS NULL")
def _(spark, d):
    return src.training_records(lines(spark, d))[0].select("doc_id")


@query("agg23_drop_reasons", TRAIN + " SELECT reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY reason")
def _(spark, d):
    return src.training_records(lines(spark, d))[1].groupBy("reason").agg(F.count("*").alias("n"))


@query("src08_strict_json", "SELECT event_id, json_extract_string(props, '$.page') AS page FROM events")
def _(spark, d):
    return load(spark, d, "events").select("event_id", F.from_json("props", "page string", {"mode": "FAILFAST"})["page"].alias("page"))


@query("src09_attack_list", "SELECT category, unnest(['attack ' || category || ' one', 'attack ' || category || ' two']) AS attack FROM (SELECT DISTINCT source AS category FROM documents)")
def _(spark, d):
    c = F.col("source")
    body = F.to_json(F.create_map(c, F.array(F.concat(F.lit("attack "), c, F.lit(" one")), F.lit("  "), F.concat(F.lit(" attack "), c, F.lit(" two ")))))
    return src.attack_list(load(spark, d, "documents").select("source").distinct().select(body.alias("line")))


@query("src11_sniffing", r"""SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'image' WHEN 3 THEN 'docx' WHEN 4 THEN 'text'
  ELSE CASE WHEN regexp_matches(left(html, 4000), '(?i)<\s*(?:!doctype\s+html|html|body|head|div|p|span|h[1-6])\b') THEN 'web' ELSE 'text' END END AS kind FROM pages""")
def _(spark, d):
    """Whole pages as files: behind the first bytes of other kinds, as they are, and with their tags escaped."""
    from ..functions.hosts import sniff

    k = F.pmod("page_id", F.lit(5))
    body = F.when(k == 4, F.replace("html", F.lit("<"), F.lit("&lt;"))).otherwise(F.col("html"))
    head = F.when(k == 0, F.unhex(F.lit("255044462D"))).when(k == 1, F.unhex(F.lit("89504E47"))).when(k == 3, F.encode(F.lit("PK..word/document.xml"), "UTF-8")).otherwise(F.unhex(F.lit("")))
    return load(spark, d, "pages").select("page_id", sniff(F.lit("upload"), F.concat(head, F.encode(body, "UTF-8"))).alias("kind"))


@query("src13_paragraphs", """, b AS (SELECT doc_id AS doc, unnest(string_split(text, ' ')) AS text, unnest(range(len(string_split(text, ' ')))) AS seq FROM documents), p AS (SELECT *, seq // (3 + doc % 4) AS para FROM b WHERE regexp_matches(text, '\\S'))
SELECT doc, dense_rank() OVER (PARTITION BY doc ORDER BY para)::BIGINT AS para, sha256(trim(regexp_replace(replace(text, '- ', '-'), '\\s+', ' ', 'g'))) AS text FROM (SELECT doc, para, string_agg(text, ' ' ORDER BY seq) AS text FROM p GROUP BY doc, para)""")
def _(spark, d):
    """The words of whole texts as boxes, in paragraphs of three to six by document."""
    b = load(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", " ")).alias("seq", "text")).where(F.regexp_like("text", F.lit("(?U)\\S")))
    y0 = F.col("seq") * 11.0 + F.floor(F.col("seq") / (3 + F.pmod("doc", F.lit(4)))) * 30.0
    boxes = b.select("doc", F.lit(1).alias("page"), "seq", "text", F.lit(50.0).alias("x0"), y0.alias("y0"), (y0 + 10.0).alias("y1"), F.lit(10.0).alias("height"))
    return files.join_paragraphs(boxes).select("doc", "para", F.sha2("text", 256).alias("text"))


@query("win08_hidden_spans", """, s AS (SELECT doc_id AS doc, unnest(string_split(text, ' ')) AS text, unnest(range(len(string_split(text, ' ')))) AS seq FROM documents) SELECT doc, seq // (3 + doc % 3) AS block, sha256(trim(regexp_replace(string_agg(text, ' ' ORDER BY seq), '\\s+', ' ', 'g'))) AS text FROM s GROUP BY ALL""")
def _(spark, d):
    s = load(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", " ")).alias("seq", "text"))
    spans = s.select("doc", "seq", "text", F.lit(1).alias("page"), F.floor(F.col("seq") / (3 + F.pmod("doc", F.lit(3)))).alias("block"), F.lit("white").alias("reason"))
    return files.merge_hidden_spans(spans).select("doc", "block", F.sha2("text", 256).alias("text"))


@query("prj22_rectangles", "SELECT doc_id, round(least(1, greatest(0, (doc_id % 100) / 600::DOUBLE)), 4) AS x0, 0.05::DOUBLE AS y0, 1::DOUBLE AS x1, 0.5::DOUBLE AS y1 FROM documents")
def _(spark, d):
    rect = F.array((F.col("doc_id") % 100).cast("double"), F.lit(40.0), F.lit(900.0), F.lit(400.0))
    return load(spark, d, "documents").select("doc_id", files.norm_rect(rect, F.array(F.lit(0.0), F.lit(0.0), F.lit(600.0), F.lit(800.0))).alias("r")).select("doc_id", *[F.col("r")[i].alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))])


@query("prj23_data_uri", "SELECT doc_id, 'data:text/plain;base64,' || to_base64(encode(left(lang, 2))) AS uri FROM documents")
def _(spark, d):
    return load(spark, d, "documents").select("doc_id", files.data_uri(F.encode(F.left("lang", F.lit(2)), "UTF-8"), F.lit("text/plain")).alias("uri"))


# ------------------------------------------------------------------ standard texts
INTENT = "CASE WHEN doc_id % 3 = 0 THEN 'find ' || lang ELSE '' END"


def _intent():
    return F.when(F.pmod("doc_id", F.lit(3)) == 0, F.concat(F.lit("find "), F.col("lang"))).otherwise("")


@query("prj01_pdf_text", f"SELECT doc_id, sha256(CASE WHEN {INTENT} <> '' THEN 'User intent: ' || {INTENT} || ' Document content: ' || trim(text) ELSE 'Document content: ' || trim(text) END) AS k FROM documents")
def _(spark, d):
    return load(spark, d, "documents").select("doc_id", F.sha2(ds.pdf_text(_intent(), F.trim("text")), 256).alias("k"))


@query("prj02_web_text", "SELECT doc_id, sha256('Web content: ' || text) AS k FROM documents")
def _(spark, d):
    return load(spark, d, "documents").select("doc_id", F.sha2(ds.web_text("text"), 256).alias("k"))


@query("prj03_image_text", "SELECT doc_id, sha256(CASE WHEN doc_id % 4 = 0 THEN 'Image content:' ELSE 'Image content: ' || regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '') END) AS text FROM documents")
def _(spark, d):
    words = F.when(F.pmod("doc_id", F.lit(4)) == 0, "  ").otherwise(F.col("text"))
    return load(spark, d, "documents").select("doc_id", F.sha2(ds.image_text(words), 256).alias("text"))


@query("prj04_content_key", "SELECT doc_id, sha256 FROM scored")
def _(spark, d):
    from ..functions.text import content_key

    return load(spark, d, "documents").select("doc_id", content_key("text").alias("sha256"))


@query("prj05_label_from_path", """, h AS (SELECT doc_id, ('0x' || left(sha256(text), 4))::BIGINT AS h FROM documents)
SELECT doc_id, CASE WHEN h % 3 = 0 AND h // 3 % 2 = 0 THEN 0 WHEN h % 3 = 1 OR (h % 3 = 0 AND h // 3 % 2 = 1 AND h // 6 % 2 = 0) THEN 1 ELSE -1 END AS label FROM h""")
def _(spark, d):
    """Paths of one to three folders chosen by a text's digest; file names, which say nothing, begin with the folders' names."""
    h = F.conv(F.left(F.sha2("text", 256), F.lit(4)), 16, 10).cast("long")
    bit = lambda n: F.pmod(F.floor(h / n), F.lit(2))
    first = F.when((h % 3 == 0) & (bit(3) == 0), "/Malicious/BENIGN").when(h % 3 == 0, F.when(bit(6) == 0, "/x/MALICIOUS").otherwise("/x/benign-not")).when(h % 3 == 1, "/malicious").otherwise("/misc")
    path = F.concat(F.lit("/raw"), first, F.lit("/"), "source", F.lit("/benign_"), F.col("doc_id").cast("string"), F.lit(".png"))
    return load(spark, d, "documents").select("doc_id", ds.label_from_path(path).alias("label"))


@query("prj06_prefix_strip", "SELECT doc_id, sha256(regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '')) AS text FROM documents")
def _(spark, d):
    prefix = F.element_at(F.array(F.lit("Web content: "), F.lit(" IMAGE CONTENT:"), F.lit("")), (F.pmod("doc_id", F.lit(3)) + 1).cast("int"))
    return load(spark, d, "documents").select("doc_id", F.sha2(ds.strip_prefix(F.concat(prefix, "text")), 256).alias("text"))


@query("prj07_pdf_split", f"SELECT doc_id, nullif({INTENT}, '') AS intent, sha256(trim(text)) AS body FROM documents")
def _(spark, d):
    x = ds.split_pdf(ds.pdf_text(_intent(), F.trim("text")))
    return load(spark, d, "documents").select("doc_id", x["intent"].alias("intent"), F.sha2(x["body"], 256).alias("body"))


@query("prj08_record_context", "SELECT doc_id, CASE WHEN domain = 'image' THEN CASE WHEN doc_id % 2 = 0 THEN lang END ELSE lang END AS content, CASE WHEN domain = 'image' THEN doc_id % 2 = 0 ELSE true END AS has_text FROM scored")
def _(spark, d):
    s = scored(spark, d)
    text = F.when(F.col("domain") == "pdf", ds.pdf_text(F.lit("q"), "lang")).otherwise(ds.web_text("lang"))
    x = ds.record_context("domain", text, "lang", F.when(F.pmod("doc_id", F.lit(2)) == 0, "text_found").otherwise("no_text"))
    return s.select("doc_id", x["content"].alias("content"), x["has_text"].alias("has_text"))


@query("prj10_model_signals", "SELECT doc_id, CASE WHEN domain <> 'image' THEN t WHEN doc_id % 2 = 0 THEN t END AS text_threat, CASE WHEN domain = 'image' THEN v END AS visual_threat FROM scored")
def _(spark, d):
    from ..functions.trust import model_signals

    res = F.struct("domain", F.col("t").alias("malicious_probability"), F.col("lang").alias("content"), F.struct((F.pmod("doc_id", F.lit(2)) == 0).alias("has_text"), F.col("t").alias("malicious_probability"), F.col("lang").alias("extracted_text")).alias("text_branch"), F.struct(F.col("v").alias("malicious_probability")).alias("visual_branch"))
    x = scored(spark, d).select("doc_id", model_signals(res).alias("x"))
    return x.select("doc_id", "x.text_threat", "x.visual_threat")


@query("prj11_required_probability", "SELECT doc_id, t AS p FROM scored WHERE t IS NOT NULL")
def _(spark, d):
    from ..functions.trust import require_probability

    res = F.struct(F.lit("web").alias("domain"), F.col("t").alias("malicious_probability"), F.struct(F.col("v").alias("malicious_probability")).alias("visual_branch"))
    return scored(spark, d).where("t is not null").select("doc_id", require_probability(res).alias("p"))


# ------------------------------------------------------------------ filters
@query("flt01_invalid_rows", "SELECT count(*) FILTER (length(text) >= 100 AND y IN (0, 1)) AS kept, count(*) FILTER (NOT (length(text) >= 100 AND y IN (0, 1))) AS dropped FROM scored")
def _(spark, d):
    good = (F.length("text") >= 100) & F.col("y").isin(0, 1)
    return scored(spark, d).agg(F.count_if(good).alias("kept"), F.count_if(~good).alias("dropped"))


@query("flt02_empty_ocr", "SELECT doc_id, CASE WHEN domain = 'image' AND doc_id % 4 <> 0 THEN 'empty_ocr_text' WHEN doc_id % 7 = 0 AND domain <> 'image' THEN 'empty_text' END AS reason FROM scored")
def _(spark, d):
    i = F.col("doc_id")
    text = F.when((F.pmod(i, F.lit(7)) == 0) & (F.col("domain") != "image"), " \n").otherwise(F.col("lang"))
    words = F.when(F.pmod(i, F.lit(4)).isin(0, 1), F.col("lang")).otherwise("")
    status = F.when(F.pmod(i, F.lit(4)) == 1, "no_text").otherwise("text_found")
    return scored(spark, d).select("doc_id", ds.drop_reason("domain", text, words, status).alias("reason"))


@query("flt03_empty_text", "SELECT doc_id FROM documents WHERE doc_id % 6 <> 0 AND regexp_matches(text, '\\S')")
def _(spark, d):
    text = F.when(F.pmod("doc_id", F.lit(6)) == 0, F.repeat(F.lit("\t "), F.pmod("doc_id", F.lit(5)).cast("int"))).otherwise(F.col("text"))
    return load(spark, d, "documents").where(ds.drop_reason(F.lit("web"), text).isNull()).select("doc_id")


@query("flt05_paper_filter", "SELECT doc_id FROM documents WHERE length(text) >= 3000 AND NOT regexp_matches(text, '(?i)click here|subscribe')")
def _(spark, d):
    return load(spark, d, "documents").where((F.length("text") >= 3000) & ~F.regexp_like("text", F.lit("(?i)click here|subscribe"))).select("doc_id")


@query("flt11_boilerplate", "SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE t END AS t, doc_id % 9 <> 0 AS has_text FROM scored")
def _(spark, d):
    text = F.when(F.pmod("doc_id", F.lit(9)) == 0, fixed.IMAGE_CONTENT).otherwise(F.col("lang"))
    has = ~text.isin(fixed.IMAGE_CONTENT, "")
    return scored(spark, d).select("doc_id", F.when(has, F.col("t")).alias("t"), has.alias("has_text"))


@query("flt14_payload_mining", "SELECT doc_id FROM scored WHERE domain = 'web' AND y = 1 AND length(text) BETWEEN 20 AND 400")
def _(spark, d):
    s = scored(spark, d).withColumn("body", ds.strip_prefix(ds.web_text("text")))
    return s.where((F.col("domain") == "web") & (F.col("y") == 1) & F.length("body").between(20, 400)).select("doc_id")


@query("flt16_input_validation", "SELECT CASE WHEN doc_id % 11 = 0 THEN 'bad_modality' WHEN domain = 'image' AND doc_id % 2 = 0 THEN 'no_image_path' ELSE 'ok' END AS status, count(*) AS n FROM scored GROUP BY ALL")
def _(spark, d):
    from .pipeline import input_status

    modality = F.when(F.pmod("doc_id", F.lit(11)) == 0, "video").otherwise(F.col("domain"))
    path = F.when(F.pmod("doc_id", F.lit(2)) != 0, "/x.png")
    return scored(spark, d).select(input_status(modality, path).alias("status")).groupBy("status").agg(F.count("*").alias("n"))


# ------------------------------------------------------------------ joins, splits and samples
def lot_sql(seed: int, key: str) -> str:
    return f"sha256('{seed}|' || {key}::VARCHAR)"


SPLIT = f""", g AS (SELECT sha256, arg_min(y, doc_id) AS label FROM scored GROUP BY sha256), q AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {lot_sql(42, 'sha256')}, sha256) AS rk, count(*) OVER (PARTITION BY label) AS n FROM g),
sp AS (SELECT sha256, label, CASE WHEN rk <= round_even(n * 0.8::DOUBLE, 0) THEN 'train' WHEN rk <= round_even(n * 0.9::DOUBLE, 0) THEN 'validation' ELSE 'test' END AS split FROM q)"""


def _splits(spark, d):
    return ds.group_split(scored(spark, d).withColumnRenamed("y", "label"), order="doc_id")


@query("smp01_group_split", SPLIT + " SELECT sha256, label, split FROM sp")
def _(spark, d):
    return _splits(spark, d)


@query("jon01_assign_split", SPLIT + " SELECT doc_id, split FROM scored JOIN sp USING (sha256)")
def _(spark, d):
    return ds.assign_split(scored(spark, d), _splits(spark, d)).select("doc_id", "split")


@query("set07_leaks", SPLIT + " SELECT sha256, min(split) AS a, max(split) AS b FROM sp GROUP BY sha256 HAVING min(split) <> max(split)")
def _(spark, d):
    return ds.leaks(_splits(spark, d))


@query("agg10_split_labels", SPLIT + " SELECT split, count(*) AS total, count(*) FILTER (y = 0) AS benign, count(*) FILTER (y = 1) AS malicious FROM scored JOIN sp USING (sha256) GROUP BY split")
def _(spark, d):
    return ds.split_label_stats(ds.assign_split(scored(spark, d), _splits(spark, d)), "split", label="y")


@query("agg11_split_domain_labels", SPLIT + " SELECT split, domain, count(*) AS total, count(*) FILTER (y = 0) AS benign, count(*) FILTER (y = 1) AS malicious FROM scored JOIN sp USING (sha256) GROUP BY split, domain")
def _(spark, d):
    return ds.split_label_stats(ds.assign_split(scored(spark, d), _splits(spark, d)), "split", "domain", label="y")


@query("agg24_build_stats", SPLIT + " SELECT split, count(*) AS n, count(DISTINCT sha256) AS n_contents, sum(length(text))::BIGINT AS chars FROM scored JOIN sp USING (sha256) GROUP BY split")
def _(spark, d):
    return ds.assign_split(scored(spark, d), _splits(spark, d)).groupBy("split").agg(F.count("*").alias("n"), F.countDistinct("sha256").alias("n_contents"), F.sum(F.length("text")).alias("chars"))


@query("win01_first_label", "SELECT sha256, arg_min(y, doc_id) AS label FROM scored GROUP BY sha256")
def _(spark, d):
    return scored(spark, d).groupBy("sha256").agg(F.min_by("y", "doc_id").alias("label"))


CONFLICT = ", bad AS (SELECT text FROM scored GROUP BY text HAVING count(DISTINCT y) > 1)"


@query("jon02_label_conflicts", CONFLICT + " SELECT doc_id FROM scored WHERE text NOT IN (SELECT text FROM bad)")
def _(spark, d):
    return ds.remove_conflicts(scored(spark, d), label="y").select("doc_id")


@query("set03_conflicting_texts", CONFLICT + " SELECT sha256(text) AS k FROM bad")
def _(spark, d):
    s = scored(spark, d)
    return s.groupBy(F.col("sha256").alias("k")).agg(F.min("y").alias("a"), F.max("y").alias("b")).where("a <> b").select("k")


@query("agg25_conflict_audit", CONFLICT + " SELECT (SELECT count(*) FROM bad) AS conflicting_texts, (SELECT count(*) FROM scored WHERE text IN (SELECT text FROM bad)) AS dropped_records")
def _(spark, d):
    return ds.conflict_audit(scored(spark, d), label="y")


@query("agg25_balance_audit", ", c AS (SELECT domain, count(*) FILTER (y = 0) AS b, count(*) FILTER (y = 1) AS m FROM scored GROUP BY domain) SELECT domain, b AS original_benign, m AS original_malicious, least(b, m, 100) AS balanced_per_class, 2 * least(b, m, 100) AS total_balanced FROM c")
def _(spark, d):
    return ds.balance_audit(scored(spark, d), label="y", most=100)


@query("smp02_balance", f", q AS (SELECT *, row_number() OVER (PARTITION BY domain, y ORDER BY {lot_sql(42, 'doc_id')}, doc_id) AS rk FROM scored), c AS (SELECT domain, least(count(*) FILTER (y = 0), count(*) FILTER (y = 1), 100) AS k FROM scored GROUP BY domain) SELECT doc_id, domain, y FROM q JOIN c USING (domain) WHERE rk <= k")
def _(spark, d):
    return ds.balance_classes(scored(spark, d), label="y", most=100).select("doc_id", "domain", "y")


@query("smp03_stratified_subset", f""", n AS (SELECT lang, count(*) AS n FROM scored GROUP BY lang), e AS (SELECT lang, n, n * 150 / (SELECT sum(n) FROM n)::DOUBLE AS x FROM n), r AS (SELECT *, row_number() OVER (ORDER BY x - floor(x) DESC, lang) AS o FROM e),
k AS (SELECT lang, floor(x) + CASE WHEN o <= 150 - (SELECT sum(floor(x)) FROM e) THEN 1 ELSE 0 END AS k FROM r), q AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY {lot_sql(42, 'doc_id')}, doc_id) AS rk FROM scored) SELECT doc_id, lang FROM q JOIN k USING (lang) WHERE rk <= k""")
def _(spark, d):
    return ds.stratified_subset(scored(spark, d), 150, "lang").select("doc_id", "lang")


@query("smp04_shuffle", f"SELECT doc_id, row_number() OVER (ORDER BY {lot_sql(7, 'doc_id')}, doc_id) AS place FROM documents")
def _(spark, d):
    return ds.seeded_rank(load(spark, d, "documents").select("doc_id", F.lit(0).alias("all")), ["all"], "doc_id", 7, "place").select("doc_id", F.col("place").cast("long").alias("place"))


@query("smp05_paper_split", f""", p AS (SELECT DISTINCT lang AS category, source AS paper FROM documents), k AS (SELECT category, greatest(1, round_even(count(*) * 0.15::DOUBLE, 0)) AS k FROM p GROUP BY category), q AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY {lot_sql(42, 'paper')}, paper) AS rk FROM p)
SELECT category, paper, CASE WHEN rk <= k THEN 'validation' WHEN rk <= 2 * k THEN 'test' ELSE 'train' END AS split FROM q JOIN k USING (category)""")
def _(spark, d):
    return ds.papers_split(load(spark, d, "documents").select(F.col("lang").alias("category"), F.col("source").alias("paper")).distinct())


@query("smp06_seeded_choice", "SELECT doc_id, ('0x' || substr(sha256('3|' || doc_id), 1, 7))::BIGINT % 3 AS position, ('0x' || substr(sha256('4|' || doc_id), 1, 7))::BIGINT % 2 = 0 AS upper FROM documents")
def _(spark, d):
    pick = lambda seed, n: F.conv(F.substring(ds.lot(seed, "doc_id"), 1, 7), 16, 10).cast("long") % n
    return load(spark, d, "documents").select("doc_id", pick(3, 3).alias("position"), (pick(4, 2) == 0).alias("upper"))


@query("smp10_first_and_random", f"(SELECT doc_id, 'first' AS kind FROM documents ORDER BY doc_id LIMIT 25) UNION ALL (SELECT doc_id, 'random' FROM documents ORDER BY {lot_sql(5, 'doc_id')}, doc_id LIMIT 25)")
def _(spark, d):
    docs = load(spark, d, "documents").select("doc_id")
    first = docs.orderBy("doc_id").limit(25).withColumn("kind", F.lit("first"))
    return first.unionByName(ds.seeded_shuffle(docs, "doc_id", 5).limit(25).withColumn("kind", F.lit("random")))


@query("jon03_payload_rotation", "SELECT doc_id, doc_id % 12 AS payload, ['start', 'middle', 'end'][doc_id % 3 + 1] AS position FROM documents")
def _(spark, d):
    from .plant import PAYLOADS

    payloads = spark.createDataFrame([(i, p) for i, p in enumerate(PAYLOADS)], "payload long, text string")
    docs = load(spark, d, "documents").select("doc_id", F.pmod("doc_id", F.lit(len(PAYLOADS))).alias("payload"))
    where = F.element_at(F.array(F.lit("start"), F.lit("middle"), F.lit("end")), (F.pmod("doc_id", F.lit(3)) + 1).cast("int"))
    return docs.join(F.broadcast(payloads), "payload").select("doc_id", "payload", where.alias("position"))  # a literal table


@query("jon07_partner", """, p AS (SELECT DISTINCT source AS paper FROM documents), c AS (SELECT a.paper, b.paper AS partner, row_number() OVER (PARTITION BY a.paper ORDER BY sha256('9|' || a.paper || '|' || b.paper), b.paper) AS rk FROM p a JOIN p b ON a.paper <> b.paper) SELECT paper, partner FROM c WHERE rk = 1""")
def _(spark, d):
    p = load(spark, d, "documents").select(F.col("source").alias("paper")).distinct()
    met = p.alias("a").join(p.alias("b"), F.col("a.paper") != F.col("b.paper")).select(F.col("a.paper").alias("paper"), F.col("b.paper").alias("partner"))
    return met.groupBy("paper").agg(F.min_by("partner", F.struct(ds.lot(9, "paper", "partner"), "partner")).alias("partner"))


@query("jon06_path_lookup", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'p' || doc_id WHEN doc_id % 3 = 1 THEN 'i' || doc_id END AS file FROM documents WHERE doc_id % 3 <> 2")
def _(spark, d):
    docs = load(spark, d, "documents").select("doc_id", F.concat(F.lit("p"), "doc_id").alias("processed"), F.concat(F.lit("i"), "doc_id").alias("image"))
    there = docs.select(F.when(F.pmod("doc_id", F.lit(3)) == 0, F.col("processed")).when(F.pmod("doc_id", F.lit(3)) == 1, F.col("image")).alias("path")).where("path is not null")
    return src.with_files(docs, there, "processed", "image")[0].select("doc_id", "file")


# ------------------------------------------------------------------ windows, sets and reports
@query("win04_token_windows", r""", t AS (SELECT doc_id, string_split_regex(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') AS w FROM documents), s AS (SELECT doc_id, w, unnest(CASE WHEN len(w) <= 200 THEN [0] ELSE range(0, len(w) - 200 + 150, 150) END) AS s FROM t)
SELECT doc_id, s::BIGINT AS start, sha256(array_to_string(w[s + 1 : s + CASE WHEN len(w) <= 200 THEN len(w) ELSE 200 END], ' ')) AS k FROM s""")
def _(spark, d):
    w = F.split(flatten("text"), " ")
    each = load(spark, d, "documents").select("doc_id", F.posexplode(token_windows(w)).alias("i", "x"))
    return each.select("doc_id", (F.col("i") * 150).cast("long").alias("start"), F.sha2(F.array_join("x", " "), 256).alias("k"))


@query("win05_full_windows", r", t AS (SELECT doc_id, string_split_regex(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') AS w FROM documents), s AS (SELECT doc_id, w, unnest(range(0, len(w) - 99, 100)) AS s FROM t WHERE len(w) >= 100) SELECT doc_id, s::BIGINT AS start, sha256(array_to_string(w[s + 1 : s + 100], ' ')) AS k FROM s")
def _(spark, d):
    each = load(spark, d, "documents").select("doc_id", F.posexplode(full_windows(F.split(flatten("text"), " "), 100)).alias("i", "x"))
    return each.select("doc_id", (F.col("i") * 100).cast("long").alias("start"), F.sha2(F.array_join("x", " "), 256).alias("k"))


@query("win09_last_n", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 30")
def _(spark, d):
    from ..streaming.adaptive import last_per_session

    return last_per_session(load(spark, d, "events").select("user_id", "event_id"), "user_id", "event_id")


@query("smp07_even_selection", "SELECT doc_id, array_to_string(list_distinct(list_transform(range(8), lambda i: round_even(i * (n - 1) / 7::DOUBLE, 0)::INTEGER)).list_sort(), ',') AS picked FROM (SELECT doc_id, 9 + doc_id % 40 AS n FROM documents)")
def _(spark, d):
    n = 9 + F.pmod("doc_id", F.lit(40))
    tokens = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda x: x.cast("int"))
    one = token_windows(tokens, 1, 1, 8)
    return load(spark, d, "documents").select("doc_id", F.array_join(F.flatten(one).cast("array<string>"), ",").alias("picked"))


@query("set01_domain_union", "SELECT doc_id, domain FROM scored")
def _(spark, d):
    s = scored(spark, d).select("doc_id", "domain")
    return s.where("domain = 'pdf'").unionByName(s.where("domain = 'web'")).unionByName(s.where("domain = 'image'"))


@query("set02_union_missing", "SELECT doc_id AS id, lang, NULL::VARCHAR AS kind FROM documents UNION ALL SELECT item_id, NULL, 'benchmark' FROM benchmark")
def _(spark, d):
    b = load(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.lit("benchmark").alias("kind"))
    return load(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang").unionByName(b, allowMissingColumns=True)


@query("set04_hiding_classes", f"""SELECT doc_id, list_min(list_intersect(string_split(lower(text || ['', ' Hidden d-none', ' INVISIBLE', ' not-hidden'][doc_id % 4 + 1]), ' '), {fixed.HIDING_CLASSES})) AS hit FROM documents""")
def _(spark, d):
    """The words of whole texts as classes, with others behind them by rule."""
    more = F.element_at(F.array(F.lit(""), F.lit(" Hidden d-none"), F.lit(" INVISIBLE"), F.lit(" not-hidden")), (F.pmod("doc_id", F.lit(4)) + 1).cast("int"))
    c = F.split(F.lower(F.concat("text", more)), " ")
    return load(spark, d, "documents").select("doc_id", F.array_min(F.array_intersect(c, F.array(*map(F.lit, fixed.HIDING_CLASSES)))).alias("hit"))


@query("set05_ordered_distinct", ", w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS w, unnest(range(len(string_split(text, ' ')))) AS i FROM documents), f AS (SELECT doc_id, w, min(i) AS i FROM w GROUP BY doc_id, w) SELECT doc_id, sha256(string_agg(w, ',' ORDER BY i)) AS v FROM f GROUP BY doc_id")
def _(spark, d):
    return load(spark, d, "documents").select("doc_id", F.sha2(F.array_join(F.array_distinct(F.split("text", " ")), ","), 256).alias("v"))


@query("agg08_dataset_summary", LINES + f", r AS (SELECT j, {ZERO_ONE} AS label FROM ln) SELECT count(*) AS total_lines, count(*) FILTER (label IS NULL) AS corrupt, count(*) FILTER (label = 0) AS benign, count(*) FILTER (label = 1) AS malicious, count(DISTINCT CASE WHEN label IS NOT NULL THEN coalesce(j->>'$.user_intent', '') || '|' || coalesce(j->>'$.context', '') END) AS unique_contents FROM r")
def _(spark, d):
    read = src.parse(lines(spark, d), src.PDF_SCHEMA).withColumn("y", src.zero_or_one("_v"))
    key = F.when(F.col("y").isNotNull(), F.concat(F.coalesce("r.user_intent", F.lit("")), F.lit("|"), F.coalesce("r.context", F.lit(""))))
    return read.agg(F.count("*").alias("total_lines"), F.count_if(F.col("y").isNull()).alias("corrupt"), F.count_if(F.col("y") == 0).alias("benign"), F.count_if(F.col("y") == 1).alias("malicious"), F.countDistinct(F.sha2(key, 256)).alias("unique_contents"))


@query("agg09_value_counts", "SELECT source, count(*) AS n FROM documents GROUP BY source")
def _(spark, d):
    return ds.value_counts(load(spark, d, "documents"), "source")


@query("agg12_ocr_stats", ", s AS (SELECT *, CASE doc_id % 4 WHEN 0 THEN 'text_found' WHEN 1 THEN 'no_text' WHEN 2 THEN 'timeout' ELSE 'text_found' END AS st FROM scored) SELECT y, count(*) FILTER (st = 'text_found') AS with_text, count(*) FILTER (st <> 'text_found') AS without_text, round(100 * count(*) FILTER (st = 'text_found') / count(*)::DOUBLE, 2) AS percent FROM s GROUP BY y")
def _(spark, d):
    st = F.element_at(F.array(F.lit("text_found"), F.lit("no_text"), F.lit("timeout"), F.lit("text_found")), (F.pmod("doc_id", F.lit(4)) + 1).cast("int"))
    found = F.count_if(F.col("st") == "text_found")
    return scored(spark, d).withColumn("st", st).groupBy("y").agg(found.alias("with_text"), F.count_if(F.col("st") != "text_found").alias("without_text"), F.round(100 * found / F.count("*"), 2).alias("percent"))


@query("agg13_dimensions", "SELECT p_brand, min(p_size) AS min_size, max(p_size) AS max_size, round(avg(p_size), 2) AS avg_size FROM part GROUP BY p_brand")
def _(spark, d):
    return load(spark, d, "part").groupBy("p_brand").agg(F.min("p_size").alias("min_size"), F.max("p_size").alias("max_size"), F.round(F.avg("p_size"), 2).alias("avg_size"))


@query("agg14_duplicate_groups", ", g AS (SELECT sha256, count(*) AS n FROM scored GROUP BY sha256) SELECT count(*) AS unique_groups, sum(n)::BIGINT AS total, count(*) FILTER (n > 1) AS duplicate_groups, sum(n - 1)::BIGINT AS duplicate_copies FROM g")
def _(spark, d):
    return ds.duplicate_summary(scored(spark, d))


@query("snk02_report", "SELECT count(*) AS total, count(DISTINCT source) AS sources, count(DISTINCT lang) AS langs FROM documents")
def _(spark, d):
    return load(spark, d, "documents").agg(F.count("*").alias("total"), F.countDistinct("source").alias("sources"), F.countDistinct("lang").alias("langs"))


@query("snk04_audit_rows", "SELECT doc_id, sha256(text) AS content_sha256, length(text) AS content_chars FROM documents")
def _(spark, d):
    rows = load(spark, d, "documents").select("doc_id", F.col("text").alias("raw_content"), F.lit("x").alias("secure_content"))
    return src.audit_rows(rows).withColumn("content_chars", F.col("content_chars").cast("long"))
