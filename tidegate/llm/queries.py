"""Queries over the driver's tables, one for each operator, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import bpe, chat, embdedup, langid, linededup, minhash, mixing, plant, repair, resample, rlz, tokencount, tokenfiles, topk
from .common import load

SQL: dict[str, str] = {}


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_topk(spark, sf_dir):
    return topk.top_k(load(spark, sf_dir, "embeddings"), "vec_id", "embedding", lambda i: i % 100 == 0)


SQL["op1_topk"] = """
WITH ok AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.r, q.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(q.v, b.v), lambda p: coalesce(p[1] * p[2], 0)))::BIGINT AS score
  FROM ok q JOIN ok b ON q.vec_id % 100 = 0 AND b.r <> q.r
), ranked AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""


def op2_mixing(spark, sf_dir):
    return mixing.mix_sources(load(spark, sf_dir, "documents"))


SQL["op2_mixing"] = """
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS lot
  FROM documents
), s AS (
  SELECT source, sum(size)::DOUBLE AS size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight FROM d GROUP BY source
), level(i, l, w) AS (
  SELECT 0, (SELECT sum(size) FROM s), (SELECT sum(weight) FROM s)
  UNION ALL
  SELECT i + 1,
    (SELECT sum(size) FROM s) - coalesce((SELECT sum(3 * s.size) FROM s WHERE s.weight * level.l / level.w > 3 * s.size), 0),
    coalesce((SELECT sum(s.weight) FROM s WHERE NOT s.weight * level.l / level.w > 3 * s.size), 1)
  FROM level WHERE i < 40
), t AS (
  SELECT s.*, CASE WHEN weight * l / w > 3 * size THEN 3 * size ELSE weight * l / w END AS target FROM s, level WHERE i = 40
), p AS (
  SELECT *, least(3, CASE WHEN size > 0 THEN floor(target / size) ELSE 0 END) AS whole FROM t
), r AS (
  SELECT d.*, p.size AS source_size, target, whole, round(target - whole * p.size) AS need,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY lot, doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
), q AS (SELECT *, greatest(0, least(size, need - before)) AS part FROM r)
SELECT doc_id, source, size, source_size::BIGINT AS source_size, target::DOUBLE AS target, (whole * size + part)::BIGINT AS taken,
  (whole + CASE WHEN 2 * part >= greatest(size, 1) THEN 1 ELSE 0 END)::INTEGER AS copies
FROM q
"""


def op3_minhash_dedup(spark, sf_dir):
    return minhash.near_duplicates(load(spark, sf_dir, "documents"), size=4, threshold=0.8)


SQL["op3_minhash_dedup"] = """
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, md5(array_to_string(w[i : i + 3], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 2))) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
edge AS (SELECT a AS u, b AS v FROM link UNION ALL SELECT b, a FROM link),
reach(u, v) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.u, edge.v FROM reach JOIN edge ON edge.u = reach.v),
c AS (SELECT u, min(v) AS m FROM reach GROUP BY u)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.m AS component_id, d.doc_id = c.m AS kept FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.u = d.doc_id
"""


def op4_language_id(spark, sf_dir):
    return langid.identify(load(spark, sf_dir, "documents").select("doc_id", "text", "lang")).select("doc_id", "held_out", "lang_pred", "score")


def op5_token_counts(spark, sf_dir):
    return tokencount.count_tokens(load(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


def op6_embedding_dedup(spark, sf_dir):
    return embdedup.near_duplicates(load(spark, sf_dir, "embeddings"), "vec_id", "embedding")


SQL["op6_embedding_dedup"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), edge AS (SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach(u, v) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.u, edge.v FROM reach JOIN edge ON edge.u = reach.v),
c AS (SELECT u, min(v) AS m FROM reach GROUP BY u), n AS (SELECT u, count(*) AS n FROM edge GROUP BY u)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.m AS component_id, e.vec_id = c.m AS kept FROM embeddings e JOIN c ON c.u = e.vec_id LEFT JOIN n ON n.u = e.vec_id
"""


def op7_bpe(spark, sf_dir):
    return bpe.encode_texts(load(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


#: Schemas of the tools that conversations may call.
TOOLS = {
    "search": {"type": "object", "required": ["query"], "properties": {"query": {"type": "string"}, "limit": {"type": "integer", "minimum": 1}}, "additionalProperties": False},
    "calculate": {"type": "object", "required": ["expression"], "properties": {"expression": {"type": "string"}}, "additionalProperties": False},
}


def op8_chat_format(spark, sf_dir):
    """All conversations, with tool calls planted into them by rule (they hold none)."""
    return chat.format_chat(plant.plant_calls(load(spark, sf_dir, "conversations")), TOOLS)


SQL["op8_chat_format"] = """
WITH RECURSIVE a AS (SELECT *, CASE WHEN role = 'assistant' THEN (7 * conv_id + turn) % 8 END AS kind FROM conversations),
c(conv_id, turn, place, id, name, args, needs, bad) AS (
  SELECT conv_id, turn, 0, 'c' || turn, 'search', '{"limit":2,"query":"w' || conv_id || '"}', []::VARCHAR[], false FROM a WHERE kind = 1
  UNION ALL SELECT conv_id, turn, 0, 'c' || turn || 'b', 'search', '{"query":"x"}', ['c' || turn], false FROM a WHERE kind = 2
  UNION ALL SELECT conv_id, turn, 1, 'c' || turn, 'calculate', '{"expression":"1+' || turn || '"}', [], false FROM a WHERE kind = 2
  UNION ALL SELECT conv_id, turn, 0, 'c' || turn, 'search', '{"limit":0,"query":"w"}', [], true FROM a WHERE kind = 3
  UNION ALL SELECT conv_id, turn, 0, 'c' || turn, 'search', '{"query":"w"}', ['c' || (turn - 2)], false FROM a WHERE kind = 4
  UNION ALL SELECT conv_id, turn, 0, 'c' || turn, 'calculate', '{}', ['c' || turn || 'b'], true FROM a WHERE kind = 5
  UNION ALL SELECT conv_id, turn, 1, 'c' || turn || 'b', 'calculate', '{"expression":"2"}', ['c' || turn], false FROM a WHERE kind = 5
  UNION ALL SELECT conv_id, turn, 0, 'c1', 'search', '{"query":"w"}', [], false FROM a WHERE kind = 6
  UNION ALL SELECT conv_id, turn, 0, 'c' || turn, 'paint', '{"colour":"red"}', list_distinct(['c' || (turn - 2), 'c1']), true FROM a WHERE kind = 7
), f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, id ORDER BY turn, place) AS nth FROM c) WHERE nth = 1),
walk(conv_id, id, cur, depth) AS (
  SELECT conv_id, id, id, 0 FROM f
  UNION
  SELECT w.conv_id, w.id, e.need, w.depth + 1 FROM walk w JOIN (SELECT conv_id, id, unnest(needs) AS need FROM f) e ON e.conv_id = w.conv_id AND e.id = w.cur WHERE w.depth < 40
), placed AS (
  SELECT w.conv_id, w.id, CASE WHEN max(depth) >= 40 OR count(*) FILTER (f.id IS NULL) > 0 THEN -1 ELSE max(depth) END AS level
  FROM walk w LEFT JOIN f ON f.conv_id = w.conv_id AND f.id = w.cur GROUP BY ALL
), r AS (
  SELECT conv_id, turn, CASE WHEN kind = 0 THEN 'zz' ELSE 'c' END || turn AS id FROM a WHERE kind <> 6 AND (conv_id + turn) % 3 <> 0
), l AS (
  SELECT c.*, p.level, f.turn = c.turn AND f.place = c.place AS mine, (c.conv_id, c.id) IN (SELECT (conv_id, id) FROM r) AS answered
  FROM c JOIN f USING (conv_id, id) JOIN placed p ON p.conv_id = c.conv_id AND p.id = c.id
), t AS (
  SELECT conv_id, turn, count(*) AS n_calls, count(*) FILTER (mine AND answered) AS n_answered, count(*) FILTER (bad) AS n_invalid, count(*) FILTER (NOT mine) AS n_repeated,
    CASE WHEN min(level) < 0 THEN -1 ELSE max(level) END AS level,
    '[' || string_agg('{"function":{"arguments":' || to_json(args)::VARCHAR || ',"name":"' || name || '"},"id":"' || id || '","type":"function"}', ',' ORDER BY place) || ']' AS shown
  FROM l GROUP BY conv_id, turn
)
SELECT a.conv_id, a.turn, a.role, a.turn AS order_turn, coalesce(t.level, 0)::INTEGER AS level, coalesce(n_calls, 0)::BIGINT AS n_calls, coalesce(n_answered, 0)::BIGINT AS n_answered,
  coalesce(n_invalid, 0)::BIGINT AS n_invalid, coalesce(n_repeated, 0)::BIGINT AS n_repeated, false AS orphan,
  '{"content":' || coalesce(to_json(text)::VARCHAR, 'null') || ',"role":' || coalesce(to_json(role)::VARCHAR, 'null') || coalesce(',"tool_calls":' || shown, '') || '}' AS message
FROM a LEFT JOIN t ON t.conv_id = a.conv_id AND t.turn = a.turn AND a.role = 'assistant'
UNION ALL
SELECT r.conv_id, r.turn, 'tool', coalesce(f.turn, r.turn), coalesce(p.level, 0)::INTEGER, 0, 0, 0, 0, f.id IS NULL, '{"content":"r' || r.turn || '","role":"tool","tool_call_id":"' || r.id || '"}'
FROM r LEFT JOIN f ON f.conv_id = r.conv_id AND f.id = r.id LEFT JOIN placed p ON p.conv_id = r.conv_id AND p.id = r.id
"""


def op9_substring_dedup(spark, sf_dir):
    return rlz.dedup_substrings(load(spark, sf_dir, "documents"))


SQL["op9_substring_dedup"] = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 12], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
least AS (SELECT g, min(doc_id) AS m FROM win GROUP BY g),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM win JOIN least USING (g), range(13) r(k) WHERE m < doc_id),
word AS (SELECT doc_id, unnest(w) AS s, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(s, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""


def op10_line_dedup(spark, sf_dir):
    out = linededup.dedup_lines(load(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


SQL["op10_line_dedup"] = """
WITH l AS (
  SELECT doc_id, line, pos, trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS s
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL)
), n AS (SELECT doc_id, pos, s, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS p FROM l WHERE s <> ''),
win AS (
  SELECT * FROM (SELECT doc_id, p, [s, lead(s) OVER w, lead(s, 2) OVER w] AS g, lead(p, 2) OVER w AS last FROM n WINDOW w AS (PARTITION BY doc_id ORDER BY p)) WHERE last IS NOT NULL
), first AS (SELECT g, min((doc_id, p)) AS f FROM win GROUP BY g HAVING count(*) > 1),
gone AS (
  SELECT DISTINCT win.doc_id, win.p + k AS p FROM win JOIN first USING (g), range(3) r(k)
  WHERE (win.doc_id, win.p) > f AND NOT (win.doc_id = f[1] AND win.p + k BETWEEN f[2] AND f[2] + 2)
), kept AS (
  SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.pos) AS t, count(DISTINCT n.p) AS kn
  FROM l LEFT JOIN n ON n.doc_id = l.doc_id AND n.pos = l.pos WHERE (l.doc_id, n.p) NOT IN (SELECT (doc_id, p) FROM gone) OR n.p IS NULL GROUP BY l.doc_id
), counts AS (SELECT doc_id, count(*) AS c FROM n GROUP BY doc_id), removed AS (SELECT doc_id, count(*) AS r FROM gone GROUP BY doc_id)
SELECT d.doc_id, coalesce(c, 0)::BIGINT AS n_lines, coalesce(r, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM documents d LEFT JOIN kept USING (doc_id) LEFT JOIN counts USING (doc_id) LEFT JOIN removed USING (doc_id)
"""


def op11_conversation_repair(spark, sf_dir):
    out = repair.repair_conversations(plant.damage(load(spark, sf_dir, "conversations")), present_col="present")
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


#: The 256 remainders of CRC-32, by its rule, as one list.
_CRC = """
crc_step(i, k, v) AS (
  SELECT i, 0, i FROM range(256) r(i) UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(3988292384, v >> 1) ELSE v >> 1 END FROM crc_step WHERE k < 8
), crc AS (SELECT list(v ORDER BY i) AS t FROM crc_step WHERE k = 8)"""


def _crc32(text: str) -> str:
    """SQL for the unsigned CRC-32 of a text's UTF-8 bytes; needs crc in FROM."""
    each = f"list_transform(range(1, 2 * strlen({text}), 2), lambda p: ('0x' || substr(hex(encode({text})), p, 2))::BIGINT)"
    return f"xor(4294967295, list_reduce({each}, lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT))"


SQL["op11_conversation_repair"] = f"""
WITH RECURSIVE {_CRC}, o AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations
), h AS (SELECT o.*, {_crc32("k")} % 20 AS d FROM o, crc),
x AS (
  SELECT conv_id, turn, CASE d WHEN 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM h, range(2) c(j) WHERE d <> 0 AND (j = 0 OR d = 3)
), y AS (
  SELECT *, left(role, 1) AS i, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS z FROM x
), r AS (
  SELECT *, z = '' AS blank, z <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS dup, lead(i) OVER (PARTITION BY conv_id ORDER BY n) AS after FROM y
), s AS (
  SELECT conv_id, count(*) AS len, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(dup) AS duplicate,
    count_if(NOT blank AND NOT dup AND z NOT IN ('.', '!', '?')) AS truncated, count_if(after IS NOT NULL AND i || after NOT IN ('su', 'ua', 'au')) AS illegal
  FROM r GROUP BY conv_id
), step(conv_id, n, last, cost, audit, said) AS (
  SELECT conv_id, 0, '^', 0, '', []::VARCHAR[] FROM s
  UNION ALL
  SELECT conv_id, n, last, w.cost, w.audit, w.said FROM (
    SELECT p.conv_id, p.n + 1 AS n, e.last, min({{'cost': p.cost + a.cost + e.cost, 'audit': p.audit || a.c || e.c, 'said': p.said || a.said || e.said}}) AS w
    FROM step p JOIN r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.n = p.n + 1,
      LATERAL (
        SELECT 0 AS cost, '' AS c, []::VARCHAR[] AS said, p.last AS last
        UNION ALL SELECT 2, 'I', [CASE WHEN p.last = 'u' THEN 'assistant:' ELSE 'user:' END], CASE WHEN p.last = 'u' THEN 'a' ELSE 'u' END
      ) a,
      LATERAL (
        SELECT 3 AS cost, 'D' AS c, []::VARCHAR[] AS said, a.last AS last
        UNION ALL SELECT CASE WHEN z IN ('.', '!', '?') THEN 0 ELSE 1 END, 'K', [role || ':' || text], i WHERE NOT blank AND NOT dup AND a.last || i IN ('^s', '^u', 'su', 'ua', 'au')
        UNION ALL SELECT CASE WHEN z IN ('.', '!', '?') THEN 2 ELSE 3 END, 'R', [v || ':' || text], left(v, 1) FROM (VALUES ('user'), ('assistant')) t(v) WHERE NOT blank AND NOT dup AND a.last || left(v, 1) IN ('^u', 'su', 'ua', 'au')
      ) e
    GROUP BY p.conv_id, p.n, e.last
  )
), done AS (
  SELECT s.conv_id, min({{'cost': p.cost + f.cost, 'audit': p.audit || f.c, 'said': p.said || f.said}}) AS w
  FROM s JOIN step p ON p.conv_id IS NOT DISTINCT FROM s.conv_id AND p.n = s.len
    JOIN (VALUES ('^', 0, '', []::VARCHAR[]), ('a', 0, '', []), ('u', 2, 'I', ['assistant:']), ('s', 4, 'II', ['user:', 'assistant:'])) f(last, cost, c, said) ON f.last = p.last
  GROUP BY s.conv_id
)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(w.cost, 0)::BIGINT AS cost, coalesce(w.audit, '') AS audit, sha256(coalesce(array_to_string(w.said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM o) o LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN done ON done.conv_id IS NOT DISTINCT FROM o.conv_id
"""


def op12_importance_resampling(spark, sf_dir):
    return resample.resample(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


SQL["op12_importance_resampling"] = f"""
WITH RECURSIVE {_CRC}, d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), dw AS (SELECT r, unnest(w) AS w FROM d),
bw AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
word AS (SELECT w, {_crc32("w")} % 10000 AS b FROM (SELECT w FROM dw UNION SELECT w FROM bw) v, crc),
s AS (SELECT b, count(*) AS n FROM dw JOIN word USING (w) GROUP BY b), t AS (SELECT b, count(*) AS n FROM bw JOIN word USING (w) GROUP BY b),
gain AS (
  SELECT b, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM dw) + 10000) / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM bw) + 10000))))::BIGINT AS g
  FROM (SELECT DISTINCT b FROM word) LEFT JOIN s USING (b) LEFT JOIN t USING (b)
), m AS (SELECT r, sum(g) AS g FROM dw JOIN word USING (w) JOIN gain USING (b) GROUP BY r),
e AS (
  SELECT d.r, doc_id, len(w)::BIGINT AS n_features, coalesce(floor(m.g::DOUBLE / len(w)), 0)::BIGINT AS weight,
    floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS noise
  FROM d LEFT JOIN m USING (r)
), f AS (SELECT r, row_number() OVER (ORDER BY weight + noise DESC, doc_id NULLS FIRST) AS k, count(*) OVER () AS n FROM e WHERE n_features >= 20)
SELECT doc_id, n_features, weight, weight + noise AS score, CASE WHEN k <= 10 * n // 100 THEN k END AS rank FROM e LEFT JOIN f USING (r)
"""


def op13_token_files(spark, sf_dir):
    return tokenfiles.token_files(load(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), end_id=2)


QUERIES = {f.__name__: f for f in (op1_topk, op2_mixing, op3_minhash_dedup, op4_language_id, op5_token_counts, op6_embedding_dedup, op7_bpe, op8_chat_format, op9_substring_dedup, op10_line_dedup, op11_conversation_repair, op12_importance_resampling, op13_token_files)}
