"""Each operator against brute force on small tables, and on rows that are null, empty, repeated or tied."""

import hashlib
import json
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidegate.llm import bpe, chat, embdedup, graph, langid, linededup, minhash, mixing, rlz, tokencount, topk

DOC = "doc_id long, text string, lang string, source string, extra int, n_words int, kept boolean, score double"


def docs(spark, texts, sources=None, langs=None):
    """Rows with columns that clash with the operators' own."""
    rows = [(i, t, langs[i] if langs else "en", sources[i] if sources else f"s{i % 3}", 7, -1, None, 0.5) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


def odd(spark):
    """Nulls, empties, repeated rows and a null id."""
    rows = [(None, "some words without any id here", None, None), (1, None, None, None), (2, "", None, "a"), (3, " \n\t", "en", None), (4, "a b c d e f", "en", "a"), (4, "a b c d e f", "en", "a"), (5, "###", "en", "b"), (6, "x" * 50_000 + " y", "de", "b")]
    return spark.createDataFrame([(*r, 7, -1, None, 0.5) for r in rows], DOC)


def sentences(rng, n):
    vocab = [f"w{i}" for i in range(400)]
    return [" ".join(rng.choice(vocab) for _ in range(rng.randint(30, 90))) for _ in range(n)]


# ------------------------------------------------------------------ 1
def brute_top(vectors, k=10):
    ok = {i: np.floor(1024 * np.array(v, float)).astype(np.int64) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = {}
    for q in ok:
        if q % 100 == 0:
            scores = sorted(((-int(ok[q] @ v), i) for i, v in ok.items() if i != q))[:k]
            out[q] = [(i, -s) for s, i in scores]
    return out


def test_top_k(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).round(2).tolist()) for i in range(400)]
    rows += [(400, rows[0][1]), (401, rows[0][1]), (402, None), (403, [None] + [0.0] * 7), (404, [float("nan")] * 8), (None, [1.0] * 8), (500, [0.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("clash")).withColumn("id", F.lit(1))
    vectors = [(r.vec_id, r.embedding) for r in df.collect()]
    got: dict = {}
    for r in topk.top_k(df, "vec_id", "embedding", lambda i: i % 100 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == brute_top(vectors)
    assert topk.top_k(df.limit(0), "vec_id", "embedding", lambda i: i % 100 == 0).count() == 0


def test_top_k_of_repeated_ids(spark):
    """Every row is a candidate but the query's own; rows that share an id are rows of their own."""
    rows = [(0, [1.0, 1.0]), (1, [1.0, 0.0]), (1, [0.5, 0.9]), (1, [0.5, 0.9]), (100, [0.0, 1.0]), (100, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    v = [(i, np.floor(1024 * np.array(x, np.float32).astype(float)).astype(np.int64)) for i, x in rows]
    want = []
    for n, (q, x) in enumerate(v):
        if q % 100 == 0:
            best = sorted((-int(x @ y), i) for m, (i, y) in enumerate(v) if m != n)
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    got = topk.top_k(df, "vec_id", "embedding", lambda i: i % 100 == 0).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_bpe_keeps_columns_that_clash(spark):
    path = public("byte_bpe_50k.json")
    df = spark.createDataFrame([(1, "some text", "a", "b", 5, "i", "k")], "doc_id long, text string, _id string, _text string, n_tokens int, ids string, key string")
    row = bpe.encode_texts(df, path, with_ids=True, keep=tuple(df.columns)).first()
    assert (row.doc_id, row.text, row["_id"], row["_text"], row["_n_tokens"], row["_ids"], row.key, row.n_tokens, len(row.ids)) == (1, "some text", "a", "b", 5, "i", "k", 2, 2)


def public(name):
    import public_tokenizers

    return public_tokenizers.path(name)


def test_top_k_index_stops_on_proof():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 16))
    x = np.floor(300 * (centres[rng.integers(0, 20, 3000)] + 0.05 * rng.normal(size=(3000, 16)))).astype(np.int64)
    index = topk.ImpactIndex(np.arange(3000), x)
    for q in range(0, 3000, 300):
        ids, scores = index.search(x[q], q, 10)
        s = x @ x[q]
        s[q] = -(2**60)
        want = np.lexsort((np.arange(3000), -s))[:10]
        assert (ids == want).all() and (scores == s[want]).all()


# ------------------------------------------------------------------ 2
def test_mixing(spark):
    rng = random.Random(3)
    texts = [" ".join(["w"] * rng.randint(0, 60)) for _ in range(300)] + [None, ""]
    sources = [rng.choice(["b", "a", "c", None, "d"]) if rng.random() < 0.5 else "a" for _ in texts]
    got = mixing.mix_sources(docs(spark, texts, sources)).toPandas()
    size = {}
    for t, s in zip(texts, sources, strict=True):
        size[s] = size.get(s, 0) + len((t or "").split())
    names = sorted(x for x in size if x) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    clamped, total = set(), sum(size.values())
    while True:  # share by weight, clamp, share the rest
        left = total - sum(3 * size[s] for s in clamped)
        free = sum(weight[s] for s in names if s not in clamped)
        target = {s: 3 * size[s] if s in clamped else weight[s] * left / free for s in names}
        more = {s for s in names if s not in clamped and target[s] > 3 * size[s]}
        if not more:
            break
        clamped |= more
    got["source"] = [None if s is None or s != s else s for s in got.source]
    for s in names:
        mine = got[[x == s for x in got.source]]
        assert abs(mine.target.iloc[0] - target[s]) < 1e-6 and abs(mine.taken.sum() - target[s]) <= 1
        assert (mine.source_size == size[s]).all() and (mine.taken <= 3 * mine["size"]).all()
    again = mixing.mix_sources(docs(spark, texts, sources)).toPandas()
    assert sorted(zip(got.doc_id, got.taken, strict=True)) == sorted(zip(again.doc_id, again.taken, strict=True))
    assert mixing.mix_sources(docs(spark, [])).count() == 0 and mixing.mix_sources(odd(spark)).count() == 8


# ------------------------------------------------------------------ 3
def components(links, nodes):
    at = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(at[a], at[b])
            changed |= at[a] != m or at[b] != m
            at[a] = at[b] = m
    return at


def brute_minhash(texts, size):
    sets = {}
    for i, t in enumerate(texts):
        w = (t or "").encode().lower().split()
        k = min(size, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    links = [(a, b) for a in sets for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    return {i: len(s) for i, s in sets.items()}, components(links, sets)


def near_copies(rng, n=70):
    base = sentences(rng, n)
    out = list(base)
    for t in base[:25]:
        for edits in (0, 1, 3):
            w = t.split()
            for _ in range(edits):
                w[rng.randrange(len(w))] = f"z{rng.randrange(99)}"
            out.append(" ".join(w))
    group = base[40].split() * 3
    for _ in range(40):  # a group of near copies of all degrees
        w = list(group)
        for _ in range(rng.randint(1, 8)):
            w[rng.randrange(len(w))] = f"q{rng.randrange(9999)}"
        out.append(" ".join(w))
    return out + [None, "", "one", "One", "two words", "TWO words"]


@pytest.mark.parametrize("size", [4, 5])
def test_minhash(spark, size):
    texts = near_copies(random.Random(size))
    n, at = brute_minhash(texts, size)
    got = {r.doc_id: r for r in minhash.near_duplicates(docs(spark, texts), size=size).collect()}
    assert {i: r.n_shingles for i, r in got.items()} == n
    assert {i: r.component_id for i, r in got.items()} == at
    assert all(r.kept == (i == r.component_id) for i, r in got.items())


def test_minhash_odd_rows(spark):
    rows = minhash.near_duplicates(odd(spark)).collect()
    assert len(rows) == 8 and all(r.kept for r in rows)
    assert minhash.near_duplicates(docs(spark, [])).count() == 0


def test_minhash_repeated_ids(spark):
    """An id with two texts is linked with what either is near to; an id whose texts differ joins their classes."""
    rng = random.Random(33)
    a, z, y = (" ".join(f"{k}{rng.randrange(10_000)}" for _ in range(40)) for k in "azy")
    rows = [(1, a), (1, z), (2, a + " m"), (3, z + " n"), (4, y), (5, y + " o"), (5, "w " + y), (6, "w " + y + " p"), (7, y[::-1]), (7, a + " q")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit("clash")).withColumn("n", F.lit("clash"))
    got = {(r.doc_id, r.component_id) for r in minhash.near_duplicates(df).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 4), (7, 1)}
    large = [(10 * i + j, f"{a} {i} {j}" if j else f"{z} {i}") for i in range(4) for j in range(6)] + [(0, a), (10, a)]
    got = minhash.near_duplicates(spark.createDataFrame(large, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {0}


def test_bayes_limits_keep_true_pairs():
    need = minhash.least_matches(0.8, 1e-6)
    rng = np.random.default_rng(0)
    hits = (rng.random((20_000, minhash.BANDS * minhash.ROWS)) < 0.8).cumsum(axis=1)[:, minhash.BATCH - 1 :: minhash.BATCH]
    assert (hits >= np.array(need)).all() and need == sorted(need)


# ------------------------------------------------------------------ 4
def test_language(spark):
    rng = random.Random(4)
    kinds = {"en": ["the", "thing", "with", "house", "other"], "de": ["der", "über", "schön", "nicht", "straße"], "fr": ["les", "été", "façon", "être", "chose"]}
    langs = [rng.choice(list(kinds)) for _ in range(400)]
    texts = [" ".join(rng.choice(kinds[x]) for _ in range(rng.randint(5, 60))) for x in langs]
    texts += [None, "", "12 34 !!", "schön " * 400_000]
    langs += [None, "en", "en", None]
    got = {r.doc_id: r for r in langid.identify(docs(spark, texts, langs=langs)).collect()}
    held = [i for i, r in got.items() if r.held_out and i < 400]
    assert 60 < len(held) < 140 and sum(got[i].lang_pred == langs[i] for i in held) / len(held) > 0.97
    assert [got[i].lang_pred for i in (400, 401, 402, 403)] == ["und", "und", "und", "de"] and got[400].score == 0.0
    assert all(0 <= r.score <= 1 and r.extra == 7 for r in got.values())
    assert langid.identify(docs(spark, [])).count() == 0
    assert {r.lang_pred for r in langid.identify(odd(spark).where("lang is null")).collect()} == {"und"}


def test_bundles_do_not_depend_on_pieces():
    own = langid.Profiles()
    text = ("ab çd " * 3000).encode()
    whole, letters = own.bundle(np.array([0, len(text)]), np.frombuffer(text, np.uint8))
    langid.BYTES, kept = 1024, langid.BYTES
    try:
        parts, n = own.bundle_long(np.array([0, len(text)]), np.frombuffer(text, np.uint8))
    finally:
        langid.BYTES = kept
    cosine = (whole[0] @ parts[0]) / np.linalg.norm(whole[0]) / np.linalg.norm(parts[0])
    assert cosine > 0.9999 and n[0] == letters[0]


# ------------------------------------------------------------------ 5 and 7
def wild(rng):
    pool = list("abcdefgh the and ing  ▁\n\t'éüß日本😀<s>0123.,!　\xa0\x00\x1c\x85ÀØ")
    return ["".join(rng.choice(pool) for _ in range(rng.randint(0, 60))) for _ in range(400)] + [None, "", " ", "a" * 5000, " " * 3000, "日本語" * 1500, "thethe" * 2000, "a<|endoftext|>b", "<s> </s>"]


def test_token_counts(spark):
    P = pytest.importorskip("public_tokenizers")
    import sentencepiece

    texts = wild(random.Random(5))
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in tokencount.count_tokens(docs(spark, texts), P.path("piece_bpe_32k.model")).collect()}
    for i, t in enumerate(texts):
        n = len(sp.encode(t or ""))
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 4096), repr(t)
    assert tokencount.count_tokens(odd(spark), P.path("piece_bpe_32k.model")).count() == 8


def test_chunk_maps_compose():
    scores = {c: -9.0 for c in "abc▁"} | {"ab": -1.0, "bc": -2.0, "abc": -3.0, "ca": -4.0, "▁a": -5.0}
    machine = tokencount.Transducer(scores)
    rng = random.Random(6)
    tokencount.CHUNK, kept = 5, tokencount.CHUNK
    try:
        for _ in range(300):
            t = "".join(rng.choice("abc ") for _ in range(rng.randint(1, 60)))
            data = np.frombuffer(t.encode(), np.uint8)
            assert machine.count(*tokencount.code_points(np.array([0, len(data)]), data))[0] == len(machine.merge("▁" + t.replace(" ", "▁")))
    finally:
        tokencount.CHUNK = kept


@pytest.mark.parametrize("entries", [64, 1])
def test_unbroken_texts(entries, monkeypatch):
    """No place at which all is settled: chunk maps for the states that recur, or, where guesses are given up, along the true path."""
    scores = {c: -9.0 for c in "ab▁"} | {"a" * n: -float(n) for n in (2, 3, 5)} | {"ba": -1.5, "ab": -2.5, "▁a": -0.5, "aab": -3.5}
    machine = tokencount.Transducer(scores)
    rng = random.Random(61)
    monkeypatch.setattr(tokencount, "CHUNK", 7)
    monkeypatch.setattr(tokencount, "GUESS", 3)
    monkeypatch.setattr(tokencount, "MOST_ENTRIES", entries)
    for _ in range(60):
        texts = [rng.choice(["a", "ab", "aab"]) * rng.randint(1, 40) + "".join(rng.choice("aab") for _ in range(rng.randint(0, 60))) for _ in range(3)]
        data = np.frombuffer("".join(texts).encode(), np.uint8)
        got = machine.count(*tokencount.code_points(np.cumsum([0, *map(len, texts)]), data)).tolist()
        assert got == [len(machine.merge("▁" + t)) for t in texts]


def test_long_unbroken_texts_are_quick():
    P = pytest.importorskip("public_tokenizers")
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    sp, machine = sentencepiece.SentencePieceProcessor(model_file=path), tokencount.Transducer(tokencount.piece_scores(path))
    for unit in ("a", "the", "=", "日本", "x7/"):
        text = unit * (400_000 // len(unit))
        data = np.frombuffer(text.encode(), np.uint8)
        offsets, points = tokencount.code_points(np.array([0, len(data)]), data)
        began = time.time()
        assert machine.count(offsets, points)[0] == len(sp.encode(text)) and time.time() - began < 5


def test_bpe(spark):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    texts = wild(random.Random(7))
    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = {r.doc_id: r for r in bpe.encode_texts(docs(spark, texts), P.path("byte_bpe_50k.json"), with_ids=True, keep=("extra", "n_words")).collect()}
    for i, t in enumerate(texts):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        back = lib.decode(ids, skip_special_tokens=False)
        r = got[i]
        assert (r.ids, r.n_tokens, r.extra) == (ids, len(ids), 7), repr(t)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()
        assert back == (t or "")
    assert bpe.encode_texts(odd(spark), P.path("byte_bpe_50k.json")).count() == 8


# ------------------------------------------------------------------ 6
def test_embedding_dedup(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(150, 12))
    rows = [v.tolist() for v in base] + [(v + s * rng.normal(size=12)).tolist() for v in base[:30] for s in (0.05, 0.15, 0.3)] + [base[0].tolist()] * 3 + [(2 * base[1]).tolist()]
    rows += [None, [0.0] * 12, [float("inf")] * 12, [None] * 12, [1.0, 2.0]]
    df = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>").withColumn("n_links", F.lit("clash"))
    x = np.array([r for r in rows[:-5]])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    at = components(list(zip(*np.nonzero(near), strict=True)), range(len(rows)))
    got = {r.vec_id: r for r in embdedup.near_duplicates(df, "vec_id", "embedding", miss=1e-9).collect()}
    assert {i: r.n_links for i, r in got.items()} == {i: int(near[i].sum()) if i < len(x) else 0 for i in range(len(rows))}
    assert {i: r.component_id for i, r in got.items()} == {i: int(at[i]) for i in at}
    assert embdedup.near_duplicates(df.limit(0), "vec_id", "embedding").count() == 0


def test_embedding_repeated_ids(spark):
    """An id with two vectors joins what is near to either."""
    x = np.eye(8) + 0.01
    rows = [(1, x[0]), (1, x[1]), (2, x[0] + 0.02 * x[5]), (3, x[1] + 0.02 * x[5]), (4, x[2]), (5, x[2]), (5, x[3]), (6, x[3] * 2), (7, x[4]), (7, x[4])]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<double>").withColumns({"rep": F.lit("clash"), "vec": F.lit("clash")})
    got = sorted((r.vec_id, r.component_id, r.n_links) for r in embdedup.near_duplicates(df, "vec_id", "embedding").collect())
    assert got == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 4, 1), (5, 4, 1), (5, 4, 1), (6, 4, 1), (7, 7, 1), (7, 7, 1)]


def test_embedding_recall_as_shipped(spark):
    """Pairs just above the threshold, with the default miss probability, among vectors that are near to nothing."""
    rng = np.random.default_rng(66)
    base = rng.normal(size=(600, 48))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = rng.normal(size=base.shape)
    side -= (side * base).sum(axis=1, keepdims=True) * base
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cosine = rng.uniform(0.9005, 0.91, (600, 1))
    rows = list(enumerate(np.concatenate([base, cosine * base + np.sqrt(1 - cosine**2) * side]).tolist()))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = embdedup.near_duplicates(df, "vec_id", "embedding").where("n_links > 0").count()
    assert found >= 0.99 * len(rows)


# ------------------------------------------------------------------ 8
def test_chat(spark):
    call = lambda *c: '{"content": null, "tool_calls": [' + ",".join(c) + "]}"
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", call('{"id":"a","name":"add","arguments":{"y":2,"x":1}}', '{"id":"b","name":"add","arguments":{"x":"no"},"needs":["a"]}')),
        (1, 2, "assistant", call('{"id":"a","name":"add","arguments":{"x":1,"y":1}}', '{"id":"c","name":"add","arguments":{"x":1,"y":1},"needs":["d"]}', '{"id":"d","name":"add","arguments":{"x":1,"y":1},"needs":["c"]}')),
        (1, 3, "tool", '{"tool_call_id":"b","content":"5"}'), (1, 4, "tool", '{"tool_call_id":"zz","content":"?"}'), (2, 0, "tool", '{"tool_call_id":"a","content":"other conversation"}'), (None, 0, "assistant", call('{"id":"q","name":"add"}')), (3, 0, None, None), (3, 1, "user", "{broken"),
    ]
    schema = {"add": {"type": "object", "required": ["x", "y"], "properties": {"x": {"type": "integer"}, "y": {"type": "integer"}}, "additionalProperties": False}}
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("message", F.lit("clash"))
    got = {(r.conv_id, r.turn): r for r in chat.format_chat(df, schema).collect()}
    first, second, result = got[1, 1], got[1, 2], got[1, 3]
    assert (first.n_calls, first.n_answered, first.n_invalid, first.n_repeated, first.level) == (2, 1, 1, 0, 1)
    assert (second.n_calls, second.n_repeated, second.level) == (3, 1, -1)
    assert (result.order_turn, result.level, result.orphan) == (1, 1, False) and got[1, 4].orphan and got[2, 0].orphan
    assert first.message.startswith('{"content":null,"role":"assistant","tool_calls":[{"function":{"arguments":"{\\"x\\":1,\\"y\\":2}"')
    assert got[3, 0].message == '{"content":null,"role":null}' and got[3, 1].message == '{"content":"{broken","role":"user"}' and len(got) == len(rows)


CONV = "conv_id long, turn long, role string, text string"


def test_chat_odd_rows(spark):
    """Repeated and null turns, halves of surrogate pairs, constants that are no JSON, schemas of odd form, very long texts."""
    call = lambda i, arguments="{}", needs="[]": f'{{"tool_calls":[{{"id":"{i}","name":"t","arguments":{arguments},"needs":{needs}}}]}}'
    rows = [
        (1, 1, "assistant", call("a")), (1, 1, "assistant", call("b", '{"x":-1}')), (1, None, "assistant", call("c", '{"x":-1}', '["b"]')), (1, 2, "assistant", call("c")), (1, 2, "assistant", call("c")),
        (2, 0, "assistant", call("s", '{"y":"\\ud800"}')), (2, 1, "tool", '{"tool_call_id":"s","content":"\\udc00 x"}'), (2, 2, "assistant", call("n", '{"x":NaN}')), (2, 3, "assistant", call("i", '{"x":1e999}')), (2, 4, "assistant", call("d", "[" * 5000 + "]" * 5000)),
        (2, 5, "assistant", call("long", '{"y":"' + "z" * 2_000_000 + '"}')), (2, 6, "assistant", call("self", "{}", '["self"]')),
    ]
    schema = {"t": {"type": "object", "properties": {"x": {"type": "number", "minimum": 0, "maximum": None}, "y": {"type": ["string", 5]}, "z": 3}, "required": None, "enum": 1, "items": []}}
    got = chat.format_chat(spark.createDataFrame(rows, CONV), schema).collect()
    assert len(got) == len(rows)
    at = lambda c, t: sorted((r.n_calls, r.n_invalid, r.n_repeated, r.level) for r in got if (r.conv_id, r.turn) == (c, t))
    assert at(1, 1) == [(1, 0, 0, 0), (1, 1, 0, 0)] and at(1, None) == [(1, 1, 1, 0)] and at(1, 2) == [(1, 0, 0, 0), (1, 0, 1, 0)]
    said = {r.turn: r for r in got if r.conv_id == 2}
    assert "\\\\ud800" in said[0].message and (said[0].n_answered, said[0].n_invalid) == (1, 0) and json.loads(said[1].message)["content"] == "\udc00 x"
    assert said[2].n_calls == said[3].n_calls == 0 and json.loads(said[2].message)["content"] == rows[7][3]
    assert said[5].n_calls == 1 and len(said[5].message) > 2_000_000 and said[6].level == -1
    assert chat.format_chat(spark.createDataFrame([], CONV), schema).count() == 0


def test_chat_levels(spark):
    """A chain of calls, a call that needs two of it, a cycle and what hangs on it."""
    needs = {f"c{i}": [f"c{i - 1}"] if i else [] for i in range(6)} | {"two": ["c1", "c5"], "x": ["y"], "y": ["x"], "z": ["x", "c0"], "gone": ["nobody"]}
    rows = [(1, t, "assistant", json.dumps({"tool_calls": [{"id": i, "name": "t", "needs": n}]})) for t, (i, n) in enumerate(needs.items())]
    got = {r.turn: r.level for r in chat.format_chat(spark.createDataFrame(rows, CONV)).collect()}
    assert list(got[t] for t in range(len(needs))) == [0, 1, 2, 3, 4, 5, 6, -1, -1, -1, -1]


# ------------------------------------------------------------------ 9
def brute_windows(texts, window=13):
    words = [(t or "").encode().split() for t in texts]
    first = {}
    for d, w in enumerate(words):
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), d)
    out = {}
    for d, w in enumerate(words):
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone |= set(range(i, i + window))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out[d] = (len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


def test_substrings(spark):
    rng = random.Random(9)
    base = sentences(rng, 60)
    shared = " ".join(f"p{i}" for i in range(60))
    texts = base + [f"{base[i]} {shared} tail{i}" for i in range(20)] + base[:10] + [" ".join(base[i].split()[5:18]) + " x" for i in range(10)] + [" ".join(base[i].split()[5:17]) for i in range(5)] + [None, "", "a " * 300, "a " * 20]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rlz.dedup_substrings(docs(spark, texts)).collect()}
    assert got == brute_windows(texts)
    rows = rlz.dedup_substrings(odd(spark), with_text=True).collect()
    assert len(rows) == 8 and all(r.n_removed == 0 for r in rows)
    assert rlz.dedup_substrings(docs(spark, [])).count() == 0


def test_substrings_of_large_ids_beside_a_null_id(spark):
    """Ids over 2**53 differ by one; a row without an id stands in every batch."""
    rng = random.Random(21)
    base = sentences(rng, 40)
    texts = base + [f"x{i} {t}" for i, t in enumerate(base)]
    large = spark.createDataFrame([(2**62 + i, t) for i, t in enumerate(texts)] + [(None, f"{base[0]} {i}") for i in range(100)], "doc_id long, text string")
    rows = rlz.dedup_substrings(large).collect()
    assert {r.doc_id - 2**62: (r.n_words, r.n_removed, r.kept_sha256) for r in rows if r.doc_id is not None} == brute_windows(texts)
    assert len(rows) == 180 and all(r.n_removed == 0 for r in rows if r.doc_id is None)


def test_common_minimizers_are_dealt_by_window(spark, monkeypatch):
    rng = random.Random(19)
    shared = " ".join(f"p{i}" for i in range(20))
    texts = [f"{rng.choice('abcd')} {rng.choice('abcd')} {shared} {rng.choice('abcd')} {rng.random()}" for _ in range(120)]
    monkeypatch.setattr(rlz, "COMMON", 1)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rlz.dedup_substrings(docs(spark, texts)).collect()}
    assert got == brute_windows(texts)


def test_factors_of_a_block():
    """Greedy factors with boundary windows find what a comparison of all windows finds, also where hashes are no help."""
    rng = random.Random(20)
    for _ in range(60):
        texts = sorted({" ".join(rng.choice("ab") for _ in range(rng.randint(4, 11))).encode() for _ in range(30)})
        ids = np.array([rng.randrange(8) for _ in texts])
        block = rlz.Block(texts, ids, 4)
        want = block._by_words().tolist()
        assert block.parse().tolist() == want
        block._same = lambda *_: False
        assert block.parse().tolist() == want


def test_pieces_hold_every_window():
    text = "a " * 300 + "x1 x2 x3 x4 x5 x6 x7 x8 x9 x10 x11 x12 x13 x14 x15"
    group = rlz.Group(pa.table({"id": pa.array([1, 2], pa.int64()), "text": [text, text + " more"]}), 13)
    every = np.unique(group.minimizers(rlz.SEED))
    for common in (0, 1):
        got = group.pieces(rlz.SEED, every | np.uint64(common), 4)
        assert got.run.sum() == len(group.start) == len(got.use) and got.run.max() == (1 if common else rlz.RUN)
        texts = got.texts.to_pylist()
        for c, n, at in zip(got.code, got.run, np.cumsum(got.run) - got.run, strict=True):
            first = group.start[got.use[at]]
            assert texts[c].split() == group.raw[group.begin[first] : group.begin[first + n + 12]].tobytes().split()


# ------------------------------------------------------------------ 10
def brute_lines(texts):
    strip = " \t\n\v\f\r"
    rows = [[(i, x.strip(strip)) for i, x in enumerate((t or "").split("\n"))] for t in texts]
    first, starts = {}, []
    for d, r in enumerate(rows):
        solid = [s for _, s in r if s]
        for p in range(len(solid) - 2):
            w = tuple(solid[p : p + 3])
            first.setdefault(w, (d, p))
            starts.append((d, p, w))
    gone = {(d, p + k) for d, p, w in starts if (d, p) != first[w] for k in range(3) if not (first[w][0] == d and first[w][1] <= p + k <= first[w][1] + 2)}
    out = {}
    for d, t in enumerate(texts):
        kept, p = [], 0
        for x in (t or "").split("\n"):
            if x.strip(strip):
                if (d, p) not in gone:
                    kept.append(x)
                p += 1
            else:
                kept.append(x)
        out[d] = (p, sum(1 for g in gone if g[0] == d), None if t is None else "\n".join(kept))
    return out


def test_lines(spark):
    rng = random.Random(10)
    pool = [f"line {i}" for i in range(12)] + ["", "  ", "license", " license "]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randint(0, 14))) for _ in range(80)] + [None, "", "a", "x\nx\nx\nx\nx\nx", "\n\n\n"]
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in linededup.dedup_lines(docs(spark, texts)).collect()}
    assert got == brute_lines(texts)
    rows = linededup.dedup_lines(odd(spark)).collect()
    assert len(rows) == 8 and all(r.n_removed == 0 for r in rows)
    assert linededup.dedup_lines(docs(spark, [])).count() == 0


def test_lines_of_very_many_lines(spark):
    """Work grows with the lines, not with their square."""
    text = "\n".join(f"l{i % 30_000}" for i in range(40_000))
    rows = docs(spark, ["warm\nup\nnow", text, text])
    linededup.dedup_lines(rows.limit(1)).collect()
    began = time.time()
    got = {r.doc_id: (r.n_lines, r.n_removed) for r in linededup.dedup_lines(rows).select("doc_id", "n_lines", "n_removed").collect()}
    assert got == {0: (3, 0), 1: (40_000, 10_000), 2: (40_000, 40_000)} and time.time() - began < 15


def test_lines_keep_columns_that_clash(spark):
    rows = docs(spark, ["a\nb\nc", "a\nb\nc\nd"]).withColumns({"gone": F.lit("g"), "id": F.lit("i"), "t": F.lit("t"), "n_lines": F.lit("old"), "h": F.lit(1)})
    got = sorted(linededup.dedup_lines(rows).collect())
    assert [(r.text, r.gone, r.id, r.t, r.h, r.n_lines, r.n_removed) for r in got] == [("a\nb\nc", "g", "i", "t", 1, 3, 0), ("d", "g", "i", "t", 1, 4, 3)]


def test_components(spark):
    rng = random.Random(11)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5)]
    at = components([x for x in links if x[0] != x[1]], {n for x in links for n in x})
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame([*links, (None, 1)], "a long, b long"), "a", "b").collect()}
    assert got == {n: c for n, c in at.items() if n in {x for a, b in links if a != b for x in (a, b)}}


# ------------------------------------------------------------------ pipeline
def test_pipeline(spark, tmp_path):
    import corpus_pipeline as cp

    texts = near_copies(random.Random(12)) + ["!!! ???", "l1\nl2\nl3\nl4", "l1\nl2\nl3\nl4"]
    df = docs(spark, texts).drop("kept", "score", "n_words")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    at = df
    for name, stage in cp.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == df.columns, name
    assert "!!! ???" not in {r.text for r in at.collect()}
    out = cp.run(spark, str(tmp_path))
    assert {"n_tokens", "ids", "decoded_sha256"} <= set(out.columns)
    rows = out.collect()
    assert rows and all(hashlib.sha256(r.text.encode()).hexdigest() == r.decoded_sha256 for r in rows)
    seen = spark.createDataFrame([], df.schema)
    for _, stage in cp.STAGES:
        seen = stage(spark, seen, str(tmp_path))
    assert seen.count() == 0
    rest = odd(spark).drop("kept", "score", "n_words")
    for _, stage in cp.STAGES:
        rest = stage(spark, rest, str(tmp_path))
    assert rest.count() >= 1


def test_pipeline_keeps_what_it_should(spark, tmp_path):
    """Null languages, names that clash, different texts under one id, very long texts."""
    import corpus_pipeline as cp

    rng = random.Random(44)
    texts = sentences(rng, 40)
    rows = [(i, t, None, "s", "g", 1, "p", 0.1, True, "t", 7) for i, t in enumerate(texts)]
    rows += [(3, texts[3] + " and a tail", None, "s", "g", 1, "p", 0.1, True, "t", 7), (3, "quite another text of its own", None, "s", "g", 1, "p", 0.1, True, "t", 7), (50, "x y z " * 300_000, None, "s", "g", 1, "p", 0.1, True, "t", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, gone string, n_removed int, lang_pred string, score double, kept boolean, rest string, id int")
    told = cp.language_id(spark, df, "")
    assert told.columns == df.columns and sorted(told.collect()) == sorted(df.collect())
    lined = cp.line_dedup(spark, df, "")
    assert sorted(lined.collect()) == sorted(df.collect())
    kept = cp.minhash_dedup(spark, df, "")
    assert kept.columns == df.columns and kept.count() == 42 and {r.text for r in kept.where("doc_id = 3").collect()} in ({texts[3], rows[41][1]}, {rows[40][1], rows[41][1]})
    mixed = cp.mix_sources(spark, kept, "")
    assert mixed.columns == df.columns and mixed.count() > 0
    named = df.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en"))
    assert {r.lang for r in cp.language_id(spark, named, "").collect()} == {"en"}
    last = cp.bpe_encode(spark, mixed.withColumn("ids", F.lit("clash")), "").where("doc_id <> 50")
    assert all(hashlib.sha256(r.text.encode()).hexdigest() == r.decoded_sha256 for r in last.collect())


def test_words_of_ascii_are_cut_alike():
    """The quicker matcher of ASCII texts against the word pattern, over every ASCII character, and against the library."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    own, library, rng = bpe.Codec(bpe.read_spec(path)), Tokenizer.from_file(path), random.Random(7)
    some = [*map(chr, range(128)), "'s", "'ll", "the", "ing", "  ", "aa", "12"] + [" "] * 20
    for _ in range(1_500):
        text = "".join(rng.choice(some) for _ in range(rng.randrange(60)))
        assert own.find_ascii(text) == own.find(text)
        assert own.encode(text) == library.encode(text, add_special_tokens=False).ids
