"""Conversation repair, importance resampling and token files against brute force, and on odd rows."""

import hashlib
import heapq
import itertools
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tidegate.llm import plant, repair, resample, tokenfiles

CONV = "conv_id long, turn long, role string, text string, present boolean, k long, c int, pos string"
WORD = re.compile(r"[^\x20\x09-\x0D]")


# ------------------------------------------------------------------ 11
def brute_repair(rows):
    """rows: (turn, role, text) of one conversation; every sequence of edits of least cost is looked at."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, marked = set(), []
    counts = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
    for _, role, text in rows:
        shown = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not WORD.search(text) else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else None
        seen.add((role, text))
        marked.append((role, text, fault))
        if fault:
            counts[fault] += 1
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    legal = re.compile(r"(s?(ua)+)?")
    prefix = re.compile(r"s?(ua)*u?")
    best = None
    todo, put = [(0, "", "", [], 0)], heapq.heappush  # cost, audit, roles, said, rows done; cheapest first
    while todo:
        cost, audit, roles, said, n = heapq.heappop(todo)
        if best and cost > best[0]:
            break
        if not prefix.fullmatch(roles):
            continue
        if n == len(marked) and legal.fullmatch(roles) and (best is None or (cost, audit) < best[:2]):
            best = (cost, audit, said)
        if audit[-2:] != "II":
            for r in ("user", "assistant"):
                put(todo, (cost + 2, audit + "I", roles + r[0], [*said, f"{r}:"], n))
        if n < len(marked):
            role, text, fault = marked[n]
            put(todo, (cost + 3, audit + "D", roles, said, n + 1))
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                for r in ("user", "assistant"):
                    put(todo, (cost + 2 + extra, audit + "R", roles + r[0], [*said, f"{r}:{text}"], n + 1))
                if role[:1] in ("s", "u", "a"):
                    put(todo, (cost + extra, audit + "K", roles + role[0], [*said, f"{role}:{text}"], n + 1))
    return (gaps, *counts.values(), illegal, best[0], best[1], hashlib.sha256("\n".join(best[2]).encode()).hexdigest())


def conversations(rng, n):
    texts = ["Fine words here.", "Cut off in the", " \t", "", "What?", "Again and again! ", "Naïve – ok.", "a\x0b."]
    out = {}
    for c in range(n):
        turns = [rng.choice([None, 0, 1, 2, 3, 5, 9]) for _ in range(rng.randint(1, 4))]
        out[c] = [(t, rng.choice(["system", "user", "assistant", "tool", "", "s"]), rng.choice(texts)) for t in turns]
    return out


@pytest.mark.parametrize("long_from", [512, 2])
def test_repair(spark, long_from):
    made = conversations(random.Random(7), 60)
    rows = [(c, *r, True, 1, 2, "x") for c, rs in made.items() for r in rs] + [(990, 1, "user", "gone", False, 1, 2, "x"), (3, 7, "user", "gone", False, 1, 2, "x")]
    got = {r.conv_id: tuple(r)[1:] for r in repair.repair_conversations(spark.createDataFrame(rows, CONV), present_col="present", long_from=long_from).collect()}
    assert got.pop(990) == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert set(got) == set(made)
    for c, rs in made.items():
        assert got[c] == brute_repair(rs), (c, rs)


def test_repair_odd_rows(spark):
    rows = [(None, None, None, None, None, 1, 2, "x"), (None, 2**62, "user", "Hi.", True, 1, 2, "x"), (None, -(2**62), "user", "Hi.", True, 1, 2, "x"), (1, 1, "user", "x" * 200_000 + ".", True, 1, 2, "x"), (1, 1, "user", "x" * 200_000 + ".", True, 1, 2, "x")]
    df = spark.createDataFrame(rows, CONV)
    for long_from in (512, 1):
        got = {r.conv_id: r for r in repair.repair_conversations(df, long_from=long_from).collect()}
        assert set(got) == {None, 1}
        assert (got[1].duplicate, got[1].audit, got[1].cost) == (1, "KDI", 5)
        assert (got[None].blank, got[None].duplicate, got[None].gaps) == (1, 1, 2**63 - 1)
        assert repair.repair_conversations(df.limit(0), long_from=long_from).count() == 0
    text = repair.repair_conversations(df, with_text=True).where("conv_id = 1").first()
    assert text.repaired == "user:" + "x" * 200_000 + ".\nassistant:" and text.repaired_sha256 == hashlib.sha256(text.repaired.encode()).hexdigest()


def test_one_very_long_conversation(spark):
    """A conversation in runs over several tasks costs what it costs in one piece."""
    rng = random.Random(5)
    rows = [(1, t // 2, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", "No", f"Word {t}."]), True, 0, 0, "") for t in range(3_000)] + [(2, t, "user", "Hi.", True, 0, 0, "") for t in range(40)]
    df = spark.createDataFrame(rows, CONV)
    whole = repair.repair_conversations(df, long_from=5_000).orderBy("conv_id").collect()
    assert whole == repair.repair_conversations(df, long_from=100).orderBy("conv_id").collect()
    assert whole[0].cost > 0 and len(whole[0].audit) >= 3_000


def test_damage(spark):
    rows = [(c, t, r, x, True, 1, 2, "x") for c in range(40) for t, r, x in ((0, "system", "A. b!"), (1, None, None), (None, "user", "C?"))]
    want = []
    for c, t, r, x, *_ in rows:
        kind = zlib.crc32(f"{c}:{' ' if t is None else t}".encode()) % 20
        text = x if x is not None else " "
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        want += [(c, t, "user" if kind == 4 else " " if r is None else r, text, kind != 0)] * (2 if kind == 3 else 1)
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in plant.damage(spark.createDataFrame(rows, CONV)).collect())


# ------------------------------------------------------------------ 12
def brute_resample(texts, target, longest=1, buckets=10_000, percent=10, least=20, seed=2024):
    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    own = [(i, features(t)) for i, t in texts]
    s, t = [0] * buckets, [0] * buckets
    for _, f in own:
        for b in f:
            s[b] += 1
    for x in target:
        for b in features(x):
            t[b] += 1
    gain = [math.floor(1000 * math.log((y + 1) * (sum(s) + buckets) / ((x + 1) * (sum(t) + buckets)))) for x, y in zip(s, t)]
    rows = []
    for i, f in own:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    may = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for k, r in enumerate(may[: percent * len(may) // 100]):
        r[4] = k + 1
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize(("longest", "percent"), [(1, 10), (2, 50), (1, 100)])
def test_resample(spark, longest, percent):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)] + ["ÉTÉ", "don't", "x-y", "日本", "ß"]
    texts = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(5, 60)))) for i in range(120)]
    texts += [(200, None), (201, ""), (202, "... \n"), (None, "word " * 30), (203, "W1 " * 4_000)]
    target = [" ".join(words[:20]), None, ""]
    df = spark.createDataFrame([(*t, 1, 2) for t in texts], "doc_id long, text string, rank int, id int")
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    got = resample.resample(df, aim, longest=longest, percent=percent)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_resample(texts, target, longest, percent=percent)


def test_resample_odd_tables(spark):
    df = spark.createDataFrame([(1, "a b " * 20), (1, "a b " * 20), (1, "a b " * 20)], "doc_id long, text string")
    ranks = sorted(r["rank"] for r in resample.resample(df, df.select("text").limit(0), percent=100).collect())
    assert ranks == [1, 2, 3]  # repeated rows are ranked each
    assert resample.resample(df.limit(0), df.select("text")).count() == 0


# ------------------------------------------------------------------ 13
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    return path, Tokenizer.from_file(path)


TEXTS = [
    "Hello  World, it's 2024!", None, "", " \n\t ", "a\x0bb\x0cc\x1cd e f\u0085g", "<|endoftext|> x<|startoftext|>y <| endoftext|>", "ΟΔΟΣ ΣΑΣ İstanbul ﬁ Å é é ́ x ́y", "日本語 テスト 👩‍👩‍👧 \U000e0041",
    "x" * 30_000, "don't DON'T 'S 's'", "İ. Word, WORD. wordİ, é. É!? É.\u0307 a.\u0338 <|ENDOFTEXT|>. <|endoftext|>. x<|endoftext|>Y, 1. 2.) ok.) Ω. ŉ.", "​ ﻿ a", "1234 12.5 ½ Ⅷ", "\r\n\r\nq", "\x00 nul \x00", "word " * 20_000,
]


def test_token_files(spark):
    path, own = library()
    rng = random.Random(1)
    chars = [chr(c) for c in [*range(0x20, 0x7F), 0xE9, 0x301, 0x3A3, 0x4E2D, 0x1F600, 0xA0, 0x2028, 0x09, 0x0A]]
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100 + i, "".join(rng.choice(chars) for _ in range(rng.randint(0, 80)))) for i in range(300)] + [(None, "no id")]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, file int, n int, begin int").repartition(5)
    got = {r.doc_id: r for r in tokenfiles.token_files(df, path, 2).collect()}
    start = 0
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*own.encode(text or "", add_special_tokens=False).ids, 2]
        crc = zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), crc), (i, text)
        start += len(ids)


def test_token_files_of_many_equal_ids(spark):
    """One id with most rows lies in several files, and starts still follow one another."""
    path, _ = library()
    df = spark.createDataFrame([(7 if i % 4 else i, f"word {i % 5}") for i in range(2_000)], "doc_id long, text string")
    rows = sorted((r.start, r.n_tokens) for r in tokenfiles.token_files(df, path, 2).collect())
    assert rows[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in itertools.pairwise(rows))
    assert tokenfiles.token_files(df.limit(0), path, 2).count() == 0


def test_files_are_pruned(spark, tmp_path):
    """Files hold stripes, an index and Bloom filters; a look-up reads few row groups of the one file that may hold it."""
    import pyarrow.orc as orc

    path, _ = library()
    df = spark.range(0, 60_000, 2).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.hex(F.xxhash64("id", F.lit(i))) for i in range(8)]).alias("text"))
    at = f"{tmp_path}/ids"
    tokenfiles.write_ids(df, path, 2, at)
    files = sorted(tmp_path.glob("ids/*.orc"))
    own = [orc.ORCFile(f) for f in files]
    assert sum(f.nrows for f in own) == 30_000 and len(files) > 1 and max(f.nstripes for f in own) >= 1

    def read(among):
        rows = tokenfiles.read_ids(spark, at, among)
        found = rows.collect()
        scan = rows._jdf.queryExecution().executedPlan()
        text = rows._jdf.queryExecution().toString()
        assert "PushedFilters: [In" in text or "PushedFilters: [IsNotNull" in text or "EqualTo" in text
        metric = next(p.metrics().get("numOutputRows").get().value() for p in _nodes(scan) if p.nodeName().startswith("Scan orc"))
        return found, metric

    found, metric = read([20_000])
    assert [r.id for r in found] == [20_000] and 0 < metric <= 5_000
    found, metric = read([20_001])  # an odd id lies within the range of its stripe: only the Bloom filter tells
    assert not found and metric <= 1_000


def _nodes(plan):
    out, todo = [], [plan]
    while todo:
        p = todo.pop()
        out.append(p)
        todo += [p.children().apply(i) for i in range(p.children().size())]
    return out
