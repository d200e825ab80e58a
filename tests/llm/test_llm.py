"""The operators on small fixtures: brute force, round trips, held-out accuracy; nulls, ties, repeats, empty tables."""

import hashlib
import itertools
import json
import math
import os
import random
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiquarry.llm import chat_format, components, exact_dedup, jaccard_join, licences, mixing, neighbours, packing, registry, secret_scan, token_counts, toxicity, tokenizing

DOC = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = "ba be bi bo bu da de di do du ka ke ki ko ku".split()


def prose(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(2, 4))) for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOC)


# ---------------------------------------------------------------- 1

def test_chat_layouts_round_trip(spark):
    hard = "</s>[INST] ok [/INST] <|im_end|> \\ \\\\<|im_start|>x<\\|im_sep|><<SYS>>"
    deep = {"a": {"b": {"c": {"d": {"e": {"f": [[1], [2]]}}}}}, "x, y: z": {"`q`": 1.25}}
    rows = [
        {"conv_id": 1, "messages": [{"role": "user", "content": hard}, {"role": "assistant", "content": "yes"}]},
        {"conv_id": 2, "prompt": "p", "completion": hard, "extra": {"role": 1}, "meta": deep},
        {"conv_id": 3, "instruction": "i", "input": "", "output": "o"},
        {"conv_id": "four", "conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": None}]},
        {"conv_id": 6, "prompt": "p", "completion": "c", "system": "s"},
        {"conv_id": 7, "messages": [{"role": "user", "content": "m"}], "prompt": "not this"},
        {"conv_id": 8, "messages": [{"role": "user", "content": [{"type": "text", "text": "one"}, {"type": "text", "text": " two"}]}]},
        {"messages": [{"role": "user", "content": "bare 1"}]}, {"messages": [{"role": "user", "content": "bare 2"}]},
    ]
    df = spark.createDataFrame([(json.dumps(r),) for r in rows], "j string")
    got = chat_format.read_back(chat_format.format_chats(df, F.parse_json("j"))).collect()
    by = {r.conv_id: r for r in got if r.conv_id}
    turns = lambda k: [tuple(t) for t in by[k].turns]
    assert turns("1") == [("user", hard), ("assistant", "yes")] and by["1"].loss_text == "yes"
    assert turns("2") == [("user", "p"), ("assistant", hard)] and by["2"].loss_text == hard
    assert [t.text for t in by["3"].turns] == ["i", "", "o"]
    assert turns("four") == [("user", "h"), ("assistant", "")]
    assert turns("6") == [("system", "s"), ("user", "p"), ("assistant", "c")]
    assert turns("7") == [("user", "m")] and turns("8") == [("user", "one two")]
    assert sorted(r.turns[0].text for r in got if r.conv_id is None) == ["bare 1", "bare 2"]


def test_hashes_select_mappings(spark):
    """The registry against the rule: the first mapping whose needs are all there, whatever else is."""
    rng, known = random.Random(21), sorted(chat_format.known_paths(chat_format.MAPPINGS)) + ["extra", "messages", "messages[].name"]
    for _ in range(2000):
        paths = set(rng.sample(known, rng.randint(0, 9)))
        want = next((m for m in chat_format.MAPPINGS if set(m.needs) <= paths), None)
        assert chat_format.select_mapping(paths, chat_format.MAPPINGS) == want
    records = [{k: "x" for k in rng.sample(["prompt", "completion", "response", "system", "question", "answer", "instruction", "output", "input", "conv_id", "zz"], rng.randint(1, 6))} for _ in range(200)]
    records += [{"messages": [{"role": "r", "content": "c", "more": 1}], **r} for r in records[:20]]
    df = spark.createDataFrame([(json.dumps(r),) for r in records], "j string")
    own = chat_format.mapped(df, F.parse_json("j")).select("mapping", "layout").collect()
    paths = lambda r: {*r, "messages[].role", "messages[].content"} if "messages" in r else set(r)
    want = sorted(str(next((m.name for m in chat_format.MAPPINGS if set(m.needs) <= paths(r)), None)) for r in records)
    assert sorted(str(r.mapping) for r in own) == want
    assert len(chat_format.registry(chat_format.MAPPINGS)) == sum(2 ** len(m.may) for m in chat_format.MAPPINGS)


def test_chat_unmapped_records(spark):
    df = spark.createDataFrame([('{"conv_id": 5, "nonsense": true}',), ('{"prompt": "p", "response": "r"}',)], "j string")
    done = chat_format.mapped(df, F.parse_json("j"))
    assert chat_format.unmapped(done).first().records == 1
    assert chat_format.format_chats(df, F.parse_json("j"), strict=False).count() == 1
    with pytest.raises(Exception, match="no mapping"):
        chat_format.format_chats(df, F.parse_json("j")).collect()
    with pytest.raises(ValueError, match="no mapping"):
        chat_format.format_chats(spark.range(1))


def test_paths_of_columns_and_of_variants_agree(spark):
    df = spark.sql("SELECT 1L AS conv_id, array(struct('u' AS role, struct(array(1) AS b) AS content)) AS messages, struct(struct('x' AS z) AS y) AS meta")
    v = df.select(F.schema_of_variant(F.expr("to_variant_object(struct(*))")).alias("schema"))
    assert sorted(v.select(chat_format.schema_paths(F.col("schema"))).first()[0]) == sorted(chat_format.column_paths(df.schema))
    told = chat_format.fingerprinted(v).first()
    assert told.mapping == "messages" and told.fingerprint == chat_format.fingerprint(told.layout)


def test_chat_rows(spark):
    rows = [(1, 1, "assistant", None, "q"), (1, 0, "user", "a", "q"), (1, 1, "assistant", "b", "q"), (None, 0, None, "x", "q"), (1, None, "gpt", "last", "q"), (1, 0, "user", "a", "q")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, head string")
    got = {r.conv_id: [tuple(t) for t in r.turns] for r in chat_format.read_back(chat_format.format_chats(df)).collect()}
    assert got == {1: [("user", "a"), ("user", "a"), ("assistant", ""), ("assistant", "b"), ("gpt", "last")], None: [("", "x")]}
    assert chat_format.format_chats(df.limit(0)).count() == 0
    names = spark.createDataFrame([("c", 0, "assistant", "x" * 300_000)], "conv_id string, turn int, role string, content string")
    r = chat_format.read_back(chat_format.format_chats(names)).first()
    assert r.conv_id == "c" and len(r.loss_text) == 300_000
    pair = spark.createDataFrame([("p", "r")], "prompt string, response string")
    assert [t.text for t in chat_format.read_back(chat_format.format_chats(pair)).first().turns] == ["p", "r"]


# ---------------------------------------------------------------- 2

def test_tokens_equal_the_library(spark):
    from tokenizers import Tokenizer

    path, rng = tokenizing.vocabulary_path(), random.Random(1)
    odd = "aBc'sS t\x85\xa0\x1c№İſΣσ Àéß×<|endoftext|> 12٣!?.,́　日本\U0001f600\n\t'reLL"
    texts = ["".join(rng.choice(odd) for _ in range(rng.randint(0, 30))) for _ in range(500)] + [prose(rng, 50), "", "x" * 3000, "<|startoftext|>"]
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert tokenizing.Encoder(path, True).texts(texts) == [len(w) for w in want]
    assert tokenizing.Encoder(path, False).texts(texts) == [np.array(w, "<u4").tobytes() for w in want]


def test_full_tables_are_emptied(monkeypatch):
    monkeypatch.setattr(tokenizing, "PIECE_BYTES", 5000)
    monkeypatch.setattr(tokenizing, "WORD_BYTES", 6000)
    path, rng = tokenizing.vocabulary_path(), random.Random(2)
    texts = [prose(rng, 40) for _ in range(20)]
    want = [len(e.ids) for e in tokenizing.Encoder(path, True).library.encode_batch(texts, add_special_tokens=False)]
    small = tokenizing.Encoder(path, True)
    assert [small.texts([t])[0] for t in texts] == want


# ---------------------------------------------------------------- 3

def texts_to_dedup():
    return [(1, "a b", "s"), (2, "ab", "s"), (3, "a  b", "s"), (4, "", "s"), (5, None, "s"), (6, " \n", "s"), (7, "c", "s"), (None, "c", "s"), (9, "C", "s"), (3, "a  b", "s")]


@pytest.mark.parametrize("weak", [False, True])
@pytest.mark.parametrize("kind", ["long", "int", "string"])
def test_exact_dedup(spark, weak, kind):
    if kind == "int" and not weak:
        return
    digest = (lambda norm: F.encode(F.lit("one"), "utf-8")) if weak else exact_dedup.sha256
    rows = texts_to_dedup()
    docs = frame(spark, rows).withColumn("doc_id", F.col("doc_id").cast(kind)).withColumn("norm_digest", F.lit(1)).withColumn("row_uid", F.lit("own"))
    as_id = (lambda i: None if i is None else str(i)) if kind == "string" else (lambda i: i)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    rank = lambda i: (i is None, as_id(i) if i is not None else 0)
    want, kept = [], []
    for i, t, _ in rows:
        same = sorted(((-len(u or ""), *rank(j)), j, u) for j, u, _ in rows if norm(u) == norm(t))
        want.append((as_id(i), as_id(same[0][1]), len(same)))
        kept.append((as_id(same[0][1]), norm(t)))
    key = lambda r: tuple((x is None, x) for x in r)
    found = exact_dedup.resolve(docs, digest=digest).collect()
    assert sorted(((r.id, r.keep_id, r.group_size) for r in found), key=key) == sorted(want, key=key)
    assert sum(r.kept for r in found) == len({norm(t) for _, t, _ in rows}) and all(r.id == r.keep_id for r in found if r.kept)
    left = exact_dedup.deduplicated(docs, digest=digest)
    assert left.columns == docs.columns
    assert sorted(((r.doc_id, norm(r.text)) for r in left.collect()), key=key) == sorted(set(kept), key=key)
    assert exact_dedup.resolve(docs.limit(0), digest=digest).count() == 0 and exact_dedup.deduplicated(docs.limit(0), digest=digest).count() == 0


def test_rows_that_share_an_id_are_told_apart(spark):
    rows = [(1, "a b c", "s"), (1, "unique text only here", "s"), (2, "a  b  c d", "s"), (3, "a b c  ", "s"), (5, "twice", "s"), (5, "twice", "s"), (6, "y" * 400_000, "s"), (7, "y" * 400_000 + " ", "s")]
    left = sorted((r.doc_id, r.text[:25]) for r in exact_dedup.deduplicated(frame(spark, rows)).collect())
    assert left == [(1, "unique text only here"), (2, "a  b  c d"), (3, "a b c  "), (5, "twice"), (7, "y" * 25)]


def test_filters_miss_nothing(spark):
    some = spark.range(3000).select(F.xxhash64("id").alias("hash"))
    asked = exact_dedup.Filter(some, 3000).asked(spark.range(9000), F.xxhash64("id"), "may")
    may = {r.id for r in asked.filter("may").collect()}
    assert set(range(3000)) <= may and len(may) < 3000 + 6000 / 8
    twice = exact_dedup.Filter(some.limit(100).union(some.limit(100)).union(some.filter("hash % 2 = 0")), 3000, shared=True)
    assert twice.asked(some.limit(100), F.col("hash"), "may").filter("may").count() == 100


def test_lsm_index(spark):
    index = exact_dedup.LsmIndex(spark, fanout=2)
    known = []
    for k in range(5):
        known += [(10 - k, "same", "s"), (100 + k, f"own {k}", "s")]
        index.add(frame(spark, known[-2:]))
    assert len(index.runs) <= 3
    best = {r.n: r.best.id for r in index.entries().collect()}
    assert best[5] == 6 and index.entries().count() == 6
    seen = index.seen(frame(spark, [(1, "s ame", "s"), (2, "new", "s"), (3, "own 4", "s")]), frame(spark, known))
    assert {r.doc_id: r.keep_id for r in seen.collect()} == {1: 6, 3: 104}


# ---------------------------------------------------------------- 4

def base_spans(t):
    out = [(m.start(), 0, "assign", m.end()) for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m.group(2)) >= 12]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m.group(0)) >= 18]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m.group(0)) >= 16]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(out))


def test_base_spans(spark):
    rng = random.Random(5)
    bits = ["token", "=", ":", '"', " ", "secret", "API_KEY", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "deadbeef", "é\U0001f600", "xyz", "'", "\n", "password"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(400)] + ["token=secret:abcdefghijklmnop", ""]
    rows = [(k, t, "s") for k, t in enumerate(texts)] + [(None, None, "s")]
    got = {r.doc_id: r.s for r in secret_scan.scan(frame(spark, rows)).select("doc_id", secret_scan.joined(F.concat("assign", "access", "hex")).alias("s")).collect()}
    assert all(got[k] == base_spans(t) for k, t in enumerate(texts)) and got[None] == ""


def test_random_strings_are_found(spark):
    rng, letters = random.Random(3), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    rows = [(k, "x " + "".join(rng.choice(letters) for _ in range(40)) + " y", "s") for k in range(30)]
    plain = "internationalization-of-things thereathaneshanontion aaaaaaaaaaaaaaaaaaaaaaaaaaaa abcdefghijklmnopqrstuvwxyz0123456789 src/main/java/com/example/FooBar"
    rows += [(100 + k, plain, "s") for k in range(30)]
    found = {r.doc_id for r in secret_scan.scan(frame(spark, rows)).filter("size(random) > 0").collect()}
    assert len([k for k in found if k < 100]) >= 27 and not [k for k in found if k >= 100]


def battery(token):
    """(encoding, length, p, likelier noise than text) of a candidate, said plainly."""
    body = token.rstrip("=")
    name, _, symbols = next(e for e in secret_scan.ENCODINGS if re.search(e[1], body))
    n, k, v = len(body), len(symbols), [symbols.index(c) for c in body]
    cdf = lambda z: 1 / (1 + math.exp(-1.5976 * max(-8, min(8, z)) - 0.07056 * max(-8, min(8, z)) ** 3))
    chi, df = sum((body.count(c) - n / k) ** 2 for c in symbols) * k / n, k - 1
    chi_z = ((max(chi, 0) / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    high = [x >= k / 2 for x in v]
    runs, mu = 1 + sum(a != b for a, b in zip(high, high[1:])), 2 * sum(high) * (n - sum(high)) / n + 1
    var, mean = (mu - 1) * (mu - 2) / (n - 1), sum(v) / n
    spread = sum((x - mean) ** 2 for x in v)
    serial = sum((a - mean) * (b - mean) for a, b in zip(v, v[1:])) / spread if spread else 1.0
    runs_z = abs(runs - mu) / math.sqrt(var) if var > 0 else 8.0
    least = min(1 - cdf(chi_z), 2 * (1 - cdf(runs_z)), 2 * (1 - cdf(abs(serial + 1 / n) * math.sqrt(n))))
    share = {c: p / sum(secret_scan.LETTERS) for c, p in zip(secret_scan.LOWER, secret_scan.LETTERS)}
    said = [share[c] if c in share else share[c.lower()] * secret_scan.CAPITAL if c.isalpha() else secret_scan.DIGIT if c.isdigit() else secret_scan.SIGN for c in body]
    return name, n, 1 - (1 - min(1, max(0, least))) ** 3, -n * math.log(k) > sum(map(math.log, said))


def added_spans(texts, alpha=0.01, fdr=0.01):
    """The battery's spans of all texts: the histogram's levels by band, overlaps compared span by span."""
    found = []
    for i, text in enumerate(texts):
        own = [tuple(map(int, s.split(":")[1:])) for s in base_spans(text).split(",") if s]
        for m in re.finditer(secret_scan.CANDIDATE, text, re.A):
            name, n, p, likely = battery(m[0])
            if likely:
                found.append((i, m.start(), m.end(), name, sum(n >= b for b in secret_scan.BANDS) - 1, p, any(a < m.end() and m.start() < b for a, b in own)))
    out = set()
    for band in range(len(secret_scan.BANDS)):
        own = [f for f in found if f[4] == band]
        bins = [min(int(f[5] * 100), 99) for f in own]
        noise = 2 * sum(b >= 50 for b in bins)
        for low in range(51):
            n = sum(b >= low for b in bins)
            if n - noise * (1 - low / 100) <= fdr * n + 2 * math.sqrt(n):
                out |= {f[:4] for f in own if f[5] >= max(alpha, low / 100) and not f[6]}
                break
    return out


def test_added_spans_by_brute_force(spark):
    rng, alphabets = random.Random(6), ["0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyz", secret_scan.ENCODINGS[5][2], secret_scan.ENCODINGS[8][2]]
    texts = []
    for k in range(300):
        words = prose(rng, rng.randint(0, 12)).split()
        for _ in range(rng.randint(0, 4)):
            letters = rng.choice(alphabets)
            token = "".join(rng.choice(letters) for _ in range(rng.choice([19, 20, 24, 40, 70, 140])))
            words.insert(rng.randint(0, len(words)), rng.choice(["", "", "é ", "token=", "secret: "]) + rng.choice([token, token, token[:10] * 3, "internationalization-of-everything"]) + rng.choice(["", "=="]))
        texts.append(" ".join(words))
    got = set()
    for r in secret_scan.scan(frame(spark, [(k, t, "s") for k, t in enumerate(texts)])).select("doc_id", F.explode("random").alias("x")).collect():
        got.add((r.doc_id, r.x.start, r.x.end, r.x.kind))
    want = added_spans(texts)
    assert len(want) > 80 and got == want


def test_many_matches_in_one_text(spark):
    """Places stay right over many runs of matches, and time stays in proportion."""
    rng = random.Random(8)
    bits = ["é", "\U0001f600 ", "x " * 3]
    text = " ".join(rng.choice(bits) + "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([16, 24, 40]))) for _ in range(32_000))
    began = time.time()
    got = secret_scan.scan(frame(spark, [(1, text, "s")])).select(secret_scan.joined(F.concat("assign", "access", "hex")).alias("s"), F.size("random").alias("n")).first()
    took = time.time() - began
    assert got.s == base_spans(text) and got.n == 0 and took < 30


# ---------------------------------------------------------------- 5

def shingle_set(t):
    w = [x for x in (p.strip(jaccard_join.PUNCTUATION) for p in (t or "").lower().split()) if x]
    k = min(5, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()


def near_rows():
    rng, rows = random.Random(7), []
    for k in range(12):
        base = prose(rng, 90).split()
        for v in range(rng.randint(1, 8)):
            t = list(base)
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(len(t))] = "changed"
            rows.append((len(rows), " ".join(t), "s"))
    rows += [(200, rows[0][1].upper() + "!", "s"), (201, rows[0][1], "s"), (202, "", "s"), (203, None, "s"), (204, "one two", "s"), (205, "One  two.", "s"), (None, "alone here", "s")]
    return rows


def test_jaccard_join(spark, monkeypatch):
    rows = near_rows()
    got = {r.id: r for r in jaccard_join.join_documents(frame(spark, rows)).collect()}
    sets = {}
    for i, t, _ in rows:
        sets.setdefault(shingle_set(t), []).append(i)
    reps = {min(x for x in v if x is not None) if any(x is not None for x in v) else None: s for s, v in sets.items()}
    links = {(a, b) for a, b in itertools.combinations(reps, 2) if reps[a] and reps[b] and len(reps[a] & reps[b]) / len(reps[a] | reps[b]) >= 0.8}
    group = {a: a for a in reps}
    for _ in reps:
        for a, b in links:
            group[a] = group[b] = min(group[a], group[b])
    for s, members in sets.items():
        rep = next(r for r, x in reps.items() if x == s)
        for i in members:
            assert (got[i].class_id, got[i].set_id, got[i].copies, got[i].n_links) == (group[rep], rep, len(members), sum(rep in p for p in links))
    kept = sorted((r.doc_id is None, r.doc_id or 0) for r in jaccard_join.one_of_each(frame(spark, rows)).collect())
    assert kept == sorted((x is None, x or 0) for x in {group[r] for r in reps})
    assert jaccard_join.join_documents(frame(spark, [])).count() == 0


@pytest.mark.parametrize("kind", ["long", "string"])
def test_near_copies_that_share_an_id(spark, kind):
    rng = random.Random(12)
    t, other, long = prose(rng, 80), prose(rng, 80), prose(rng, 30_000)
    rows = [(1, t, "s"), (2, t + " z", "s"), (2, other, "s"), (3, other, "s"), (3, other, "s"), (None, None, "s"), (None, "", "s"), (4, long, "s"), (5, long + " z", "s")]
    docs = frame(spark, rows).withColumn("doc_id", F.col("doc_id").cast(kind)).withColumn("row_uid", F.lit(0)).withColumn("uid", F.lit(0))
    left = jaccard_join.one_of_each(docs)
    assert left.columns == docs.columns
    assert sorted((r.doc_id is not None and int(r.doc_id), r.text or "") for r in left.collect()) == sorted([(1, t), (2, other), (False, ""), (4, long)])


def test_blocks_lose_nothing():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 62, 200).astype(np.uint64)
    sets = [np.unique(np.r_[base[: 200 - int(rng.integers(0, 30))], rng.integers(0, 1 << 62, int(rng.integers(0, 20))).astype(np.uint64)]) for _ in range(40)]
    sig = np.array([jaccard_join.min_hashes(s) for s in sets])
    exact = np.array([[a is not b and len(np.intersect1d(a, b)) / len(np.union1d(a, b)) >= 0.8 for b in sets] for a in sets])
    assert (jaccard_join.verified(sets, jaccard_join.plausible(sig, 128)) == exact).all()
    halves = jaccard_join.plausible(sig, 128, 15)
    assert not halves[:15, :15].any() and (halves[:15, 15:] == jaccard_join.plausible(sig, 128)[:15, 15:]).all()


def test_components(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (101, 102), (7, 7)], "a long, b long")
    got = {r.node: r.label for r in components.components(links).collect()}
    assert {got[k] for k in range(41)} == {0} and {got[k] for k in (100, 101, 102)} == {100}


# ---------------------------------------------------------------- 6

def test_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 16)) * rng.uniform(0.5, 1.5, (900, 1))
    x[50:80] = x[40]
    rows = [(k, v.tolist(), 1) for k, v in enumerate(x)] + [(2000, None, 1), (2020, [0.0] * 16, 1), (2040, [float("nan")] * 16, 1), (2060, [1.0], 1), (None, x[0].tolist(), 1), (3, x[3].tolist(), 1)]
    rows.append((60, (x[60] + x[0]).tolist(), 1))  # an id with two vectors: two queries
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {}
    for r in neighbours.nearest(df, F.pmod("id", F.lit(20)) == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == set(range(0, 900, 20))
    hit = 0
    assert len(got.pop(60)) == 40
    for q, found in got.items():
        found = [(i, score) for i, score in found if i != 60]
        s = x @ x[q]
        s[60] = -9
        best = [i for i in np.lexsort((np.arange(900), -s)) if i != q][:20]
        assert 18 <= len(found) <= 20 and q not in [i for i, _ in found]
        assert all(abs(score - s[i]) < 1e-9 for i, score in found)
        hit += len({i for i, _ in found} & set(best))
    assert hit / (20 * len(got)) >= 0.9
    few = spark.createDataFrame([(0, [1.0, 0.0], 1), (1, [0.5, 0.5], 1), (2, [0.5, 0.5], 1)], "vec_id long, embedding array<double>, label int")
    assert [(r.rank, r.vec_id) for r in neighbours.nearest(few, F.pmod("id", F.lit(20)) == 0).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert neighbours.nearest(few.limit(0), F.lit(True)).count() == 0


# ---------------------------------------------------------------- 7

def test_grammar():
    g = toxicity.Grammar({"idiot": 2.0})
    tapes = lambda t: [o[0] for o in g._run(t.lower().split())[0]]
    assert tapes("You are an idiot.") == [("insult", "plain", True)]
    assert tapes("This is not an idiot.") == [("insult", "negated", False)]
    assert g.clauses("No one here, an idiot.") == ([2.0], 2)
    assert tapes("They said idiots run.") == [("insult", "reported", True)]
    assert tapes("I will kill you.") == [("threat", "plain", True)]
    assert tapes("") == []


def test_tapes_by_brute_force():
    """Random clauses against the rules said plainly, word by word."""
    g, rng = toxicity.Grammar({"idiot": 2.0, "scum": 1.5}), random.Random(13)
    words = ["you", "not", "said", "idiot", "idiots", "scummy", "kill", "killed", "kills", "killjoys", "the", "tree", "is"]
    for _ in range(500):
        clause = [rng.choice(words) for _ in range(rng.randint(1, 9))]
        want, said, since = [], False, 99
        for w in clause:
            since = 0 if w == "not" else since + 1
            said = said or w == "said"
            kind = ("insult", 2.0) if w.startswith("idiot") else ("insult", 1.5) if w.startswith("scum") else ("threat", 1.0) if w in ("kill", "killed", "kills") else None
            if kind:
                want.append(((kind[0], "reported" if said else "negated" if since < 3 else "plain", "you" in clause), kind[1]))
        out, state = g._run(clause)
        assert out == want
        worth = sum(w * {"plain": 1.0, "negated": 0.3, "reported": 0.4}[how] * (1.5 if aimed else 1.0) for (_, how, aimed), w in want)
        kinds = {kind for (kind, _, _), _ in want}
        assert abs(toxicity.clause_score(out, state) - worth * (1.5 if len(kinds) == 2 and "you" in clause else 1.0)) < 1e-9


def test_scores_by_brute_force():
    """Whole texts: split into clauses by a regular expression, each scored by the rules, then the stated function."""
    g, rng = toxicity.Grammar({"idiot": 2.0, "scum": 1.5}), random.Random(17)
    words = ["you", "not", "said", "idiot", "scummy", "kill", "tree", "is", "tree,", "idiot.", "you!", "kill?", "...", "on"]
    for _ in range(400):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))
        clauses = [c.split() for c in re.findall(r"(?:\S*[^\s.,;:!?…](?:\s+|$))*\S*[.,;:!?…](?=\s|$)|\S.*$", text) if c.split()]
        clauses = [[w.strip(".,!?") for w in c] for c in clauses]
        scores = []
        for clause in clauses:
            plain, since, said = 0.0, 99, False
            kinds = set()
            for w in clause:
                since, said = 0 if w == "not" else since + 1, said or w == "said"
                kind, weight = ("insult", 2.0) if w == "idiot" else ("insult", 1.5) if w == "scummy" else ("threat", 1.0) if w == "kill" else (None, 0)
                if kind:
                    kinds.add(kind)
                    plain += weight * (0.4 if said else 0.3 if since < 3 else 1.0) * (1.5 if "you" in clause else 1.0)
            if kinds:
                scores.append(plain * (1.5 if len(kinds) == 2 and "you" in clause else 1.0))
        want = [math.log1p(sum(scores)), max(scores, default=0.0), 10 * len(scores) / (len(clauses) + 4)]
        assert np.allclose(g.features(text), want), text


def test_how_it_is_said_counts(spark):
    """Negated and reported count less than plain, aimed more, and no learned weight can turn that round."""
    rng = random.Random(18)
    x, y = np.array([[rng.random() for _ in range(3)] for _ in range(300)]), np.array([rng.random() < 0.5 for _ in range(300)], float)
    for sign in (1, -1):
        weights = toxicity.fit_logistic(sign * x * (1 + y[:, None]), y)
        assert (weights[1:] >= 0).all()
    model = toxicity.Model({"idiot": 3.0}, toxicity.DEFAULT)
    said = ["the tree is an idiot.", "you are an idiot.", "the tree is not an idiot.", "it said the tree is an idiot.", "you idiot and i kill you.", "the tree."]
    s = {r.t: r.s for r in spark.createDataFrame([(t,) for t in said], "t string").select("t", model.score(F.col("t")).alias("s")).collect()}
    plain, aimed, negated, reported, worst, none = (s[t] for t in said)
    assert worst > aimed > plain > max(negated, reported) and min(negated, reported) > none


def test_toxicity_held_out(spark):
    rng, rows, labels = random.Random(9), [], []
    for k in range(600):
        bad = k % 6 == 0
        words = prose(rng, 60).split()
        if bad:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["zorgax", "idiot", "zorgul"]))
        rows.append((k, " ".join(words) + ".", "s"))
        labels.append((k, 1, int(bad)))
    docs, marks = frame(spark, rows + [(None, None, "s")]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.learn(docs, marks)
    got = {r.doc_id: r.s for r in docs.select("doc_id", model.score(F.col("text")).alias("s")).collect()}
    held = [k for k in range(600) if zlib.crc32(str(k).encode()) % 4 == 2]
    right = sum((got[k] >= 0.3) == (k % 6 == 0) for k in held)
    assert right / len(held) > 0.95 and 0 <= got[None] < 0.3
    empty = toxicity.learn(docs, marks.limit(0))
    assert 0 <= docs.limit(1).select(model.score(F.lit(prose(rng, 30_000) + " idiot.")).alias("s")).first().s <= 1
    assert empty.stems["idiot"] == 2.0 and docs.select(empty.score(F.col("text"))).count() == 601


# ---------------------------------------------------------------- 8

def test_licences(spark):
    # the first text matches as a line, and as the paragraph around it (4 of 6 bigrams: 0.8)
    rows = [(1, "text\nReleased under the MIT License.\nmore", "s"), (2, "Licensed under CC BY-NC 4.0", "s"), (3, "the license of poetry is free", "s"), (4, None, "s"), (5, "MIT", "s"),
            (6, "\n\n".join(["x", licences.TEMPLATES["MIT-grant"].replace(", ", ",\n"), "y"]), "s")]
    got = {r.doc_id: [h.licence for h in r.hits] for r in licences.scan(frame(spark, rows)).collect()}
    assert got[1] == ["MIT", "MIT"] and got[2][0] == "CC-BY-NC-4.0" and not got[3] and not got[4] and not got[5] and "MIT-grant" in got[6]


def test_pruning_is_exact(spark):
    rng = random.Random(4)
    words = sorted({w for t in licences.TEMPLATES.values() for w in re.sub(r"[\W_]+", " ", t.lower()).split()})
    rows = []
    for k in range(300):
        t = re.sub(r"[\W_]+", " ", rng.choice(list(licences.TEMPLATES.values()))).split()
        for _ in range(rng.randint(0, max(1, len(t) // 4))):
            t[rng.randrange(len(t))] = rng.choice(words)
        rows.append((k, " ".join(t), "s"))
    got = {r.doc_id: {(h.licence, round(h.dice, 9)) for h in r.hits} for r in licences.scan(frame(spark, rows)).collect()}
    for k, t, _ in rows:
        a = set(licences.bigrams_of(t))
        dice = {(n, round(2 * len(a & set(b)) / (len(a) + len(b)), 9)) for n, b in ((n, licences.bigrams_of(x)) for n, x in licences.TEMPLATES.items())}
        assert got[k] == {(n, d) for n, d in dice if d >= 0.8}


# ---------------------------------------------------------------- 9

def test_mixing(spark):
    rng = random.Random(6)
    rows = [(k, prose(rng, rng.randint(1, 30)), rng.choice(["a", "a", "a", "a", "b", "c", "tiny" if k < 3 else "a", None])) for k in range(400)] + [(400, None, "a"), (401, "", "void"), (7, rows_text := "x y", "a")]
    docs = frame(spark, rows)
    mixed = lambda df: mixing.mix(df)[0].select("doc_id", "source", "mix.*")
    got = mixed(docs).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    order = sorted(x for x in sizes if x is not None) + ([None] if None in sizes else [])
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    target, open_, left = {}, set(order), float(sum(sizes.values()))
    while open_:  # clamp and share out again, said plainly
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if 3 * sizes[s] < level * weight[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: 3.0 * sizes[s] for s in full}
        left -= sum(3 * sizes[s] for s in full)
        open_ -= full
    taken = Counter()
    for r in got:
        assert abs(r.target - target[r.source]) < 1e-6 and r.taken <= 3 * r.size and r.source_size == sizes[r.source]
        taken[r.source] += r.taken
    assert len(got) == len(rows) and all(abs(taken[s] - target[s]) <= 30 for s in order)
    again = mixed(docs.repartition(7)).collect()
    assert sorted((r.doc_id, r["size"], r.taken) for r in again) == sorted((r.doc_id, r["size"], r.taken) for r in got)
    out = mixing.repeated(docs)
    assert out.columns == docs.columns and out.count() == sum(r.epochs for r in got)
    assert mixing.repeated(docs.limit(0)).count() == 0 and rows_text


def test_mixing_of_rows_that_share_an_id(spark):
    rows = [(None, "one two three four five", "a")] * 200 + [(k, "six words are in this one", "b") for k in range(50)] + [(1, "w " * 100_000, "c")]
    docs = frame(spark, rows).withColumn("size", F.lit(99)).withColumn("mix", F.lit("own")).withColumn("_meta", F.lit("m")).withColumn("copy", F.lit("c"))
    out, own = mixing.mix(docs)
    assert own == "_mix"
    got = out.select("source", "_mix.*").collect()
    for s in "abc":
        mine = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= max(r["size"] for r in mine)
    left = mixing.repeated(docs)
    assert left.columns == docs.columns and {r["size"] for r in left.collect()} == {99} and left.first()._meta == "m"


# ---------------------------------------------------------------- 10

def test_packing(spark):
    rng = random.Random(8)
    rows = [(k, prose(rng, rng.randint(0, 1200)), "s") for k in range(120)] + [(120, None, "s"), (121, "", "s"), (5, "again", "s"), (None, "no id", "s")]
    got = packing.pack_documents(frame(spark, rows), shard_items=32).collect()
    ids = tokenizing.Encoder(tokenizing.vocabulary_path(), False).texts([t for _, t, _ in rows])
    want = []
    for (i, _, _), raw in zip(rows, ids):
        raw += packing.END_ID
        want += [(i, k, at // 4, len(raw[at : at + 8192]) // 4, zlib.crc32(raw[at : at + 8192])) for k, at in enumerate(range(0, len(raw), 8192))]
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=key) == sorted(want, key=key)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= 1.03 * sum(w[3] for w in want) / 2048 + 1
    assert packing.pack_documents(frame(spark, [])).count() == 0


def test_migration_brings_better_plans(spark):
    """Hard bins (best fit needs more): an island that gets an elite does no worse than it, and the search beats best fit."""
    rng = np.random.default_rng(5)
    lengths = np.concatenate([[a, b, 2048 - a - b] for a, b in rng.integers(500, 860, (60, 2))]).astype(np.int64)  # 60 full bins exist
    plain = packing.best_fit(lengths, np.argsort(-lengths, kind="stable"), 2048).max() + 1
    alone = [packing.evolve(lengths, 2048, [1, k], [], 8, 60) for k in range(4)]
    bins = [p.max() + 1 for p in alone]
    elite = alone[int(np.argmin(bins))]
    moved = [packing.evolve(lengths, 2048, [2, k], [p, elite], 8, 60) for k, p in enumerate(alone)]
    assert max(p.max() + 1 for p in moved) <= min(bins) <= plain
    assert all((np.bincount(p, lengths) <= 2048).all() for p in moved)


def test_ids_of_any_type_are_packed(spark):
    rows = [(2**60 + 1, "big id", "s"), (None, "none", "s")]
    assert {r.doc_id for r in packing.pack_documents(frame(spark, rows)).collect()} == {2**60 + 1, None}
    named = frame(spark, rows).withColumn("doc_id", F.lit("name"))
    assert {r.doc_id for r in packing.pack_documents(named).collect()} == {"name"}


def test_crossover_keeps_all_pieces():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 2048, 300)
    a, b = (packing.best_fit(lengths, rng.permutation(300), 2048) for _ in range(2))
    child = packing.crossover(a, b, lengths, 2048, rng)
    assert (np.bincount(child, lengths) <= 2048).all() and len(child) == 300 and set(child) == set(range(child.max() + 1))


# ---------------------------------------------------------------- the pipeline

def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(11)
    clean = [(k, prose(rng, 80), f"s{k % 3}") for k in range(60)]
    docs = clean + [(100, clean[0][1] + "  ", "s0"), (101, clean[1][1].replace(" ", "  ", 1), "s1"), (102, clean[2][1] + " end", "s2"), (103, "you idiot. stupid idiot, moron scum.", "s0")]
    frame(spark, docs).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kept, d = spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path)
    seen = []
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = corpus_pipeline.settle(stage(spark, kept, d), name)
        assert out.columns == kept.columns
        kept = out
        seen.append({r.doc_id for r in kept.collect()})
    assert 103 not in seen[0] and set(range(60)) <= seen[0]
    assert seen[1] == (seen[0] - {0, 1}) and {100, 101} <= seen[1]  # the longer ones stay
    assert 102 not in seen[2] and seen[3] <= seen[2]
    rows = corpus_pipeline.run(spark, d).collect()
    assert len({r.sequence_id for r in rows}) <= len(rows) and {r.doc_id for r in rows} <= seen[2]


DATA = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_chat_format": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars", "op2_token_counts": "doc_id n_bytes n_tokens over_limit", "op3_exact_dedup": "doc_id keep_id group_size kept text_sha256",
    "op4_secrets": "doc_id n_assign n_access n_hex base_sha256 spans", "op5_jaccard_join": "doc_id class_id set_id copies n_links", "op6_neighbours": "query_id rank vec_id score",
    "op7_toxicity": "doc_id held_out score predicted", "op8_licences": "doc_id n_hits best_licence best_dice licences", "op9_mixing": "doc_id size source_size target taken",
    "op10_packing": "doc_id piece start length ids_crc32 sequence_id offset", "op11_fill_middle": "doc_id n form prefix_chars middle_chars output_sha256 restored_sha256",
    "op12_prefix_trie": "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256", "op13_quality": "doc_id held_out score predicted",
}


def equal_rows(got, want):
    cols = sorted(got.columns)
    whole = lambda x: int(x) if isinstance(x, float) and x.is_integer() else x  # noqa: E731 (whole numbers beside nulls are floats in pandas)
    key = lambda df: df[cols].astype(object).where(df[cols].notna(), None).map(whole).astype(str).sort_values(cols).reset_index(drop=True)
    return cols == sorted(want.columns) and key(got).equals(key(want))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_queries(spark, name):
    got = registry.QUERIES[name](spark, DATA).toPandas()
    assert list(got.columns) == COLUMNS[name].split()
    tables = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        tables.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    docs = tables.sql("SELECT doc_id, coalesce(text, '') AS text FROM documents").fetchall()
    if name in registry.SQL:
        assert equal_rows(got, tables.sql(registry.SQL[name]).df())
    elif name == "op2_token_counts":
        from tokenizers import Tokenizer

        want = {i: len(e.ids) for (i, _), e in zip(docs, Tokenizer.from_file(tokenizing.vocabulary_path()).encode_batch([t for _, t in docs], add_special_tokens=False))}
        assert {r.doc_id: (r.n_tokens, r.n_bytes, r.over_limit) for r in got.itertuples()} == {i: (want[i], len(t.encode()), want[i] > 2048) for i, t in docs}
    elif name == "op4_secrets":
        kinds = ("assign", "access", "hex")
        for r in got.itertuples():
            base = ",".join(x for x in r.spans.split(",") if x.split(":")[0] in kinds)
            assert base == base_spans(dict(docs)[r.doc_id]) and r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
            assert [r.n_assign, r.n_access, r.n_hex] == [base.count(f"{k}:") for k in kinds]
    elif name == "op7_toxicity":
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in got.itertuples())
    elif name == "op10_packing":
        assert (got.groupby("sequence_id")["length"].sum() <= 2048).all() and set(got.doc_id) == {i for i, _ in docs}
    else:
        assert len(got)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_queries_on_empty_tables(spark, tmp_path, name):
    frame(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    spark.createDataFrame([], "vec_id long, embedding array<double>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = registry.QUERIES[name](spark, str(tmp_path)).collect()
    assert len(got) == (1 if name == "op1_chat_format" else 0)


def test_clashing_columns_and_repeated_rows(spark):
    """Extra columns named like the operators' own, null ids, a very long text and rows that repeat."""
    text = "you idiot. token=abcdefghijklmnop " + "word " * 60_000
    rows = [(1, text, "s"), (1, text, "s"), (None, None, "s")]
    docs = frame(spark, rows)
    for c in ("tested", "assign", "hits", "grams", "t", "unit", "score", "id", "digest", "uid", "length", "shard", "bin", "room"):
        docs = docs.withColumn(c, F.lit(c))
    assert sorted(r.n for r in secret_scan.scan(docs).select(F.size("assign").alias("n")).collect()) == [0, 1, 1]
    assert licences.scan(docs).count() == 3
    assert packing.pack_documents(docs).select("doc_id", "piece").distinct().count() > 30
    assert toxicity.learn(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")) is not None
