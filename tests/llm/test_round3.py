"""Fill-in-middle, the conversation trie, quality by nearest neighbours: brute force, round trips, held-out labels."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiquarry.llm import fill_middle, prefix_trie, quality, running

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def run_query(query, spark, tmp_path, **tables):
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return query(spark, str(tmp_path)).collect()


# ---------------------------------------------------------------- 11

def fim_by_regex(key, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n, d = len(units), sha(f"1:{'' if key is None else key}")
    h1, h2, h3, h4 = (int(d[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_fill_middle_equals_regular_expressions():
    rng = random.Random(1)
    letters = "abZ \n<PSM>é🙂0\0\r\x85İſ"
    for key in [*range(1500), None, -3]:
        text = "".join(rng.choice(letters) for _ in range(rng.choice((0, 1, 2, 9, 60, 400))))
        assert fill_middle.transform(key, text) == fim_by_regex(key, text), (key, text)
    long = "word, 🙂 " * 200_000
    assert fill_middle.transform(5, long) == fim_by_regex(5, long)


def test_fill_middle_selects_by_halving():
    rng = random.Random(2)
    for width in (1, 2, 3, 64, 1000):
        bits = rng.getrandbits(width) | 1
        places = [k for k in range(width) if bits >> k & 1]
        assert [fill_middle.place_of(bits, k) for k in range(len(places))] == places


def test_fill_middle_query(spark, tmp_path):
    texts = ["", None, "a", "one two", "x<P>y", "<", "<P", "<S<P", "é é", "same", "same", "w " * 50_000, "a\r\nb c", *[f"t{k} <S {k}<M" for k in range(60)]]
    rows = [(k, t, "clash", "s", 9) for k, t in enumerate(texts)] + [(None, "no id", "x", "s", 1), (3, "one two", "x", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fim string, form string, n long")
    got = run_query(fill_middle.op11_fill_middle, spark, tmp_path, documents=docs)
    want = sorted(((r[0], *(w := fim_by_regex(r[0], r[1]))[:4], sha(w[4]), sha(r[1] or "")) for r in rows), key=str)
    assert sorted(map(tuple, got), key=str) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    out = fill_middle.fill_in_middle(docs)
    assert out.columns == [*docs.columns, "_fim"] and out.filter("doc_id = 3 AND _fim.output IS NULL").count() == 0
    assert fill_middle.fill_in_middle(docs.limit(0)).count() == 0


# ---------------------------------------------------------------- 12

def trie_by_dicts(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            convs[conv].append((turn is not None, turn, digest, role, text))
    own = {c: [t[3:] for t in sorted(ts, key=lambda t: (t[0], t[1] or 0, t[2]))] for c, ts in convs.items()}
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + ts[h:]
    members = defaultdict(list)
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for path, m in members.items():
        if path:
            kids[path[:-1]] += 1
    for path, m in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += kids[path] == 0
            saved[path[:d]] += (len(m) - 1) * len(path[-1][1]) if path else 0
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], sha(",".join(str(c) for c in sorted(m) if len(built[c]) == len(p))))
        for p, m in members.items()
    )


TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
TURN = "conv_id long, turn long, role string, text string, depth int, label string, digest string"


def turn_frame(spark, rows):
    return spark.createDataFrame([(*r, 7, "x", "y") for r in rows], TURN)


def hard_conversations():
    rng = random.Random(3)
    rows = []
    for c in [*range(0, 60), *range(100, 130), 205, 999]:
        rows += [(c, k, rng.choice("ua"), rng.choice(("hi", "yo", "é🙂"))) for k in range(rng.randint(1, 7))]
    for c in (300, 301, 302, 345):  # long, equal for long, two of them throughout
        rows += [(c, k, "u", f"t{k}") for k in range(120 if c < 302 else 119)]
    rows += [(c, k, "u", "copy") for c in range(400, 440) for k in range(9)]  # copies of one conversation
    rows += [(50, None, None, None), (51, 1, "u", "tie"), (51, 1, "a", "tie"), (51, 1, "a", "tie"), (None, 1, "u", "nobody's"), (52, 2, "u", "long " * 30_000), (-7, 0, "u", "hi")]
    rows += [(c, 0, "u", "alone") for c in range(701, 720)]  # no first one of the family: some are left without turns
    return rows


def test_trie_equals_dictionaries(spark, tmp_path):
    rows = hard_conversations()
    got = run_query(prefix_trie.op12_prefix_trie, spark, tmp_path, conversations=turn_frame(spark, rows).repartition(5))
    want = trie_by_dicts(rows)
    assert sorted((tuple(r[c] for c in TRIE) for r in got), key=str) == sorted(want, key=str)
    assert any(r.depth == 0 and r.ends_sha256 != sha("") for r in got)
    assert max(r.depth for r in got) == 120


@pytest.mark.parametrize("rows", [[], [(4, 1, "u", "only"), (4, 2, "a", None)], [(1, 0, "u", "x")], [(None, 0, "u", "x")], [(c, 0, "u", "x") for c in (100, 101, 102, 103)]])
def test_trie_of_little(spark, tmp_path, rows):
    got = run_query(prefix_trie.op12_prefix_trie, spark, tmp_path, conversations=turn_frame(spark, rows))
    assert sorted((tuple(r[c] for c in TRIE) for r in got), key=str) == sorted(trie_by_dicts(rows), key=str)


def test_trie_gives_texts(spark):
    conversations = turn_frame(spark, [(0, k, "u", f"t{k}") for k in range(3)])
    turns, convs = prefix_trie.rebuilt(prefix_trie.numbered(conversations))
    found = prefix_trie.with_texts(prefix_trie.prefix_trie(turns, convs), conversations).orderBy("depth").collect()
    assert [(r.depth, r.role, r.text) for r in found] == [(0, None, None), (1, "u", "t0"), (2, "u", "t1"), (3, "u", "t2")]


def test_running_sums_over_slices(spark):
    rows = [(g, k, k % 5) for g, n in ((1, 700), (2, 1), (3, 40)) for k in range(n)]
    got = running.running_sum(spark.createDataFrame(rows, "g int, k int, v long"), ["g"], [F.desc("k")], F.col("v"), "s").collect()
    assert len(got) == len(rows) and all(r.s == sum(v for g, k, v in rows if g == r.g and k >= r.k) for r in got)


# ---------------------------------------------------------------- 13

def labelled(spark, n=400):
    rng = random.Random(4)
    words = ["".join(rng.choice("aeioudnrst") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    docs, labels = [], []
    for k in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(20, 80))]
        good = rng.random() < 0.6
        if not good:
            text = [w.upper() + "!!" for w in text] if rng.random() < 0.5 else [w for w in text for _ in range(8)]
        docs.append((k, " ".join(text), "en"))
        labels.append((k, int(good)))
    docs += [(n, None, "en"), (n + 1, "", "en"), (n + 2, docs[0][1], "xx"), (None, docs[1][1], "en"), (n + 3, "word " * 40_000, "en"), (0, docs[0][1], "en")]
    return docs, labels


def test_quality_is_held_out_and_right(spark, tmp_path):
    docs, labels = labelled(spark)
    tables = {"documents": spark.createDataFrame(docs, "doc_id long, text string, y string").repartition(3), "labels": spark.createDataFrame([*labels, (0, 0), (None, 1)], "doc_id long, quality int")}
    got = run_query(quality.op13_quality, spark, tmp_path, **tables)
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    truth = dict(labels)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 100 and sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    by = {r.doc_id: r.score for r in got}
    assert by[400] == by[401] and by[402] == by[0]
    again = quality.op13_quality(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, got), key=str)


def test_quality_votes_by_brute_force(spark):
    docs, labels = labelled(spark, 150)
    frame = spark.createDataFrame(docs[:150], "doc_id long, text string, y string")
    model = quality.learn(frame, spark.createDataFrame(labels, "doc_id long, quality int"), dimensions=8, neighbours=5)
    kept = sorted(k for k, _ in labels if zlib.crc32(str(k).encode()) % 3 != 1)
    terms = quality.Terms()
    x = np.array([terms.vector(docs[k][1]) for k in kept], np.float64)
    _, size, right = np.linalg.svd(x, full_matrices=False)
    known = x @ right[:8].T
    known /= np.linalg.norm(known, axis=1, keepdims=True)
    y = dict(labels)
    mean = np.mean([y[k] for k in kept])
    got = {r.doc_id: r.score for r in frame.select("doc_id", model.score(F.col("text")).alias("score")).collect()}
    for k in range(0, 150, 7):
        v = terms.vector(docs[k][1]).astype(np.float64) @ right[:8].T
        cosines = [(float(np.dot(v, u) / np.linalg.norm(v)), y[i]) for u, i in zip(known, kept)]
        near = sorted(cosines, reverse=True)[:5]
        want = (sum(c**8 * label for c, label in near if c > 0) + 0.5 * mean) / (sum(c**8 for c, _ in near if c > 0) + 0.5)
        assert abs(got[k] - want) < 0.02, k


def test_quality_without_labels(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in run_query(quality.op13_quality, spark, tmp_path, documents=docs, labels=none)} == {0.5}
    assert docs.limit(0).select(quality.learn(docs, none).score(F.col("text"))).count() == 0


def test_quality_terms_see_shape_and_repeats():
    terms = quality.Terms()
    plain, shout, same = (terms.vector(t) for t in ("one two three four", "ONE!! TWO!! THREE!! FOUR!!", "one one one one"))
    cos = lambda a, b: float(a @ b) / 3  # noqa: E731 (three blocks of length 1)
    assert abs(cos(plain, plain) - 1) < 1e-6 and cos(plain, shout) < 0.5 and cos(plain, same) < 0.7
    assert not terms.vector(" \n").any() and not terms.vector(None).any()


def test_plain_texts_are_cut_into_pretokens_at_once():
    """Plain texts fill no table of pieces, and every letter and sign of theirs gives the library's ids."""
    from lexiquarry.llm import tokenizing

    e = tokenizing.Encoder(tokenizing.vocabulary_path(), False)
    signs = "".join(chr(c) for c in range(0x21, 0x250) if tokenizing.PLAIN.fullmatch(chr(c)))
    plain = [signs, " ".join(signs), "xy".join(signs), "Don't we'll THEY'RE 'tis ''s o'',s _a_b_ 12 a1b2×÷Ⱥx\tQwrtzx,\nqwrtzx. (QWRTZX)\r\n", " ", "", None]
    odd = ["<|endoftext|> a <| b", "naïve\xa0x “q” qwrtzx…", "Ωmega ΣΑΣ é", "a\x1cb \x85 c"]
    want = [[k for k in x.ids] for x in e.library.encode_batch([t or "" for t in plain + odd], add_special_tokens=False)]
    for texts, ids in ((plain, want[: len(plain)]), (plain + odd, want), (odd + plain[:4], want[len(plain) :] + want[:4])):
        got = [np.frombuffer(b, "<u4").tolist() for b in e.texts(texts)]
        assert got == ids
        if texts is plain:
            assert not e.pieces
    e.word_bytes = tokenizing.WORD_BYTES + 1
    assert [np.frombuffer(b, "<u4").tolist() for b in e.texts([plain[3] + " newwordzz"])] == [list(e.library.encode(plain[3] + " newwordzz", add_special_tokens=False).ids)]
    assert e.word_bytes < tokenizing.WORD_BYTES
    e.done()
