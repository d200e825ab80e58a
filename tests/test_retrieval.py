import random
import re

from pyspark.sql import functions as F

from lexiquarry.operators import retrieval as R
from lexiquarry.plans import config as C
from lexiquarry.plans.config import SERVICE

ROW = "question_id int, intent string, threshold double, bucket int, selectable boolean, priority boolean, source_type string, source_id string, document_id long, score double, rerank_score double, rank int"


def greedy(rows, k=12):
    """The selection, said plainly: (question, intent, least, bucket, selectable, priority, type, id, document, score, rerank, rank)."""
    intent = rows[0][1]
    by_score = intent in ("documents", "deadline")
    rows = sorted((r for r in rows if r[4]), key=lambda r: (r[3], -r[10] if by_score else 0, r[11]))
    chosen = []
    for r in rows:
        cap, (first, other) = R.type_cap(intent if by_score else "other", r[6], k), R.document_caps(intent)
        if len(chosen) < k and r[10] >= r[2] and sum(c[6] == r[6] for c in chosen) < cap and sum(c[8] == r[8] for c in chosen) < (first if r[5] else other):
            chosen.append(r)
    if len(chosen) < 3:
        chosen += [r for r in rows if r not in chosen][: k - len(chosen)]
    return [r[7] for r in chosen]


def test_selection_is_greedy(spark):
    rng, rows = random.Random(4), []
    for q in range(30):
        intent = rng.choice(["documents", "deadline", "procedure"])
        least = rng.choice([0.2, 0.45, 2.0])
        for k in range(rng.randint(1, 44)):
            s = round(rng.random() * 1.5, 3)
            rows.append((q, intent, least, rng.randint(0, 3) if intent != "procedure" else 0, intent != "deadline" or rng.random() < 0.6, rng.random() < 0.5, rng.choice(C.BRANCHES), f"s{k}", rng.randint(1, 4), s, s, k))
    got = R.select_capped(spark.createDataFrame(rows, ROW)).orderBy("question_id", "place").collect()
    for q in range(30):
        assert [r.source_id for r in got if r.question_id == q] == greedy([r for r in rows if r[0] == q])


def test_buckets_of_the_selection(spark):
    rows = [("documents", "table_row", "documents", True, False), ("documents", "table", "documents", True, False), ("documents", "table_row", "deadlines", True, False), ("documents", "block", "", False, False),
            ("deadline", "block", "", True, True), ("deadline", "block", "", True, False), ("deadline", "table", "deadlines", True, False), ("deadline", "table", "", True, True), ("procedure", "block", "", True, False)]
    df = spark.createDataFrame(rows, "intent string, kind string, semantic string, priority boolean, dated boolean")
    c = [F.col(x) for x in ("intent", "kind", "semantic")]
    bucket = R.selection_bucket(*c, F.col("priority"), F.col("dated"), F.lit("decision"), F.lit("decision"), F.lit(False))
    got = [(r.b, r.s) for r in df.select(bucket.alias("b"), R.selectable(*c, F.col("dated"), F.lit(False)).alias("s")).collect()]
    assert got == [(0, True), (1, True), (2, True), (3, True), (0, True), (8, False), (8, True), (4, False), (0, True)]


def test_bundle(spark):
    q = spark.createDataFrame([(1, "Какие документы нужны для ЕДВ через ЕПГУ?", "documents", None), (2, "Срок выплаты", "deadline", "М1")], "question_id int, text string, intent string, measure_code string")
    a, b = R.bundle(q, SERVICE).orderBy("question_id").collect()
    assert (a.channel, a.profile, b.kind, b.profile) == ("epgu", "documents_by_submission_channel", "payment", "deadline")
    assert a.terms[0] == "документы" and len(a.terms) <= 24 and len(set(a.terms)) == len(a.terms) and "м1" in b.terms
    assert a.scope_hints and not b.scope_hints


def test_terms_keep_wildcards(spark):
    df = spark.createDataFrame([("a_c",), ("abc",), (None,)], "c string")
    got = [r[0] for r in df.select(R.term_score(F.array(F.lit("a_c")), 0.5, [F.col("c")])).collect()]
    assert got == [0.5, 0.5, 0.0]


def test_kind_ties(spark):
    df = spark.createDataFrame([("уведомление выплата",), ("принятие решения выплата",), ("",)], "c string")
    assert [r[0] for r in df.select(R.candidate_kind(F.col("c"), SERVICE)).collect()] == ["notification", "decision", "other"]


def test_quality_rules(spark):
    selected = [(1, 0, 10, 0.9), (1, 1, 10, 0.8), (2, 0, 10, 0.1), (3, 0, 10, 0.9)] + [(q, k, 10 + k, 0.8) for q in (4, 5) for k in range(3)] + [(6, k, max(10, 8 + k), 0.8) for k in range(5)] + [(7, 0, 10, 0.5), (7, 1, 10, 0.9)]
    stats = [(q, 10 + k, 1.0 if q == 6 else 1.0 - k / 2) for q in range(1, 8) for k in range(2)]
    prio = [(q, d) for q in range(1, 8) for d in ((10,) if q == 4 else (10, 11))]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = R.evidence_quality(frame([(q,) for q in range(1, 9)], "question_id int"), frame(selected, "question_id int, place int, document_id long, final_score double"), frame(prio, "question_id int, document_id long"), frame(stats, "question_id int, document_id long, doc_score double"))
    assert {r.question_id: (r.quality, r.reason) for r in got.collect()} == {
        1: ("strong", "ok"), 2: ("insufficient", "top_score_too_low"), 3: ("weak", "single_candidate_only"), 4: ("weak", "document_spread_too_wide"), 5: ("weak", "low_document_concentration"),
        6: ("weak", "no_clear_document_leader"), 7: ("strong", "ok"), 8: ("insufficient", "no_candidates")}


def test_retrieve_runs_the_filters(spark):
    rows = [("block", "b1", 1, 1.0, "Short", "short"), ("block", "b2", 1, 1.0, "x" * 60 + " срок принятия решения 10 рабочих дней", "срок принятия решения 10 рабочих дней"), ("block", "b3", 2, 1.0, "y" * 300, "nothing of it"), ("table_row", "r1", 2, 0.9, "", "срок 5 рабочих дней"), ("table_row", "r1", 2, 0.4, "", "срок 5 рабочих дней")]
    df = spark.createDataFrame([(1, "deadline", *r, ["срок"], "decision", None, []) for r in rows], "question_id int, intent string, source_type string, source_id string, document_id long, score double, snippet string, blob string, terms array<string>, asked string, channel string, hints array<string>")
    got = R.Retrieval(spark.createDataFrame([(1, "deadline"), (2, "other")], "question_id int, intent string"), df, SERVICE)
    assert {r.source_id for r in got.merged.collect()} == {"b1", "b2", "b3", "r1"} and {r.source_id for r in got.ranked.collect()} == {"b2", "r1"}
    assert {r.source_id for r in got.selected.collect()} == {"b2", "r1"}
    assert {r.question_id: r.quality for r in got.quality.collect()}[2] == "insufficient"
    a, b = got.metrics.orderBy("question_id").collect()
    assert (a.strategy_code, a.n_raw, a.n_merged, a.n_reranked, a.n_final, a.n_block, a.n_table_row, a.n_priority, b.n_final, b.evidence_quality) == ("deadlines_priority", 5, 4, 2, 2, 1, 1, 1, 0, "insufficient")


def test_hits_of_terms(spark):
    df = spark.createDataFrame([("Order the a_c",), ("abc",), (None,)], "c string")
    arr = lambda *ts: F.array(*[F.lit(t) for t in ts])
    own = df.withColumn("h", R.term_hits(arr("order", "zz"), [F.col("c"), F.lit("zz")], arr("a_c")))
    score = R.hit_score(arr("order", "order", "a_c"), F.col("h"), 0.5)
    assert [r.s for r in own.select(score.alias("s")).collect()] == [1.5, 0.5, 0.0]


INTENTS = ("documents", "deadline", "rejection", "form", "eligibility", "procedure", "appeal", "other")


def test_second_document_by_strategy(spark):
    """Only the strategies procedure, balanced, rejection and eligibility take a second document, and only a close one."""
    rows = [(q, i, d, score, score, 1, d) for q, i in enumerate(INTENTS) for d, score in ((1, 2.0), (2, 1.3), (3, 1.29))]
    rows += [(90, "procedure", 1, 2.0, 1.0, 1, 0), (90, "procedure", 2, 1.23, 1.0, 1, 1), (91, "procedure", 1, 1.0, 1.0, 1, 0), (91, "procedure", 2, 0.74, 1.0, 1, 1)]
    stats = spark.createDataFrame(rows, "question_id int, intent string, document_id long, doc_score double, best double, n_candidates long, first_rank long")
    got = {}
    for r in R.priority_documents(stats).collect():
        got.setdefault(r.question_id, set()).add(r.document_id)
    assert {i: got[q] for q, i in enumerate(INTENTS)} == {"documents": {1}, "deadline": {1}, "form": {1}, **{i: {1, 2} for i in ("rejection", "eligibility", "procedure", "appeal", "other")}}
    assert got[90] == {1} and got[91] == {1}
    one = R.priority_documents(stats, max_documents=1)
    assert one.count() == len(INTENTS) + 2


def branch_by_all_pairs(questions, rows, k, weight):
    """Every row scored for every question: id, block type, text; question, intent, terms."""
    out = set()
    for q, intent, terms in questions:
        kinds, more = (("paragraph", "list", "heading"), 0.2) if intent in ("procedure", "appeal") else (("paragraph", "list"), 0.1)
        scored = []
        for key, kind, text in rows:
            hits = sum(bool(re.search(".*".join(map(re.escape, t.lower().split("%"))).replace("_", "."), text.lower())) for t in terms[:6])
            scored.append((-round(hits * weight + (more if kind in kinds else 0), 6), key))
        out |= {(q, key, -s) for s, key in sorted(scored)[:k] if s < 0}
    return out


def test_branch_equals_all_pairs(spark):
    rng, words = random.Random(7), "order the urgent within high low a_c zz Able".split()
    rows = [(f"s{k:03}", rng.choice(["paragraph", "list", "heading", "other", None]), " ".join(rng.choices(words, k=rng.randint(0, 3)))) for k in range(300)]
    questions = [(1, "procedure", ["order", "THE", "order"]), (2, "documents", ["nothing"]), (3, "other", []), (4, "appeal", ["a_c", "hi%w", "zz"]), (5, "deadline", [f"t{k}" for k in range(6)] + ["order"])]
    q = spark.createDataFrame(questions, "question_id int, intent string, terms array<string>")
    children = spark.createDataFrame([(1, *r) for r in rows], "document_id int, source_id string, block_type string, content string")
    registry = spark.createDataFrame([(1, "active"), (2, "replaced")], "document_id int, status string")
    for k in (3, 12, 200):
        intent, kind = F.col("intent"), F.col("block_type")
        got = R.branch(q, children, registry, "block", ["content"], weight=0.35, boost=R.block_boost(intent, kind), boost_keys=R.block_keys(intent, kind), k=k).collect()
        weigh = {"procedure": 1.0, "documents": 0.65, "other": 1.0, "appeal": 1.0, "deadline": 0.9}
        want = branch_by_all_pairs(questions, rows, k, 0.35)
        by = dict((a, b) for a, b, _ in questions)
        assert {(r.question_id, r.source_id, round(r.score, 6)) for r in got} == {(a, b, round(c * weigh[by[a]], 6)) for a, b, c in want}


def test_facts_meet_by_boosts(spark):
    rng = random.Random(8)
    rows = [(1, f"f{k:03}", rng.choice(["deadline", "documents", "x", None]), rng.choice(["m1", "m2", None]), rng.choice(["s1", None]), "note") for k in range(120)]
    children = spark.createDataFrame(rows, "document_id int, source_id string, fact_type string, measure_code string, subject string, note string")
    q = spark.createDataFrame([(1, "deadline", ["zz"], "m1", "s1"), (2, "documents", ["note"], None, None), (3, "other", [], "m2", None)], "question_id int, intent string, terms array<string>, wanted string, wanted_subject string")
    c = {x: F.col(x) for x in ("intent", "fact_type", "measure_code", "wanted", "subject", "wanted_subject")}
    boost = R.fact_boost(c["intent"], c["fact_type"], c["measure_code"], c["wanted"], c["subject"], c["wanted_subject"])
    keys = R.fact_keys(c["fact_type"], c["measure_code"], c["intent"], c["wanted"], c["subject"], c["wanted_subject"])
    got = R.branch(q, children, spark.createDataFrame([(1, "active")], "document_id int, status string"), "legal_fact", ["note"], boost=boost, boost_keys=keys, keep=R.exact_or_null(c["measure_code"], c["wanted"]), k=10).collect()
    want = set()
    for n, intent, terms, m, s in ((1, "deadline", [], "m1", "s1"), (2, "documents", ["note"], None, None), (3, "other", [], "m2", None)):
        scored = []
        for _, key, kind, measure, subject, _ in rows:
            if m is None or measure is None or m == measure:
                value = 0.35 * len(terms) + (m is not None and measure == m) * 1.0 + (s is not None and subject == s) * 0.7 + (kind == intent and intent in ("deadline", "documents")) * 0.9
                scored.append((-round(value, 6), key))
        want |= {(n, key) for v, key in sorted(scored)[:10] if v < 0}
    assert {(r.question_id, r.source_id) for r in got} == want


def test_threshold(spark):
    f = lambda i, b: spark.range(1).select(R.adaptive_threshold(F.lit(i), F.lit(b))).first()[0]
    assert f("documents", 3.0) == 0.45 and f("deadline", 0.1) == 0.25 and f("procedure", 3.0) == 0.35 and f("rejection", 1.1) == 0.385
