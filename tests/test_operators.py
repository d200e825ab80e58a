import io
import zipfile

from pyspark.sql import functions as F

from lexiquarry.operators import feedback, generate, ingest, publish, render, reuse, store
from lexiquarry.sources import embedding, files, ooxml
from lexiquarry.streaming import feedback as streaming


def test_reuse_status(spark):
    rows = [(2, 5.0, 0), (3, 4.19, 0), (3, 4.2, 0), (4, 4.5, 1), (5, 4.6, 1), (0, None, 0)]
    df = spark.createDataFrame(rows, "n int, a double, l int")
    t, p = F.lit(True), F.lit("passed")
    score = feedback.reuse_score(t, F.col("n"), F.col("a"), F.col("l"))
    got = [r[0].reason for r in df.select(feedback.reuse_status(t, F.lit("grounded_narrative"), p, t, t, F.col("n"), F.col("a"), F.col("l"), score)).collect()]
    assert got == ["insufficient_feedback_count", "avg_feedback_below_threshold", None, "negative_feedback_ratio_too_high", None, "insufficient_feedback_count"]


def test_daily_modes(spark):
    a = spark.sql("SELECT 1 AS answer_id, TIMESTAMP '2024-01-01 10:00:00' AS created_at, 'web' AS channel, 'documents' AS intent, CAST(NULL AS STRING) AS measure_code, 'reused_answer' AS mode, 'passed' AS validation_status")
    v = spark.createDataFrame([(1, 5), (1, 1)], "answer_id int, score int")
    assert [feedback.quality_daily(a, v, as_written=w).first().total_answers for w in (False, True)] == [1, 2]


def test_chunks(spark):
    text = "\n".join("x" * n for n in (500, 600, 300, 2000, 10))
    df = spark.createDataFrame([(1, text), (2, ""), (3, None)], "document_id int, text string")
    assert [len(r.content) for r in ingest.chunks(df).orderBy("chunk_index").collect()] == [1101, 501, 2201, 211]
    assert ingest.chunks(df, as_written=True).count() == 1


def test_cells(spark):
    df = spark.sql("SELECT array('A', 'b', 'A') AS k, array('1', '2', '3', '4') AS c")
    keys = ingest.header_names(F.col("k"))
    assert df.select(ingest.cell_map(keys, F.col("c"))).first()[0] == {"a": "3", "b": "2", "column_4": "4"}


def test_plan(spark):
    reg = spark.createDataFrame([(1, "u1", "active", "h1"), (2, "u2", "active", "h2"), (3, "u3", "replaced", "h3")], "document_id long, doc_uid_base string, status string, content_hash string")
    new = spark.createDataFrame([("a", "u1", "h1", "d"), ("b", "u2", "x", "d"), ("c", "u2", "y", None), ("d", "u3", "h3", "d"), ("e", " ", "z", "d")], "doc_key string, doc_uid_base string, content_hash string, revision_date string")
    plan = publish.publication_plan(new, reg)
    assert {r.doc_key: r["mode"] for r in plan.collect()} == {"a": "conflict", "b": "replace_active_revision", "c": "replace_active_revision_without_revision_date", "d": "insert_new_active", "e": "insert_new_active_unbound"}
    assert {r.document_id: r.status for r in publish.replace_revisions(reg, plan, F.current_timestamp()).collect()} == {1: "active", 2: "replaced", 3: "replaced"}


def test_job_state(spark):
    log = spark.createDataFrame([("j", 1, "running", "a", {"x": "1"}), ("j", 2, "completed", "b", {"x": "2", "y": "3"})], "job_id string, at int, status string, stage string, payload map<string,string>")
    r = publish.job_state(log).first()
    assert (r.status, r.payload) == ("completed", {"x": "2", "y": "3"})


def test_document_items(spark):
    rows = [(1, "Паспорт гражданина (копия)", "", "r1", 1), (1, "Паспорт", "", "r2", 2), (1, "Доверенность", "c1", "r3", 3), (1, "Справка при наличии", "c1", "r4", 4)]
    got = generate.document_items(spark.createDataFrame(rows, "question_id int, document_name string, category_id string, row_id string, place int")).orderBy("place").collect()
    assert [(r.document_name, r.family, r.role, r.applicability) for r in got] == [
        ("Паспорт", "identity_document", "general_document", "always"), ("Справка при наличии", "status_certificate", "general_document", "conditional"), ("Доверенность", "authority_document", "representative_only", "category_specific")]
    assert got[0].row_ids == ["r1", "r2"]


def test_deadline_kind(spark):
    f = lambda s: tuple(spark.range(1).select(generate.deadline_kind(F.lit(s))).first()[0])
    assert f("Срок выплаты ЕДВ")[0] == "payment" and f("срок уведомления о решении")[0] == "notification" and f("рассмотрение заявления")[0] == "decision" and f("") == ("other", 0.0)
    assert spark.range(1).select(generate.deadline_value(F.lit("решение в течение 10 рабочих дней, не позднее вторника"))).first()[0] == "в течение 10 рабочих дней"


def test_freshness_and_integrity(spark):
    reg = spark.createDataFrame([(1, "active", "h", "f"), (2, "replaced", "h", "f")], "document_id long, status string, content_hash string, file_hash string")
    ev = spark.createDataFrame([(1, 1, "h", None, None), (2, 2, "h", None, None), (3, 9, "h", None, None), (4, 1, "x", None, None), (5, 1, None, None, None), (6, None, None, None, "b"), (7, 1, "h", None, "b")], "answer_id int, document_id long, document_content_hash string, document_file_hash string, block_id string")
    ev = ev.withColumns({c: F.lit(None).cast("string") for c in ("table_id", "table_row_id", "legal_fact_id")})
    answers = spark.createDataFrame([(k, "e") for k in range(1, 9)], "answer_id int, evidence_hash string")
    assert [r.is_fresh for r in reuse.freshness(answers, ev, reg).orderBy("answer_id").collect()] == [True, False, False, False, False, False, True, False]
    assert {r.answer_id: r.block_reason for r in reuse.integrity(answers, ev).collect() if r.answer_id > 5} == {6: None, 7: "invalid_evidence_items", 8: "no_evidence_items"}


def test_render(spark):
    c = F.array(F.struct(F.lit("A.b").alias("label"), F.lit("http://x").alias("url")))
    assert spark.range(1).select(render.citations_block(c, F.lit("html"))).first()[0] == '<b>Sources</b>\n1. <a href="http://x">A.b</a>'
    assert spark.range(1).select(render.keyboard(F.lit("a"), F.lit(True))).first()[0][4].callback_data == "fb:a:5"


def docx() -> bytes:
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    row = lambda *c: "<w:tr>" + "".join(f"<w:tc>{p(x)}</w:tc>" for x in c) + "</w:tr>"
    body = p("Приказ") + f"<w:tbl>{row('A', 'B')}{row('1', '2')}</w:tbl>" + p("Конец")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def test_docx(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(docx())
    (tmp_path / "b.docx").write_bytes(b"no zip")
    own = files.files(spark, str(tmp_path))
    assert own.count() == 2 and own.filter("length(file_hash) = 64").count() == 2
    items = ooxml.items(own)
    assert items.filter("kind = 'error'").count() == 1
    good = items.filter("kind <> 'error'")
    assert ooxml.plain_text(good).first().text == "Приказ\nA | B\n1 | 2\nКонец"
    assert ooxml.table_rows(good).count() == 2


def test_embedding(spark):
    df = spark.createDataFrame([("a b",), (None,)], "t string")
    got = [r[0] for r in df.select(embedding.embed(spark, F.col("t"), dimension=8, provider=lambda ts: embedding.hashed(ts, 8))).collect()]
    assert [len(v) for v in got] == [8, 8] and abs(sum(x * x for x in got[0]) - 1) < 1e-5


def test_streams(spark, tmp_path):
    rows = [("s1", f"a{k:02}", f"2024-01-01 {k % 24:02}:00:00") for k in range(12)]
    path = str(tmp_path / "in")
    src = spark.createDataFrame(rows, "session_id string, answer_id string, at string").withColumn("at", F.to_timestamp("at")).coalesce(1)
    src.write.parquet(path)
    q = streaming.sampled(spark.readStream.schema(src.schema).parquet(path)).writeStream.format("memory").queryName("sampled").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.answer_id for r in spark.table("sampled").filter("ask").collect()) == ["a04", "a09"]

    votes = src.select("session_id", "answer_id", F.lit(5).alias("score"), F.col("at").alias("submitted_at"))
    twice = str(tmp_path / "votes")
    votes.union(votes).coalesce(1).write.parquet(twice)
    q = streaming.votes_once(spark.readStream.schema(votes.schema).parquet(twice)).writeStream.format("memory").queryName("once").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("once").count() == 12


def test_similar_misses_nothing(spark):
    """Against all pairs said plainly: equal, contained (also within words) and alike texts, short ones too."""
    import random

    rng, words = random.Random(3), [a + b for a in "bdgklmn" for b in ("a", "ei", "o")]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 12))) for _ in range(60)]
    asked = texts[:20] + [" ".join(texts[30].split()[1:-1]), texts[31] + " " + texts[32], texts[33][1:-1], "a", "", None]
    q = spark.createDataFrame(list(enumerate(asked)), "question_id int, text string")
    h = spark.createDataFrame([(100 + k, t) for k, t in enumerate(texts + ["", None, "ba"])], "past_id int, text string")
    got = {(r.question_id, r.past_id): r.similarity for r in reuse.similar(q, h, most=1000).collect()}

    def similarity(a, b):
        if not a or not b:
            return 0.0
        x, y = set(a.split(" ")), set(b.split(" "))
        j = len(x & y) / len(x | y)
        return 1.0 if a == b else 0.97 if a in b or b in a else 0.95 if j >= 0.8 else 0.92 if j >= 0.7 else 0.9 if j >= 0.6 else 0.0

    want = {(i, 100 + k): similarity(a, b) for i, a in enumerate(asked) for k, b in enumerate(texts + ["", None, "ba"]) if similarity(a, b) >= 0.9}
    assert got == want


def test_similar_keeps_nothing_of_the_past(spark, monkeypatch):
    """The past is not cached, its repeated ids are rows of their own, and keys joined by shuffle give the same."""
    import random

    rng, words = random.Random(5), [a + b for a in "bdgklmn" for b in ("a", "ei", "o")]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 9))) for _ in range(80)]
    q = spark.createDataFrame(list(enumerate(texts[:25] + ["a", texts[40][1:], "ba " + texts[41] + " ba"])), "question_id int, text string")
    h = spark.createDataFrame([(k // 2, t) for k, t in enumerate(texts + texts[:10] + [texts[3] + " x", "b", None])] + [(7, texts[2]), (7, texts[2])], "past_id int, text string")
    told = lambda df: sorted(map(tuple, df.select("question_id", "past_id", "similarity").collect()))
    plain = [(i, p, 1.0) for i, t in q.collect() for p, other in h.collect() if t == other]
    df = reuse.similar(q, h, most=1000)
    assert not any("past" in line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "InMemoryRelation" in line)
    got = told(df)
    assert [x for x in got if x[2] == 1.0] == sorted(plain) and len(got) > len(plain)
    monkeypatch.setattr(reuse, "KEYS", 0)
    assert told(reuse.similar(q, h, most=1000)) == got


def test_similar_asks_equal_questions_once_and_shuffles_no_words(spark, monkeypatch):
    """Many questions, copies among them: only counts of words and best pairs are shuffled, and each copy gets its pairs."""
    import random

    rng, words = random.Random(11), [f"w{k}" for k in range(60)]
    texts = [" ".join(rng.sample(words, 40)) for _ in range(400)]
    asked = texts[:6] * 10 + [" ".join(t.split()[3:9]) for t in texts[:12]]
    q = spark.createDataFrame(list(enumerate(asked)), "question_id int, text string")
    h = spark.createDataFrame([(k, t) for k, t in enumerate(texts * 5)], "past_id int, text string").coalesce(2)
    monkeypatch.setattr(reuse, "KEYS", 400)

    def shuffled():
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = shuffled()
    rows = reuse.similar(q, h, most=4).collect()
    assert shuffled() - before < 10_000  # the past has 80,000 words
    got = {}
    for r in rows:
        got.setdefault(r.question_id, []).append((r.place, r.past_id, r.similarity))
    assert all(sorted(got[k]) == sorted(got[k % 6]) for k in range(60))
    assert sorted(got[0]) == [(p + 1, 400 * p, 1.0) for p in range(4)]
    assert all(len(got[60 + k]) == 4 and {r[2] for r in got[60 + k]} == {0.97} for k in range(12))


def test_reuse_decisions_keep_nothing_of_the_past(spark):
    from lexiquarry import catalogue

    plan = catalogue.QUERIES["q35_reuse_decision"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert not any("past" in line for line in plan.splitlines() if "InMemoryRelation" in line)


def test_all_qc_codes(spark):
    m = spark.createDataFrame([(0, 0, 0, 0, 0, 0.0, 0.0, 0.0, False, 0, 0, 0, 0, 0, 2), (500, 9, 0, 9, 400, 0.0, 0.0, 40.0, False, 1, 0, 4, 0, 4, 1)],
                              "text_chars int, n_blocks int, n_empty int, n_meaningful int, chars int, empty_ratio double, other_ratio double, avg_block double, duplicate_order boolean, n_tables int, n_without_rows int, n_rows int, n_unbound int, n_empty_rows int, declared_tables int")
    from lexiquarry.operators import ingest as I

    a, b = (r.errors for r in I.qc_verdict(m).orderBy("text_chars").collect())
    assert {"declared_tables_not_extracted", "no_retrievable_units", "normalized_text_empty"} <= set(a) and b == ["all_table_rows_empty"]


def test_answer_points(spark):
    from lexiquarry.operators import answers as A

    facts = spark.createDataFrame(
        [("1", "documents", "", ["a", "b"], None, None), ("2", "deadline", "", None, {"days": "5"}, None), ("3", "rejection_reason", "no papers.", None, None, None),
         ("4", "eligibility", "lives here", None, None, {"age": "60"}), ("5", "other", "A note..", None, None, None), ("6", "other", "", None, None, None)],
        "source_id string, fact_type string, validity_note string, documents array<string>, value map<string,string>, condition map<string,string>")
    rows = spark.createDataFrame([("1", "a  row", None), ("2", "", {"k": "v", "none": ""})], "source_id string, row_summary string, cells map<string,string>")
    tables = spark.createDataFrame([("1", "", "Fees")], "source_id string, summary string, table_title string")
    blocks = spark.createDataFrame([("1", "x" * 300), ("2", "a row.")], "source_id string, content string")
    asked = [("legal_fact", str(k)) for k in range(1, 8)] + [("table_row", "1"), ("table_row", "2"), ("table_row", "3"), ("table", "1"), ("block", "1"), ("block", "2")]
    cand = spark.createDataFrame([(k, t, i, k, "cut  off") for k, (t, i) in enumerate(asked)], "question_id int, source_type string, source_id string, place int, snippet string")
    got = {r.place: r.point for r in A.hydrate(cand, {"legal_fact": facts, "table_row": rows, "table": tables, "block": blocks}).select("place", A.answer_point().alias("point")).collect()}
    assert [got[k] for k in range(len(asked))] == [
        "Необходимые документы: a, b.", "Срок: days: 5.", "Основания отказа: no papers.", "Условия предоставления: age: 60; lives here.", "A note.", None, "cut  off",
        "a row.", "k: v.", "cut off.", "Найдена релевантная таблица: Fees.", "x" * 257 + "...", "a row."]
    few = A.answer_points(A.hydrate(cand.withColumn("question_id", F.lit(1)), {"block": blocks, "table_row": rows}))
    assert [r.point for r in few.orderBy("place").collect()] == ["cut  off", "a row.", "k: v.", "cut off.", "x" * 257 + "..."]


def test_evidence_hashes(spark):
    import hashlib
    import json

    from lexiquarry.operators import answers as A

    ev = spark.createDataFrame(
        [(1, 5, "block", "supporting", None, "b", None, None, {"z": "1", "a": "я"}), (1, 2, "document", "primary", "d", None, "h", None, {}), (1, 9, "document", "primary", "d", None, "h", "f", {})],
        "answer_id int, evidence_order int, evidence_item_type string, role_code string, document_id string, block_id string, document_content_hash string, document_file_hash string, citation map<string,string>")
    items = [{k: None for k in ("block_id", "document_content_hash", "document_file_hash", "document_id", "legal_fact_id", "table_id", "table_row_id")} for _ in range(3)]
    items[0] |= {"order": 1, "evidence_item_type": "document", "role_code": "primary", "document_id": "d", "document_content_hash": "h", "citation_json": {}}
    items[1] |= {"order": 2, "evidence_item_type": "block", "role_code": "supporting", "block_id": "b", "citation_json": {"a": "я", "z": "1"}}
    items[2] |= {"order": 3, "evidence_item_type": "document", "role_code": "primary", "document_id": "d", "document_content_hash": "h", "document_file_hash": "f", "citation_json": {}}
    said = lambda x: hashlib.sha256(json.dumps(x, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    got = A.evidence_hashes(ev).first()
    assert (got.document_set_hash, got.evidence_hash, got.n_items) == (said({"documents": ["h"]}), said(items), 3)
    given = spark.createDataFrame([(1, " t ", True), (2, "u", False)], "answer_id int, answer_text string, reuse_allowed boolean")
    events, rows, candidates = A.answer_events(given, ev)
    by = {r.answer_id: r for r in events.collect()}
    assert by[2].evidence_hash == said([]) and by[2].document_set_hash == said({"documents": []}) and by[1].answer_text == "t"
    assert sorted(r.evidence_order for r in rows.collect()) == [1, 2, 3]
    assert [r.answer_id for r in candidates.collect()] == [1]


def test_publish_again(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "document_id int, content string")
    tables = {"document_blocks": rows, "document_registry": rows.select("document_id")}
    for batch in ("one", "one", "two"):
        publish.publish(tables, str(tmp_path), batch)
    read = store.read(spark, str(tmp_path), "document_blocks")
    assert {r["batch"]: r["count"] for r in read.groupBy("batch").count().collect()} == {"one": 2, "two": 2}
    docs = spark.createDataFrame([(1, "passed", "f", "c"), (2, None, "f", "c"), (3, "passed", " ", "c"), (4, "passed", "f", None)], "document_id int, qc_status string, file_hash string, content_hash string")
    assert {r.document_id: r.reason for r in publish.unpublishable(docs).collect()} == {2: "qc_not_passed", 3: "file_hash_missing", 4: "content_hash_missing"}


def test_deadline_cells(spark):
    rows = spark.createDataFrame([(1, {"deadline_value": "", "срок_ответа": "не более 26 рабочих дней", "service_name": "Выплата", "row_number": "3"}), (2, {"note": "в 5 дней", "who": " "})], "k int, cells map<string,string>")
    got = rows.select("k", generate.cells_deadline(F.col("cells")).alias("v"), generate.cells_scope(F.col("cells")).alias("s"), generate.specificity(generate.cells_deadline(F.col("cells"))).alias("n")).orderBy("k").collect()
    assert (got[0].v, got[0].s, got[0].n) == ("не более 26 рабочих дней", "service name: Выплата", 7)
    assert (got[1].v, got[1].s) == (None, None)
