import datetime as dt
import hashlib
import json
import math
import random

from pyspark.sql import functions as F

from lexiquarry.functions.canonical import canonical
from lexiquarry.operators import answers, store

said = lambda x: json.dumps(x, ensure_ascii=False, sort_keys=True, separators=(",", ":"), default=lambda t: t.astimezone(dt.timezone.utc).isoformat())


def told(spark, rows, kind):
    df = spark.createDataFrame([(r,) for r in rows], f"x {kind}")
    return [r.c for r in df.select(canonical(F.col("x"), df.schema["x"].dataType).alias("c")).collect()]


def test_numbers_read_back(spark):
    rng = random.Random(1)
    rows = [0.0, -0.0, 1.0, 0.1, 2.5e-5, 1e-4, 0.001, 1e7, 123456789.25, 1e15, 1e16, 1.5e16, 1e22, -3.25e100, 1.7976931348623157e308, math.inf, -math.inf, None]
    rows += [round(rng.uniform(-1, 1) * 10 ** rng.randint(-12, 20), rng.randint(0, 9)) for _ in range(500)]
    assert told(spark, rows, "double") == [said(x) for x in rows]


def test_strings(spark):
    rows = ["", "plain", "é я 🙂", "\\u000B is written \\", *[chr(c) + "x" for c in range(128)], "\u2028", "<a href='x'>/</a>", None]
    assert told(spark, rows, "string") == [said(x) for x in rows]


def test_nested_values(spark):
    rng = random.Random(2)
    zone = dt.timezone(dt.timedelta(hours=3))

    def make():
        return {"b": [{"z": rng.choice([None, 1, -7]), "a": {rng.choice("kяéA"): [rng.random() * 1e9, None] for _ in range(3)}} for _ in range(rng.randint(0, 3))], "A": rng.choice([None, True]), "at": dt.datetime(2024, 5, 17, 23, 30, 1, rng.choice([0, 5, 120000]), zone), "é\"q": rng.choice(["x", None, "a\nb"]), "aa": rng.choice([None, []])}

    rows = [make() for _ in range(50)] + [None]
    kind = "struct<b: array<struct<z: bigint, a: map<string, array<double>>>>, A: boolean, at: timestamp, `é\"q`: string, aa: array<array<int>>>"
    want = [said(x) for x in rows]
    assert told(spark, rows, kind) == want
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert told(spark, rows, kind) == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_four_hashes_and_nested_citations(spark, tmp_path):
    hashed = lambda x: hashlib.sha256(said(x).encode()).hexdigest()
    cited = {"page": 3, "where": {"row": None, "at": [1, 2]}}
    evidence = spark.createDataFrame([(1, 1, "block", "primary", "b", cited)], "answer_id int, evidence_order int, evidence_item_type string, role_code string, block_id string, citation struct<page: int, where: struct<row: string, at: array<int>>>")
    given = spark.createDataFrame([(1, " t  u ", True, {"x": [1.5]}), (2, "v", False, None)], "answer_id int, answer_text string, reuse_allowed boolean, payload map<string,array<double>>")
    item = {k: None for k in ("document_content_hash", "document_file_hash", "document_id", "legal_fact_id", "table_id", "table_row_id")} | {"order": 1, "evidence_item_type": "block", "role_code": "primary", "block_id": "b", "citation_json": cited}
    got = {r.answer_id: r for r in answers.answer_events(given, evidence)[0].collect()}
    assert got[1].evidence_hash == hashed([item]) and got[1].answer_payload_hash == hashed({"x": [1.5]}) and got[2].answer_payload_hash == hashed(None)
    assert got[1].answer_text_hash == hashlib.sha256(b"t u").hexdigest() and got[2].document_set_hash == hashed({"documents": []})
    assert [answers.store_answers(spark, str(tmp_path), "b", given, evidence) for _ in range(2)] == [True, False]
    assert store.read(spark, str(tmp_path), "answer_event").count() == 2 and store.read(spark, str(tmp_path), "answer_reuse_candidate").count() == 1


def test_history_of_one_question_does_not_crowd_out(spark):
    """A question with many leading answers of its own still gets the first ones of others."""
    rows = [(k, 1 if k < 200 else 2 + k % 3, 1.0 - k / 1000) for k in range(240)]
    past = spark.createDataFrame(rows, "answer_id int, question_id int, reuse_score double").selectExpr("*", "5 AS avg_score", "3 AS n_votes", "timestamp'2024-01-01' AS created_at", "'same words here' AS question_text", "'documents' AS intent", "'m' AS measure_code", "CAST(null AS STRING) AS subject", "true AS reuse_allowed", "'grounded' AS mode", "'passed' AS validation_status", "true AS deterministic_passed", "true AS semantic_passed", "'eligible' AS reuse_status", "true AS reuse_effective")
    asked = spark.createDataFrame([(1,), (2,), (99,)], "question_id int").selectExpr("*", "'same words here' AS text", "'documents' AS intent", "'m' AS measure_code", "CAST(null AS STRING) AS subject")
    got = {}
    for r in answers.history_matches(asked, past, most=5).orderBy("question_id", "place").collect():
        got.setdefault(r.question_id, []).append(r.past_id)
    assert got == {1: [200, 201, 202, 203, 204], 2: [0, 1, 2, 3, 4], 99: [0, 1, 2, 3, 4]}
