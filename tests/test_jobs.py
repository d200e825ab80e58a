import pytest
from pyspark.sql import functions as F

from lexiquarry.operators import jobs, publish, store
from lexiquarry.sources import files
from tests_docx import docx


def test_one_of_ten_fails_alone(spark, tmp_path):
    def doubled(row):
        if row["v"] == 7:
            raise ValueError("seven")
        return {"w": row["v"] * 2}

    docs = spark.range(10).select(F.col("id").alias("document_id"), F.col("id").alias("v"))
    stages = [("double", lambda df: jobs.guarded(df, doubled, "w long")), ("check", lambda df: df.withColumn("error", F.when(F.col("w") == 4, "four"))), ("end", lambda df: df.select("document_id", "w"))]
    out = jobs.run(spark, str(tmp_path), "j", docs, stages)
    assert sorted(r.w for r in out.collect()) == [0, 2, 6, 8, 10, 12, 16, 18]
    got = {r.document_id: (r.status, r.stage, r.error) for r in jobs.states(spark, str(tmp_path), "j", stages).collect()}
    assert got[7] == ("failed", "double", "ValueError: seven") and got[2] == ("failed", "check", "four") and got[0] == ("completed", "end", None) and len(got) == 10
    assert store.read(spark, str(tmp_path), jobs.LOG).count() == 10 + 9 + 8


def test_a_job_goes_on_where_it_stopped(spark, tmp_path):
    calls, broken = [], [True]

    def second(df):
        calls.append("second")
        return df.withColumn("b", F.when(F.lit(broken[0]), F.raise_error(F.lit("machine lost"))).otherwise(1))

    def first(df):
        calls.append("first")
        return df.withColumn("a", F.lit(1))

    docs, stages = spark.range(3).toDF("document_id"), [("first", first), ("second", second)]
    with pytest.raises(Exception, match="machine lost"):
        jobs.run(spark, str(tmp_path), "j", docs, stages)
    assert {(r.status, r.stage) for r in jobs.states(spark, str(tmp_path), "j", stages).collect()} == {("running", "first")}
    broken[0] = False
    for _ in range(2):
        assert jobs.run(spark, str(tmp_path), "j", docs, stages).count() == 3
    assert calls == ["first", "second", "second"]
    assert store.read(spark, str(tmp_path), jobs.LOG).count() == 6


def test_files_to_registry(spark, tmp_path):
    inbox, folder = tmp_path / "in", str(tmp_path / "out")
    inbox.mkdir()
    long = "Обычный абзац с достаточно длинным текстом, который проверка качества сочтёт настоящим содержанием документа."
    for k in range(3):
        (inbox / f"order{k}.docx").write_bytes(docx(f"Приказ № {k}-п", long, long + " Ещё.", "1. Пункт первый приказа.", f"от 0{k + 1}.02.2024"))
    (inbox / "short.docx").write_bytes(docx("Мало"))
    (inbox / "bad.docx").write_bytes(b"no zip")
    table = files.files(spark, str(inbox))
    got = {r.stage: r for r in jobs.ingest_files(spark, folder, "one", table).collect() if r.status == "failed"}
    assert got["normalization"].error.startswith("BadZipFile") and got["quality_control"].error == "normalized_text_too_short"
    active = publish.registry(spark, folder)
    assert {r.title for r in active.collect()} == {"Приказ № 0-п", "Приказ № 1-п", "Приказ № 2-п"} and active.filter("status = 'active'").count() == 3
    assert store.read(spark, folder, "document_blocks").count() == 15
    again = {(r.status, r.stage) for r in jobs.ingest_files(spark, folder, "two", table).collect()}
    assert again == {("skipped", "idempotency_check"), ("failed", "normalization"), ("failed", "quality_control")}
    (inbox / "order1.docx").write_bytes(docx("Приказ № 1-п", long, long + " Новое.", "1. Пункт первый приказа."))
    jobs.ingest_files(spark, folder, "three", files.files(spark, str(inbox)).filter("file_name = 'order1.docx'"))
    assert {r["status"]: r["count"] for r in publish.registry(spark, folder).groupBy("status").count().collect()} == {"active": 3, "replaced": 1}


def test_every_warning(spark):
    from lexiquarry.operators import ingest

    names = ("detected_language_code_missing document_title_missing doc_uid_base_missing revision_date_missing other_block_ratio_too_high avg_block_text_length_too_low all_block_order_values_missing block_order_not_monotonic "
             "some_tables_without_title some_tables_with_unknown_type document_type_missing source_authority_missing legal_facts_missing measure_codes_missing retrievable_units_count_low").split()  # fmt: skip
    rows = [(5, None, " ", None, None, 0.9, 2, 3.0, 2, 0, False, 1, 1, "", None, 0, 0, 2), (5, "ru", "t", "u", "d", 0.1, 2, 30.0, 2, 2, True, 0, 0, "k", "a", 1, 1, 9), (0, None, "t", "u", "d", 0.1, 0, 0.0, 0, 0, None, 0, 0, "k", "a", 1, 1, 3)]
    facts = spark.createDataFrame(rows, "text_chars int, language string, title string, doc_uid_base string, revision_date string, other_ratio double, n_meaningful int, avg_block double, n_blocks int, n_ordered int, is_monotonic boolean, n_untitled int, n_untyped int, document_type string, authority string, n_facts int, n_measures int, n_units int")
    got = [r.w for r in facts.select(ingest.qc_warnings(facts).alias("w")).collect()]
    assert got == [names, [], []]
    few = facts.select("title", "n_units")
    assert few.select(ingest.qc_warnings(few).alias("w")).first().w == ["document_title_missing", "retrievable_units_count_low"]
