from lexiquarry.operators import required_documents as D


def test_lists_notes_and_reasons(spark):
    row = lambda q, place, cells, semantic="documents", kind="table_row": (q, place, kind, f"r{place}", semantic, cells)
    candidates = spark.createDataFrame([
        row(1, 0, {"document_name": "Запрос о выплате", "in_person_submission": "оригинал"}), row(1, 1, {"document_name": "Заявление на выплату", "in_person_submission": "копия"}), row(1, 2, {"document_name": "Паспорт гражданина РФ", "in_person_submission": "оригинал"}),
        row(1, 3, {"document_name": "Доверенность (для представителя)"}), row(1, 4, {"document_name": "Свидетельство о рождении"}), row(1, 5, {"document_name": "Трудовая  книжка", "applicant_category_id": "A"}), row(1, 6, {"document_name": "Сведения о доходах (за год)", "applicant_category_id": "B"}),
        row(1, 7, {"document_name": "Наименование документа:"}), row(1, 8, {"document_name": " "}), row(1, 9, None), row(1, 10, {"document_name": "x"}, "deadlines"), row(1, 11, None, None, "block"),
        row(2, 0, {"document_name": "Заявление", "epgu_submission": "образ"}), row(3, 0, {}),
    ], "question_id int, place int, source_type string, source_id string, semantic string, cells map<string,string>")
    asked = spark.createDataFrame([(1, "in_person"), (2, None), (3, "mfc"), (4, None)], "question_id int, channel string")
    got = {r.question_id: r for r in D.answers(asked, candidates).collect()}
    assert got[1].text == "\n".join([
        "Для предоставления услуги при подаче лично обычно требуются следующие документы:", "1. Заявление — оригинал; копия", "2. Паспорт или иной документ, удостоверяющий личность — оригинал", "",
        "Дополнительно в отдельных случаях могут потребоваться:", "— Свидетельство о рождении", "", "Если документы подаёт представитель, также потребуется:", "— Доверенность", "",
        "Для отдельных категорий заявителей могут потребоваться дополнительные документы:", "— Трудовая книжка", "", D.ENDING])
    assert [(d.place, d.reason) for d in got[1].dropped] == [(7, "service_header_row"), (8, "empty_document_name"), (9, "cells_not_dict"), (10, "not_documents_table")]
    merged = next(i for i in got[1]["items"] if i.family == "employment_proof")
    assert merged.row_ids == ["r5", "r6"] and merged.categories == ["A", "B"]
    assert got[2].text.startswith("Для предоставления услуги обычно требуются следующие документы:\n1. Заявление\n\n")
    assert (got[3].can_answer, got[3].reason, got[3].text) == (False, "no_documents_rows", None) and got[4].dropped is None
