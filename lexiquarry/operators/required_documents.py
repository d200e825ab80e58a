"""Answers to questions for documents: rows of documents tables to items, merged, put in four lists, told as a text by channel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import generate as G

#: Names that are headings, channels with their words and the cells that tell how to hand in.
SERVICE_NAMES = ("наименование документа", "наименование документов", "документы", "документы информация необходимые", "исчерпывающий перечень документов", "способ подачи в уполномоченное учреждение")
CHANNELS = {"epgu": "через ЕПГУ", "regional_portal": "через РПГУ / краевой портал", "in_person": "лично", "post": "почтовым отправлением", "mfc": "через МФЦ"}
NOTE_CELLS = {"epgu": ("epgu_submission",), "regional_portal": ("regional_portal_submission", "epgu_submission"), "in_person": ("in_person_submission",), "post": ("post_submission",), "mfc": ("mfc_submission",)}
IDENTITY, APPLICATION = "Паспорт или иной документ, удостоверяющий личность", "Заявление (в зависимости от основания обращения)"
HEADINGS = ("Дополнительно в отдельных случаях могут потребоваться:", "Если документы подаёт представитель, также потребуется:", "Для отдельных категорий заявителей могут потребоваться дополнительные документы:")
ENDING = "Итоговый перечень зависит от конкретной жизненной ситуации, основания обращения и категории заявителя."
SIGNS = ",.;:()«»\"'"


def _clean(c: Column) -> Column:
    return F.nullif(T.collapse(c), F.lit(""))


def note(cells: Column, channel: Column) -> Column:
    """How the row says to hand in by this channel."""
    cell = lambda k: _clean(F.try_element_at(cells, F.lit(k)))
    out = F.lit(None).cast("string")
    for name, keys in NOTE_CELLS.items():
        out = F.when(channel == name, F.coalesce(*[cell(k) for k in keys])).otherwise(out)
    return out


def judged_rows(questions: DataFrame, candidates: DataFrame) -> DataFrame:
    """Rows with name, category, note, family, role and applicability, or with the first ``drop_reason``.

    ``questions``: question_id, channel (null: none).  ``candidates``: question_id, place, source_type, source_id, semantic, cells.
    """
    own = candidates.filter("source_type = 'table_row'").join(questions.select("question_id", "channel"), "question_id")
    cells = F.col("cells")
    own = own.withColumns({"name": _clean(F.try_element_at(cells, F.lit("document_name"))), "category": _clean(F.try_element_at(cells, F.lit("applicant_category_id"))), "note": note(cells, F.col("channel"))})
    plain = T.normalize_for_documents(F.col("name"), SIGNS)
    reason = (F.when(F.lower(F.trim(F.coalesce("semantic", F.lit("")))) != "documents", "not_documents_table").when(cells.isNull(), "cells_not_dict").when(F.col("name").isNull(), "empty_document_name").when(plain.isin(*SERVICE_NAMES), "service_header_row"))
    own = own.withColumn("drop_reason", reason).withColumn("family", G.family(F.col("name"))).withColumn("role", G.role(F.col("family")))
    return own.withColumn("applicability", G.applicability(F.col("name"), F.col("family"), F.col("category")))


def merged_items(judged: DataFrame) -> DataFrame:
    """One item for each family, role and applicability of a question, with ids, categories and notes in the order they came."""
    in_order = lambda c: F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("place", F.col(c).cast("string").alias("v"))))), lambda x: x["v"]))
    out = judged.filter("drop_reason IS NULL").groupBy("question_id", "family", "role", "applicability").agg(
        F.count("*").alias("n"), F.min_by("name", "place").alias("first"), F.min_by("name", F.struct(F.char_length("name"), F.lower("name"), "place")).alias("shortest"), in_order("source_id").alias("row_ids"), in_order("category").alias("categories"), in_order("note").alias("notes"))
    chosen = F.when(F.col("family") != "application_request", F.col("shortest")).when(F.col("n") > 1, APPLICATION).otherwise(F.col("first"))
    bare = F.when(F.contains(chosen, F.lit("(")) & F.contains(chosen, F.lit(")")), F.coalesce(F.nullif(F.trim(F.substring_index(chosen, "(", 1)), F.lit("")), chosen)).otherwise(chosen)
    name = F.when(F.col("family") == "identity_document", IDENTITY).otherwise(bare)
    part = F.when(F.col("role") == "representative_only", 2).when(F.col("applicability") == "category_specific", 3).when(F.col("applicability") == "always", 0).otherwise(1)
    return out.select("question_id", part.alias("part"), G.ordered(F.col("role"), G.ROLE_ORDER).alias("by_role"), G.ordered(F.col("applicability"), G.APPLICABILITY_ORDER).alias("by_use"), F.lower(name).alias("by_name"), "family", name.alias("name"), F.nullif(F.array_join("notes", "; "), F.lit("")).alias("note"), "row_ids", "categories")


def answers(questions: DataFrame, candidates: DataFrame) -> DataFrame:
    """A row a question: can_answer, items (in order), dropped, reason and text."""
    judged = judged_rows(questions, candidates)
    item = F.struct("by_role", "by_use", "by_name", "family", "part", "name", "note", "row_ids", "categories")
    items = merged_items(judged).groupBy("question_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    dropped = judged.filter("drop_reason IS NOT NULL").groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("place", F.col("source_id").cast("string").alias("source_id"), F.col("drop_reason").alias("reason")))).alias("dropped"))
    out = questions.select("question_id", "channel").join(items, "question_id", "left").join(dropped, "question_id", "left")
    channel, has = F.lit("указанным способом"), F.coalesce("channel", F.lit("")) != ""
    for name, said in CHANNELS.items():
        channel = F.when(F.col("channel") == name, said).otherwise(channel)
    told = lambda x: F.concat(x["name"], F.when(has & x["note"].isNotNull(), F.concat(F.lit(" — "), x["note"])).otherwise(""))
    of = lambda k: F.filter("items", lambda x: x["part"] == k)
    first = F.concat(F.lit("Для предоставления услуги "), F.when(has, F.concat(F.lit("при подаче "), channel, F.lit(" "))).otherwise(""), F.lit("обычно требуются следующие документы:"))
    lines = [F.array(first), F.transform(of(0), lambda x, k: F.concat((k + 1).cast("string"), F.lit(". "), told(x)))]
    for k, heading in enumerate(HEADINGS, 1):
        lines.append(F.when(F.size(of(k)) > 0, F.concat(F.array(F.lit(""), F.lit(heading)), F.transform(of(k), lambda x: F.concat(F.lit("— "), told(x))))).otherwise(F.array().cast("array<string>")))
    text = F.array_join(F.concat(*lines, F.array(F.lit(""), F.lit(ENDING))), "\n")
    can = F.col("items").isNotNull()
    return out.select("question_id", can.alias("can_answer"), "items", "dropped", F.when(~can, "no_documents_rows").alias("reason"), F.when(can, text).alias("text"))
