"""Answer events: hydrated evidence, answer points, hashes, safe answers, history of reusable answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.canonical import canonical, quoted
from ..functions.similarity import text_similarity
from . import store
from .publish import row_id
from .reuse import eligible, signature_score

#: Fields of evidence objects that points are made of; an object frame may lack any of them.
POINT_FIELDS = {
    "fact_type": "string", "validity_note": "string", "documents": "array<string>", "value": "map<string,string>", "condition": "map<string,string>",
    "row_summary": "string", "cells": "map<string,string>", "summary": "string", "table_title": "string", "content": "string",
}

#: Kinds of facts and the words in front of their points.
DOCUMENT_FACTS = ("required_documents", "documents")
DEADLINE_FACTS = ("deadline", "review_period", "payment_deadline")
REJECTION_FACTS = ("rejection_reason", "grounds_for_refusal")
ELIGIBILITY_FACTS = ("eligibility", "condition", "recipient_category")
SAFE_TEXT = "Я не могу надёжно ответить на этот вопрос только по найденным источникам. Для точного ответа в текущей выборке недостаточно подтверждённых данных."


def hydrate(candidates: DataFrame, objects: dict[str, DataFrame]) -> DataFrame:
    """Candidates (source_type, source_id) with the POINT_FIELDS of their objects and ``found``.

    All kinds of objects meet the candidates in one join; a missing object leaves nulls.
    """
    whole = None
    for kind, df in objects.items():
        fields = [(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in POINT_FIELDS.items()]
        part = df.select(F.lit(kind).alias("source_type"), F.col("source_id").cast("string").alias("source_id"), *fields, F.lit(True).alias("found"))
        whole = part if whole is None else whole.unionByName(part)
    out = candidates.withColumn("source_id", F.col("source_id").cast("string")).join(whole, ["source_type", "source_id"], "left")
    return out.withColumn("found", F.coalesce("found", F.lit(False)))


def answer_point() -> Column:
    """The point that a hydrated candidate makes; null if it makes none."""
    note = F.trim(F.coalesce("validity_note", F.lit("")))
    bare = F.regexp_replace(note, r"\.+$", "")
    filled = lambda c: F.size(F.coalesce(F.col(c), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))) > 0
    compact = lambda c: T.compact_map(F.col(c))
    kind = F.trim(F.coalesce("fact_type", F.lit("")))
    said = lambda lead, c: F.concat(F.lit(lead), c, F.lit("."))
    conditions = F.concat_ws("; ", F.when(filled("condition"), compact("condition")), F.when(note != "", note))
    fact = (
        F.when(kind.isin(*DOCUMENT_FACTS) & (F.coalesce(F.size("documents"), F.lit(0)) > 0), said("Необходимые документы: ", F.array_join(F.slice("documents", 1, 8), ", ")))
        .when(kind.isin(*DOCUMENT_FACTS, *DEADLINE_FACTS) & (note != ""), note)
        .when(kind.isin(*DEADLINE_FACTS) & filled("value"), said("Срок: ", compact("value")))
        .when(kind.isin(*REJECTION_FACTS) & (note != ""), said("Основания отказа: ", bare))
        .when(kind.isin(*REJECTION_FACTS) & filled("value"), said("Основания отказа: ", compact("value")))
        .when(kind.isin(*ELIGIBILITY_FACTS) & (filled("condition") | (note != "")), said("Условия предоставления: ", conditions))
        .when(note != "", F.concat(bare, F.lit("."))).when(filled("value"), said("", compact("value")))
    )
    row = F.when(T.first_filled(F.col("row_summary")).isNotNull(), T.sentence(F.col("row_summary"))).when(filled("cells"), said("", compact("cells")))
    title = T.first_filled(F.col("table_title"))
    table = F.when(T.first_filled(F.col("summary")).isNotNull(), T.sentence(F.col("summary"))).when(title.isNotNull(), said("Найдена релевантная таблица: ", title))
    block = T.sentence(T.shorten(F.col("content"), 260, collapsed=True))
    kinds = F.col("source_type")
    unknown = F.when(kinds == "legal_fact", F.col("snippet")).when(kinds.isin("table_row", "table", "block"), T.sentence(F.col("snippet")))
    made = F.when(kinds == "legal_fact", fact).when(kinds == "table_row", row).when(kinds == "table", table).when(kinds == "block", block)
    return F.nullif(F.when(F.col("found"), made).otherwise(unknown), F.lit(""))


def answer_points(hydrated: DataFrame, *, most: int = 6) -> DataFrame:
    """question_id, place, point: each different point once, where it comes first, the first ``most``."""
    once = hydrated.select("question_id", "place", answer_point().alias("point")).filter("point IS NOT NULL").groupBy("question_id", "point").agg(F.min("place").alias("first"))
    w = Window.partitionBy("question_id").orderBy("first", "point")
    return once.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most).select("question_id", "place", "point")


def submission_channel(constraint: Column, bundle: Column) -> Column:
    """What the question's constraints say, else the query bundle; in lower case."""
    return F.lower(T.first_filled(constraint, bundle))


def query_terms(raw: Column, normalized: Column, measure: Column, subject: Column) -> Column:
    return F.array_compact(F.array(raw, normalized, F.nullif(measure, F.lit("")), F.nullif(subject, F.lit(""))))


def safe_answers(questions: DataFrame, reason: Column, quality: Column) -> DataFrame:
    """The record of an answer that is not given: fixed text and scores, never reused, with its reason."""
    text = F.lit(SAFE_TEXT)
    return questions.select(
        "question_id", F.lit("safe_no_answer").alias("answer_mode"), text.alias("answer_text"), text.alias("answer_text_short"), F.lit(0.35).alias("confidence_score"), F.lit(0.30).alias("trust_score"),
        F.lit("passed").alias("validation_status"), F.lit(True).alias("deterministic_passed"), F.lit(True).alias("semantic_passed"), F.lit(False).alias("reuse_allowed"),
        reason.alias("reason_code"), quality.alias("evidence_quality"))


#: Fields of the evidence hash beside the order, in alphabetical order.
HASHED = ("block_id", "citation", "document_content_hash", "document_file_hash", "document_id", "evidence_item_type", "legal_fact_id", "order", "role_code", "table_id", "table_row_id")
#: Their names in the hashed JSON, where they differ.
HASHED_AS = {"citation": "citation_json"}


def evidence_hashes(evidence: DataFrame) -> DataFrame:
    """answer_id, document_set_hash, evidence_hash, n_items.

    The first is over the different document hashes (of the content, else of the file), the second over all
    items in order (ties by their other fields), numbered anew, in canonical JSON.  ``citation`` may be a map or a struct
    of any depth; a missing one is empty.  An answer's evidence is a handful of rows.
    """
    cols = [c for c in HASHED if c not in ("order", "citation")]
    fields = {c: (F.col(c) if c in evidence.columns else F.lit(None)).cast("string") for c in cols}
    told = canonical(F.col("citation"), evidence.schema["citation"].dataType) if "citation" in evidence.columns else F.lit("null")
    fields["citation"] = F.when(told == "null", "{}").otherwise(told)
    item = F.struct("evidence_order", *[fields[c].alias(c) for c in HASHED if c != "order"])
    document = F.coalesce(F.nullif(fields["document_content_hash"], F.lit("")), F.nullif(fields["document_file_hash"], F.lit("")))
    per = evidence.groupBy("answer_id").agg(F.collect_list(item).alias("items"), F.array_sort(F.collect_set(document)).alias("documents"))

    def as_json(x: Column, k: Column) -> Column:
        value = lambda c: (k + 1).cast("string") if c == "order" else x[c] if c == "citation" else F.coalesce(quoted(x[c]), F.lit("null"))
        names = sorted((HASHED_AS.get(c, c), c) for c in HASHED)
        return F.concat(F.lit("{"), *[p for n, (name, c) in enumerate(names) for p in (F.lit(f'{"," if n else ""}"{name}":'), value(c))], F.lit("}"))

    items = F.concat(F.lit("["), F.array_join(F.transform(F.array_sort("items"), as_json), ","), F.lit("]"))
    documents = F.concat(F.lit('{"documents":['), F.array_join(F.transform("documents", quoted), ","), F.lit("]}"))
    return per.select("answer_id", F.sha2(documents, 256).alias("document_set_hash"), F.sha2(items, 256).alias("evidence_hash"), F.size("items").alias("n_items"))


def answer_events(answers: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Events with their four hashes, numbered evidence rows, and empty candidates of answers that may be reused.

    ``answers``: answer_id, answer_text, reuse_allowed, payload (of any type; optional), more; ids follow from keys, so a rerun
    gives the same.
    """
    events = answers.withColumn("answer_text", F.trim("answer_text")).join(evidence_hashes(evidence), "answer_id", "left")
    none = {"document_set_hash": F.sha2(F.lit('{"documents":[]}'), 256), "evidence_hash": F.sha2(F.lit("[]"), 256), "n_items": F.lit(0)}
    payload = canonical(F.col("payload"), answers.schema["payload"].dataType) if "payload" in answers.columns else F.lit("{}")
    events = events.withColumns({c: F.coalesce(F.col(c), v) for c, v in none.items()} | {"answer_text_hash": T.text_hash(F.col("answer_text")), "answer_payload_hash": F.sha2(payload, 256)})
    w = Window.partitionBy("answer_id").orderBy("evidence_order")
    rows = evidence.join(answers.select("answer_id"), "answer_id", "left_semi").withColumn("evidence_order", F.row_number().over(w))
    rows = rows.withColumn("evidence_id", row_id(F.col("answer_id"), F.col("evidence_order")))
    candidates = answers.filter("reuse_allowed").select(
        row_id(F.col("answer_id"), F.lit("reuse")).alias("reuse_candidate_id"), "answer_id", F.lit("needs_revalidation").alias("reuse_status"), F.lit(False).alias("reuse_effective"),
        F.lit(0).alias("n_votes"), F.lit(0).alias("n_low"), F.create_map(F.lit("policy"), F.lit("feedback_reuse_v1"), F.lit("state"), F.lit("initialized")).alias("payload"))
    return events, rows, candidates


def store_answers(spark, folder: str, batch: str, answers: DataFrame, evidence: DataFrame) -> bool:
    """Events, evidence and candidates of a batch as one commit (``store``); a batch that is there already adds nothing."""
    return store.write(spark, folder, batch, dict(zip(("answer_event", "answer_evidence_item", "answer_reuse_candidate"), answer_events(answers, evidence))))


def history(answers: DataFrame, questions: DataFrame, candidates: DataFrame) -> DataFrame:
    """Answers with their questions and what is known of their reuse, on (question_id) and (answer_id)."""
    return answers.join(questions, "question_id").join(candidates, "answer_id")


def leading_history(past: DataFrame, most: int, *, of_one: int | None = None) -> DataFrame:
    """The first ``most`` eligible answers by reuse score, average, votes and age (nulls first), with ``standing``.

    Of one question at most ``of_one`` answers count, if that is given."""
    order = [F.col(c).desc_nulls_first() for c in ("reuse_score", "avg_score", "n_votes", "created_at")] + [F.col("answer_id")]
    best = eligible(past)
    if of_one is not None:
        best = best.withColumn("_nth", F.row_number().over(Window.partitionBy("question_id").orderBy(*order))).filter(F.col("_nth") <= of_one).drop("_nth")
    best = best.orderBy(*order).limit(most)
    return best.withColumn("standing", F.row_number().over(Window.orderBy(*order)))  # ``most`` rows


def history_matches(questions: DataFrame, past: DataFrame, *, threshold: float = 0.90, most: int = 20) -> DataFrame:
    """question_id, past_id, similarity, signature, place: the best ``most`` answers of the leading 3 * ``most``.

    A question's own answers don't count.  The order doesn't depend on the question, so the leading ones are found once: of each
    past question's answers 3 * ``most`` are enough for anybody else, and then no question has more than that to leave
    out, so twice as many hold the first 3 * ``most`` of everybody.  That bounds what is broadcast, whatever the history's size.
    ``questions``: question_id, text, intent, measure_code, subject; ``past`` adds question_text.
    """
    lead = leading_history(past, 6 * most, of_one=3 * most).select(
        F.col("question_id").alias("past_question"), F.col("answer_id").alias("past_id"), T.normalize(F.col("question_text")).alias("past"), F.col("intent").alias("_i"), F.col("measure_code").alias("_m"), F.col("subject").alias("_s"),
        *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("reuse_score", "avg_score", "n_votes")], "created_at", "standing")
    asked = questions.select("question_id", T.normalize(F.col("text")).alias("norm"), "intent", "measure_code", "subject")
    pairs = asked.join(F.broadcast(lead), F.col("question_id") != F.col("past_question"))
    counted = F.row_number().over(Window.partitionBy("question_id").orderBy("standing"))
    pairs = pairs.withColumn("counted", counted).filter(F.col("counted") <= 3 * most)
    pairs = pairs.withColumn("similarity", text_similarity(F.col("norm"), F.col("past"), threshold=threshold)).filter(F.col("similarity") >= threshold)
    pairs = pairs.withColumn("signature", signature_score(*[F.col(c) for c in ("intent", "_i", "measure_code", "_m", "subject", "_s")]))
    order = [F.desc(c) for c in ("similarity", "signature", "reuse_score", "avg_score", "n_votes", "created_at")] + [F.col("standing")]
    return pairs.withColumn("place", F.row_number().over(Window.partitionBy("question_id").orderBy(*order))).filter(F.col("place") <= most).select("question_id", "past_id", "similarity", "signature", "place")


def lookup(table: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The rows of the keys asked for, and the keys that aren't there."""
    asked = keys.select(key).distinct()
    return table.join(asked, key, "left_semi"), asked.join(table.select(key), key, "left_anti")
