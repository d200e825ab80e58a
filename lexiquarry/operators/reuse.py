"""The reuse gate: history, similarity, signature, freshness, evidence, decision; all questions in one pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.similarity import least_jaccard, text_similarity

POINTERS = ("document_id", "block_id", "table_id", "table_row_id", "legal_fact_id")


def eligible(history: DataFrame) -> DataFrame:
    return history.filter(
        F.col("reuse_allowed") & ~F.col("mode").isin("reused_answer", "safe_no_answer") & (F.col("validation_status") == "passed")
        & F.col("deterministic_passed") & F.col("semantic_passed") & (F.col("reuse_status") == "eligible") & F.col("reuse_effective"))


#: Words that a text needs so that one of them must stand whole in any text that contains it.
ANCHORED = 3
#: Keys of questions and characters of their texts that are broadcast at once; more are asked in turns.
KEYS, CHARACTERS = 500_000, 50_000_000
#: Keys that are no words: a blank before an inner word of the past, the key of all past texts, the key of brief ones.
INNER, EVERY, BRIEF = " ", "", "  "


def _asked_keys(q: DataFrame, rare: DataFrame, need: float) -> DataFrame:
    """(key, asked, least_size, most_size, least_length, most_length): which past texts a question meets, and the bounds of their words and characters.

    Nothing is lost: (1) a similar set lacks at most |q| - ceil(need |q|) of a question's words, so it has one of any one more of
    them, here the rarest; (2) of a question that a past text contains, all words but the first and the last stand whole in that one,
    so its rarest inner word does; (3) so does any inner word of a past text that a question contains; (4) texts with fewer than
    ANCHORED words are compared with all.  Words that no past text has meet nothing.
    """
    inner = lambda x: (x["at"] > 0) & (x["at"] < F.size("tokens") - 1)
    words = q.select("asked", "norm", "tokens", F.size("words").alias("size"), F.posexplode("tokens").alias("at", "w"))
    words = words.groupBy("asked", "w").agg(F.max("size").alias("size"), F.max(inner({"at": F.col("at")})).alias("is_inner"), F.max(F.char_length("norm")).alias("length")).join(rare, "w", "left")
    per = words.groupBy("asked", "size", "length").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "w", "is_inner"))).alias("items"))
    none = F.lit(None).cast("int")
    prefix = F.slice("items", F.lit(1), F.size("items") - F.ceil(need * F.col("size") - 1e-9).cast("int") + 1)
    alike = per.select(F.explode(prefix).alias("x"), "asked", F.ceil(need * F.col("size") - 1e-9).cast("int"), F.floor(F.col("size") / need + 1e-9).cast("int") if need > 0 else none, none, none).filter("x.n > 0").withColumn("x", F.col("x.w"))
    held = per.select(F.get(F.filter("items", lambda x: x["is_inner"]), F.lit(0)).alias("x"), "asked", none, none, "length", none).filter("x.n > 0").withColumn("x", F.col("x.w"))
    holding = words.select(F.concat(F.lit(INNER), "w"), "asked", none, none, none, "length")
    every = q.filter(F.size("tokens") < ANCHORED).select(F.lit(EVERY), "asked", none, none, none, none)
    brief = q.select(F.lit(BRIEF), "asked", none, none, none, F.char_length("norm"))
    return alike.union(held).union(holding).union(every).union(brief).toDF("key", "asked", "least_size", "most_size", "least_length", "most_length")


def _past_keys(longest: int) -> Column:
    """The keys by which a past text (past, tokens, words) is met: its words, and if it fits into a question its longest inner word."""
    lengths = F.transform(F.slice("tokens", F.lit(2), F.greatest(F.size("tokens") - 2, F.lit(0))), lambda w: F.struct(F.char_length(w).alias("n"), w.alias("w")))
    of_short = F.when(F.size("tokens") < ANCHORED, F.array(F.lit(BRIEF))).otherwise(F.array(F.concat(F.lit(INNER), F.array_max(lengths)["w"])))
    keys = F.concat("words", F.array(F.lit(EVERY)), F.when(F.char_length("past") <= longest, of_short).otherwise(F.array().cast("array<string>")))
    return F.when(F.col("past") != "", keys)


def similar(questions: DataFrame, history: DataFrame, *, threshold: float = 0.90, most: int = 20) -> DataFrame:
    """Pairs (question_id, past_id) whose similarity reaches the threshold, the best ``most`` of each question.

    Equal questions are asked once.  Their keys are broadcast and the past streams by: it is read to count the words that questions
    have and to compare each text, where it lies, with those questions that it meets by a key.  Of the past nothing is kept, and
    only numbers of words and each task's best pairs are shuffled.  Questions with too many keys are asked in turns, the past read
    again for each; the best pairs of a turn are kept.
    """
    def told(df: DataFrame, name: str) -> DataFrame:
        return df.withColumn("tokens", F.split(F.col(name), " ")).withColumn("words", F.array_distinct("tokens"))

    need = least_jaccard(threshold)
    named = questions.select("question_id", T.normalize(F.col("text")).alias("norm")).filter(F.col("norm") != "").withColumn("asked", F.unhex(F.sha2("norm", 256)))
    q = told(named.select("norm", "asked").distinct(), "norm").persist()
    h = told(history.select("past_id", T.normalize(F.col("text")).alias("past")), "past")
    vocabulary = q.select(F.explode("words").alias("w")).distinct()
    n_asked, n_keys, n_chars, longest = (x or 0 for x in q.agg(F.count("*"), F.sum(F.size("words")), F.sum(F.char_length("norm")), F.max(F.char_length("norm"))).first())
    turns = max(1, min(n_asked, max(-(-3 * n_keys // max(KEYS, 1)), -(-n_chars // CHARACTERS))))  # a word gives two keys at most, and a question three
    said = h.select(F.explode("tokens").alias("w"))
    if n_keys <= KEYS or vocabulary.count() <= KEYS:
        said = said.join(F.broadcast(vocabulary), "w", "left_semi")
    rare = said.groupBy("w").agg(F.count("*").alias("n")).join(vocabulary, "w", "left_semi").persist()
    keys = _asked_keys(q, rare, need).persist()
    asked = q.select("asked", "norm", F.col("words").alias("_q"))
    met = h.withColumn("held", F.monotonically_increasing_id()).withColumn("key", F.explode(_past_keys(longest)))  # a row of the past is told from others by its number, in the one pass that makes it

    def fits(size: Column, length: Column) -> Column:
        return size.between(F.coalesce("least_size", size), F.coalesce("most_size", size)) & length.between(F.coalesce("least_length", length), F.coalesce("most_length", length))

    def best(keys: DataFrame, asked: DataFrame) -> DataFrame:
        pairs = met.join(F.broadcast(keys), "key").filter(fits(F.size("words"), F.char_length("past"))).join(F.broadcast(asked), "asked")
        pairs = pairs.select("asked", "held", "past_id", text_similarity(F.col("norm"), F.col("past"), F.col("_q"), F.col("words"), threshold).alias("similarity")).filter(F.col("similarity") >= threshold)
        w = Window.partitionBy("asked").orderBy(F.desc("similarity"), "past_id", "held")
        pairs = pairs.withColumn("place", F.dense_rank().over(w)).filter(F.col("place") <= most)  # a pair that several keys meet has one place, so each task may keep its best ones
        return pairs.select("asked", "held", "past_id", "similarity", "place").distinct().select("asked", "past_id", "similarity", "place")

    if turns == 1:
        kept = best(keys, asked)
    else:
        parts = []
        for k in range(turns):
            own = F.pmod(F.xxhash64("asked"), F.lit(turns)) == k
            parts.append(best(keys.filter(own), asked.filter(own)).persist())
            parts[-1].count()  # one turn's broadcasts at a time
        kept = reduce(DataFrame.union, parts)
    return named.select("question_id", "asked").join(kept, "asked").select("question_id", "past_id", "similarity", "place")


def signature_score(intent: Column, past_intent: Column, measure: Column, past_measure: Column, subject: Column, past_subject: Column) -> Column:
    def part(a: Column, b: Column, equal: float, both_null: float) -> Column:
        return F.when(a == b, equal).when(a.isNull() & b.isNull(), both_null).otherwise(0.0)

    return F.round(F.least(F.when(intent == past_intent, 0.50).otherwise(0.0) + part(measure, past_measure, 0.30, 0.10) + part(subject, past_subject, 0.20, 0.05), F.lit(1.0)), 4)


def signature_matches(intent: Column, past_intent: Column, measure: Column, past_measure: Column, subject: Column, past_subject: Column, *, relaxed: bool = False) -> Column:
    same = intent == past_intent
    if relaxed:
        return same
    return same & (measure.isNull() | F.coalesce(measure == past_measure, F.lit(False))) & (subject.isNull() | F.coalesce(subject == past_subject, F.lit(False)))


def item_freshness(evidence: DataFrame, registry: DataFrame) -> DataFrame:
    """Evidence items bound to a document, with the reason why they are stale (null: fresh)."""
    now = registry.select(F.col("document_id").alias("_id"), F.col("status").alias("_status"), F.col("content_hash").alias("_content"), F.col("file_hash").alias("_file"))
    rows = evidence.filter(F.col("document_id").isNotNull()).join(now, F.col("document_id") == F.col("_id"), "left")
    reason = (F.when(F.col("_id").isNull(), "document_not_found").when(F.lower("_status") != "active", "document_not_active")
              .when(F.col("document_content_hash").isNotNull(), F.when(~F.col("_content").eqNullSafe(F.col("document_content_hash")), "document_content_hash_mismatch"))
              .when(F.col("document_file_hash").isNotNull(), F.when(~F.col("_file").eqNullSafe(F.col("document_file_hash")), "document_file_hash_mismatch")).otherwise("missing_stored_hashes_in_evidence"))
    return rows.withColumn("stale_reason", reason).drop("_id", "_status", "_content", "_file")


def freshness(answers: DataFrame, evidence: DataFrame, registry: DataFrame) -> DataFrame:
    """answer_id, checked, mismatched, is_fresh, block_reason of every answer."""
    per = item_freshness(evidence, registry).groupBy("answer_id").agg(F.count("*").alias("checked"), F.count("stale_reason").alias("mismatched"))
    out = answers.select("answer_id").join(per, "answer_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("checked", "mismatched")})
    fresh = (F.col("checked") > 0) & (F.col("mismatched") == 0)
    return out.withColumn("is_fresh", fresh).withColumn("block_reason", F.when(F.col("checked") == 0, "no_document_bound_evidence").when(~fresh, "freshness_check_failed"))


def pointers() -> Column:
    out = F.lit(0)
    for p in POINTERS:
        out = out + F.col(p).isNotNull().cast("int")
    return out


def integrity(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """answer_id, n_items, n_invalid, is_valid, block_reason; ``answers`` has evidence_hash."""
    per = evidence.withColumn("_p", pointers()).groupBy("answer_id").agg(F.count("*").alias("n_items"), F.count_if(F.col("_p") != 1).alias("n_invalid"), F.count_if(F.col("_p") > 0).alias("n_strong"))
    out = answers.select("answer_id", "evidence_hash").join(per, "answer_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_items", "n_invalid", "n_strong")})
    reason = (F.when(F.col("n_items") == 0, "no_evidence_items").when(F.coalesce("evidence_hash", F.lit("")) == "", "missing_evidence_hash")
              .when(F.col("n_invalid") > 0, "invalid_evidence_items").when(F.col("n_strong") == 0, "no_strong_evidence_items"))
    return out.withColumn("block_reason", reason).withColumn("is_valid", reason.isNull()).drop("evidence_hash", "n_strong")


def decision_confidence(similarity: Column, signature: Column, reuse: Column, average: Column, fresh: Column, valid: Column) -> Column:
    votes = F.least(F.greatest((F.coalesce(average, F.lit(0.0)) - 1.0) / 4.0, F.lit(0.0)), F.lit(1.0))
    value = 0.35 * similarity + 0.20 * signature + 0.20 * F.coalesce(reuse, F.lit(0.0)) + 0.10 * votes + 0.10 * fresh.cast("double") + 0.05 * valid.cast("double")
    return F.round(F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)), 4)


def decide(questions: DataFrame, pairs: DataFrame) -> DataFrame:
    """question_id, decision, past_id: ``pairs`` has similarity, signature_ok, is_fresh, is_valid and sort keys.

    The stages are flags; the first stage that nobody passes names the decision.
    """
    flags = [("signature_ok", "signature_mismatch"), ("is_fresh", "all_candidates_stale"), ("is_valid", "evidence_mismatch")]
    passed, counts = F.lit(True), []
    for k, (flag, _) in enumerate(flags):
        passed = passed & F.col(flag)
        counts.append(F.count_if(passed).alias(f"_c{k}"))
    best = F.max_by("past_id", F.when(passed, F.struct("similarity", "signature", "reuse_score", "avg_score", "n_votes", (-F.col("past_id")).alias("last"))))
    per = pairs.groupBy("question_id").agg(F.count("*").alias("_n"), *counts, best.alias("past_id"))
    out = questions.select("question_id").join(per, "question_id", "left")
    code = F.when(F.coalesce("_n", F.lit(0)) == 0, "no_candidates_found")
    for k, (_, name) in enumerate(flags):
        code = code.when(F.col(f"_c{k}") == 0, name)
    out = out.withColumn("decision", code.otherwise("reuse_allowed"))
    return out.select("question_id", "decision", F.when(F.col("decision") == "reuse_allowed", F.col("past_id")).alias("past_id"))
