"""Feedback analytics: summaries, reuse scores and status, daily quality, sampling of rating requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values.
NEGATIVE_UP_TO = 2
MIN_VOTES, MIN_AVERAGE, MAX_NEGATIVE, MIN_SCORE = 3, 4.2, 0.20, 0.80


def summary(answers: DataFrame, votes: DataFrame) -> DataFrame:
    """Every answer with its votes: count, average, low ones, first and last time; 0 low ones without votes."""
    per = votes.groupBy("answer_id").agg(F.count("*").alias("n_votes"), F.avg("score").alias("avg_score"), F.count_if(F.col("score") <= NEGATIVE_UP_TO).alias("n_low"), F.min("submitted_at").alias("first_at"), F.max("submitted_at").alias("last_at"))
    return answers.select("answer_id").join(per, "answer_id", "left").withColumns({"n_votes": F.coalesce("n_votes", F.lit(0)), "n_low": F.coalesce("n_low", F.lit(0))})


def votes_once(votes: DataFrame) -> DataFrame:
    """Votes with ``accepted``: the first of each (session, answer); the others are conflicts."""
    w = Window.partitionBy("session_id", "answer_id").orderBy("submitted_at", "vote_id")
    return votes.withColumn("accepted", F.row_number().over(w) == 1)


def reuse_score(validated: Column, n_votes: Column, average: Column, n_low: Column) -> Column:
    negative = F.when(n_votes > 0, n_low / n_votes).otherwise(1.0)
    raw = 0.40 * validated.cast("double") + 0.20 * F.least(n_votes / 5.0, F.lit(1.0)) + 0.30 * F.greatest(F.least((average - 1.0) / 4.0, F.lit(1.0)), F.lit(0.0)) + 0.10 * F.greatest(1.0 - negative, F.lit(0.0))
    return F.when(average.isNull(), 0.0).otherwise(F.round(F.greatest(F.least(raw, F.lit(1.0)), F.lit(0.0)), 4))


def reuse_status(allowed: Column, mode: Column, status: Column, deterministic: Column, semantic: Column, n_votes: Column, average: Column, n_low: Column, score: Column) -> Column:
    """(status, allowed, reason): the first rule that holds."""
    rules = [
        (~allowed, "blocked", "answer_event_reuse_not_allowed"), (mode == "safe_no_answer", "blocked", "safe_no_answer_not_reusable"), (status != "passed", "blocked", "validation_status_not_passed"),
        (~deterministic, "blocked", "deterministic_validation_failed"), (~semantic, "blocked", "semantic_validation_failed"), (n_votes < MIN_VOTES, "needs_revalidation", "insufficient_feedback_count"),
        (average.isNull(), "needs_revalidation", "avg_feedback_unavailable"), (average < MIN_AVERAGE, "blocked", "avg_feedback_below_threshold"),
        (F.when(n_votes > 0, n_low / n_votes).otherwise(1.0) > MAX_NEGATIVE, "blocked", "negative_feedback_ratio_too_high"), (score.isNull() | (score < MIN_SCORE), "needs_revalidation", "reuse_score_below_threshold"),
    ]
    out = F.struct(F.lit("eligible").alias("status"), F.lit(True).alias("allowed"), F.lit(None).cast("string").alias("reason"))
    for cond, what, why in reversed(rules):
        out = F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(what).alias("status"), F.lit(False).alias("allowed"), F.lit(why).alias("reason"))).otherwise(out)
    return out


def upsert(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """New values where there are any, else the old row; keys of both sides."""
    n = new.select(key, *[F.col(c).alias(f"_n_{c}") for c in columns], F.lit(True).alias("_new"))
    return old.join(n, key, "full").select(key, *[F.when(F.col("_new"), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) for c in columns])


def quality_daily(answers: DataFrame, votes: DataFrame, *, as_written: bool = False) -> DataFrame:
    """Daily figures by channel, intent and measure (null is a group).

    An answer counts once; ``as_written`` counts it once for each of its votes (and once without votes).
    """
    keys = [F.to_date("created_at").alias("day"), "channel", "intent", "measure_code"]
    per = votes.groupBy("answer_id").agg(F.count("*").alias("n_votes"), F.sum("score").alias("sum_score"), F.count_if(F.col("score") <= NEGATIVE_UP_TO).alias("n_low"))
    rows = answers.join(per, "answer_id", "left")
    times = F.greatest(F.coalesce("n_votes", F.lit(0)), F.lit(1)) if as_written else F.lit(1)
    return rows.groupBy(*keys).agg(
        F.sum(times).alias("total_answers"), F.coalesce(F.sum("n_votes"), F.lit(0)).alias("total_feedback"), (F.sum("sum_score") / F.sum("n_votes")).alias("avg_score"),
        F.sum(F.when(F.col("mode") == "reused_answer", times).otherwise(0)).alias("reused_answers"), F.coalesce(F.sum("n_low"), F.lit(0)).alias("low_rated"),
        F.sum(F.when(F.col("validation_status") == "failed", times).otherwise(0)).alias("failed_validation"))


def overwrite_days(aggregates: DataFrame, path: str) -> None:
    """Replace exactly the days that are in ``aggregates``."""
    aggregates.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def session_stats(answers: DataFrame, votes: DataFrame) -> DataFrame:
    a = answers.filter(F.col("mode") != "safe_no_answer").groupBy("session_id").agg(F.count("*").alias("n_eligible"))
    v = votes.groupBy("session_id").agg(F.count("*").alias("n_votes"), F.max("submitted_at").alias("last_vote"))
    return a.join(v, "session_id", "full").select("session_id", F.coalesce("n_eligible", F.lit(0)).alias("n_eligible"), F.coalesce("n_votes", F.lit(0)).alias("n_votes"), "last_vote")


def every_n(events: DataFrame, n: int, *, offset: int = 0) -> DataFrame:
    """place of each event in its session, and whether it is an n-th one (``offset`` 1: counted one further)."""
    w = Window.partitionBy("session_id").orderBy("at", "event_id")
    return events.withColumn("place", F.row_number().over(w)).withColumn("is_nth", (F.col("place") + offset) % n == 0)


def cooldown(events: DataFrame, minutes: int) -> DataFrame:
    """Whether enough time has passed since the session's last vote before each event."""
    w = Window.partitionBy("session_id").orderBy("at", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    last = F.max(F.when(F.col("is_vote"), F.col("at"))).over(w)
    return events.withColumn("last_vote", last).withColumn("cooldown_ok", F.coalesce(F.col("at") >= F.col("last_vote") + F.expr(f"INTERVAL {minutes} MINUTES"), F.lit(True)))


def sampling_decision(*, enabled: Column, mode: Column, intent: Column, confidence: Column, n_votes: Column, cooldown_ok: Column, is_nth: Column, excluded=(), priority=(), max_votes: int = 3, min_confidence: float = 0.40, reused_always: bool = True) -> Column:
    """The code of the first rule that decides."""
    out = F.when(~enabled, "policy_disabled").when(mode == "safe_no_answer", "answer_mode_not_eligible").when(intent.isin(*excluded), "intent_excluded")
    out = out.when(confidence.isNotNull() & (confidence < min_confidence), "confidence_below_threshold").when(n_votes >= max_votes, "session_feedback_limit_reached").when(~cooldown_ok, "cooldown_active")
    if reused_always:
        out = out.when(mode == "reused_answer", "priority_reused_answer")
    return out.when(intent.isin(*priority), "priority_intent").when(is_nth, "every_n_answers_rule").otherwise("not_selected_by_sampling_rule")
