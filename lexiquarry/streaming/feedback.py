"""Streaming forms of the feedback operators.  Event time is the time of submission."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.feedback import NEGATIVE_UP_TO
from ..plans.shipping import ship


def votes_once(votes: DataFrame, *, late: str = "1 day") -> DataFrame:
    """One vote for each (session, answer) within the watermark; later repeats go to the batch recompute."""
    return votes.withWatermark("submitted_at", late).dropDuplicatesWithinWatermark(["session_id", "answer_id"])


def daily_quality(votes: DataFrame, *, late: str = "1 day") -> DataFrame:
    """Votes by day: count, average, low ones."""
    day = F.window("submitted_at", "1 day")
    return votes.withWatermark("submitted_at", late).groupBy(day).agg(F.count("*").alias("n_votes"), F.avg("score").alias("avg_score"), F.count_if(F.col("score") <= NEGATIVE_UP_TO).alias("n_low")).select(F.to_date("window.start").alias("day"), "n_votes", "avg_score", "n_low")


def session_activity(messages: DataFrame, *, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Runs of messages of a session without a longer gap."""
    return messages.withWatermark("at", late).groupBy("session_id", F.session_window("at", gap)).agg(F.count("*").alias("n")).select("session_id", F.col("session_window.start").alias("started_at"), F.col("session_window.end").alias("ended_at"), "n")


def sampled(answers: DataFrame, *, n: int = 5, cooldown_min: int = 30, most: int = 3) -> DataFrame:
    """Which answers ask for a rating: every n-th of a session, not within the cooldown, at most ``most``.

    ``answers``: session_id, answer_id, at.  State for each session: answers so far, requests, last request.
    """
    ship(answers.sparkSession)

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        count, asked, last = state.get if state.exists else (0, 0, 0)
        rows = pd.concat(list(batches)).sort_values(["at", "answer_id"])
        out = []
        for answer, at in zip(rows["answer_id"], rows["at"]):
            count += 1
            ms = int(at.timestamp() * 1000)
            ask = count % n == 0 and asked < most and (not asked or ms - last >= cooldown_min * 60_000)
            if ask:
                asked, last = asked + 1, ms
            out.append((key[0], answer, ask))
        state.update((count, asked, last))
        yield pd.DataFrame(out, columns=["session_id", "answer_id", "ask"])

    kind = dict(answers.dtypes)
    return answers.groupBy("session_id").applyInPandasWithState(step, f"session_id {kind['session_id']}, answer_id {kind['answer_id']}, ask boolean", "count long, asked long, last long", "append", "NoTimeout")


def each_batch(updates: DataFrame, handle, checkpoint: str, **trigger):
    """Run ``handle(messages, votes, batch_id)`` on every micro-batch of chat updates."""
    from ..sources.files import updates as split

    return updates.writeStream.foreachBatch(lambda df, k: handle(*split(df), k)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
