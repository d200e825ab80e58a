"""Chat updates to stored tables, each micro-batch once, and sessions that end by a timer.

``foreachBatch`` may run a batch again after a failure.  Each batch is one commit under the query's name and the batch's number
(``store``), a ledger of what has been handled: a batch that is there is passed over, one that was cut off is written anew, whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import publish, store
from ..plans.shipping import ship
from ..sources.files import updates as split


def batch_name(query: str, number: int) -> str:
    return f"{query}.{number:012}"


def store_batches(stream: DataFrame, folder: str, query: str, tables_of: Callable[[DataFrame], dict[str, DataFrame]], checkpoint: str, **trigger):
    """Start a query that writes ``tables_of(batch)`` of every micro-batch as one commit, whatever is replayed."""
    def handle(df: DataFrame, number: int) -> None:
        spark, name = df.sparkSession, batch_name(query, number)
        if not store.committed(spark, folder, name):
            store.write(spark, folder, name, tables_of(df), query=query, number=number)

    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def chat_tables(channel: str = "telegram") -> Callable[[DataFrame], dict[str, DataFrame]]:
    """From raw updates (value): session events, question events and votes, with ids that follow from the update."""
    def tables(raw: DataFrame) -> dict[str, DataFrame]:
        messages, votes = split(raw)
        session = publish.row_id(F.lit(channel), F.col("external_session_id"))
        questions = messages.select(publish.row_id(F.lit(channel), F.col("update_id")).alias("question_event_id"), session.alias("session_id"), "update_id", F.col("text").alias("question_text"), "at")
        seen = messages.select(F.lit(channel).alias("channel"), "external_session_id", "at", "external_user_id", "user_name")
        given = votes.select(publish.row_id(F.lit(channel), F.lit("vote"), F.col("update_id")).alias("vote_id"), session.alias("session_id"), "update_id", "kind", "answer_id", "score")
        return {"question_event": questions, "session_event": seen, "answer_vote": given}

    return tables


def sessions(spark, folder: str) -> DataFrame | None:
    """One row a session over all that is committed (``publish.sessions``)."""
    seen = store.read(spark, folder, "session_event")
    return None if seen is None else publish.sessions(seen.drop("batch", "committed_at"))


def reused_tables(decisions: DataFrame, answers: DataFrame, evidence: DataFrame) -> dict[str, DataFrame]:
    """Answers that are given again: events under new ids, with the evidence of the answers they come from cloned.

    ``decisions``: question_id, past_id, confidence; ``answers``: answer_id, answer_text and more; ``evidence``: answer_id, evidence_order and more.
    """
    own = decisions.filter("past_id IS NOT NULL").select(publish.row_id(F.lit("reused"), F.col("question_id"), F.col("past_id")).alias("answer_id"), "question_id", F.col("past_id").alias("reused_from"), F.col("confidence").alias("reuse_confidence"))
    told = answers.drop("question_id", "answer_mode").withColumnRenamed("answer_id", "reused_from")
    events = own.join(told, "reused_from").withColumn("answer_mode", F.lit("reused_answer"))
    return {"answer_event": events, "answer_evidence_item": publish.clone_evidence(own.select("answer_id", "reused_from"), evidence)}


ENDED = "session_id string, started_at timestamp, ended_at timestamp, n long"


def ended_sessions(messages: DataFrame, *, gap_s: int = 1800, late: str = "1 hour") -> DataFrame:
    """Sessions (session_id, at) that have ended: told once, when the watermark is ``gap_s`` beyond their last message.

    The state of a session is its first and last time and its count; a timer in event time ends it.  A later message opens another.
    """
    ship(messages.sparkSession)

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            first, last, n = state.get
            state.remove()
            yield pd.DataFrame({"session_id": [str(key[0])], "started_at": [pd.Timestamp(first, unit="ms")], "ended_at": [pd.Timestamp(last, unit="ms")], "n": [n]})
            return
        times = sorted(int(t.timestamp() * 1000) for b in batches for t in b["at"])
        first, last, n = state.get if state.exists else (times[0], times[0], 0)
        out = []
        for at in times:
            if at - last > gap_s * 1000:
                out.append((str(key[0]), pd.Timestamp(first, unit="ms"), pd.Timestamp(last, unit="ms"), n))
                first, n = at, 0
            first, last, n = min(first, at), max(last, at), n + 1
        state.update((first, last, n))
        state.setTimeoutTimestamp(max(last + gap_s * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["session_id", "started_at", "ended_at", "n"]).astype({"n": "int64", "started_at": "datetime64[ns]", "ended_at": "datetime64[ns]"})

    return messages.withWatermark("at", late).groupBy("session_id").applyInPandasWithState(step, ENDED, "first long, last long, n long", "append", "EventTimeTimeout")
