import json

import pytest
from pyspark.sql import functions as F

from lexiquarry.operators import plugins, store
from lexiquarry.streaming import orchestrate


def update(k, chat=1):
    return json.dumps({"update_id": k, "message": {"message_id": k, "date": 1_700_000_000 + k, "text": f"t{k}", "chat": {"id": chat}, "from": {"id": 9, "username": f"u{k}"}}})


def vote(k):
    return json.dumps({"update_id": k, "callback_query": {"id": "c", "data": "fb:a1:4", "message": {"chat": {"id": 1}}}})


def test_replayed_batches_write_nothing_twice(spark, tmp_path):
    folder, inbox, calls = str(tmp_path / "out"), tmp_path / "in", []
    inbox.mkdir()
    tables = orchestrate.chat_tables()

    def counted(df):
        calls.append(1)
        return tables(df)

    def run(checkpoint):
        raw = spark.readStream.text(str(inbox))
        orchestrate.store_batches(raw, folder, "chat", counted, str(tmp_path / checkpoint)).awaitTermination()

    (inbox / "a.txt").write_text("\n".join([update(1), update(2, 2), vote(3)]))
    run("one")
    run("two")  # another checkpoint: batch 0 comes again, as after a lost commit
    count = lambda t: store.read(spark, folder, t).count()
    assert (count("question_event"), count("session_event"), count("answer_vote"), len(calls)) == (2, 2, 1, 1)
    (inbox / "b.txt").write_text(update(4))
    run("one")
    assert (count("question_event"), len(calls)) == (3, 2)
    got = {r.external_session_id: (r.user_name, r.last_at.timestamp() - r.started_at.timestamp()) for r in orchestrate.sessions(spark, folder).collect()}
    assert got == {"1": ("u4", 3.0), "2": ("u2", 0.0)}


def test_a_batch_that_was_cut_off_is_written_whole(spark, tmp_path):
    folder, inbox, broken = str(tmp_path / "out"), tmp_path / "in", [True]
    inbox.mkdir()
    (inbox / "a.txt").write_text(update(1))

    def tables(df):
        out = orchestrate.chat_tables()(df)
        if broken[0]:
            out["session_event"] = out["session_event"].withColumn("at", F.raise_error(F.lit("cut off")).cast("timestamp"))
        return out

    def run():
        orchestrate.store_batches(spark.readStream.text(str(inbox)), folder, "chat", tables, str(tmp_path / "c")).awaitTermination()

    with pytest.raises(Exception, match="cut off"):
        run()
    assert store.read(spark, folder, "question_event") is None
    broken[0] = False
    run()
    assert store.read(spark, folder, "question_event").count() == 1 and store.read(spark, folder, "session_event").count() == 1


def test_reused_answers_have_cloned_evidence(spark):
    decisions = spark.createDataFrame([(1, 7, 0.9), (2, None, None)], "question_id int, past_id int, confidence double")
    answers = spark.createDataFrame([(7, 5, "text", "grounded")], "answer_id int, question_id int, answer_text string, answer_mode string")
    evidence = spark.createDataFrame([(7, 1, "b1"), (7, 2, "b2"), (8, 1, "x")], "answer_id int, evidence_order int, block_id string")
    out = orchestrate.reused_tables(decisions, answers, evidence)
    event, items = out["answer_event"].collect(), out["answer_evidence_item"].collect()
    assert [(e.question_id, e.reused_from, e.answer_text, e.answer_mode) for e in event] == [(1, 7, "text", "reused_answer")]
    assert sorted((i.evidence_order, i.block_id, i.answer_id == event[0].answer_id) for i in items) == [(1, "b1", True), (2, "b2", True)]


def test_sessions_end_by_a_timer(spark, tmp_path):
    inbox, told = tmp_path / "in", []
    inbox.mkdir()
    schema = "session_id string, at timestamp"

    def put(name, rows):
        spark.createDataFrame([(s, f"2024-01-01 {t}") for s, t in rows], "session_id string, at string").withColumn("at", F.to_timestamp("at")).coalesce(1).write.parquet(str(inbox / name))

    def run():
        raw = spark.readStream.schema(schema).parquet(f"{inbox}/*")
        q = orchestrate.ended_sessions(raw, late="0 seconds").writeStream.foreachBatch(lambda df, k: told.extend(df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()

    put("a", [("s", "10:00:00"), ("s", "10:10:00"), ("t", "10:00:00")])
    run()
    assert not told
    put("b", [("s", "12:00:00"), ("u", "12:00:00")])
    run()
    put("c", [("u", "12:10:00")])
    run()
    got = sorted((r.session_id, r.started_at.strftime("%H:%M"), r.ended_at.strftime("%H:%M"), r.n) for r in told)
    assert got == [("s", "10:00", "10:10", 2), ("t", "10:00", "10:00", 1)]


def test_plug_ins_are_checked(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "question_id int, text string")
    intent = rows.withColumn("intent", F.lit("documents"))
    known = plugins.Registry()
    for name, do in {
        "good": lambda df: df.withColumn("intent", F.lit("deadline")), "loses": lambda df: intent.filter("question_id = 1"), "doubles": lambda df: intent.union(intent.filter("question_id = 2")),
        "makes_up": lambda df: intent.withColumn("question_id", F.coalesce("question_id", F.lit(9))), "lacks": lambda df: df, "other_type": lambda df: df.withColumn("intent", F.lit(1)),
    }.items():
        known.add("classifier", name, do)
    assert {r.intent for r in known.run("classifier", "good", rows).collect()} == {"deadline"}
    for name, why in {"loses": "2 rows lost", "doubles": "1 rows doubled", "makes_up": "1 rows lost, 1 rows made up", "lacks": "lacks intent", "other_type": "intent is int, not string", "absent": "no classifier absent"}.items():
        with pytest.raises(plugins.Refused, match=why):
            known.run("classifier", name, rows)
    with pytest.raises(plugins.Refused, match="already"):
        known.add("classifier", "good", lambda df: df)
    with pytest.raises(plugins.Refused, match="no kind"):
        known.add("oracle", "x", lambda df: df)
    assert known.names("classifier")[0] == "doubles" and known.names("reranker") == []
