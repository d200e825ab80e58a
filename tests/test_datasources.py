import json
import zipfile

import pytest

from lexiquarry.sources import datasources, files, ooxml
from tests_docx import docx

@pytest.fixture(scope="module")
def sources(spark):
    datasources.register(spark)
    return spark


def test_docx_items_in_order(sources, tmp_path):
    (tmp_path / "below").mkdir()
    for k in range(5):
        (tmp_path / f"f{k}.docx").write_bytes(docx(f"one {k}", "two", table=[["a", "b"], ["1", "2"]]))
    (tmp_path / "below" / "cut.docx").write_bytes(docx("x" * 500)[:200])
    (tmp_path / "below" / "other.docx").write_bytes(b"PK no zip")
    with zipfile.ZipFile(tmp_path / "empty.DOCX", "w") as z:
        z.writestr("nothing", "")
    (tmp_path / "note.txt").write_text("no")
    df = sources.read.format("docx_items").option("path", str(tmp_path)).option("bytesPerPartition", 1).load()
    assert df.rdd.getNumPartitions() == 8
    by = {}
    for r in df.collect():
        by.setdefault(r.path.rpartition("/")[2], []).append(r)
    assert {n for n, rs in by.items() if rs[0].kind == "error"} == {"cut.docx", "other.docx", "empty.DOCX"} and len(by) == 8
    good = sorted(by["f3.docx"], key=lambda r: r.item_order)
    assert [(r.item_order, r.kind, r.text) for r in good] == [(0, "paragraph", "one 3"), (1, "paragraph", "two"), (2, "table", None), (3, "paragraph", "")] and good[2].cells == [["a", "b"], ["1", "2"]]
    assert sources.read.format("docx_items").load(str(tmp_path)).rdd.getNumPartitions() == 1
    same = ooxml.items(files.files(sources, str(tmp_path)))
    strip = lambda rows: sorted((r.path.rpartition("/")[2], r.item_order, r.kind, r.text, str(r.cells)) for r in rows if not r.path.endswith("DOCX"))
    assert strip(df.collect()) == strip(same.collect())


def test_no_docx(sources, tmp_path):
    assert sources.read.format("docx_items").load(str(tmp_path)).count() == 0
    with pytest.raises(Exception, match="absent"):
        sources.read.format("docx_items").load(str(tmp_path / "absent")).count()


def update(k):
    return json.dumps({"update_id": k, "message": {"message_id": k, "date": 1_700_000_000 + k, "text": f"t{k}", "chat": {"id": k % 3}, "from": {"id": 9, "username": "u"}}})


def test_updates_resume_at_their_offset(sources, tmp_path):
    folder, seen = tmp_path / "in", []
    folder.mkdir()
    (folder / "a.jsonl").write_text("\n".join([*map(update, range(100, 125)), "no json", '{"x": 1}', ""]))

    def run(batches):
        def handle(df, k):
            seen.append((k, sorted(r.update_id for r in df.collect())))

        raw = sources.readStream.format("chat_updates").option("maxUpdatesPerTrigger", 10).load(str(folder))
        q = raw.writeStream.foreachBatch(handle).option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="0 seconds").start()
        while len(seen) < batches and q.exception() is None:
            q.awaitTermination(0.2)
        q.processAllAvailable()
        q.stop()

    run(3)
    assert [u for _, u in seen] == [[*range(100, 110)], [*range(110, 120)], [*range(120, 125)]]
    (folder / "b.jsonl").write_text("\n".join(map(update, range(125, 140))))
    run(5)
    assert [u for _, u in seen[3:] if u] == [[*range(125, 135)], [*range(135, 140)]]
    assert sorted(x for _, u in seen for x in u) == [*range(100, 140)]


def test_updates_become_messages(sources, tmp_path):
    (tmp_path / "a.jsonl").write_text(update(7) + "\n" + json.dumps({"update_id": 8, "callback_query": {"id": "c", "data": "fb:a1:4", "message": {"chat": {"id": 1}}}}))
    messages, votes = files.updates(sources.readStream.format("chat_updates").load(str(tmp_path)))
    for name, df in (("m", messages), ("v", votes)):
        df.writeStream.format("memory").queryName(f"updates_{name}").trigger(availableNow=True).start().awaitTermination()
    assert sources.table("updates_m").first().text == "t7" and sources.table("updates_v").first().score == 4
