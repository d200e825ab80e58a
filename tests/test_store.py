"""Several tables as one commit, revisions, chunks with overlap and their storage."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from lexiquarry.operators import ingest, publish, store
from lexiquarry.sources import embedding

DOC = "document_id long, doc_uid_base string, content_hash string, revision_date string, title string"


def numbers(df):
    return sorted(r[0] for r in df.collect())


@pytest.mark.parametrize("broken", ["a", "b", "c"])
def test_a_failure_between_tables_leaves_the_old_state(spark, tmp_path, broken):
    folder = str(tmp_path)
    good = {name: spark.range(k + 1) for k, name in enumerate("abc")}
    assert store.write(spark, folder, "first", good)
    bad = {name: df.select((F.raise_error(F.lit("cut off")) if name == broken else F.col("id") + 10).cast("long").alias("id")) for name, df in good.items()}
    with pytest.raises(Exception, match="cut off"):
        store.write(spark, folder, "second", bad)
    assert [numbers(store.read(spark, folder, t).select("id")) for t in "abc"] == [[0], [0, 1], [0, 1, 2]]
    assert store.sweep(spark, folder) == [] and store.sweep(spark, folder, older_than_s=-60) == ["second"]
    assert os.listdir(f"{folder}/parts") == ["first"]
    assert store.write(spark, folder, "second", {name: df.select(F.col("id") + 10) .toDF("id") for name, df in good.items()})
    assert numbers(store.read(spark, folder, "c").select("id")) == [0, 1, 2, 10, 11, 12]
    assert not store.write(spark, folder, "second", bad) and store.read(spark, folder, "none") is None
    assert [m["batch"] for m in store.manifests(spark, folder)] == ["first", "second"]


def test_the_last_row_of_a_key_counts(spark, tmp_path):
    folder = str(tmp_path)
    for batch, rows in (("b1", [(1, "x"), (2, "x")]), ("b0", [(2, "y")])):
        store.write(spark, folder, batch, {"t": spark.createDataFrame(rows, "k int, v string")})
    assert {(r.k, r.v) for r in store.latest(spark, folder, "t", ["k"]).collect()} == {(1, "x"), (2, "y")}


def test_revisions_are_one_commit(spark, tmp_path):
    folder, now = str(tmp_path), F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    texts = lambda *ids: {"document_blocks": spark.createDataFrame([(i, f"t{i}") for i in ids], "document_id long, content string")}
    first = spark.createDataFrame([(1, "u", "h1", "d", "one"), (2, None, "h2", None, "two")], DOC)
    assert publish.publish_revisions(spark, folder, "a", first, texts(1, 2), now)
    second = spark.createDataFrame([(3, "u", "h1", "d", "same"), (4, "v", "h4", "d", "four")], DOC)
    assert publish.publish_revisions(spark, folder, "b", second, texts(3, 4), now)
    third = spark.createDataFrame([(5, "u", "h5", None, "newer")], DOC)
    for _ in range(2):
        publish.publish_revisions(spark, folder, "c", third, texts(5), now)
    got = {r.document_id: (r.status, r.replaced_by) for r in publish.registry(spark, folder).collect()}
    assert got == {1: ("replaced", 5), 2: ("active", None), 4: ("active", None), 5: ("active", None)}
    assert numbers(store.read(spark, folder, "document_blocks").select("document_id")) == [1, 2, 4, 5]
    assert store.read(spark, folder, "document_registry").count() == 5  # 1 and 2, 4, then 5 and 1 anew


def test_plan_modes(spark):
    registry = spark.createDataFrame([(1, "u", "h1", "active"), (2, "u", "h2", "active"), (3, "w", "h3", "replaced")], "document_id int, doc_uid_base string, content_hash string, status string")
    rows = [(10, "u", "h1", "d"), (11, "u", "h9", "d"), (12, "u", "h9", None), (13, " ", "h1", "d"), (14, "w", "h3", "d"), (15, None, None, None), (16, "u", None, "d")]
    got = {r.doc_key: (r["mode"], r.n_replaced) for r in publish.publication_plan(spark.createDataFrame(rows, "doc_key int, doc_uid_base string, content_hash string, revision_date string"), registry).collect()}
    assert got == {10: ("conflict", 0), 11: ("replace_active_revision", 2), 12: ("replace_active_revision_without_revision_date", 2), 13: ("insert_new_active_unbound", 0), 14: ("insert_new_active", 0), 15: ("insert_new_active_unbound", 0), 16: ("replace_active_revision", 2)}


def folded(text, most, overlap):
    out, parts, size = [], [], 0
    for p in (re.sub(r"\s+", " ", line).strip() for line in (text or "").split("\n")):
        if p and parts and size + len(p) > most:
            out.append("\n".join(parts))
            parts = [out[-1][-overlap:]]
            size = len(parts[0])
        if p:
            parts.append(p)
            size += len(p)
    return out + (["\n".join(parts)] if parts else [])


def test_chunks_overlap(spark):
    rng = random.Random(5)
    texts = [None, "", " \n\t", "one", "x" * 500, "\n".join("é" * rng.randint(1, 60) + " y" for _ in range(200))] + ["\r\n".join("w" * rng.randint(0, 90) for _ in range(rng.randint(1, 30))) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "document_id int, text string")
    got = {}
    for r in ingest.chunks(docs, most=100, overlap=30).orderBy("document_id", "chunk_index").collect():
        got.setdefault(r.document_id, []).append(r.content)
    assert got == {k: folded(t, 100, 30) for k, t in enumerate(texts) if folded(t, 100, 30)}
    with pytest.raises(ValueError):
        ingest.chunks(docs, most=10, overlap=10)


def test_chunks_are_stored_once(spark, tmp_path):
    folder, asked = str(tmp_path), {"dimension": 8, "provider": lambda ts: embedding.hashed(ts, 8), "most": 50, "overlap": 10}
    docs = spark.createDataFrame([(1, "a" * 40 + "\n" + "b" * 40), (2, "same"), (3, "same"), (4, None)], "document_id long, text string")
    assert {r.document_id: r.chunks_created for r in ingest.ingest_chunks(docs, folder, **asked).collect()} == {1: 2, 2: 1, 3: 1}
    assert ingest.ingest_chunks(docs, folder, **asked).count() == 0
    more = docs.unionByName(spark.createDataFrame([(5, "new")], docs.schema))
    assert [tuple(r) for r in ingest.ingest_chunks(more, folder, **asked).collect()] == [(5, 1)]
    blocks, vectors = store.read(spark, folder, "document_block"), store.read(spark, folder, "document_block_embedding")
    assert blocks.count() == 5 and vectors.count() == 5 and blocks.join(vectors, "block_id", "left_anti").count() == 0
    assert {len(r.embedding) for r in vectors.collect()} == {8}
