"""Staged jobs over documents: failures leave at the stage where they happen, a job that is run again goes on where it stopped.

A stage takes a row a document and gives a row a document, of which ``error`` (null: none) tells what failed.  Each stage is one commit
(``store``): its rows that go on, and the log's events of all its documents.  What is committed is not done again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.shipping import ship
from ..sources import ooxml
from . import ingest, publish, store

LOG = "job_log"
Stage = tuple[str, Callable[[DataFrame], DataFrame]]


def batch_of(job: str, at: int, stage: str) -> str:
    return f"{job}.{at:02}-{stage}"


def run(spark: SparkSession, folder: str, job: str, documents: DataFrame, stages: list[Stage]) -> DataFrame:
    """The documents that passed all ``stages``, as the last one gave them.

    ``documents`` has document_id, unique.  A stage that fails as a whole raises, with the stages before committed; run again
    with the same ``job`` it starts there.  Events: job_id, document_id, stage, status (running, failed, skipped), error, at.
    """
    rows = documents
    for k, (name, stage) in enumerate(stages):
        batch = batch_of(job, k, name)
        if not store.committed(spark, folder, batch):
            with store.commit(spark, folder, batch, job=job, stage=name) as add:
                done = stage(rows)
                if "error" not in done.columns:
                    done = done.withColumn("error", F.lit(None).cast("string"))
                kept = add(f"stage_{name}", done)
                skipped = F.startswith("error", F.lit("skipped"))
                status = F.when(F.col("error").isNull(), "running").when(skipped, "skipped").otherwise("failed")
                add(LOG, kept.select(F.lit(job).alias("job_id"), "document_id", F.lit(k).alias("stage_order"), F.lit(name).alias("stage"), status.alias("status"), "error", F.current_timestamp().alias("at")))
        own = store.read(spark, folder, f"stage_{name}").filter(F.col("batch") == batch)
        rows = own.filter("error IS NULL").drop("batch", "committed_at", "error")
    return rows


def states(spark: SparkSession, folder: str, job: str, stages: list[Stage]) -> DataFrame:
    """document_id, status, stage, error: where each document of a job stands; one that passed the last stage is completed."""
    log = store.read(spark, folder, LOG).filter(F.col("job_id") == job)
    last = log.groupBy("document_id").agg(F.max_by(F.struct("status", "stage", "error"), "stage_order").alias("s"))
    done = (F.col("s.status") == "running") & (F.col("s.stage") == stages[-1][0])
    return last.select("document_id", F.when(done, "completed").otherwise(F.col("s.status")).alias("status"), "s.stage", "s.error")


def guarded(rows: DataFrame, do: Callable[[dict], dict], schema: str) -> DataFrame:
    """``do`` (a row as a dict to the stage's new columns) on each row; an exception becomes the row's ``error``, and only its.

    The result has the row's columns, those of ``schema`` and ``error``.
    """
    import pandas as pd

    ship(rows.sparkSession)
    names = [f.strip().split(" ")[0] for f in _fields(schema)]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                try:
                    made = do(row)
                    out.append({**row, **{n: made[n] for n in names}, "error": None})
                except Exception as e:  # one document's failure is its own
                    out.append({**row, **dict.fromkeys(names), "error": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame(out, columns=[*batch.columns, *names, "error"])

    return rows.mapInPandas(each, f"{rows.schema.toDDL()}, {schema}, error string")


def _fields(schema: str) -> list[str]:
    """The fields of a schema at its top level."""
    out, depth, start = [], 0, 0
    for k, c in enumerate(schema):
        depth += c in "<(" and 1 or c in ">)" and -1 or 0
        if c == "," and not depth:
            out.append(schema[start:k])
            start = k + 1
    return [*out, schema[start:]]


# ---------------------------------------------------------------- documents


def document_stages(spark: SparkSession, folder: str, *, job: str, force: bool = False) -> list[Stage]:
    """From files (path, file_name, file_hash, content) with document_id to the registry: the stages of ingestion, composed.

    Duplicates of active documents are skipped, damaged files fail in normalization, poor ones in quality control; the rest is published in
    one commit with the revisions that it replaces.
    """
    def received(files: DataFrame) -> DataFrame:
        now = publish.registry(spark, folder)
        if now is None or force:
            return files
        known = now.filter("status = 'active'").select("file_hash", F.lit("skipped: active_duplicate_by_file_hash").alias("error")).distinct()
        return files.join(known, "file_hash", "left")

    def normalized(files: DataFrame) -> DataFrame:
        items = ooxml.items(files)
        text = ooxml.plain_text(items.filter("kind <> 'error'")).select("path", T.normalize_document(F.col("text")).alias("text"))
        wrong = items.filter("kind = 'error'").select("path", "error")
        return files.drop("content").join(text, "path", "left").join(wrong, "path", "left").withColumn("content_hash", T.content_hash(F.col("text")))

    def structured(docs: DataFrame) -> DataFrame:
        block = F.struct("block_order", "content", "block_type", "clause_number")
        own = ingest.blocks(docs).groupBy("document_id").agg(F.array_sort(F.collect_list(block)).alias("blocks"))
        return docs.join(own, "document_id", "left")

    def enriched(docs: DataFrame) -> DataFrame:
        titles = ingest.document_titles(docs.select("document_id", "file_name"), blocks_of(docs))
        out = docs.join(titles, "document_id").withColumn("e", ingest.enrich(F.concat_ws("\n", "title", "text"))).select("*", "e.*").drop("e")
        number = T.found_number(F.concat_ws("\n", "file_name", "title", F.substring("text", 1, 3000)))
        return out.withColumn("doc_uid_base", ingest.document_uid(F.col("title"), number)).withColumn("revision_date", T.found_date(F.concat_ws("\n", "file_name", "text")))

    def checked(docs: DataFrame) -> DataFrame:
        figures = ingest.qc_verdict(ingest.qc_metrics(docs.select("document_id", "text"), blocks_of(docs))).drop("warnings")
        out = docs.join(figures, "document_id").withColumn("n_units", F.col("n_meaningful"))
        return out.select(*docs.columns, ingest.qc_warnings(out).alias("warnings"), F.col("error_code").alias("error"))

    def published(docs: DataFrame) -> DataFrame:
        rows = blocks_of(docs).withColumn("block_id", publish.row_id(F.col("document_id"), F.lit("block"), F.col("block_order")))
        publish.publish_revisions(spark, folder, f"{job}.published", docs.drop("text", "blocks", "warnings"), {"document_blocks": rows}, F.current_timestamp())
        now = publish.registry(spark, folder).select("document_id", F.col("status").alias("_s"))
        return docs.join(now, "document_id", "left").withColumn("error", F.when(F.col("_s").isNull(), "conflict")).select("document_id", "title", "error")

    return [("idempotency_check", received), ("normalization", normalized), ("structure_extraction", structured), ("semantic_enrichment", enriched), ("quality_control", checked), ("publication", published)]


def blocks_of(docs: DataFrame) -> DataFrame:
    return docs.select("document_id", F.explode("blocks").alias("b")).select("document_id", "b.*")


def ingest_files(spark: SparkSession, folder: str, job: str, files: DataFrame, *, force: bool = False) -> DataFrame:
    """``files.files`` rows to published documents; the state of each (``states``).  The id follows from path and hash."""
    stages = document_stages(spark, folder, job=job, force=force)
    run(spark, folder, job, files.withColumn("document_id", publish.row_id(F.col("path"), F.col("file_hash"))), stages)
    return states(spark, folder, job, stages)
