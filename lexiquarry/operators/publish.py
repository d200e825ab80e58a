"""Publication: plans, revisions, deterministic ids, append-only job logs, all tables of a batch as one commit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import store

CHILDREN = ("document_blocks", "document_tables", "document_table_rows", "legal_facts", "measure_aliases")
REGISTRY = "document_registry"
CHANNELS = ("telegram", "web", "mobile", "api", "internal")


def row_id(*parts: Column) -> Column:
    """An id from the natural key: a task that runs again gives the same."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def publication_plan(incoming: DataFrame, registry: DataFrame) -> DataFrame:
    """incoming (doc_key, doc_uid_base, content_hash, revision_date) → mode and n_replaced, the active documents it replaces.

    A conflict (the same content is active under the same uid) is a status of its row, not a failure.  A uid's documents are
    counted and its hashes met by joins; nothing is gathered for a uid.
    """
    active = registry.filter(F.col("status") == "active").select(F.col("doc_uid_base").alias("_uid"), F.col("content_hash").alias("_hash"))
    uid = F.nullif(F.trim("doc_uid_base"), F.lit(""))
    out = incoming.withColumn("_own", uid).join(active.groupBy("_uid").agg(F.count("*").alias("_n")), F.col("_own") == F.col("_uid"), "left").drop("_uid")
    out = out.join(active.distinct(), (F.col("_own") == F.col("_uid")) & (F.col("content_hash") == F.col("_hash")), "left")
    mode = (F.when(F.col("_own").isNull(), "insert_new_active_unbound").when(F.col("_n").isNull(), "insert_new_active").when(F.col("_hash").isNotNull(), "conflict")
            .when(F.col("revision_date").isNull(), "replace_active_revision_without_revision_date").otherwise("replace_active_revision"))
    out = out.withColumn("mode", mode)
    return out.withColumn("n_replaced", F.when(F.startswith("mode", F.lit("replace")), F.col("_n")).otherwise(0).cast("long")).drop("_own", "_n", "_uid", "_hash")


def replace_revisions(registry: DataFrame, plan: DataFrame, at: Column) -> DataFrame:
    """The registry with the active documents that a plan replaces marked: status, replaced_by (the least doc_key), replaced_at."""
    uid = F.nullif(F.trim("doc_uid_base"), F.lit(""))
    by = plan.filter(F.startswith("mode", F.lit("replace"))).groupBy(uid.alias("_uid")).agg(F.min("doc_key").alias("_by"))
    out = registry.join(by, F.col("doc_uid_base") == F.col("_uid"), "left")
    hit = F.col("_by").isNotNull() & (F.col("status") == "active")
    old = lambda c, kind: F.col(c) if c in registry.columns else F.lit(None).cast(kind)
    by_type = plan.schema["doc_key"].dataType.simpleString()
    return out.withColumns({"status": F.when(hit, "replaced").otherwise(F.col("status")), "replaced_by": F.when(hit, F.col("_by")).otherwise(old("replaced_by", by_type)), "replaced_at": F.when(hit, at).otherwise(old("replaced_at", "timestamp"))}).drop("_by", "_uid")


def block_rows(items: DataFrame) -> DataFrame:
    from ..functions.text import first_filled

    return items.withColumn("content", first_filled(F.col("content_clean"), F.col("content_raw"))).withColumn("block_type", F.coalesce("block_type", F.lit("paragraph"))).withColumn("block_id", row_id(F.col("document_id"), F.lit("block"), F.col("block_order")))


def bound_rows(rows: DataFrame, tables: DataFrame) -> DataFrame:
    """Rows with their table's id; null where the table is missing."""
    return rows.join(tables.select(F.col("local_table_id").alias("_l"), "document_id", "table_id"), (rows["local_table_id"] == F.col("_l")) & (rows["document_id"] == tables["document_id"]), "left").drop(tables["document_id"]).drop("_l")


def insert_absent(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(target.select(*keys), keys, "left_anti")


def seed_channels(spark) -> DataFrame:
    return spark.createDataFrame([(k + 1, c, c.title(), True) for k, c in enumerate(CHANNELS)], "channel_id long, channel_code string, channel_name string, is_active boolean")


def publish(tables: dict[str, DataFrame], folder: str, batch: str) -> bool:
    """All tables of a batch as one commit (``store``): readers see the whole batch or nothing of it.

    Publishing a batch again adds nothing; False then.
    """
    return store.write(tables[REGISTRY].sparkSession, folder, batch, {name: tables[name] for name in (*[c for c in CHILDREN if c in tables], REGISTRY)})


def publish_revisions(spark, folder: str, batch: str, incoming: DataFrame, children: dict[str, DataFrame], at: Column) -> bool:
    """Publish new documents and mark the revisions that they replace, in one commit.

    ``incoming``: document_id, doc_uid_base, content_hash, revision_date and the registry's other columns; ``children``: tables by
    document_id.  Conflicts and their children are left out.  The registry is read by ``registry``: a replaced document's
    row is written anew with its status, and the last row of a document counts.
    """
    if store.committed(spark, folder, batch):
        return False
    now = registry(spark, folder)
    known = now if now is not None else spark.createDataFrame([], incoming.drop("status").schema.add("status", "string").add("replaced_by", incoming.schema["document_id"].dataType).add("replaced_at", "timestamp"))
    plan = publication_plan(incoming.withColumn("doc_key", F.col("document_id")), known)
    accepted = plan.filter("mode <> 'conflict'")
    own = accepted.select(*incoming.drop("status").columns, F.lit("active").alias("status"), F.lit(None).cast(incoming.schema["document_id"].dataType).alias("replaced_by"), F.lit(None).cast("timestamp").alias("replaced_at"))
    with store.commit(spark, folder, batch) as add:
        for name, rows in children.items():
            add(name, rows.join(accepted.select("document_id"), "document_id", "left_semi"))
        gone = replace_revisions(known, accepted, at).filter("status = 'replaced'").join(known.filter("status = 'active'").select("document_id"), "document_id", "left_semi")
        add(REGISTRY, own.unionByName(gone.select(*own.columns)))
    return True


def registry(spark, folder: str) -> DataFrame | None:
    """The registry as published: the last committed row of each document."""
    rows = store.latest(spark, folder, REGISTRY, ["document_id"])
    return None if rows is None else rows.drop("batch", "committed_at")


def unpublishable(documents: DataFrame) -> DataFrame:
    """document_id and reason of documents that may not be published: checks not passed or hashes missing."""
    missing = lambda c: T.first_filled(F.col(c)).isNull()
    reason = F.when(~F.coalesce(F.col("qc_status") == "passed", F.lit(False)), "qc_not_passed").when(missing("file_hash"), "file_hash_missing").when(missing("content_hash"), "content_hash_missing")
    return documents.select("document_id", reason.alias("reason")).filter("reason IS NOT NULL")


def job_state(log: DataFrame) -> DataFrame:
    """The current state of each job from its log (job_id, at, status, stage, payload): latest wins, payloads merge."""
    last = F.max_by(F.struct("status", "stage"), F.struct("at", "stage"))
    events = F.array_sort(F.collect_list(F.struct("at", F.map_entries("payload").alias("entries"))))
    newer = lambda acc, e: F.concat(F.filter(acc, lambda x: ~F.exists(e["entries"], lambda y: y["key"] == x["key"])), e["entries"])
    none = F.slice(F.flatten(F.transform(events, lambda e: e["entries"])), 1, 0)
    merged = F.map_from_entries(F.aggregate(events, none, newer))
    return log.groupBy("job_id").agg(last.alias("s"), merged.alias("payload"), F.min("at").alias("started_at"), F.max("at").alias("changed_at")).select("job_id", "s.status", "s.stage", "payload", "started_at", "changed_at")


def sessions(messages: DataFrame) -> DataFrame:
    """One row for each (channel, external session): first and last time, latest names."""
    latest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("at"))).alias(c)
    return messages.groupBy("channel", "external_session_id").agg(F.min("at").alias("started_at"), F.max("at").alias("last_at"), latest("external_user_id"), latest("user_name")).withColumn("session_id", row_id(F.col("channel"), F.col("external_session_id")))


def clone_evidence(reused: DataFrame, evidence: DataFrame) -> DataFrame:
    """(answer_id, reused_from) with the evidence of the source answer under the new id."""
    return reused.join(evidence.withColumnRenamed("answer_id", "reused_from"), "reused_from").withColumn("evidence_id", row_id(F.col("answer_id"), F.col("evidence_order")))
