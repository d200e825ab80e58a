"""Files as tables: content hashes, types, evaluation cases, chat updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MIME = {"docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "pdf": "application/pdf", "txt": "text/plain", "json": "application/json"}
CASES = "case_id string, intent string, question string, expected_substrings array<string>, forbidden_substrings array<string>, expected_answer_mode string, expected_evidence_quality string, notes string"
UPDATE = "update_id long, message struct<message_id: long, date: long, text: string, chat: struct<id: long>, from: struct<id: long, username: string>>, callback_query struct<id: string, data: string, message: struct<chat: struct<id: long>>>"


def mime_type(extension: Column) -> Column:
    out = F.lit("application/octet-stream")
    for ext, mime in MIME.items():
        out = F.when(extension == ext, mime).otherwise(out)
    return out


def files(spark: SparkSession, path: str, *, pattern: str = "*.docx") -> DataFrame:
    """path, file_name, extension, mime_type, size, modified, file_hash, content; unreadable folders raise."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    ext = F.lower(F.element_at(F.split(name, r"\."), -1))
    return raw.select("path", name.alias("file_name"), ext.alias("extension"), mime_type(ext).alias("mime_type"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("file_hash"), "content")


def eval_cases(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of cases; those without case_id, intent or question are refused."""
    rows = spark.read.schema(CASES).option("multiLine", True).json(path)
    need = F.col("case_id").isNotNull() & F.col("intent").isNotNull() & F.col("question").isNotNull()
    none = F.array().cast("array<string>")
    checked = F.when(need, F.col("case_id")).otherwise(F.raise_error(F.lit("a case lacks case_id, intent or question")))
    return rows.select(checked.alias("case_id"), "intent", "question", F.coalesce("expected_substrings", none).alias("expected"), F.coalesce("forbidden_substrings", none).alias("forbidden"), F.col("expected_answer_mode").alias("expected_mode"), F.col("expected_evidence_quality").alias("expected_quality"))


def updates(raw: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """Chat updates (JSON) as messages and callbacks; works on streams too."""
    from ..functions.text import callback

    u = raw.select(F.from_json(F.col(value).cast("string"), UPDATE).alias("u")).select("u.*")
    messages = u.filter("message.text IS NOT NULL").select("update_id", F.col("message.chat.id").cast("string").alias("external_session_id"), F.col("message.from.id").cast("string").alias("external_user_id"), F.col("message.from.username").alias("user_name"), F.col("message.text").alias("text"), F.timestamp_seconds("message.date").alias("at"))
    votes = u.filter("callback_query.data IS NOT NULL").select("update_id", F.col("callback_query.message.chat.id").cast("string").alias("external_session_id"), callback(F.col("callback_query.data")).alias("c")).filter("c IS NOT NULL").select("update_id", "external_session_id", "c.*")
    return messages, votes
