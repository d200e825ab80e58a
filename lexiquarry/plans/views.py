"""The driver's tables as the engine's relations, so that every operator has data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import ingest

#: question_id, intent, terms, kind of deadline asked for, measure wanted: the stated query set, one for each strategy at least.
QUESTIONS = (
    (1, "documents", ("order", "the", "tion"), "other", "Brand#2"),
    (2, "deadline", ("within", "ent", "en"), "decision", None),
    (3, "procedure", ("that", "high", "ring"), "other", None),
    (4, "rejection", ("non", "returned", "urgent"), "other", None),
    (5, "eligibility", ("able", "accepted", "ung"), "other", "Brand#3"),
    (6, "form", ("the", "low", "deadline_table"), "other", None),
    (7, "other", ("avec", "heit", "end"), "other", None),
    (8, "deadline", ("not", "pour", "at the end"), "payment", None),
)
HISTORY_VOTES = 200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def questions(spark: SparkSession) -> DataFrame:
    rows = [(i, intent, list(terms), kind, measure, None, []) for i, intent, terms, kind, measure in QUESTIONS]
    return spark.createDataFrame(rows, "question_id int, intent string, terms array<string>, asked string, measure string, channel string, hints array<string>")


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    docs = table(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    return docs.select(F.col("doc_id").alias("document_id"), F.col("source").alias("doc_uid_base"), F.col("lang").alias("language"), F.when(F.col("quality") == 0, "replaced").otherwise("active").alias("status"), T.text_hash(F.col("text")).alias("content_hash"))


def statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry without hashes: no text is read for it."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    docs = table(spark, sf_dir, "documents").select("doc_id").join(labels, "doc_id", "left")
    return docs.select(F.col("doc_id").alias("document_id"), F.when(F.col("quality") == 0, "replaced").otherwise("active").alias("status"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = ingest.blocks(table(spark, sf_dir, "documents"), key="doc_id")
    return own.withColumn("source_id", F.concat_ws("-", "document_id", "block_order"))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select((F.col("p_partkey") % 1000).alias("document_id"), F.concat(F.lit("f"), F.col("p_partkey")).alias("source_id"), F.lower("p_type").alias("fact_type"), F.col("p_brand").alias("measure_code"), F.col("p_size").cast("string").alias("subject"), F.col("p_name").alias("note"))


def tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 1000).alias("document_id"), F.concat(F.lit("t"), F.col("o_orderkey")).alias("source_id"), F.col("o_orderpriority").alias("title"), F.when(F.col("o_orderstatus") == "O", "deadline_table").otherwise("generic").alias("table_type"), F.when(F.col("o_orderkey") % 3 == 0, "deadlines").when(F.col("o_orderkey") % 3 == 1, "documents").alias("semantic"))


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")
    summary = F.concat_ws(" ", F.when(F.col("l_returnflag") == "R", "returned within order").when(F.col("l_returnflag") == "A", "accepted at the end").otherwise("none"), F.when(F.col("l_linestatus") == "O", "ring").otherwise("that"), F.col("l_linenumber").cast("string"))
    return l.select((F.col("l_orderkey") % 1000).alias("document_id"), F.concat(F.lit("r"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")).alias("source_id"), F.concat(F.lit("t"), F.col("l_orderkey")).alias("table_id"), F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("row_order"), "l_returnflag", "l_linestatus", summary.alias("summary"),
                    F.when(F.col("l_linenumber") % 3 == 0, "documents").when(F.col("l_linenumber") % 3 == 1, "deadlines").otherwise("refusal_reasons").alias("semantic"), (F.col("l_linenumber") % 2 == 0).alias("has_value"))


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("vote_id"), F.col("user_id").alias("session_id"), (F.col("event_id") % HISTORY_VOTES).alias("answer_id"), (F.col("event_id") % 5 + 1).cast("int").alias("score"), F.col("ts").alias("submitted_at"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations' assistant turns as answers, some modes and failures by number."""
    c = table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    n = F.col("conv_id") * 10 + F.col("turn")
    return c.select(
        (n % HISTORY_VOTES).alias("slot"), n.alias("answer_id"), F.col("conv_id").alias("session_id"), F.coalesce("text", F.lit("")).alias("answer_text"),
        F.when(n % 7 == 0, "reused_answer").when(n % 11 == 0, "safe_no_answer").otherwise("grounded_narrative").alias("mode"), F.when(n % 13 == 0, "failed").otherwise("passed").alias("validation_status"),
        F.when(n % 3 == 0, "documents").otherwise("deadline").alias("intent"), F.when(n % 2 == 0, "telegram").otherwise("web").alias("channel"), F.when(n % 5 != 0, F.concat(F.lit("m"), (n % 5).cast("string"))).alias("measure_code"),
        F.expr("TIMESTAMP '2024-01-01 00:00:00'" ) .alias("epoch"), n.alias("n")).withColumn("created_at", F.timestamp_seconds(F.unix_timestamp("epoch") + F.col("n") * 600)).drop("epoch")


#: Title and headers of an order as a table, by its number modulo 5; the rows that open groups of a documents table.
PAPERS = (
    ("Перечень документов, необходимых для услуги", ("№ п/п", "Наименование документа", "Способ подачи", "Способ подачи", "Способ подачи")),
    ("Категории заявителей", ("Идентификатор", "Категории заявителей")),
    ("Основания для отказа", ("Основание", "Идентификатор")),
    ("", ("Действие", "Срок исполнения")),
    ("Сведения", ("Имя", "Имя", "Примечание")),
)
PAPER_GROUPS = ("Документы, которые заявитель должен представить самостоятельно", "Документы, которые заявитель вправе представить по собственной инициативе")


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tables with headers, their lines as rows; documents tables have a row of column numbers and rows of groups."""
    l = table(spark, sf_dir, "lineitem")
    n, part, supplier = (F.col(f"x.{c}").cast("string") for c in ("l_linenumber", "l_partkey", "l_suppkey"))
    returned, open_ = F.col("x.l_returnflag") == "R", F.col("x.l_linestatus") == "O"
    kind = F.col("l_orderkey") % len(PAPERS)
    cat = lambda *cs: F.concat(*[F.lit(c) if isinstance(c, str) else c for c in cs])
    made = (
        (n, cat("Документ ", part), F.when(returned, "лично").otherwise(""), F.when(open_, "ЕПГУ").otherwise(""), F.lit("почта")), (cat("A", supplier), cat("группа ", n)),
        (cat("причина ", part), F.when(returned, cat("A", supplier)).otherwise("")), (cat("решение ", n), cat(F.col("x.l_quantity").cast("int").cast("string"), " рабочих дней")),
        (cat("x", part), F.when(open_, "y").otherwise(""), cat("достаточно длинное примечание номер сорок один ", n)),
    )
    cells = F.lit(None).cast("array<string>")
    for k, own in enumerate(made):
        cells = F.when(kind == k, F.array(*own)).otherwise(cells)
    x = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_quantity").alias("x")
    rows = l.select("l_orderkey", x).select("l_orderkey", F.struct("x.l_linenumber", "x.l_partkey", "x.l_suppkey", cells.alias("cells")).alias("r"))
    body = rows.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["cells"]).alias("body"))
    texts = lambda values: F.array(*[F.lit(v) for v in values])
    own, free = (F.array(texts((g,))) for g in PAPER_GROUPS)
    body = body.withColumn("body", F.when(kind == 0, F.concat(F.array(texts("12345")), own, F.slice("body", 1, 2), free, F.slice("body", F.lit(3), F.size("body")))).otherwise(F.col("body")))
    title, headers = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    for k, (name, names) in enumerate(PAPERS):
        title, headers = F.when(kind == k, name).otherwise(title), F.when(kind == k, texts(names)).otherwise(headers)
    return body.select(F.col("l_orderkey").alias("table_id"), title.alias("title"), F.concat(F.array(headers), "body").alias("cells"))


#: The same relations for the oracle.
SQL = {
    "labels1": "labels1 AS (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY doc_id)",
    "registry": r"""registry AS (SELECT d.doc_id AS document_id, source AS doc_uid_base, lang AS language, CASE WHEN quality = 0 THEN 'replaced' ELSE 'active' END AS status,
  sha256(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))) AS content_hash FROM documents d LEFT JOIN labels1 l USING (doc_id))""",
    "blocks": r"""cut AS (SELECT doc_id AS document_id, unnest(string_split(coalesce(text, ''), chr(10))) AS raw, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
blocks AS (SELECT document_id, CAST(pos AS INTEGER) AS block_order, trim(raw) AS content, document_id || '-' || pos AS source_id,
  CASE WHEN regexp_matches(trim(raw), '(?i)^(таблица|table)\s*(№|n)?\s*\d') THEN 'table_caption' WHEN regexp_matches(trim(raw), '^([-•*–]|\d+[.)]|[a-zа-я]\))\s') THEN 'list_item'
    WHEN length(trim(raw)) <= 80 AND NOT regexp_matches(trim(raw), '[.,;:]$') THEN 'heading' ELSE 'paragraph' END AS block_type FROM cut WHERE trim(raw) <> '')""",
    "facts": "facts AS (SELECT p_partkey % 1000 AS document_id, 'f' || p_partkey AS source_id, lower(p_type) AS fact_type, p_brand AS measure_code, CAST(p_size AS VARCHAR) AS subject, p_name AS note FROM part)",
    "tables": "tabs AS (SELECT o_orderkey % 1000 AS document_id, 't' || o_orderkey AS source_id, o_orderpriority AS title, CASE WHEN o_orderstatus = 'O' THEN 'deadline_table' ELSE 'generic' END AS table_type, CASE o_orderkey % 3 WHEN 0 THEN 'deadlines' WHEN 1 THEN 'documents' END AS semantic FROM orders)",
    "rows": """rws AS (SELECT l_orderkey % 1000 AS document_id, 'r' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS source_id, 't' || l_orderkey AS table_id, l_orderkey AS order_key, l_linenumber AS row_order, l_returnflag, l_linestatus,
  (CASE WHEN l_returnflag = 'R' THEN 'returned within order' WHEN l_returnflag = 'A' THEN 'accepted at the end' ELSE 'none' END) || ' ' || (CASE WHEN l_linestatus = 'O' THEN 'ring' ELSE 'that' END) || ' ' || l_linenumber AS summary,
  CASE l_linenumber % 3 WHEN 0 THEN 'documents' WHEN 1 THEN 'deadlines' ELSE 'refusal_reasons' END AS semantic, l_linenumber % 2 = 0 AS has_value FROM lineitem)""",
    "questions": "questions(question_id, intent, terms, asked, measure) AS (VALUES " + ", ".join(f"({i}, '{intent}', [{', '.join(repr(t) for t in terms)}], '{kind}', {repr(m) if m else 'NULL'})" for i, intent, terms, kind, m in QUESTIONS) + ")",
    "papers": f"""lines AS (SELECT l_orderkey AS k, l_orderkey % 5 AS kind, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n, l_linenumber AS ln, l_partkey AS pk, l_suppkey AS sk, l_returnflag = 'R' AS ret, l_linestatus = 'O' AS op, CAST(l_quantity AS INTEGER) AS q FROM lineitem),
papers AS (SELECT DISTINCT k, CASE kind {' '.join(f"WHEN {k} THEN '{t}'" for k, (t, _) in enumerate(PAPERS))} END AS title, CASE kind {' '.join(f"WHEN {k} THEN {list(h)}" for k, (_, h) in enumerate(PAPERS))} END AS headers FROM lines),
paper_rows AS (SELECT k, CASE WHEN kind = 0 THEN n + CASE WHEN n <= 2 THEN 2 ELSE 3 END ELSE n END AS pos, CASE kind WHEN 0 THEN [ln::VARCHAR, 'Документ ' || pk, CASE WHEN ret THEN 'лично' ELSE '' END, CASE WHEN op THEN 'ЕПГУ' ELSE '' END, 'почта'] WHEN 1 THEN ['A' || sk, 'группа ' || ln]
    WHEN 2 THEN ['причина ' || pk, CASE WHEN ret THEN 'A' || sk ELSE '' END] WHEN 3 THEN ['решение ' || ln, q || ' рабочих дней'] ELSE ['x' || pk, CASE WHEN op THEN 'y' ELSE '' END, 'достаточно длинное примечание номер сорок один ' || ln] END AS cells FROM lines
  UNION ALL SELECT DISTINCT k, 1, ['1', '2', '3', '4', '5'] FROM lines WHERE kind = 0 UNION ALL SELECT DISTINCT k, 2, ['{PAPER_GROUPS[0]}'] FROM lines WHERE kind = 0 UNION ALL SELECT k, least(max(n), 2) + 3, ['{PAPER_GROUPS[1]}'] FROM lines WHERE kind = 0 GROUP BY k)""",
    "votes": "votes AS (SELECT event_id AS vote_id, user_id AS session_id, event_id % 200 AS answer_id, CAST(event_id % 5 + 1 AS INTEGER) AS score, ts AS submitted_at FROM events)",
    "answers": """answers AS (SELECT n % 200 AS slot, n AS answer_id, conv_id AS session_id, text AS answer_text, CASE WHEN n % 7 = 0 THEN 'reused_answer' WHEN n % 11 = 0 THEN 'safe_no_answer' ELSE 'grounded_narrative' END AS mode,
  CASE WHEN n % 13 = 0 THEN 'failed' ELSE 'passed' END AS validation_status, CASE WHEN n % 3 = 0 THEN 'documents' ELSE 'deadline' END AS intent, CASE WHEN n % 2 = 0 THEN 'telegram' ELSE 'web' END AS channel,
  CASE WHEN n % 5 <> 0 THEN 'm' || (n % 5) END AS measure_code, n, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(n * 600) AS created_at
  FROM (SELECT conv_id * 10 + turn AS n, conv_id, coalesce(text, '') AS text FROM conversations WHERE role = 'assistant'))""",
}


def with_views(body: str, *names: str) -> str:
    if "registry" in names and "labels1" not in names:
        names = ("labels1", *names)
    return "WITH " + ",\n".join(SQL[n] for n in names) + ("\n" if body.lstrip().startswith("SELECT") else ",\n") + body
