"""All queries on the driver's tables, with the SQL that an independent engine runs for each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import similarity as S
from .functions import text as T
from .operators import answers, deadlines, evaluate, feedback, generate, ingest, publish, required_documents, retrieval, reuse, table_rows, vector
from .plans import views as V
from .plans.config import DRIVER
from .plans.views import with_views

QUERIES: dict = {}
SQL: dict = {}
FLAGSHIP = "q18_capped_selection"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


# ---------------------------------------------------------------- scans, branches

@query("q01_active_registry", with_views("SELECT document_id, doc_uid_base, language, content_hash FROM registry WHERE status = 'active'", "registry"))
def q01(spark, d):
    return V.registry(spark, d).filter("status = 'active'").select("document_id", "doc_uid_base", "language", "content_hash")


@query("q02_blocks", with_views("SELECT document_id, block_order, content, block_type FROM blocks", "blocks"))
def q02(spark, d):
    return V.blocks(spark, d).select("document_id", "block_order", "content", "block_type")


def _score_sql(columns: list[str], w: float, boost: str = "0") -> str:
    hit = " OR ".join(f"contains(lower({c}), t)" for c in columns)
    return f"round(list_sum(list_transform(terms, lambda t: CASE WHEN {hit} THEN {w}::DOUBLE ELSE 0::DOUBLE END)) + ({boost}), 6)"


def _weight_sql(branch: str) -> str:
    from .plans.config import STRATEGIES

    return "CASE intent " + " ".join(f"WHEN '{i}' THEN {s.weight(branch)}::DOUBLE" for i, s in STRATEGIES.items()) + f" ELSE {STRATEGIES['other'].weight(branch)}::DOUBLE END"


_BLOCK_BOOST = "CASE WHEN intent IN ('procedure', 'appeal') THEN CASE WHEN block_type IN ('paragraph', 'list', 'heading') THEN 0.2 ELSE 0 END WHEN block_type IN ('paragraph', 'list') THEN 0.1 ELSE 0 END::DOUBLE"
_FACT_BOOST = "CASE WHEN measure_code = measure THEN 1.0 ELSE 0 END::DOUBLE"
_TABLE_BOOST = "CASE WHEN table_type IN ('eligibility_table', 'documents_table', 'deadline_table', 'form_table') THEN 0.25 ELSE 0 END::DOUBLE"


def _branch_sql(name: str, view: str, branch: str, score: str, k: int, where: str = "true") -> str:
    return f"""{name} AS (SELECT * FROM (SELECT question_id, intent, source_id, document_id, '{branch}' AS source_type, score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, source_id) AS place
  FROM (SELECT question_id, intent, v.source_id, v.document_id, {score} * {_weight_sql(branch)} AS score FROM questions, {view} v
    WHERE v.document_id IN (SELECT document_id FROM registry WHERE status = 'active') AND ({where}))) WHERE place <= {k} AND score > 0)"""


_B4 = _branch_sql("b4", "blocks", "block", _score_sql(["content"], 0.35, _BLOCK_BOOST), 12)
_B1 = _branch_sql("b1", "facts", "legal_fact", _score_sql(["note"], 0.35, _FACT_BOOST), 10, "measure IS NULL OR measure_code IS NULL OR measure_code = measure")
_B2 = _branch_sql("b2", "tabs", "table", _score_sql(["title", "table_type"], 0.40, _TABLE_BOOST), 10)
_B3 = _branch_sql("b3", "rws", "table_row", _score_sql(["summary"], 0.45), 12)
_ALL = ("registry", "blocks", "facts", "tables", "rows", "questions")
_OUT = "SELECT question_id, source_id, document_id, score, CAST(place AS INTEGER) AS place FROM "


@query("q03_block_scores", with_views(f"SELECT question_id, v.source_id, {_score_sql(['content'], 0.35, _BLOCK_BOOST)} * {_weight_sql('block')} AS score FROM questions, blocks v WHERE v.document_id IN (SELECT document_id FROM registry WHERE status = 'active')", "registry", "blocks", "questions"))
def q03(spark, d):
    own = V.blocks(spark, d).join(V.statuses(spark, d).filter("status = 'active'").select("document_id"), "document_id", "left_semi")
    terms = F.array(*[F.lit(t) for t in sorted({t for q in V.QUESTIONS for t in q[2]})])
    own = own.select("source_id", "block_type", retrieval.term_hits(terms, [F.col("content")]).alias("hits"))
    score = F.round(retrieval.hit_score(F.col("terms"), F.col("hits"), 0.35) + retrieval.block_boost(F.col("intent"), F.col("block_type")), 6)
    every = own.join(F.broadcast(V.questions(spark)), F.lit(True))  # a stated handful of questions; the query asks for all scores
    return every.select("question_id", "source_id", (score * retrieval.strategy_weight(F.col("intent"), "block")).alias("score"))


def _blocks(spark, d):
    intent, kind = F.col("intent"), F.col("block_type")
    return retrieval.branch(V.questions(spark), V.blocks(spark, d), V.statuses(spark, d), "block", ["content"], boost=retrieval.block_boost(intent, kind), boost_keys=retrieval.block_keys(intent, kind))


def _facts(spark, d):
    boost = retrieval.fact_boost(F.col("intent"), F.col("fact_type"), F.col("measure_code"), F.col("measure"))
    keys = retrieval.fact_keys(F.col("fact_type"), F.col("measure_code"), F.col("intent"), F.col("measure"))
    return retrieval.branch(V.questions(spark), V.facts(spark, d), V.statuses(spark, d), "legal_fact", ["note"], boost=boost, boost_keys=keys, keep=retrieval.exact_or_null(F.col("measure_code"), F.col("measure")))


def _tables(spark, d):
    kind = F.col("table_type")
    return retrieval.branch(V.questions(spark), V.tables(spark, d), V.statuses(spark, d), "table", ["title", "table_type"], boost=retrieval.table_boost(kind), boost_keys=retrieval.table_keys(kind))


def _rows(spark, d):
    return retrieval.branch(V.questions(spark), V.rows(spark, d), V.statuses(spark, d), "table_row", ["summary"])


for _name, _f, _sql in (("q04_block_top_k", _blocks, _B4 + "\n" + _OUT + "b4"), ("q05_fact_top_k", _facts, _B1 + "\n" + _OUT + "b1"), ("q06_table_top_k", _tables, _B2 + "\n" + _OUT + "b2"), ("q07_row_top_k", _rows, _B3 + "\n" + _OUT + "b3")):
    query(_name, with_views(_sql, *_ALL))(lambda spark, d, f=_f: f(spark, d).select("question_id", "source_id", "document_id", "score", F.col("place").cast("int").alias("place")))

CANDIDATE = ["question_id", "intent", "source_type", "source_id", "document_id", "score", "snippet", "blob", "semantic", "has_value", "terms", "asked", "channel", "hints"]


def candidates(spark, d) -> DataFrame:
    """The four branches as one relation; blob is the normalised text, snippet the text as it is."""
    none, no = F.lit(None).cast("string"), F.lit(False)
    parts = [(_facts, ["note", "fact_type"], none, no), (_rows, ["summary"], F.col("semantic"), F.col("has_value")), (_tables, ["title", "table_type"], F.col("semantic"), no), (_blocks, ["content"], none, no)]
    made = [f(spark, d).withColumns({"blob": retrieval.blob(*[F.col(c) for c in cols]), "snippet": F.col(cols[0]), "semantic": semantic, "has_value": value}).select(*CANDIDATE) for f, cols, semantic, value in parts]
    return reduce(DataFrame.unionByName, made)


_UNION = ",\n".join((_B1, _B2, _B3, _B4)) + """,
texts AS (SELECT source_id, note AS snippet, lower(note || ' ' || fact_type) AS blob, '' AS semantic, false AS has_value FROM facts UNION ALL SELECT source_id, summary, lower(summary), coalesce(semantic, ''), has_value FROM rws
  UNION ALL SELECT source_id, title, lower(title || ' ' || table_type), coalesce(semantic, ''), false FROM tabs UNION ALL SELECT source_id, content, lower(trim(regexp_replace(content, '\\s+', ' ', 'g'))), '', false FROM blocks),
cands AS (SELECT u.*, blob, snippet, semantic, has_value, terms, asked FROM (SELECT * FROM b1 UNION ALL SELECT * FROM b2 UNION ALL SELECT * FROM b3 UNION ALL SELECT * FROM b4) u JOIN texts USING (source_id) JOIN questions USING (question_id))"""


@query("q08_union_branches", with_views(_UNION + "\nSELECT question_id, source_type, source_id, document_id, score FROM cands", *_ALL))
def q08(spark, d):
    return candidates(spark, d).select("question_id", "source_type", "source_id", "document_id", "score")


_MERGED = _UNION + """,
merged AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, CASE source_type WHEN 'legal_fact' THEN 4 WHEN 'table_row' THEN 3 WHEN 'table' THEN 2 ELSE 1 END DESC, source_id) AS merge_rank
  FROM (SELECT * FROM (SELECT * FROM cands UNION ALL SELECT * REPLACE (score * 0.5 AS score) FROM cands) QUALIFY row_number() OVER (PARTITION BY question_id, source_type, source_id ORDER BY score DESC) = 1))"""


def _twice(spark, d) -> DataFrame:
    """Each candidate a second time with half its score, so that there is something to merge."""
    return candidates(spark, d).withColumn("score", F.explode(F.array(F.col("score"), F.col("score") * 0.5)))


def merged(spark, d) -> DataFrame:
    return retrieval.merge(_twice(spark, d))


def retrieved(spark, d) -> retrieval.Retrieval:
    """The whole retrieval for the stated questions, step by step."""
    return retrieval.Retrieval(V.questions(spark), _twice(spark, d), DRIVER, semantic=F.col("semantic"), has_value=F.col("has_value"))


@query("q09_merge_dedupe", with_views(_MERGED + "\nSELECT question_id, source_type, source_id, score, CAST(merge_rank AS INTEGER) AS merge_rank FROM merged", *_ALL))
def q09(spark, d):
    return merged(spark, d).select("question_id", "source_type", "source_id", "score", F.col("merge_rank").cast("int").alias("merge_rank"))


_FACTOR = "CASE source_type WHEN 'table_row' THEN 1.45 WHEN 'legal_fact' THEN 1.2 WHEN 'table' THEN 1.05 ELSE 0.85 END::DOUBLE"


@query("q10_type_factor", with_views(_MERGED + f"\nSELECT question_id, source_type, source_id, round(score * {_FACTOR}, 6) AS score FROM merged", *_ALL))
def q10(spark, d):
    return merged(spark, d).select("question_id", "source_type", "source_id", F.round(F.col("score") * retrieval.type_factor(F.col("source_type")), 6).alias("score"))


_NOISE = r"""(length(content) <= 40 OR lower(content) IN ('untitled') OR (length(content) <= 180 AND
  CASE WHEN len(regexp_extract_all(content, '\p{L}')) = 0 THEN 0 ELSE len(regexp_extract_all(content, '\p{Lu}')) / len(regexp_extract_all(content, '\p{L}')) END >= 0.6)
  OR (length(content) <= 220 AND (contains(lower(content), 'licen') OR contains(lower(content), 'http'))))"""


@query("q11_header_noise", with_views(f"SELECT document_id, block_order, {_NOISE} AS is_noise FROM blocks", "blocks"))
def q11(spark, d):
    return V.blocks(spark, d).select("document_id", "block_order", retrieval.header_noise(F.col("content"), T.normalize(F.col("content")), DRIVER).alias("is_noise"))


@query("q12_anchor_filters", with_views(r"""SELECT question_id, source_id,
  (CASE WHEN contains(b, 'the') THEN 1 ELSE 0 END + CASE WHEN contains(b, 'tion') THEN 2 ELSE 0 END + CASE WHEN contains(b, 'en') THEN 1 ELSE 0 END + len(list_filter(terms, lambda t: length(t) >= 4 AND contains(b, t)))) >= 2 AS documents_anchor,
  CAST(len(list_filter(terms, lambda t: length(t) >= 3 AND contains(b, t))) AS INTEGER) AS hits
FROM (SELECT source_id, lower(trim(regexp_replace(content, '\s+', ' ', 'g'))) AS b FROM blocks), questions""", "blocks", "questions"))
def q12(spark, d):
    own = V.blocks(spark, d).select("source_id", T.normalize(F.col("content")).alias("b")).crossJoin(F.broadcast(V.questions(spark)))
    return own.select("question_id", "source_id", retrieval.documents_anchor(F.col("b"), F.col("terms"), DRIVER).alias("documents_anchor"), retrieval.lexical_hits(F.col("b"), F.col("terms")).alias("hits"))


_TEMPORAL = "(contains(b, 'not later') OR contains(b, 'within') OR (regexp_matches(b, '[0-9]') AND (contains(b, 'tion') OR contains(b, 'keit') OR contains(b, 'ment'))))"
_N = lambda *ws: "(" + " + ".join(f"CASE WHEN contains(b, '{w}') THEN 1 ELSE 0 END" for w in ws) + ")"
_D, _NO, _PA = _N("that", "this"), _N("sich", "nicht"), _N("pour", "avec", "para")
_KIND = f"CASE WHEN greatest({_D}, {_NO}, {_PA}) = 0 THEN 'other' WHEN {_D} = greatest({_D}, {_NO}, {_PA}) THEN 'decision' WHEN {_NO} = greatest({_D}, {_NO}, {_PA}) THEN 'notification' ELSE 'payment' END"


@query("q13_temporal_kind", with_views(rf"SELECT source_id, {_TEMPORAL} AS is_temporal, {_KIND} AS kind, CASE WHEN contains(b, 'sich') THEN 'notification' WHEN contains(b, 'pour') THEN 'payment' WHEN contains(b, 'that') THEN 'decision' ELSE 'other' END AS asked FROM (SELECT source_id, lower(trim(regexp_replace(content, '\s+', ' ', 'g'))) AS b FROM blocks)", "blocks"))
def q13(spark, d):
    b = F.col("b")
    own = V.blocks(spark, d).select("source_id", T.normalize(F.col("content")).alias("b"))
    return own.select("source_id", retrieval.temporal(b, DRIVER).alias("is_temporal"), retrieval.candidate_kind(b, DRIVER).alias("kind"), retrieval.question_kind(b, DRIVER).alias("asked"))


_ANCHOR = "(CASE WHEN contains(b, 'the') THEN 1 ELSE 0 END + CASE WHEN contains(b, 'tion') THEN 2 ELSE 0 END + CASE WHEN contains(b, 'en') THEN 1 ELSE 0 END + len(list_filter(terms, lambda t: length(t) >= 4 AND contains(b, t)))) >= 2"
_REQUIRED = "(CASE WHEN contains(b, 'order') THEN 1 ELSE 0 END + CASE WHEN contains(b, 'urgent') THEN 1 ELSE 0 END + CASE WHEN contains(b, 'high') THEN 1 ELSE 0 END) >= 2"
_HITS = "len(list_filter(terms, lambda t: length(t) >= 3 AND contains(b, t)))"
_DUE = "semantic IN ('deadline', 'deadlines')"
_TYPED = lambda row, table, other=0: f"CASE WHEN is_row THEN {row} WHEN is_table THEN {table} ELSE {other} END::DOUBLE"
_BAD = "(semantic IN ('refusal_reasons', 'documents') AND NOT has_value OR contains(b, '@') OR contains(b, 'not specified'))"
_RERANKED = _MERGED + f""",
flat AS (SELECT *, blob AS b, score * {_FACTOR} AS base, source_type = 'block' AS is_block, source_type = 'table_row' AS is_row, source_type = 'table' AS is_table, {_NOISE.replace("content", "snippet")} OR blob = '' AS is_noise FROM merged),
told AS (SELECT * FROM flat WHERE NOT is_block OR NOT is_noise AND CASE WHEN intent = 'documents' THEN {_ANCHOR} WHEN intent IN ('deadline', 'form') THEN {_HITS} >= 1 WHEN intent IN ('rejection', 'eligibility') THEN {_HITS} >= 2 ELSE true END),
reranked AS (SELECT *, round(base + {_TYPED(0.05, 0.03)} + CASE intent
  WHEN 'documents' THEN CASE WHEN semantic = 'documents' THEN {_TYPED(0.65, 0.35)} ELSE 0 END + CASE WHEN contains(b, '@') THEN {_TYPED(-1.1, -0.9, -0.4)} ELSE 0 END
    + CASE WHEN {_REQUIRED} THEN {_TYPED(0.45, 0.25)} ELSE 0 END + CASE WHEN {_ANCHOR} THEN 0.18 ELSE 0 END::DOUBLE
  WHEN 'deadline' THEN CASE WHEN {_BAD} THEN -1.2 ELSE 0 END::DOUBLE + CASE WHEN {_DUE} THEN {_TYPED(0.45, 0.22)} ELSE 0 END + CASE WHEN has_value THEN 0.3 ELSE 0 END::DOUBLE
    + CASE WHEN {_TEMPORAL} THEN CASE WHEN is_block THEN 0.42 WHEN is_row THEN 0.22 ELSE 0.12 END WHEN is_block THEN -0.9 WHEN is_row AND NOT has_value THEN -0.6 WHEN is_table AND NOT {_DUE} THEN -0.6 ELSE 0 END::DOUBLE
    + CASE WHEN is_row AND NOT has_value AND NOT {_DUE} THEN -0.7 ELSE 0 END::DOUBLE + CASE WHEN asked <> 'other' AND {_KIND} = asked THEN 0.55 WHEN asked <> 'other' AND {_KIND} <> 'other' THEN -0.3 ELSE 0 END::DOUBLE
    + CASE WHEN asked = 'payment' AND {_KIND} = 'decision' AND NOT {_TEMPORAL} THEN -0.3 ELSE 0 END::DOUBLE
  WHEN 'rejection' THEN CASE WHEN contains(b, 'non') THEN 0.18 ELSE 0 END::DOUBLE WHEN 'eligibility' THEN CASE WHEN contains(b, 'able') THEN 0.18 ELSE 0 END::DOUBLE ELSE 0 END, 6) AS rerank_score FROM told),
ranked AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY rerank_score DESC, base DESC, is_block DESC, is_row DESC, merge_rank) - 1 AS rank FROM reranked)"""


@query("q14_rerank", with_views(_RERANKED + "\nSELECT question_id, source_type, source_id, rerank_score, CAST(rank AS INTEGER) AS rank FROM ranked", *_ALL))
def q14(spark, d):
    return retrieved(spark, d).ranked.select("question_id", "source_type", "source_id", "rerank_score", F.col("rank").cast("int").alias("rank"))


_STATS = _RERANKED + """,
stats AS (SELECT *, round(discounted + 0.6 * best + 0.12 * least(n_candidates, 4) + 0.08 * n_types, 6) AS doc_score FROM (SELECT question_id, document_id, count(*) AS n_candidates, greatest(max(rerank_score), 0) AS best, sum(rerank_score / (1 + 0.15 * rank)) AS discounted,
  count(DISTINCT source_type) AS n_types, string_agg(DISTINCT source_type, ',' ORDER BY source_type) AS types, min(rank) AS first_rank FROM ranked GROUP BY question_id, document_id))"""
#: A second priority document is for the strategies procedure, balanced, rejection and eligibility only.
_SECOND = "place = 1 OR intent NOT IN ('documents', 'deadline', 'form') AND doc_score >= greatest(0.75, 0.62 * top)"


@query("q15_document_stats", with_views(_STATS + "\nSELECT question_id, document_id, n_candidates, best, types, CAST(first_rank AS INTEGER) AS first_rank, doc_score FROM stats", *_ALL))
def q15(spark, d):
    return retrieved(spark, d).stats.select("question_id", "document_id", "n_candidates", "best", F.array_join("types", ",").alias("types"), F.col("first_rank").cast("int").alias("first_rank"), "doc_score")


_PRIORITY = _STATS + """,
prio AS (SELECT *, max(CASE WHEN place = 1 THEN doc_score END) OVER (PARTITION BY question_id) AS top FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY doc_score DESC, best DESC, n_candidates DESC, first_rank, document_id) AS place FROM stats) WHERE place <= 2)"""


@query("q16_priority_documents", with_views(_PRIORITY + "\nSELECT question_id, document_id, doc_score, CAST(place AS INTEGER) AS place FROM prio JOIN questions USING (question_id) WHERE " + _SECOND, *_ALL))
def q16(spark, d):
    return retrieved(spark, d).priority.select("question_id", "document_id", "doc_score", F.col("place").cast("int").alias("place"))


@query("q17_threshold", with_views(_PRIORITY + "\nSELECT question_id, intent, least(CASE WHEN intent IN ('documents', 'deadline', 'form') THEN 0.45 WHEN intent IN ('eligibility', 'rejection') THEN 0.4 ELSE 0.35 END::DOUBLE, greatest(0.25::DOUBLE, 0.35::DOUBLE * best)) AS threshold FROM prio JOIN questions USING (question_id) WHERE place = 1", *_ALL))
def q17(spark, d):
    first = retrieved(spark, d).priority.filter("place = 1")
    return first.select("question_id", "intent", retrieval.adaptive_threshold(F.col("intent"), F.col("best")).alias("threshold"))


_TYPE_CAP = """CASE intent WHEN 'documents' THEN CASE source_type WHEN 'table' THEN 2 WHEN 'table_row' THEN 12 ELSE 1 END WHEN 'deadline' THEN CASE source_type WHEN 'table_row' THEN 4 WHEN 'block' THEN 6 ELSE 1 END
  ELSE CASE source_type WHEN 'table' THEN 4 ELSE 5 END END"""
_DOC_CAP = "CASE intent WHEN 'documents' THEN CASE WHEN priority THEN 12 ELSE 4 END WHEN 'deadline' THEN CASE WHEN priority THEN 8 ELSE 3 END ELSE CASE WHEN priority THEN 6 ELSE 3 END END"
#: The selection step by step: a list of what is chosen so far is carried from candidate to candidate.
_SELECTED = _PRIORITY + f""",
listed AS (SELECT question_id, document_id FROM prio JOIN questions USING (question_id) WHERE {_SECOND}),
least_ AS (SELECT question_id, intent, least(CASE WHEN intent IN ('documents', 'deadline', 'form') THEN 0.45 WHEN intent IN ('eligibility', 'rejection') THEN 0.4 ELSE 0.35 END::DOUBLE, greatest(0.25::DOUBLE, 0.35::DOUBLE * best)) AS threshold FROM prio JOIN questions USING (question_id) WHERE prio.place = 1),
flagged AS (SELECT r.*, threshold, l.document_id IS NOT NULL AS priority, {_TEMPORAL} AS dated, {_KIND} AS kind, {_BAD} AS noise FROM ranked r JOIN least_ USING (question_id) LEFT JOIN listed l ON l.question_id = r.question_id AND l.document_id = r.document_id),
bucketed AS (SELECT *, CASE intent WHEN 'documents' THEN CASE WHEN priority AND is_row AND semantic = 'documents' THEN 0 WHEN priority AND is_table AND semantic = 'documents' THEN 1 WHEN priority THEN 2 ELSE 3 END
    WHEN 'deadline' THEN CASE WHEN noise THEN 9 WHEN priority AND is_block AND dated AND kind = asked AND asked <> 'other' THEN 0 WHEN priority AND is_row AND semantic = 'deadlines' AND kind = asked AND asked <> 'other' THEN 1 WHEN priority AND is_block AND dated THEN 2
    WHEN priority AND is_row AND semantic = 'deadlines' THEN 3 WHEN priority AND dated THEN 4 WHEN is_block AND dated THEN 5 WHEN is_row AND semantic = 'deadlines' THEN 6 WHEN dated THEN 7 ELSE 8 END ELSE 0 END AS bucket, CASE WHEN intent IN ('documents', 'deadline') THEN -rerank_score ELSE 0 END AS less,
  intent <> 'deadline' OR (NOT noise AND CASE WHEN is_block OR is_row THEN dated WHEN is_table THEN {_DUE} ELSE true END) AS fits FROM flagged),
ordered AS (SELECT *, {_TYPE_CAP} AS type_cap, {_DOC_CAP} AS doc_cap, row_number() OVER (PARTITION BY question_id ORDER BY bucket, less, rank) AS i FROM bucketed WHERE fits),
walk AS (SELECT question_id, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(i BIGINT, t VARCHAR, d BIGINT)[]) AS chosen FROM questions UNION ALL
  SELECT w.question_id, o.i, CASE WHEN len(w.chosen) < 12 AND o.rerank_score >= o.threshold AND len(list_filter(w.chosen, lambda x: x.t = o.source_type)) < o.type_cap AND len(list_filter(w.chosen, lambda x: x.d = o.document_id)) < o.doc_cap
    THEN list_append(w.chosen, {{'i': o.i, 't': o.source_type, 'd': o.document_id}}) ELSE w.chosen END FROM walk w JOIN ordered o ON o.question_id = w.question_id AND o.i = w.i + 1),
ends AS (SELECT question_id, list_transform(arg_max(chosen, i), lambda x: x.i) AS taken FROM walk GROUP BY question_id),
placed AS (SELECT o.*, len(taken) AS n_taken, nullif(coalesce(list_position(taken, o.i), 0), 0) AS spot, row_number() OVER (PARTITION BY o.question_id, list_contains(taken, o.i) ORDER BY o.i) AS nth FROM ordered o JOIN ends USING (question_id)),
chosen AS (SELECT * EXCLUDE (place), CASE WHEN spot IS NOT NULL THEN spot ELSE n_taken + nth END - 1 AS place FROM placed WHERE spot IS NOT NULL OR (n_taken < 3 AND nth <= 12 - n_taken)))"""[:-1]


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


@query("q18_capped_selection", _recursive(with_views(_SELECTED + "\nSELECT question_id, intent, CAST(place AS INTEGER) AS place, source_type, source_id, document_id, rerank_score AS final_score, priority, CAST(rank AS INTEGER) AS rank FROM chosen", *_ALL)))
def q18(spark, d):
    return retrieved(spark, d).selected


_QUALITY = _SELECTED + """,
per AS (SELECT question_id, count(*) AS n_items, count(DISTINCT document_id) AS n_documents, count(*) FILTER (WHERE rerank_score >= 0.75) AS n_strong, arg_min(rerank_score, place) AS top_score, arg_min(document_id, place) AS top_document FROM chosen GROUP BY 1),
shares AS (SELECT question_id, count(*) FILTER (WHERE document_id = top_document) / count(*) AS top_share FROM chosen JOIN per USING (question_id) GROUP BY 1),
leaders AS (SELECT question_id, list(doc_score ORDER BY doc_score DESC) AS l FROM stats GROUP BY 1), counted AS (SELECT question_id, count(*) AS n_priority FROM listed GROUP BY 1),
summed AS (SELECT question_id, coalesce(n_items, 0) AS n_items, coalesce(n_documents, 0) AS n_documents, top_share, coalesce(n_strong, 0) AS n_strong, top_score, coalesce(n_priority, 0) AS n_priority, coalesce(l[2] > l[1] * 0.95::DOUBLE, false) AS close
  FROM questions LEFT JOIN per USING (question_id) LEFT JOIN shares USING (question_id) LEFT JOIN leaders USING (question_id) LEFT JOIN counted USING (question_id)),
judged AS (SELECT *, CASE WHEN n_items = 0 THEN 'insufficient:no_candidates' WHEN top_score < 0.25 THEN 'insufficient:top_score_too_low' WHEN n_items = 1 THEN 'weak:single_candidate_only' WHEN n_documents > 2 AND n_priority <= 1 THEN 'weak:document_spread_too_wide'
  WHEN top_share < 0.4 AND n_documents > 2 THEN 'weak:low_document_concentration' WHEN n_strong = 0 AND top_score < 0.55 THEN 'weak:no_strong_candidates' WHEN close AND n_documents > 2 THEN 'weak:no_clear_document_leader' ELSE 'strong:ok' END AS x FROM summed)
SELECT question_id, n_items, n_documents, round(top_share, 6) AS top_share, n_strong, top_score, split_part(x, ':', 1) AS quality, split_part(x, ':', 2) AS reason FROM judged"""


@query("q19_evidence_quality", _recursive(with_views(_QUALITY, *_ALL)))
def q19(spark, d):
    return retrieved(spark, d).quality.withColumn("top_share", F.round("top_share", 6))


_IDS = ", ".join(f"coalesce(string_agg(source_id, ',' ORDER BY place) FILTER (WHERE source_type = '{t}'), '') AS {t}_ids" for t in ("legal_fact", "table_row", "table", "block"))


@query("q19b_evidence_package", _recursive(with_views(_SELECTED + f""",
seen AS (SELECT question_id, document_id, min(place) AS p FROM chosen GROUP BY 1, 2), docs AS (SELECT question_id, string_agg(CAST(document_id AS VARCHAR), ',' ORDER BY p) AS document_ids FROM seen GROUP BY 1)
SELECT question_id, n_items, legal_fact_ids, table_row_ids, table_ids, block_ids, document_ids FROM (SELECT question_id, count(*) AS n_items, {_IDS} FROM chosen GROUP BY 1) JOIN docs USING (question_id)""", *_ALL)))
def q19b(spark, d):
    out = retrieved(spark, d).package
    return out.select("question_id", F.col("n_items").cast("long").alias("n_items"), *[F.array_join(c, ",").alias(c) for c in out.columns[2:]])


_JUDGED, _, _ = _QUALITY.rpartition("\nSELECT question_id, n_items")
_COUNTED = lambda name, of: f"(SELECT count(*) FROM {of} c WHERE c.question_id = q.question_id) AS {name}"
_CODES = "CASE intent WHEN 'documents' THEN 'documents_priority' WHEN 'deadline' THEN 'deadlines_priority' WHEN 'rejection' THEN 'rejection_priority' WHEN 'form' THEN 'forms_priority' WHEN 'eligibility' THEN 'eligibility_priority' WHEN 'procedure' THEN 'procedure_balanced' ELSE 'balanced_default' END"


@query("q19c_package_metrics", _recursive(with_views(_JUDGED + f""",
tops AS (SELECT question_id, document_id AS top FROM prio WHERE place = 1),
scored AS (SELECT question_id, list(rerank_score ORDER BY place) AS scores, count(*) FILTER (WHERE source_type = 'legal_fact') AS n_legal_fact, count(*) FILTER (WHERE source_type = 'table_row') AS n_table_row, count(*) FILTER (WHERE source_type = 'table') AS n_table,
  count(*) FILTER (WHERE source_type = 'block') AS n_block, round(count(*) FILTER (WHERE document_id = tops.top) / count(*), 4) AS share FROM chosen JOIN tops USING (question_id) GROUP BY 1)
SELECT q.question_id, {_CODES} AS strategy_code, 2 * {_COUNTED('n_raw', 'cands')[: -len(" AS n_raw")]} AS n_raw, {_COUNTED('n_merged', 'merged')}, {_COUNTED('n_reranked', 'ranked')}, j.n_items AS n_final, coalesce(n_legal_fact, 0) AS n_legal_fact, coalesce(n_table_row, 0) AS n_table_row, coalesce(n_table, 0) AS n_table, coalesce(n_block, 0) AS n_block,
  j.n_documents, {_COUNTED('n_documents_before', 'stats')}, j.n_strong, j.n_priority, coalesce(round(CAST(scores[1] AS DECIMAL(18, 6)), 4), 0)::DOUBLE AS top_candidate_score, coalesce(round(CAST(scores[2] AS DECIMAL(18, 6)), 4), 0)::DOUBLE AS second_candidate_score, coalesce(round(CAST(l[1] AS DECIMAL(18, 6)), 4), 0)::DOUBLE AS top_document_score, coalesce(round(CAST(l[2] AS DECIMAL(18, 6)), 4), 0)::DOUBLE AS second_document_score,
  coalesce(share, 0) AS top_document_share, (SELECT string_agg(CAST(p.document_id AS VARCHAR), ',' ORDER BY p.place) FROM prio p JOIN listed USING (question_id, document_id) WHERE p.question_id = q.question_id) AS priority_document_ids, split_part(x, ':', 1) AS evidence_quality, split_part(x, ':', 2) AS guard_reason
FROM questions q JOIN judged j USING (question_id) LEFT JOIN scored USING (question_id) LEFT JOIN leaders USING (question_id)""", *_ALL)))
def q19c(spark, d):
    return retrieved(spark, d).metrics.withColumn("priority_document_ids", F.array_join("priority_document_ids", ","))


# ---------------------------------------------------------------- vectors

_VEC = """SELECT query_id, vec_id, similarity, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM
  (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS similarity FROM embeddings v, embeddings q WHERE q.vec_id IN ({ids}))) WHERE rank <= 20"""


def _vectors(ids):
    def f(spark, d):
        e = V.table(spark, d, "embeddings").select("vec_id", "embedding")
        return vector.vector_top_k(e, e.filter(F.col("vec_id").isin(*ids)).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))).withColumn("rank", F.col("rank").cast("int"))

    return f


query("q20_vector_top_k", _VEC.format(ids="7"))(_vectors([7]))
query("q21_vector_batch", _VEC.format(ids="1, 17, 42, 99, 256"))(_vectors([1, 17, 42, 99, 256]))


# ---------------------------------------------------------------- feedback

_SUM = "sums AS (SELECT answer_id, count(*) AS n_votes, avg(score) AS avg_score, count(*) FILTER (WHERE score <= 2) AS n_low, min(submitted_at) AS first_at, max(submitted_at) AS last_at FROM votes GROUP BY answer_id),\nfull_sums AS (SELECT a.answer_id, coalesce(n_votes, 0) AS n_votes, avg_score, coalesce(n_low, 0) AS n_low, first_at, last_at, a.n % 2 = 0 AS ok FROM (SELECT i AS answer_id, i AS n FROM range(0, 210) r(i)) a LEFT JOIN sums USING (answer_id))"


def _summary(spark, d):
    ids = spark.range(0, 210).withColumnRenamed("id", "answer_id")
    return feedback.summary(ids, V.votes(spark, d)).withColumn("ok", F.col("answer_id") % 2 == 0)


@query("q22_feedback_summary", with_views(_SUM + "\nSELECT answer_id, n_votes, round(avg_score, 6) AS avg_score, n_low, first_at, last_at FROM full_sums", "votes"))
def q22(spark, d):
    return _summary(spark, d).select("answer_id", "n_votes", F.round("avg_score", 6).alias("avg_score"), "n_low", "first_at", "last_at")


@query("q23_vote_once", with_views("SELECT vote_id, session_id, answer_id, row_number() OVER (PARTITION BY session_id, answer_id ORDER BY submitted_at, vote_id) = 1 AS accepted FROM votes", "votes"))
def q23(spark, d):
    return feedback.votes_once(V.votes(spark, d)).select("vote_id", "session_id", "answer_id", "accepted")


_RSCORE = "CASE WHEN avg_score IS NULL THEN 0 ELSE round(greatest(least(0.4 * (CASE WHEN ok THEN 1 ELSE 0 END)::DOUBLE + 0.2 * least(n_votes / 5.0::DOUBLE, 1) + 0.3 * greatest(least((avg_score - 1) / 4.0::DOUBLE, 1), 0) + 0.1 * greatest(1 - n_low / n_votes, 0), 1), 0), 4) END::DOUBLE"


@query("q24_reuse_score", with_views(_SUM + f"\nSELECT answer_id, {_RSCORE} AS reuse_score FROM full_sums", "votes"))
def q24(spark, d):
    return _summary(spark, d).select("answer_id", feedback.reuse_score(F.col("ok"), F.col("n_votes"), F.col("avg_score"), F.col("n_low")).alias("reuse_score"))


@query("q25_reuse_status", with_views(_SUM + f""",
st AS (SELECT *, {_RSCORE} AS rs, answer_id % 17 <> 0 AS allowed, CASE WHEN answer_id % 19 = 0 THEN 'safe_no_answer' ELSE 'grounded_narrative' END AS mode FROM full_sums)
SELECT answer_id, split_part(x, ':', 1) AS status, nullif(split_part(x, ':', 2), '') AS reason FROM (SELECT answer_id, CASE WHEN NOT allowed THEN 'blocked:answer_event_reuse_not_allowed' WHEN mode = 'safe_no_answer' THEN 'blocked:safe_no_answer_not_reusable'
  WHEN NOT ok THEN 'blocked:validation_status_not_passed' WHEN n_votes < 3 THEN 'needs_revalidation:insufficient_feedback_count' WHEN avg_score IS NULL THEN 'needs_revalidation:avg_feedback_unavailable' WHEN avg_score < 4.2 THEN 'blocked:avg_feedback_below_threshold'
  WHEN n_low / n_votes > 0.2 THEN 'blocked:negative_feedback_ratio_too_high' WHEN rs < 0.8 THEN 'needs_revalidation:reuse_score_below_threshold' ELSE 'eligible:' END AS x FROM st)""", "votes"))
def q25(spark, d):
    own = _summary(spark, d)
    rs = feedback.reuse_score(F.col("ok"), F.col("n_votes"), F.col("avg_score"), F.col("n_low"))
    s = feedback.reuse_status(F.col("answer_id") % 17 != 0, F.when(F.col("answer_id") % 19 == 0, "safe_no_answer").otherwise("grounded_narrative"), F.when(F.col("ok"), "passed").otherwise("failed"), F.col("ok"), F.col("ok"), F.col("n_votes"), F.col("avg_score"), F.col("n_low"), rs)
    return own.select("answer_id", s["status"].alias("status"), s["reason"].alias("reason"))


def _daily_sql(times: str) -> str:
    return with_views(f"""per AS (SELECT answer_id, count(*) AS nv, sum(score) AS ss, count(*) FILTER (WHERE score <= 2) AS nl FROM votes GROUP BY answer_id)
SELECT strftime(created_at, '%Y-%m-%d') AS day, channel, intent, measure_code, CAST(sum({times}) AS BIGINT) AS total_answers, CAST(coalesce(sum(nv), 0) AS BIGINT) AS total_feedback, round(sum(ss) / sum(nv), 6) AS avg_score,
  CAST(sum(CASE WHEN mode = 'reused_answer' THEN {times} ELSE 0 END) AS BIGINT) AS reused_answers, CAST(coalesce(sum(nl), 0) AS BIGINT) AS low_rated, CAST(sum(CASE WHEN validation_status = 'failed' THEN {times} ELSE 0 END) AS BIGINT) AS failed_validation
FROM answers a LEFT JOIN per ON per.answer_id = a.slot GROUP BY ALL""", "votes", "answers")


def _daily(as_written):
    def f(spark, d):
        out = feedback.quality_daily(V.answers(spark, d).withColumn("answer_id", F.col("slot")), V.votes(spark, d), as_written=as_written)
        return out.withColumn("day", F.col("day").cast("string")).withColumn("avg_score", F.round("avg_score", 6)).withColumns({c: F.col(c).cast("long") for c in ("total_answers", "total_feedback", "reused_answers", "low_rated", "failed_validation")})

    return f


query("q26_quality_daily", _daily_sql("1"))(_daily(False))
query("q26b_quality_daily_as_written", _daily_sql("greatest(coalesce(nv, 0), 1)"))(_daily(True))


@query("q27_session_stats", with_views("""a AS (SELECT session_id, count(*) AS n FROM answers WHERE mode <> 'safe_no_answer' GROUP BY 1), v AS (SELECT session_id, count(*) AS n, max(submitted_at) AS last_vote FROM votes GROUP BY 1)
SELECT coalesce(a.session_id, v.session_id) AS session_id, coalesce(a.n, 0) AS n_eligible, coalesce(v.n, 0) AS n_votes, last_vote FROM a FULL JOIN v ON a.session_id = v.session_id""", "votes", "answers"))
def q27(spark, d):
    return feedback.session_stats(V.answers(spark, d), V.votes(spark, d))


def _events(spark, d):
    return V.table(spark, d, "events").select("event_id", F.col("user_id").alias("session_id"), F.col("ts").alias("at"), (F.col("event_type") == "purchase").alias("is_vote"), F.col("value").alias("value"), "event_type")


_EV = "ev AS (SELECT event_id, user_id AS session_id, ts AS tm, event_type = 'purchase' AS is_vote, value, event_type FROM events), "
_PLACED = "placed AS (SELECT *, row_number() OVER w AS place, max(CASE WHEN is_vote THEN tm END) OVER (PARTITION BY session_id ORDER BY tm, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_vote, count(*) FILTER (WHERE is_vote) OVER w AS n_votes FROM ev WINDOW w AS (PARTITION BY session_id ORDER BY tm, event_id))"


@query("q28_every_n", "WITH " + _EV + _PLACED + " SELECT event_id, CAST(place AS INTEGER) AS place, place % 5 = 0 AS is_nth FROM placed")
def q28(spark, d):
    return feedback.every_n(_events(spark, d), 5).select("event_id", F.col("place").cast("int").alias("place"), "is_nth")


@query("q29_cooldown", "WITH " + _EV + _PLACED + " SELECT event_id, last_vote, coalesce(tm >= last_vote + INTERVAL 30 MINUTE, true) AS cooldown_ok FROM placed")
def q29(spark, d):
    return feedback.cooldown(_events(spark, d), 30).select("event_id", "last_vote", "cooldown_ok")


@query("q30_sampling", "WITH " + _EV + _PLACED + """ SELECT event_id, CASE WHEN event_type = 'error' THEN 'answer_mode_not_eligible' WHEN event_type = 'view' THEN 'intent_excluded' WHEN value < 5 THEN 'confidence_below_threshold' WHEN n_votes >= 20 THEN 'session_feedback_limit_reached'
  WHEN NOT coalesce(tm >= last_vote + INTERVAL 30 MINUTE, true) THEN 'cooldown_active' WHEN event_type = 'signup' AND value > 40 THEN 'priority_reused_answer' WHEN event_type = 'purchase' THEN 'priority_intent' WHEN place % 5 = 0 THEN 'every_n_answers_rule' ELSE 'not_selected_by_sampling_rule' END AS decision FROM placed""")
def q30(spark, d):
    own = feedback.cooldown(feedback.every_n(_events(spark, d), 5), 30)
    w = Window.partitionBy("session_id").orderBy("at", "event_id")
    own = own.withColumn("n_votes", F.count_if("is_vote").over(w))
    mode = F.when(F.col("event_type") == "error", "safe_no_answer").when((F.col("event_type") == "signup") & (F.col("value") > 40), "reused_answer").otherwise("grounded_narrative")
    code = feedback.sampling_decision(enabled=F.lit(True), mode=mode, intent=F.col("event_type"), confidence=F.col("value"), n_votes=F.col("n_votes"), cooldown_ok=F.col("cooldown_ok"), is_nth=F.col("is_nth"), excluded=("view",), priority=("purchase",), max_votes=20, min_confidence=5.0)
    return own.select("event_id", code.alias("decision"))


# ---------------------------------------------------------------- reuse

_PAIRS = r"""q AS (SELECT item_id AS question_id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS norm, list_distinct(string_split(norm, ' ')) AS a FROM benchmark),
h AS (SELECT doc_id AS past_id, lower(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))) AS past, list_distinct(string_split(past, ' ')) AS b FROM documents),
shared AS (SELECT question_id, past_id, norm, past, len(a) + len(b) AS n, CASE WHEN least(len(a), len(b)) >= 0.6 * greatest(len(a), len(b)) THEN len(list_intersect(a, b)) ELSE 0 END AS c FROM q, h),
sims AS (SELECT question_id, past_id, norm, past, c / (n - c) AS j FROM shared),
pairs AS (SELECT question_id, past_id, CASE WHEN norm = '' OR past = '' THEN 0 WHEN norm = past THEN 1 WHEN contains(norm, past) OR contains(past, norm) THEN 0.97 WHEN j >= 0.8 THEN 0.95 WHEN j >= 0.7 THEN 0.92 WHEN j >= 0.6 THEN 0.9 ELSE round(j, 4) END::DOUBLE AS similarity FROM sims),
kept AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY similarity DESC, past_id) AS place FROM pairs WHERE similarity >= 0.9)"""


def _similar(spark, d):
    q = V.table(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), "text")
    h = V.table(spark, d, "documents").select(F.col("doc_id").alias("past_id"), "text")
    return reuse.similar(q, h)


@query("q31_similar_history", "WITH " + _PAIRS + " SELECT question_id, past_id, similarity, CAST(place AS INTEGER) AS place FROM kept WHERE place <= 20")
def q31(spark, d):
    return _similar(spark, d).withColumn("place", F.col("place").cast("int"))


_SIG = "round(least((CASE WHEN a.p_type = b.p_type THEN 0.5 ELSE 0 END + CASE WHEN a.m = b.m THEN 0.3 WHEN a.m IS NULL AND b.m IS NULL THEN 0.1 ELSE 0 END + CASE WHEN a.s = b.s THEN 0.2 WHEN a.s IS NULL AND b.s IS NULL THEN 0.05 ELSE 0 END)::DOUBLE, 1), 4)"


@query("q32_signature", f"WITH p AS (SELECT p_partkey, p_type, CASE WHEN p_size % 3 <> 0 THEN p_brand END AS m, CASE WHEN p_size % 2 = 0 THEN p_size END AS s FROM part) SELECT a.p_partkey AS a_key, b.p_partkey AS b_key, {_SIG} AS signature, a.p_type = b.p_type AND (a.m IS NULL OR coalesce(a.m = b.m, false)) AND (a.s IS NULL OR coalesce(a.s = b.s, false)) AS matches FROM p a JOIN p b ON b.p_partkey = a.p_partkey + 1")
def q32(spark, d):
    p = V.table(spark, d, "part").select("p_partkey", "p_type", F.when(F.col("p_size") % 3 != 0, F.col("p_brand")).alias("m"), F.when(F.col("p_size") % 2 == 0, F.col("p_size")).alias("s"))
    a, b = p.alias("a"), p.alias("b")
    six = [F.col(x) for x in ("a.p_type", "b.p_type", "a.m", "b.m", "a.s", "b.s")]
    return a.join(b, F.col("b.p_partkey") == F.col("a.p_partkey") + 1).select(F.col("a.p_partkey").alias("a_key"), F.col("b.p_partkey").alias("b_key"), reuse.signature_score(*six).alias("signature"), reuse.signature_matches(*six).alias("matches"))


def _evidence(spark, d):
    """Evidence of orders as answers: lines point to documents, some to two things, hashes by number."""
    reg = V.registry(spark, d).select(F.col("document_id").alias("reg_id"), "content_hash")
    l = V.rows(spark, d).join(reg, F.col("document_id") == F.col("reg_id"), "left")
    k = F.col("row_order")
    return l.select(
        F.col("order_key").alias("answer_id"), k.alias("evidence_order"), F.when(k != 6, F.when(F.col("l_returnflag") == "R", F.col("document_id") + 1_000_000).otherwise(F.col("document_id"))).alias("document_id"),
        F.when(k == 5, F.lit("b")).alias("block_id"), F.lit(None).cast("string").alias("table_id"), F.lit(None).cast("string").alias("table_row_id"), F.lit(None).cast("string").alias("legal_fact_id"),
        F.when(k <= 3, F.when(k == 2, F.concat("content_hash", F.lit("x"))).otherwise(F.col("content_hash"))).alias("document_content_hash"), F.when(k == 4, F.lit("file")).alias("document_file_hash"))


_EVID = """evid AS (SELECT order_key AS answer_id, row_order AS k, CASE WHEN row_order <> 6 THEN CASE WHEN l_returnflag = 'R' THEN r.document_id + 1000000 ELSE r.document_id END END AS document_id, CASE WHEN row_order = 5 THEN 'b' END AS block_id,
  CASE WHEN row_order <= 3 THEN CASE WHEN row_order = 2 THEN content_hash || 'x' ELSE content_hash END END AS ch, CASE WHEN row_order = 4 THEN 'file' END AS fh FROM rws r LEFT JOIN registry g ON g.document_id = r.document_id)"""


@query("q33_freshness", with_views(_EVID + """,
items AS (SELECT e.answer_id, CASE WHEN g.document_id IS NULL THEN 'nf' WHEN g.status <> 'active' THEN 'na' WHEN e.ch IS NOT NULL THEN CASE WHEN g.content_hash IS DISTINCT FROM e.ch THEN 'c' END WHEN e.fh IS NOT NULL THEN 'f' ELSE 'm' END AS why FROM evid e LEFT JOIN registry g ON g.document_id = e.document_id WHERE e.document_id IS NOT NULL),
per AS (SELECT answer_id, count(*) AS checked, count(why) AS mismatched FROM items GROUP BY 1)
SELECT o_orderkey AS answer_id, coalesce(checked, 0) AS checked, coalesce(mismatched, 0) AS mismatched, coalesce(checked, 0) > 0 AND coalesce(mismatched, 0) = 0 AS is_fresh,
  CASE WHEN coalesce(checked, 0) = 0 THEN 'no_document_bound_evidence' WHEN mismatched > 0 THEN 'freshness_check_failed' END AS block_reason FROM orders LEFT JOIN per ON answer_id = o_orderkey""", "registry", "rows"))
def q33(spark, d):
    answers = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("answer_id"))
    return reuse.freshness(answers, _evidence(spark, d), V.registry(spark, d).withColumn("file_hash", F.lit(None).cast("string")))


@query("q34_integrity", with_views(_EVID + """,
per AS (SELECT answer_id, count(*) AS n, count(*) FILTER (WHERE (document_id IS NOT NULL)::INT + (block_id IS NOT NULL)::INT <> 1) AS bad, count(*) FILTER (WHERE document_id IS NOT NULL OR block_id IS NOT NULL) AS strong FROM evid GROUP BY 1),
o AS (SELECT o_orderkey AS answer_id, CASE WHEN o_orderkey % 10 <> 0 THEN 'h' END AS hash, coalesce(n, 0) AS n, coalesce(bad, 0) AS bad, coalesce(strong, 0) AS strong FROM orders LEFT JOIN per ON answer_id = o_orderkey)
SELECT answer_id, n AS n_items, bad AS n_invalid, CASE WHEN n = 0 THEN 'no_evidence_items' WHEN hash IS NULL THEN 'missing_evidence_hash' WHEN bad > 0 THEN 'invalid_evidence_items' WHEN strong = 0 THEN 'no_strong_evidence_items' END AS block_reason,
  n > 0 AND hash IS NOT NULL AND bad = 0 AND strong > 0 AS is_valid FROM o""", "registry", "rows"))
def q34(spark, d):
    answers = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("answer_id"), F.when(F.col("o_orderkey") % 10 != 0, "h").alias("evidence_hash"))
    return reuse.integrity(answers, _evidence(spark, d))


_FLAGS = "flagged AS (SELECT *, past_id % 3 <> 0 AS signature_ok, past_id % 5 <> 0 AS is_fresh, past_id % 7 <> 0 AS is_valid, (past_id % 10) / 10.0::DOUBLE AS signature, (past_id % 4) / 4.0::DOUBLE AS reuse_score, 1 + past_id % 5 AS avg_score, past_id % 6 AS n_votes FROM kept WHERE place <= 20)"


def _flagged(spark, d):
    p = F.col("past_id")
    return _similar(spark, d).withColumns({"signature_ok": p % 3 != 0, "is_fresh": p % 5 != 0, "is_valid": p % 7 != 0, "signature": (p % 10) / 10.0, "reuse_score": (p % 4) / 4.0, "avg_score": 1 + p % 5, "n_votes": p % 6})


@query("q35_reuse_decision", "WITH " + _PAIRS + ", " + _FLAGS + """,
per AS (SELECT question_id, count(*) AS n, count(*) FILTER (WHERE signature_ok) AS c0, count(*) FILTER (WHERE signature_ok AND is_fresh) AS c1, count(*) FILTER (WHERE signature_ok AND is_fresh AND is_valid) AS c2 FROM flagged GROUP BY 1),
best AS (SELECT question_id, past_id FROM flagged WHERE signature_ok AND is_fresh AND is_valid QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY similarity DESC, signature DESC, reuse_score DESC, avg_score DESC, n_votes DESC, past_id) = 1)
SELECT item_id AS question_id, CASE WHEN coalesce(n, 0) = 0 THEN 'no_candidates_found' WHEN c0 = 0 THEN 'signature_mismatch' WHEN c1 = 0 THEN 'all_candidates_stale' WHEN c2 = 0 THEN 'evidence_mismatch' ELSE 'reuse_allowed' END AS decision, coalesce(b.past_id, -1) AS past_id
FROM benchmark LEFT JOIN per ON per.question_id = item_id LEFT JOIN best b ON b.question_id = item_id""")
def q35(spark, d):
    return reuse.decide(V.table(spark, d, "benchmark").select(F.col("item_id").alias("question_id")), _flagged(spark, d)).withColumn("past_id", F.coalesce("past_id", F.lit(-1)))


@query("q36_decision_confidence", "WITH " + _PAIRS + ", " + _FLAGS + " SELECT question_id, past_id, round(least(greatest(0.35 * similarity + 0.2 * signature + 0.2 * reuse_score + 0.1 * least(greatest((avg_score - 1) / 4.0::DOUBLE, 0), 1) + 0.1 * is_fresh::INT + 0.05 * is_valid::INT, 0), 1), 4)::DOUBLE AS confidence FROM flagged")
def q36(spark, d):
    return _flagged(spark, d).select("question_id", "past_id", reuse.decision_confidence(F.col("similarity"), F.col("signature"), F.col("reuse_score"), F.col("avg_score").cast("double"), F.col("is_fresh"), F.col("is_valid")).alias("confidence"))


# ---------------------------------------------------------------- ingestion

_CHUNKS = r"""WITH RECURSIVE par AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS p FROM documents),
walk AS (SELECT doc_id, 0 AS i, CAST([] AS VARCHAR[]) AS done, '' AS open_, 0 AS n FROM par UNION ALL
  SELECT w.doc_id, w.i + 1, CASE WHEN w.open_ <> '' AND w.n + length(p[w.i + 1]) > 1200 THEN list_append(w.done, w.open_) ELSE w.done END,
    CASE WHEN w.open_ = '' THEN p[w.i + 1] WHEN w.n + length(p[w.i + 1]) > 1200 THEN right(w.open_, 200) || chr(10) || p[w.i + 1] ELSE w.open_ || chr(10) || p[w.i + 1] END,
    CASE WHEN w.open_ <> '' AND w.n + length(p[w.i + 1]) > 1200 THEN least(200, length(w.open_)) ELSE w.n END + length(p[w.i + 1]) FROM walk w JOIN par USING (doc_id) WHERE w.i < len(p)),
ends AS (SELECT doc_id, arg_max(CASE WHEN open_ = '' THEN done ELSE list_append(done, open_) END, i) AS cs FROM walk GROUP BY doc_id)
SELECT doc_id AS document_id, CAST(k - 1 AS INTEGER) AS chunk_index, cs[k] AS content FROM (SELECT doc_id, cs, unnest(range(1, len(cs) + 1)) AS k FROM ends)"""


@query("q37_chunks", _CHUNKS)
def q37(spark, d):
    return ingest.chunks(V.table(spark, d, "documents"), key="doc_id")


@query("q37b_chunks_as_written", r"SELECT doc_id AS document_id, 0 AS chunk_index, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS content FROM documents WHERE trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) <> ''")
def q37b(spark, d):
    return ingest.chunks(V.table(spark, d, "documents"), key="doc_id", as_written=True)


@query("q38_normalize_hash", r"SELECT doc_id, sha256(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))) AS text_hash, sha256(coalesce(text, '')) AS content_hash, length(lower(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')))) AS n FROM documents")
def q38(spark, d):
    t = F.col("text")
    return V.table(spark, d, "documents").select("doc_id", T.text_hash(t).alias("text_hash"), T.content_hash(t).alias("content_hash"), F.char_length(T.normalize(t)).cast("long").alias("n"))


@query("q39_language", "SELECT doc_id, CASE WHEN c > l THEN 'ru' WHEN l > c THEN 'en' END AS language FROM (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '\\p{Cyrillic}')) AS c, len(regexp_extract_all(coalesce(text, ''), '[A-Za-z]')) AS l FROM documents)")
def q39(spark, d):
    return V.table(spark, d, "documents").select("doc_id", T.language(F.col("text")).alias("language"))


_QC = r"""b AS (SELECT document_id, count(*) AS n_blocks, sum(length(content)) AS chars FROM blocks GROUP BY 1),
m AS (SELECT doc_id AS document_id, length(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))) AS text_chars, coalesce(n_blocks, 0) AS n_blocks, coalesce(n_blocks, 0) AS n_meaningful, CASE WHEN n_blocks > 0 THEN 0 ELSE 1 END::DOUBLE AS empty_ratio,
  CASE WHEN n_blocks > 0 THEN round(chars / n_blocks, 2) ELSE 0 END::DOUBLE AS avg_block FROM documents LEFT JOIN b ON document_id = doc_id)"""


def _metrics(spark, d):
    docs = V.table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), "text")
    return ingest.qc_metrics(docs, V.blocks(spark, d))


@query("q40_qc_metrics", with_views(_QC + "\nSELECT document_id, text_chars, n_blocks, n_meaningful, empty_ratio, avg_block FROM m", "blocks"))
def q40(spark, d):
    return _metrics(spark, d).select("document_id", F.col("text_chars").cast("long").alias("text_chars"), "n_blocks", "n_meaningful", "empty_ratio", "avg_block")


@query("q41_qc_verdict", with_views(_QC + """,
e AS (SELECT *, list_filter([CASE WHEN text_chars = 0 THEN 'normalized_text_empty' END, CASE WHEN text_chars < 200 THEN 'normalized_text_too_short' END, CASE WHEN n_blocks = 0 THEN 'blocks_missing' END, CASE WHEN n_blocks < 3 THEN 'blocks_count_too_low' END,
  CASE WHEN n_meaningful < 2 THEN 'meaningful_blocks_count_too_low' END, CASE WHEN empty_ratio > 0.3 THEN 'empty_block_ratio_too_high' END], lambda x: x IS NOT NULL) AS errors FROM m)
SELECT document_id, array_to_string(errors, ',') AS errors, len(errors) = 0 AS passed, errors[1] AS error_code FROM e""", "blocks"))
def q41(spark, d):
    return ingest.qc_verdict(_metrics(spark, d)).select("document_id", F.array_join("errors", ",").alias("errors"), "passed", "error_code")


@query("q42_duplicate_files", with_views("SELECT document_id, content_hash IN (SELECT content_hash FROM registry WHERE status = 'active') AS is_duplicate FROM registry WHERE status = 'replaced'", "registry"))
def q42(spark, d):
    reg = V.registry(spark, d).withColumnRenamed("content_hash", "file_hash")
    files = reg.filter("status = 'replaced'")
    dup = ingest.duplicate_files(files, reg).select("document_id", F.lit(True).alias("is_duplicate"))
    return dup.unionByName(ingest.new_files(files, reg).select("document_id", F.lit(False).alias("is_duplicate")))


_PLAN = """act AS (SELECT doc_uid_base AS u, list(document_id ORDER BY document_id) AS ids, list(DISTINCT content_hash) AS hs FROM registry WHERE status = 'active' AND document_id % 2 = 0 GROUP BY 1),
inc AS (SELECT document_id AS doc_key, CASE WHEN document_id % 9 <> 1 THEN doc_uid_base END AS uid, content_hash, CASE WHEN document_id % 4 = 1 THEN 'd' END AS rev FROM registry WHERE document_id % 2 = 1),
pl AS (SELECT doc_key, CASE WHEN uid IS NULL THEN 'insert_new_active_unbound' WHEN ids IS NULL THEN 'insert_new_active' WHEN list_contains(hs, inc.content_hash) THEN 'conflict' WHEN rev IS NULL THEN 'replace_active_revision_without_revision_date' ELSE 'replace_active_revision' END AS mode, ids FROM inc LEFT JOIN act ON u = uid)"""


def _plan(spark, d):
    reg = V.registry(spark, d)
    inc = reg.filter("document_id % 2 = 1").select(F.col("document_id").alias("doc_key"), F.when(F.col("document_id") % 9 != 1, F.col("doc_uid_base")).alias("doc_uid_base"), "content_hash", F.when(F.col("document_id") % 4 == 1, "d").alias("revision_date"))
    return publish.publication_plan(inc, reg.filter("document_id % 2 = 0"))


@query("q43_publication_plan", with_views(_PLAN + "\nSELECT doc_key, mode, CASE WHEN mode LIKE 'replace%' THEN len(ids) ELSE 0 END AS n_replaced FROM pl", "registry"))
def q43(spark, d):
    return _plan(spark, d).select("doc_key", "mode", "n_replaced")


@query("q44_replace_revisions", with_views(_PLAN + """,
gone AS (SELECT id, min(doc_key) AS by_ FROM (SELECT doc_key, unnest(ids) AS id FROM pl WHERE mode LIKE 'replace%') GROUP BY 1)
SELECT document_id, CASE WHEN by_ IS NOT NULL THEN 'replaced' ELSE status END AS status, coalesce(by_, -1) AS replaced_by FROM registry LEFT JOIN gone ON id = document_id WHERE document_id % 2 = 0""", "registry"))
def q44(spark, d):
    return publish.replace_revisions(V.registry(spark, d).filter("document_id % 2 = 0"), _plan(spark, d), F.current_timestamp()).select("document_id", "status", F.coalesce("replaced_by", F.lit(-1)).alias("replaced_by"))


@query("q45_carry_forward", with_views("SELECT source_id, coalesce(last_value(CASE WHEN l_returnflag = 'R' THEN 's' || row_order END IGNORE NULLS) OVER (PARTITION BY table_id ORDER BY row_order, source_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'unknown') AS section FROM rws", "rows"))
def q45(spark, d):
    own = V.rows(spark, d).withColumn("at", F.struct("row_order", "source_id"))
    return ingest.carry_forward(own, F.when(F.col("l_returnflag") == "R", F.concat(F.lit("s"), F.col("row_order"))), order="at").select("source_id", "section")


@query("q45b_context_before", with_views("SELECT document_id, block_order, array_to_string(list_filter(list_slice(c, greatest(len(c) - 4, 1), len(c)), lambda x: true), '|') AS context FROM (SELECT document_id, block_order, coalesce(list(content) FILTER (WHERE block_type = 'paragraph' AND length(content) >= 2) OVER (PARTITION BY document_id ORDER BY block_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), []) AS c FROM blocks)", "blocks"))
def q45b(spark, d):
    items = V.blocks(spark, d).select("document_id", F.col("block_order").alias("item_order"), F.col("block_type").alias("kind"), F.col("content").alias("text"))
    return ingest.context_before(items).select("document_id", F.col("item_order").alias("block_order"), F.array_join("context", "|").alias("context"))


@query("q45c_unique_keys", "SELECT p_partkey, CASE WHEN n > 1 THEN p_brand || '_' || n ELSE p_brand END AS key FROM (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_type, p_brand ORDER BY p_partkey) AS n FROM part)")
def q45c(spark, d):
    return ingest.unique_keys(V.table(spark, d, "part").select(F.col("p_type").alias("table_id"), F.col("p_partkey").alias("idx"), F.col("p_brand").alias("key"))).select(F.col("idx").alias("p_partkey"), "key")


# ---------------------------------------------------------------- generation

@query("q46_items_merge", "SELECT p_type, p_size, arg_min(p_name, (length(p_name), lower(p_name), p_name)) AS name, count(*) AS n_sources, string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY p_partkey) AS row_ids FROM part GROUP BY 1, 2")
def q46(spark, d):
    items = V.table(spark, d, "part").select("p_type", "p_size", F.col("p_name").alias("name"), F.col("p_partkey").cast("string").alias("row_id"), F.col("p_partkey").alias("place"))
    return generate.merge_items(items, ["p_type", "p_size"]).select("p_type", "p_size", "name", "n_sources", F.array_join("row_ids", ",").alias("row_ids"))


@query("q47_best_deadlines", with_views("""i AS (SELECT document_id AS question_id, l_returnflag AS value, l_linestatus AS scope, 'k' || (row_order % 2) AS kind, (order_key % 97) / 97.0::DOUBLE AS score, row_order / 10.0::DOUBLE AS confidence, source_id FROM rws)
SELECT question_id, value, scope, kind, source_id, max_conf AS confidence, n AS n_sources FROM (SELECT *, row_number() OVER (PARTITION BY question_id, value, scope, kind ORDER BY score DESC, confidence DESC, source_id) AS p, max(confidence) OVER (PARTITION BY question_id, value, scope, kind) AS max_conf, count(*) OVER (PARTITION BY question_id, value, scope, kind) AS n FROM i) WHERE p = 1""", "rows"))
def q47(spark, d):
    items = V.rows(spark, d).select(F.col("document_id").alias("question_id"), F.col("l_returnflag").alias("value"), F.col("l_linestatus").alias("scope"), F.concat(F.lit("k"), F.col("row_order") % 2).alias("kind"), (F.col("order_key") % 97 / F.lit(97.0)).alias("score"), (F.col("row_order") / F.lit(10.0)).alias("confidence"), F.lit("table_row").alias("source_type"), "source_id")
    return generate.best_deadlines(items).select("question_id", "value", "scope", "kind", "source_id", "confidence", "n_sources")


@query("q48_citations", with_views(_RERANKED + """
SELECT question_id, source_id, CAST(cited AS INTEGER) AS cited FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY rank) AS cited FROM (SELECT *, row_number() OVER (PARTITION BY question_id, source_type, blob ORDER BY rank) AS n FROM ranked) WHERE n = 1) WHERE cited <= 5""", *_ALL))
def q48(spark, d):
    own = retrieved(spark, d).ranked.withColumn("place", F.col("rank")).withColumn("display_label", F.col("source_type")).withColumn("citation_text", F.col("blob"))
    return generate.citations(own).select("question_id", "source_id", F.col("cited").cast("int").alias("cited"))


_CONF = "CASE WHEN mode = 'safe_no_answer' THEN CASE quality WHEN 'insufficient' THEN 0.2 WHEN 'weak' THEN 0.28 ELSE 0.35 END ELSE round(least(greatest(0.25 * least(n / 8.0, 1) + 0.18 * det + 0.15 * sem + 0.12 * CASE WHEN mode = 'direct_structured' THEN 0.9 ELSE 0.8 END + 0.1 * least(strong / 4.0, 1) + 0.1 * least(greatest(top, 0), 1) + 0.05 * least(greatest(share, 0), 1) + 0.05 * CASE quality WHEN 'strong' THEN 1 WHEN 'weak' THEN 0.35 WHEN 'insufficient' THEN 0 ELSE 0.55 END, 0), 1), 4) END"


@query("q49_confidence_trust", f"""WITH a AS (SELECT l_orderkey AS k, l_linenumber AS ln, l_partkey AS pk, l_suppkey AS sk, CASE l_returnflag WHEN 'R' THEN 'safe_no_answer' WHEN 'A' THEN 'direct_structured' ELSE 'grounded_narrative' END AS mode, CASE WHEN l_linenumber <= 2 THEN 'strong' WHEN l_linenumber = 3 THEN 'weak' WHEN l_linenumber = 4 THEN 'insufficient' ELSE 'x' END AS quality,
  ((l_quantity % 12) / 1.1::DOUBLE)::DOUBLE AS n, (l_linenumber % 2)::DOUBLE AS det, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0.8 END::DOUBLE AS sem, (l_suppkey % 6)::DOUBLE AS strong, (l_discount * 10)::DOUBLE AS top, (l_tax * 11.37::DOUBLE)::DOUBLE AS share, l_suppkey % 3 AS docs FROM lineitem),
c AS (SELECT *, ({_CONF})::DOUBLE AS confidence FROM a)
SELECT k, ln, pk, sk, confidence, round(least(1, greatest(0, confidence - CASE WHEN det < 1 THEN 0.2 ELSE 0 END - CASE WHEN sem < 1 THEN 0.15 ELSE 0 END - CASE WHEN mode = 'safe_no_answer' THEN 0.05 ELSE 0 END + CASE WHEN docs = 1 THEN 0.06 ELSE 0 END + CASE WHEN share >= 0.75 THEN 0.05 WHEN share >= 0.5 THEN 0.02 ELSE 0 END
  + CASE quality WHEN 'strong' THEN 0.05 WHEN 'weak' THEN -0.03 WHEN 'insufficient' THEN -0.08 ELSE 0 END)), 4)::DOUBLE AS trust, mode <> 'safe_no_answer' AND det = 1 AND sem = 1 AND confidence >= 0.78 AS reuse_allowed FROM c""")
def q49(spark, d):
    l = V.table(spark, d, "lineitem")
    mode = F.when(F.col("l_returnflag") == "R", "safe_no_answer").when(F.col("l_returnflag") == "A", "direct_structured").otherwise("grounded_narrative")
    quality = F.when(F.col("l_linenumber") <= 2, "strong").when(F.col("l_linenumber") == 3, "weak").when(F.col("l_linenumber") == 4, "insufficient").otherwise("x")
    own = l.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("ln"), F.col("l_partkey").alias("pk"), F.col("l_suppkey").alias("sk"), mode.alias("mode"), quality.alias("quality"), (F.col("l_quantity") % 12 / 1.1).alias("n"), (F.col("l_linenumber") % 2).cast("double").alias("det"), F.when(F.col("l_linestatus") == "O", 1.0).otherwise(0.8).alias("sem"), (F.col("l_suppkey") % 6).cast("double").alias("strong"), (F.col("l_discount") * 10).alias("top"), (F.col("l_tax") * 11.37).alias("share"), (F.col("l_suppkey") % 3).alias("docs"))
    c = {x: F.col(x) for x in own.columns}
    own = own.withColumn("confidence", generate.confidence(c["mode"], c["quality"], c["n"], c["det"], c["sem"], c["strong"], c["top"], c["share"]))
    trust = generate.trust(F.col("confidence"), c["mode"], c["det"] == 1, c["sem"] == 1, c["docs"], c["share"], c["quality"])
    status = generate.validation_status(c["det"] == 1, c["sem"] == 1)
    return own.select("k", "ln", "pk", "sk", "confidence", trust.alias("trust"), generate.reuse_allowed(c["mode"], status, F.col("confidence"), F.lit("documents")).alias("reuse_allowed"))


@query("q50_short_text", r"""WITH t AS (SELECT doc_id, trim(coalesce(text, '')) AS a, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS b FROM documents)
SELECT doc_id, CASE WHEN length(a) <= 120 THEN a ELSE rtrim(substring(a, 1, 117)) || '...' END AS short, CASE WHEN length(b) <= 350 THEN b ELSE rtrim(substring(b, 1, 347)) || '...' END AS short_answer, CASE WHEN b = '' THEN NULL WHEN right(b, 1) IN ('.', '!', '?') THEN b ELSE b || '.' END AS sentence FROM t""")
def q50(spark, d):
    t = F.col("text")
    return V.table(spark, d, "documents").select("doc_id", T.shorten(t, 120).alias("short"), generate.short_answer(t, F.lit("grounded_narrative")).alias("short_answer"), T.sentence(t).alias("sentence"))


@query("q51_terms", r"""SELECT doc_id, array_to_string(list_slice(list_filter(string_split(lower(trim(regexp_replace(translate(coalesce(text, ''), '"()', '   '), '\s+', ' ', 'g'))), ' '), lambda w: length(w) >= 3 AND NOT list_contains(['the', 'and', 'der', 'die', 'und', 'les', 'des', 'que'], w)), 1, 8), ' ') AS terms FROM documents""")
def q51(spark, d):
    return V.table(spark, d, "documents").select("doc_id", F.array_join(T.terms(F.col("text"), DRIVER.stop_words), " ").alias("terms"))


_HTML = r"""WITH bare AS (SELECT page_id, regexp_replace(coalesce(html, ''), '<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>', ' ', 'gis') AS h FROM pages),
broken AS (SELECT page_id, regexp_replace(regexp_replace(h, '</?(?:p|div|li|tr|h[1-6]|br|ul|ol|table|article|nav|section|body|head|title)\b[^>]*>', chr(10), 'gi'), '<[^>]+>', '', 'g') AS t FROM bare),
cut AS (SELECT page_id, unnest(string_split(t, chr(10))) AS raw, generate_subscripts(string_split(t, chr(10)), 1) AS pos FROM broken)
SELECT page_id, CAST(pos AS INTEGER) AS block_order, trim(raw) AS content, CASE WHEN regexp_matches(trim(raw), '(?i)^(таблица|table)\s*(№|n)?\s*\d') THEN 'table_caption' WHEN regexp_matches(trim(raw), '^([-•*–]|\d+[.)]|[a-zа-я]\))\s') THEN 'list_item'
  WHEN length(trim(raw)) <= 80 AND NOT regexp_matches(trim(raw), '[.,;:]$') THEN 'heading' ELSE 'paragraph' END AS block_type, nullif(regexp_extract(trim(raw), '^(\d+(?:\.\d+)*)[.)]?\s', 1), '') AS clause_number FROM cut WHERE trim(raw) <> ''"""


@query("q52_html_blocks", _HTML)
def q52(spark, d):
    """Pages as blocks: tags of blocks end a line, other tags, scripts and comments go."""
    html = F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)<!--.*?-->|<(script|style)\b.*?</\1>", " ")
    html = F.regexp_replace(html, r"(?i)</?(?:p|div|li|tr|h[1-6]|br|ul|ol|table|article|nav|section|body|head|title)\b[^>]*>", "\n")
    plain = F.regexp_replace(html, r"<[^>]+>", "")
    return ingest.blocks(V.table(spark, d, "pages").select("page_id", plain.alias("text")), key="page_id").withColumnRenamed("document_id", "page_id")


@query("q53_eval_checks", with_views("""c AS (SELECT answer_id AS case_id, lower(answer_text) AS t, mode FROM answers)
SELECT case_id, array_to_string(list_filter(['tion', 'en'], lambda x: NOT contains(t, x)), ',') AS missing, array_to_string(list_filter(['licen'], lambda x: contains(t, x)), ',') AS present,
  NOT (NOT contains(t, 'tion') OR NOT contains(t, 'en') OR contains(t, 'licen') OR mode <> 'grounded_narrative') AS passed FROM c""", "answers"))
def q53(spark, d):
    return _checked(spark, d).select("case_id", F.array_join("missing", ",").alias("missing"), F.array_join("present", ",").alias("present"), "passed")


def _checked(spark, d):
    own = V.answers(spark, d).select(F.col("answer_id").alias("case_id"), "answer_text", F.col("mode").alias("answer_mode"), F.lit("strong").alias("evidence_quality"))
    cases = own.select("case_id", F.array(F.lit("tion"), F.lit("en")).alias("expected"), F.array(F.lit("licen")).alias("forbidden"), F.lit("grounded_narrative").alias("expected_mode"), F.lit(None).cast("string").alias("expected_quality"))
    return evaluate.eval_checks(own, cases)


@query("q54_eval_summary", with_views("""c AS (SELECT contains(lower(answer_text), 'tion') AND contains(lower(answer_text), 'en') AND NOT contains(lower(answer_text), 'licen') AND mode = 'grounded_narrative' AS ok FROM answers)
SELECT count(*) AS total, count(*) FILTER (WHERE ok) AS passed, count(*) FILTER (WHERE NOT ok) AS failed, round(100.0 * count(*) FILTER (WHERE ok) / count(*), 2)::DOUBLE AS pass_rate FROM c""", "answers"))
def q54(spark, d):
    return evaluate.eval_summary(_checked(spark, d))


@query("q55_callbacks", "SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 'vote' WHEN event_type = 'error' THEN 'comment' END AS kind, CASE WHEN event_type IN ('click', 'view', 'error') THEN 'a' || event_id END AS answer_id, CASE WHEN event_type IN ('click', 'view') THEN CAST(event_id % 5 + 1 AS INTEGER) ELSE 0 END AS score FROM events")
def q55(spark, d):
    e = V.table(spark, d, "events")
    key = F.concat(F.lit("a"), F.col("event_id"))
    raw = F.when(F.col("event_type").isin("click", "view"), F.concat_ws(":", F.lit("fb"), key, F.col("event_id") % 5 + 1)).when(F.col("event_type") == "error", F.concat_ws(":", F.lit("fb_comment"), key)).otherwise(F.concat_ws(":", F.lit("fb"), key, F.lit("9")))
    c = T.callback(raw)
    return e.select("event_id", c["kind"].alias("kind"), c["answer_id"].alias("answer_id"), F.coalesce(c["score"], F.lit(0)).alias("score"))


@query("q56_sessions", with_views("SELECT session_id AS external_session_id, min(submitted_at) AS started_at, max(submitted_at) AS last_at FROM votes GROUP BY 1", "votes"))
def q56(spark, d):
    m = V.votes(spark, d).select(F.lit("web").alias("channel"), F.col("session_id").alias("external_session_id"), F.col("submitted_at").alias("at"), F.lit(None).cast("string").alias("external_user_id"), F.lit(None).cast("string").alias("user_name"))
    return publish.sessions(m).select("external_session_id", "started_at", "last_at")


@query("q57_orphan_rows", with_views("SELECT 'row' AS what, count(*) AS n FROM rws WHERE table_id NOT IN (SELECT source_id FROM tabs) UNION ALL SELECT 'table', count(*) FROM tabs WHERE source_id NOT IN (SELECT table_id FROM rws)", "tables", "rows"))
def q57(spark, d):
    rows, tabs = V.rows(spark, d).select("table_id"), V.tables(spark, d).select(F.col("source_id").alias("table_id"))
    a = rows.join(tabs, "table_id", "left_anti").agg(F.count("*").alias("n")).select(F.lit("row").alias("what"), "n")
    return a.unionByName(tabs.join(rows, "table_id", "left_anti").agg(F.count("*").alias("n")).select(F.lit("table").alias("what"), "n"))


@query("q58_text_functions", r"""SELECT doc_id, length(regexp_replace(regexp_replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), '\t', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')) AS n_document, nullif(regexp_extract(coalesce(text, ''), '(\d{2}\.\d{2}\.\d{4})', 1), '') IS NOT NULL AS has_date,
  array_to_string(list_slice(string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^0-9a-zа-я]+', '_', 'g'), '_'), '_'), 1, 5), '_') AS key FROM documents""")
def q58(spark, d):
    t = F.col("text")
    raw = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(t, F.lit("")), "\r\n?", "\n"), "\t", " "), r"\n{3,}", "\n\n")
    return V.table(spark, d, "documents").select("doc_id", F.char_length(raw).cast("long").alias("n_document"), (F.regexp_extract(F.coalesce(t, F.lit("")), r"(\d{2}\.\d{2}\.\d{4})", 1) != "").alias("has_date"), F.array_join(F.slice(F.split(T.token_key(t), "_"), 1, 5), "_").alias("key"))


@query("q59_upsert", with_views("""o AS (SELECT answer_id, count(*) AS n FROM votes WHERE vote_id % 2 = 0 AND answer_id < 150 GROUP BY 1), w AS (SELECT answer_id, count(*) AS n FROM votes WHERE vote_id % 3 = 0 AND answer_id > 50 GROUP BY 1)
SELECT coalesce(o.answer_id, w.answer_id) AS answer_id, CASE WHEN w.answer_id IS NOT NULL THEN w.n ELSE o.n END AS n FROM o FULL JOIN w ON o.answer_id = w.answer_id""", "votes"))
def q59(spark, d):
    v = V.votes(spark, d)
    old = v.filter("vote_id % 2 = 0 AND answer_id < 150").groupBy("answer_id").agg(F.count("*").alias("n"))
    new = v.filter("vote_id % 3 = 0 AND answer_id > 50").groupBy("answer_id").agg(F.count("*").alias("n"))
    return feedback.upsert(old, new, "answer_id", ["n"])


@query("q60_cosine_pairs", "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def q60(spark, d):
    e = V.table(spark, d, "embeddings")
    return e.alias("a").join(e.alias("b"), F.col("b.vec_id") == F.col("a.vec_id") + 1).select("a.vec_id", F.round(S.cosine(F.col("a.embedding"), F.col("b.embedding")), 6).alias("similarity"))


# ---------------------------------------------------------------- answer events, history, documents

@query("q61_json_filters", """SELECT event_id, wanted IS NULL OR json_extract_string(props, '$.k') IS NULL OR json_extract_string(props, '$.k') = wanted AS same, contains(lower(coalesce(props, '')), '"k": 1') AS held
  FROM (SELECT event_id, props, CASE WHEN event_id % 3 <> 0 THEN CAST(event_id % 10 AS VARCHAR) END AS wanted FROM events)""")
def q61(spark, d):
    wanted = F.when(F.col("event_id") % 3 != 0, (F.col("event_id") % 10).cast("string"))
    return V.table(spark, d, "events").select("event_id", retrieval.json_exact_or_null(F.col("props"), "$.k", wanted).alias("same"), retrieval.json_holds(F.col("props"), F.lit('"K": 1')).alias("held"))


@query("q62_answer_points", with_views(r"""cand AS (SELECT document_id AS question_id, 'block' AS kind, block_order AS place, content AS raw, content AS note, true AS found FROM blocks
  UNION ALL SELECT document_id, 'legal_fact', 1000000 + CAST(substring(source_id, 2) AS INTEGER), note, note, CAST(substring(source_id, 2) AS INTEGER) % 2 = 0 FROM facts),
flat AS (SELECT *, trim(regexp_replace(raw, '\s+', ' ', 'g')) AS t FROM cand),
short AS (SELECT *, CASE WHEN length(t) <= 260 THEN t ELSE rtrim(substring(t, 1, 257)) || '...' END AS s FROM flat),
made AS (SELECT question_id, place, CASE WHEN kind = 'block' THEN CASE WHEN s = '' THEN NULL WHEN right(s, 1) IN ('.', '!', '?') THEN s ELSE s || '.' END WHEN found THEN regexp_replace(trim(note), '\.+$', '') || '.' ELSE note END AS point FROM short),
once AS (SELECT question_id, point, min(place) AS first FROM made WHERE point <> '' GROUP BY ALL),
numbered AS (SELECT question_id, point, row_number() OVER (PARTITION BY question_id ORDER BY first, point) AS place FROM once)
SELECT question_id, CAST(place AS INTEGER) AS place, point FROM numbered WHERE place <= 6""", "blocks", "facts"))
def q62(spark, d):
    """Blocks and facts of a document as candidates; every other fact can't be found any more."""
    blocks, facts = V.blocks(spark, d), V.facts(spark, d)
    number = F.substring("source_id", 2, 20).cast("int")
    cand = blocks.select(F.col("document_id").alias("question_id"), F.lit("block").alias("source_type"), "source_id", F.col("block_order").alias("place"), F.col("content").alias("snippet"))
    cand = cand.unionByName(facts.select(F.col("document_id").alias("question_id"), F.lit("legal_fact").alias("source_type"), "source_id", (1_000_000 + number).alias("place"), F.col("note").alias("snippet")))
    objects = {"block": blocks.select("source_id", "content"), "legal_fact": facts.filter(number % 2 == 0).select("source_id", "fact_type", F.col("note").alias("validity_note"))}
    return answers.answer_points(answers.hydrate(cand, objects))


_PAST = """, hist AS (SELECT n AS answer_id, n AS question_id, b.text AS question_text, intent, measure_code, mode, validation_status, created_at, (n % 4) / 4.0::DOUBLE AS reuse_score, CASE WHEN n % 6 <> 0 THEN 1 + n % 5 END AS avg_score, n % 9 AS n_votes
  FROM answers a LEFT JOIN benchmark b ON b.item_id = n % 40 WHERE n % 8 <> 0)"""


def _past(spark, d):
    """The three relations of the history: answers, their questions, what is known of their reuse."""
    a = V.answers(spark, d)
    own = a.select("answer_id", F.col("answer_id").alias("question_id"), "mode", "validation_status", "created_at", F.lit(True).alias("reuse_allowed"), F.lit(True).alias("deterministic_passed"), F.lit(True).alias("semantic_passed"))
    text = V.table(spark, d, "benchmark").select((F.col("item_id")).alias("_item"), F.col("text").alias("question_text"))
    asked = a.select(F.col("answer_id").alias("question_id"), "intent", "measure_code", F.lit(None).cast("string").alias("subject"), (F.col("n") % 40).alias("_item")).join(text, "_item", "left").drop("_item")
    n = F.col("n")
    known = a.filter(n % 8 != 0).select("answer_id", F.lit("eligible").alias("reuse_status"), F.lit(True).alias("reuse_effective"), (n % 4 / 4.0).alias("reuse_score"), F.when(n % 6 != 0, 1 + n % 5).alias("avg_score"), (n % 9).alias("n_votes"))
    return answers.history(own, asked, known)


_LEAD = _PAST + """, lead_ AS (SELECT *, row_number() OVER (ORDER BY reuse_score DESC NULLS FIRST, avg_score DESC NULLS FIRST, n_votes DESC NULLS FIRST, created_at DESC NULLS FIRST, answer_id) AS standing FROM hist WHERE mode NOT IN ('reused_answer', 'safe_no_answer') AND validation_status = 'passed')"""


@query("q63_leading_history", with_views("x AS (SELECT 1)" + _LEAD + " SELECT answer_id, CAST(standing AS INTEGER) AS standing FROM lead_ WHERE standing <= 60", "answers"))
def q63(spark, d):
    return answers.leading_history(_past(spark, d), 60).select("answer_id", "standing")


@query("q64_history_matches", with_views("x AS (SELECT 1)" + _LEAD + r""", q AS (SELECT item_id AS question_id, lower(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))) AS norm, CASE WHEN item_id % 2 = 0 THEN 'documents' ELSE 'deadline' END AS intent, 'm' || (item_id % 5) AS measure_code FROM benchmark),
h AS (SELECT *, lower(trim(regexp_replace(coalesce(question_text, ''), '\s+', ' ', 'g'))) AS past FROM lead_ WHERE standing <= 61),
pairs AS (SELECT q.question_id, q.norm, q.intent AS qi, q.measure_code AS qm, h.answer_id, h.past, h.intent, h.measure_code, h.reuse_score, h.avg_score, h.n_votes, h.created_at, h.standing, row_number() OVER (PARTITION BY q.question_id ORDER BY standing) AS counted FROM q JOIN h ON h.question_id <> q.question_id),
sets AS (SELECT *, list_distinct(string_split(norm, ' ')) AS a, list_distinct(string_split(past, ' ')) AS b FROM pairs WHERE counted <= 60),
sims AS (SELECT *, len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b)))::DOUBLE AS j FROM sets),
scored AS (SELECT *, CASE WHEN norm = '' OR past = '' THEN 0 WHEN norm = past THEN 1 WHEN contains(norm, past) OR contains(past, norm) THEN 0.97 WHEN j >= 0.8 THEN 0.95 WHEN j >= 0.7 THEN 0.92 WHEN j >= 0.6 THEN 0.9 ELSE round(j, 4) END::DOUBLE AS similarity,
  round(CASE WHEN qi = intent THEN 0.5 ELSE 0 END + CASE WHEN qm = measure_code THEN 0.3 ELSE 0 END + 0.05, 4)::DOUBLE AS signature FROM sims),
placed AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY similarity DESC, signature DESC, reuse_score DESC, coalesce(avg_score, 0) DESC, n_votes DESC, created_at DESC, standing) AS place FROM scored WHERE similarity >= 0.9)
SELECT question_id, answer_id AS past_id, similarity, signature, CAST(place AS INTEGER) AS place FROM placed WHERE place <= 20""", "answers"))
def q64(spark, d):
    i = F.col("item_id")
    asked = V.table(spark, d, "benchmark").select(i.alias("question_id"), "text", F.when(i % 2 == 0, "documents").otherwise("deadline").alias("intent"), F.concat(F.lit("m"), (i % 5).cast("string")).alias("measure_code"), F.lit(None).cast("string").alias("subject"))
    return answers.history_matches(asked, _past(spark, d))


@query("q65_evidence_hashes", with_views(_EVID + """,
items AS (SELECT *, row_number() OVER (PARTITION BY answer_id ORDER BY k, block_id NULLS FIRST, ch NULLS FIRST, fh NULLS FIRST, CAST(document_id AS VARCHAR) NULLS FIRST) AS place FROM evid),
per AS (SELECT answer_id, count(*) AS n, list_sort(list_distinct(list(coalesce(ch, fh)) FILTER (WHERE coalesce(ch, fh) IS NOT NULL))) AS documents,
  string_agg('{"block_id":' || coalesce('"' || block_id || '"', 'null') || ',"citation_json":{},"document_content_hash":' || coalesce('"' || ch || '"', 'null') || ',"document_file_hash":' || coalesce('"' || fh || '"', 'null') || ',"document_id":' || coalesce('"' || document_id || '"', 'null')
    || ',"evidence_item_type":"document","legal_fact_id":null,"order":' || place || ',"role_code":"primary","table_id":null,"table_row_id":null}', ',' ORDER BY place) AS told FROM items GROUP BY 1)
SELECT answer_id, sha256('{"documents":[' || coalesce(array_to_string(list_transform(documents, lambda x: '"' || x || '"'), ','), '') || ']}') AS document_set_hash, sha256('[' || told || ']') AS evidence_hash, CAST(n AS INTEGER) AS n_items FROM per""", "registry", "rows"))
def q65(spark, d):
    return answers.evidence_hashes(_evidence(spark, d).withColumns({"evidence_item_type": F.lit("document"), "role_code": F.lit("primary")}))


@query("q70_payload_hashes", """WITH items AS (SELECT l_orderkey AS k, string_agg('{"flags":{"line":"' || l_linestatus || '","return":"' || l_returnflag || '"},"part":' || l_partkey || ',"price":' || CAST(l_extendedprice AS VARCHAR) || ',"ship":"' || strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S') || '+00:00"}', ',' ORDER BY l_linenumber, l_partkey, l_suppkey) AS told FROM lineitem GROUP BY 1)
SELECT o_orderkey AS answer_id, sha256('{"items":[' || coalesce(told, '') || '],"none":null,"status":"' || o_orderstatus || '","sum":{"a":' || CAST(o_totalprice AS VARCHAR) || ',"z":' || (o_orderkey % 3) || '}}') AS answer_payload_hash FROM orders LEFT JOIN items ON k = o_orderkey""")
def q70(spark, d):
    """Orders with their lines as payloads of answers, nested and out of order."""
    l = V.table(spark, d, "lineitem")
    items = l.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", F.struct("l_shipdate", "l_extendedprice", "l_returnflag", "l_linestatus").alias("x")))), lambda i: F.struct(
        i["x"]["l_shipdate"].alias("ship"), i["x"]["l_extendedprice"].alias("price"), F.create_map(F.lit("return"), i["x"]["l_returnflag"], F.lit("line"), i["x"]["l_linestatus"]).alias("flags"), i["l_partkey"].alias("part"))).alias("items"))
    own = V.table(spark, d, "orders").join(items, "o_orderkey", "left")
    payload = F.struct(F.col("o_orderstatus").alias("status"), F.struct((F.col("o_orderkey") % 3).alias("z"), F.col("o_totalprice").alias("a")).alias("sum"), F.lit(None).cast("string").alias("none"), F.coalesce("items", F.array().cast(items.schema["items"].dataType)).alias("items"))
    events = answers.answer_events(own.select(F.col("o_orderkey").alias("answer_id"), F.lit("t").alias("answer_text"), F.lit(False).alias("reuse_allowed"), payload.alias("payload")), _evidence(spark, d))[0]
    return events.select("answer_id", "answer_payload_hash")


@query("q66_document_titles", with_views(r"""n AS (SELECT document_id, trim(regexp_replace(content, '\s+', ' ', 'g')) AS t, block_order, row_number() OVER (PARTITION BY document_id ORDER BY block_order) AS place FROM blocks),
first_ AS (SELECT document_id, arg_min(t, block_order) AS t FROM n WHERE place <= 20 AND length(t) >= 4 GROUP BY 1)
SELECT doc_id AS document_id, coalesce(t, 'file' || doc_id || '.v1') AS title FROM documents LEFT JOIN first_ ON document_id = doc_id""", "blocks"))
def q66(spark, d):
    docs = V.table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.concat(F.lit("in/file"), F.col("doc_id"), F.lit(".v1.docx")).alias("file_name"))
    return ingest.document_titles(docs, V.blocks(spark, d))


@query("q67_extraction_counters", with_views("""n AS (SELECT table_id, count(*) AS n FROM rws WHERE l_returnflag = 'R' GROUP BY 1),
per AS (SELECT document_id, count(*) AS declared, count(*) FILTER (WHERE n IS NULL) AS skipped, count(n) AS meaningful, sum(coalesce(n, 0))::BIGINT AS table_rows FROM tabs LEFT JOIN n ON table_id = source_id GROUP BY 1)
SELECT doc_id AS document_id, coalesce(declared, 0) AS declared, coalesce(skipped, 0) AS skipped, coalesce(meaningful, 0) AS meaningful, coalesce(table_rows, 0) AS table_rows FROM documents LEFT JOIN per ON document_id = doc_id""", "tables", "rows"))
def q67(spark, d):
    """Rows that were returned count as meaningful; a table without any is skipped."""
    docs = V.table(spark, d, "documents").select(F.col("doc_id").alias("document_id"))
    return ingest.extraction_counters(docs, V.tables(spark, d).withColumnRenamed("source_id", "table_id"), V.rows(spark, d).filter("l_returnflag = 'R'").select("table_id"))


@query("q68_safe_answers", with_views(f"SELECT answer_id AS question_id, 'safe_no_answer' AS answer_mode, '{answers.SAFE_TEXT}' AS answer_text, '{answers.SAFE_TEXT}' AS answer_text_short, 0.35::DOUBLE AS confidence_score, 0.3::DOUBLE AS trust_score, 'passed' AS validation_status, true AS deterministic_passed, true AS semantic_passed, false AS reuse_allowed, 'insufficient_evidence' AS reason_code, CASE WHEN n % 2 = 0 THEN 'weak' ELSE 'insufficient' END AS evidence_quality FROM answers WHERE mode = 'safe_no_answer'", "answers"))
def q68(spark, d):
    a = V.answers(spark, d).filter("mode = 'safe_no_answer'").withColumnRenamed("answer_id", "question_id")
    return answers.safe_answers(a, F.lit("insufficient_evidence"), F.when(F.col("n") % 2 == 0, "weak").otherwise("insufficient"))


@query("q69_lookup", "SELECT item_id AS document_id, CASE WHEN item_id * 50 IN (SELECT doc_id FROM documents) THEN 'found' ELSE 'missing' END AS state FROM benchmark")
def q69(spark, d):
    keys = V.table(spark, d, "benchmark").select((F.col("item_id") * 50).alias("doc_id"))
    found, missing = answers.lookup(V.table(spark, d, "documents").select("doc_id"), keys, "doc_id")
    told = found.withColumn("state", F.lit("found")).unionByName(missing.withColumn("state", F.lit("missing")))
    return told.select((F.col("doc_id") / 50).cast("long").alias("document_id"), "state")


# ---------------------------------------------------------------- tables of documents

_HAS = lambda c, *ws: "(" + " + ".join(f"CASE WHEN contains({c}, '{w}') THEN 1 ELSE 0 END" for w in ws) + ")"
_TOKEN = lambda c: f"trim(regexp_replace(replace(lower({c}), '№', 'n'), '[^0-9a-zа-я]+', '_', 'g'), '_')"
_TABLE_ROWS = f"""numbered AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY pos) AS row_order, cells FROM paper_rows),
judged AS (SELECT *, lower(array_to_string(cells, ' ')) AS said, len(cells) >= 3 AND len(list_filter(cells, lambda c: regexp_full_match(c, '[0-9]+|[ivxlcm]+'))) >= greatest(3, len(cells) - 1) AS is_numbers FROM numbered),
opened AS (SELECT *, len(cells) = 1 AND length(said) > 30 AND contains(said, 'документ') AS is_service, CASE WHEN contains(said, 'представить самостоятельно') THEN 'required' WHEN contains(said, 'по собственной инициативе') THEN 'optional' END AS opens FROM judged WHERE NOT is_numbers),
carried AS (SELECT *, last_value(CASE WHEN is_service THEN opens END IGNORE NULLS) OVER (PARTITION BY k ORDER BY row_order) AS grp FROM opened),
heads AS (SELECT k, title, headers, unnest(headers) AS header, generate_subscripts(headers, 1) AS idx FROM papers),
keyed AS (SELECT *, {_TOKEN('header')} AS base, row_number() OVER (PARTITION BY k, {_TOKEN('header')} ORDER BY idx) AS nth FROM heads),
named AS (SELECT k, title, headers, header, idx, CASE WHEN nth > 1 THEN base || '_' || nth ELSE base END AS key, base FROM keyed),
cell AS (SELECT r.k, row_order, coalesce(grp, 'unknown') AS grp, idx, title, headers, header, key, base, r.cells[idx] AS v FROM carried r JOIN named USING (k) WHERE NOT is_service),
told AS (SELECT k, row_order, any_value(grp) AS grp, any_value(title) AS title, any_value(headers) AS headers, CASE WHEN any_value(title) <> '' THEN 'Таблица: ' || any_value(title) || '. ' ELSE '' END || 'Колонки таблицы: ' || array_to_string(any_value(headers), ', ') || '.'
  || coalesce(' ' || string_agg(upper(substring(replace(key, '_', ' '), 1, 1)) || substring(replace(key, '_', ' '), 2) || ': ' || v || '.', ' ' ORDER BY idx) FILTER (WHERE v <> ''), '') AS row_summary FROM cell GROUP BY 1, 2),
heard AS (SELECT k, lower(any_value(title) || ' ' || array_to_string(any_value(headers), ' ') || ' ' || string_agg(row_summary, ' ' ORDER BY row_order)) AS t FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY row_order) AS nth FROM told) WHERE nth <= 8 GROUP BY k),
typed AS (SELECT k, CASE WHEN {_HAS('t', 'документов, необходимых', 'документы, необходимые', 'исчерпывающий перечень документов', 'наименование документа', 'способ подачи', 'электронной подаче', 'лично', 'почтовым отправлением', 'мфц', 'иные требования')} >= 2 THEN 'documents'
  WHEN contains(t, 'основания для отказа') THEN 'refusal_reasons' WHEN contains(t, 'срок') OR contains(t, 'рабочих дней') THEN 'deadlines' WHEN contains(t, 'категории заявителей') THEN 'identifiers' ELSE 'generic' END AS table_type FROM heard),
meant AS (SELECT c.*, table_type, CASE WHEN table_type = 'documents' THEN CASE WHEN contains(lower(header), 'наименование документа') THEN 'document_name' WHEN lower(header) = '№ п/п' THEN 'row_number' WHEN ends_with(key, '_2') THEN 'epgu_submission' WHEN ends_with(key, '_3') THEN 'post_submission' WHEN contains(key, 'способ_подачи') THEN 'in_person_submission' ELSE base END
  WHEN table_type = 'identifiers' THEN CASE WHEN contains(lower(header), 'идентификатор') THEN 'applicant_category_id' WHEN contains(lower(header), 'категор') THEN 'applicant_category_name' ELSE base END
  WHEN table_type = 'refusal_reasons' THEN CASE WHEN contains(lower(header), 'основан') THEN 'refusal_reason' WHEN contains(lower(header), 'идентификатор') THEN 'applicant_category_id' ELSE base END
  WHEN table_type = 'deadlines' AND contains(lower(header), 'срок') THEN 'deadline_value' ELSE base END AS meaning, row_number() OVER (PARTITION BY c.k, row_order, header ORDER BY idx) AS again FROM cell c JOIN typed USING (k) WHERE v <> ''),
won AS (SELECT k, row_order, meaning, arg_max(v, idx) AS v FROM meant GROUP BY 1, 2, 3),
maps AS (SELECT k, row_order, string_agg(meaning || '=' || v, ';' ORDER BY meaning) AS by_meaning, string_agg(meaning || '=' || {_TOKEN('v')}, ';' ORDER BY meaning) AS by_meaning_normal FROM won GROUP BY 1, 2),
headed AS (SELECT k, row_order, string_agg(CASE WHEN again > 1 THEN header || ' [' || key || ']' ELSE header END || '=' || v, ';' ORDER BY CASE WHEN again > 1 THEN header || ' [' || key || ']' ELSE header END) AS by_header, string_agg(key || '=' || v, ';' ORDER BY key) AS by_key FROM meant GROUP BY 1, 2)
SELECT told.k AS table_id, CAST(told.row_order AS INTEGER) AS row_order, table_type, grp AS requirement_group, row_summary, by_header, by_key, by_meaning, by_meaning_normal FROM told JOIN typed USING (k) JOIN maps ON maps.k = told.k AND maps.row_order = told.row_order JOIN headed ON headed.k = told.k AND headed.row_order = told.row_order"""


@query("q71_table_rows", with_views(_TABLE_ROWS, "papers"))
def q71(spark, d):
    """Orders as tables of five kinds, to the rows that can be found; maps as text, by key."""
    out = table_rows.retrievable_rows(V.papers(spark, d))
    told = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return out.select("table_id", "row_order", "table_type", "requirement_group", "row_summary", *[told(c).alias(c) for c in ("by_header", "by_key", "by_meaning", "by_meaning_normal")])


# ---------------------------------------------------------------- deadline answers

_ASKED = ("какой срок выплаты едв", "срок уведомления о решении", "срок принятия решения", "когда")
_DEEDS = ("выплата", "уведомление", "принятие решения")
_BLOCKS = ("Решение о назначении ЕДВ принимается в течение {} рабочих дней со дня регистрации заявления.", "Уведомление направляется заявителю не позднее {} дней после принятия решения", "Выплата ЕДВ осуществляется ежемесячно не позднее 26 числа месяца", "об исправлении опечаток в течение {} дней", "без даты, {}")
_MARKS = lambda words, w: " + ".join(f"CASE WHEN contains(t, '{m}') THEN {w}::DOUBLE ELSE 0 END" for m in words)
_KINDS = {k: _MARKS(strong, ws) + " + " + _MARKS(weak, ww) for k, (ws, strong, ww, weak) in generate.KIND_MARKERS.items()}


def _kind_sql(name: str, of: str) -> str:
    """kind and confidence of the texts ``t`` of a relation."""
    return f"""{name}_w AS (SELECT *, {_KINDS['decision']} AS d0, {_KINDS['notification']} AS n0, {_KINDS['payment']} AS p0, contains(t, 'принятия решения') AS said FROM {of}),
{name}_x AS (SELECT *, d0 * CASE WHEN p0 > 0 AND said THEN 0.45 ELSE 1 END * CASE WHEN n0 > 0 AND said THEN 0.55 ELSE 1 END + CASE WHEN contains(t, 'срок принятия решения') THEN 1.5 ELSE 0 END AS sd, n0 + CASE WHEN contains(t, 'срок уведомления') THEN 1.5 ELSE 0 END AS sn, p0 + CASE WHEN contains(t, 'срок выплаты') THEN 1.5 ELSE 0 END AS sp FROM {name}_w),
{name} AS (SELECT * EXCLUDE (d0, n0, p0, said, sd, sn, sp), CASE WHEN greatest(sd, sn, sp) <= 0 THEN 'other' WHEN sd = greatest(sd, sn, sp) THEN 'decision' WHEN sn = greatest(sd, sn, sp) THEN 'notification' ELSE 'payment' END AS kind,
  CASE WHEN greatest(sd, sn, sp) <= 0 THEN 0 WHEN greatest(sd, sn, sp) - list_sort([sd, sn, sp])[2] < 0.35 THEN least(round(greatest(sd, sn, sp) / (sd + sn + sp), 3), 0.58) ELSE round(greatest(sd, sn, sp) / (sd + sn + sp), 3) END::DOUBLE AS conf FROM {name}_x)"""


_SPEC = "(CASE WHEN contains(lower(value), 'рабоч') THEN 3 ELSE 0 END + CASE WHEN contains(lower(value), 'календар') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(value, '[0-9]') THEN 2 ELSE 0 END + CASE WHEN contains(lower(value), 'не более') OR contains(lower(value), 'не позднее') THEN 1 ELSE 0 END + CASE WHEN contains(value, '26') THEN 1 ELSE 0 END)"
_LABEL = lambda k: f"CASE {k} WHEN 'decision' THEN 'принятия решения' WHEN 'notification' THEN 'уведомления' WHEN 'payment' THEN 'выплаты' ELSE 'срока' END"
_DEADLINES = f"""WITH asked0 AS (SELECT o_orderkey AS q, CASE o_orderkey % 4 {' '.join(f"WHEN {k} THEN '{t}'" for k, t in enumerate(_ASKED))} END AS t FROM orders),
{_kind_sql('asked', 'asked0')},
cand AS (SELECT l_orderkey AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS place, l_partkey % 2 = 0 AS is_row, (l_partkey % 50) / 50.0::DOUBLE AS base, CASE WHEN l_suppkey % 5 = 0 THEN 'documents' ELSE 'deadlines' END AS semantic,
  CASE CAST(l_quantity AS INTEGER) % 4 WHEN 0 THEN CAST(l_quantity AS INTEGER) || ' рабочих дней' WHEN 1 THEN 'Срок' WHEN 2 THEN NULL ELSE 'быстро' END AS cell, CASE l_linenumber % 3 {' '.join(f"WHEN {k} THEN '{t}'" for k, t in enumerate(_DEEDS))} END AS deed,
  replace(CASE l_linenumber % 5 {' '.join(f"WHEN {k} THEN '{t}'" for k, t in enumerate(_BLOCKS))} END, '{{}}', CAST(l_suppkey % 30 + 1 AS VARCHAR)) AS snippet FROM lineitem),
found AS (SELECT *, CASE WHEN is_row THEN cell ELSE coalesce(nullif(regexp_extract(snippet, '(?i)не позднее\\s+26(?:-го)?\\s+числа\\s+месяца[^.;]{{0,160}}'), ''), nullif(regexp_extract(snippet, '(?i)в течение\\s+\\d+\\s+(?:рабоч(?:их|его)|календарн(?:ых|ого))\\s+дн(?:я|ей)'), ''), nullif(regexp_extract(snippet, '(?i)в течение\\s+\\d+\\s+дн(?:я|ей)'), ''), nullif(regexp_extract(snippet, '(?i)не позднее\\s+[^.;]{{3,160}}'), '')) END AS value,
  CASE WHEN is_row THEN 'действие: ' || deed END AS row_scope FROM cand),
why AS (SELECT *, CASE WHEN is_row THEN CASE WHEN value IS NULL THEN 'empty_deadline_value' WHEN lower(value) = 'срок' THEN 'service_header_row' WHEN NOT regexp_matches(value, '[0-9]') THEN 'not_deadline_like_value' WHEN semantic = 'documents' THEN 'not_deadlines_table' END
  WHEN contains(snippet, 'исправлении опечаток') THEN 'offtopic_deadline_block' WHEN value IS NULL THEN 'block_without_deadline_marker' END AS why, lower(CASE WHEN is_row THEN concat_ws(' ', value, row_scope) ELSE snippet END) AS t FROM found),
{_kind_sql('item', 'why')},
scoped AS (SELECT i.*, a.kind AS asked, a.t AS asked_text, CASE WHEN is_row THEN row_scope WHEN i.kind = 'payment' THEN CASE WHEN contains(i.t, 'едв') THEN 'выплата ЕДВ' ELSE 'выплата' END WHEN i.kind = 'notification' THEN CASE WHEN contains(i.t, 'уведомление') THEN 'уведомление о решении' ELSE 'уведомление' END
  WHEN i.kind = 'decision' THEN CASE WHEN contains(i.t, 'решение о назначении едв') THEN 'принятие решения о назначении ЕДВ' ELSE 'принятие решения' END END AS scope FROM item i JOIN asked a USING (q)),
scored AS (SELECT *, round(base + CASE WHEN asked = 'other' THEN 0 WHEN kind = asked THEN 0.45 WHEN kind <> 'other' THEN -0.22 ELSE 0 END + least(0.12, 0.04 * coalesce(len(list_filter(string_split(asked_text, ' '), lambda w: length(w) >= 4 AND contains(lower(scope), w))), 0))::DOUBLE, 9) AS score FROM scoped),
one AS (SELECT q, asked, lower(value) AS vk, coalesce(lower(scope), '') AS sk, kind, arg_min(value, (-score, -conf, -{_SPEC}, coalesce(length(scope), 0), place)) AS value, arg_min(scope, (-score, -conf, -{_SPEC}, coalesce(length(scope), 0), place)) AS scope, max(conf) AS conf, max(score) AS score, count(*) AS n, bool_or(is_row) AS has_row, min(place) AS first FROM scored WHERE why IS NULL GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY CASE WHEN asked = 'other' OR kind = asked THEN 0 ELSE 1 END, score + CASE WHEN has_row THEN 0.05 ELSE 0 END DESC, conf DESC, {_SPEC} DESC, n DESC, coalesce(length(scope), 0), first) AS r FROM one),
tops AS (SELECT * FROM ranked WHERE r = 1),
alike AS (SELECT q, arg_min(score, r) AS next_score FROM ranked WHERE r > 1 AND kind = asked GROUP BY q),
near AS (SELECT x.*, row_number() OVER (PARTITION BY x.q ORDER BY x.r) AS nth FROM ranked x JOIN tops p USING (q) LEFT JOIN alike USING (q) WHERE x.r > 1 AND (x.asked = 'other' OR x.kind = x.asked) AND p.score - x.score <= 0.18 AND NOT (x.vk = p.vk AND x.kind = p.kind)
  AND NOT CASE WHEN x.asked = 'other' THEN false WHEN p.kind <> x.asked THEN false WHEN next_score IS NULL THEN true ELSE p.score - next_score >= 0.18 OR (p.conf >= 0.62 AND p.score - next_score >= 0.1) END),
more AS (SELECT q, string_agg('— ' || value || ' (' || {_LABEL('kind')} || coalesce('; ' || scope, '') || ')', chr(10) ORDER BY r) AS lines FROM near WHERE nth <= 2 GROUP BY q),
gone AS (SELECT q, string_agg(place || ':' || why, ',' ORDER BY place) AS dropped FROM scored WHERE why IS NOT NULL GROUP BY q),
counts AS (SELECT q, count(*) AS n_items, count(DISTINCT vk) > 1 AS ambiguous FROM ranked GROUP BY q)
SELECT a.q AS question_id, a.kind AS asked, p.value IS NOT NULL AS can_answer, coalesce(n_items, 0) AS n_items, p.kind, p.conf AS confidence, p.score, coalesce(dropped, '') AS dropped, CASE WHEN ambiguous THEN 'multiple_distinct_deadlines' END AS ambiguity_reason, CASE WHEN p.value IS NULL THEN 'no_deadline_items' END AS reason,
  CASE WHEN lines IS NULL THEN 'Срок ' || {_LABEL('p.kind')} || ' по найденным источникам: ' || p.value || coalesce(' (' || p.scope || ')', '') || '.' ELSE 'По найденным источникам установлены следующие сроки:' || chr(10) || '— ' || p.value || ' (' || {_LABEL('p.kind')} || coalesce('; ' || p.scope, '') || ')' || chr(10) || lines || chr(10) || chr(10) || 'Конкретный срок зависит от того, о каком действии или этапе процедуры идёт речь.' END AS text
FROM asked a LEFT JOIN tops p ON p.q = a.q LEFT JOIN more ON more.q = a.q LEFT JOIN gone ON gone.q = a.q LEFT JOIN counts ON counts.q = a.q"""


@query("q72_deadline_answers", _DEADLINES)
def q72(spark, d):
    """Orders as questions for a deadline, their lines as rows of tables and blocks that may tell it."""
    l = V.table(spark, d, "lineitem")
    by = lambda c, values: F.get(F.array(*[F.lit(v) for v in values]), (c % len(values)).cast("int"))
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    quantity, row = F.col("l_quantity").cast("int"), F.col("l_partkey") % 2 == 0
    cell = F.when(quantity % 4 == 0, F.concat(quantity.cast("string"), F.lit(" рабочих дней"))).when(quantity % 4 == 1, "Срок").when(quantity % 4 == 2, "").otherwise("быстро")
    snippet = F.replace(by(F.col("l_linenumber"), _BLOCKS), F.lit("{}"), (F.col("l_suppkey") % 30 + 1).cast("string"))
    cand = l.select(F.col("l_orderkey").alias("question_id"), place.alias("place"), F.when(row, "table_row").otherwise("block").alias("source_type"), F.concat_ws("-", "l_partkey", "l_suppkey").alias("source_id"), (F.col("l_partkey") % 50 / 50.0).alias("score"),
                    F.when(F.col("l_suppkey") % 5 == 0, "documents").otherwise("deadlines").alias("semantic"), F.when(row, F.create_map(F.lit("deadline_value"), cell, F.lit("действие"), by(F.col("l_linenumber"), _DEEDS))).alias("cells"), F.when(~row, snippet).alias("snippet"), F.lit(None).cast("string").alias("title"))
    asked = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("question_id"), by(F.col("o_orderkey"), _ASKED).alias("text"))
    out = deadlines.answers(asked, cand)
    told = F.coalesce(F.array_join(F.transform("dropped", lambda x: F.concat_ws(":", x["place"].cast("string"), x["reason"])), ","), F.lit(""))
    return out.select("question_id", "asked", "can_answer", F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), "primary.kind", "primary.confidence", "primary.score", told.alias("dropped"), "ambiguity_reason", "reason", "text")


# ---------------------------------------------------------------- answers about documents

_PAPER_NAMES = ("Заявление", "Запрос о предоставлении услуги", "Паспорт гражданина", "Доверенность (для представителя)", "Справка о доходах", "Справка о регистрации по месту жительства", "Трудовая книжка", "Наименование документа", "")
_HANDED = ("in_person", "epgu", None)
_KIN = (("application_request", ("заявление", "запрос", "ходатайств")), ("identity_document", ("паспорт", "удостоверяющ личность")), ("authority_document", ("полномоч", "доверенн", "представител")), ("residency_proof", ("регистрац", "проживани", "место жительства", "место пребывания")),
        ("court_decision", ("решение суда",)), ("status_certificate", ("справк", "удостоверени", "свидетельств", "категори")), ("employment_proof", ("трудов", "работ", "служб", "занятост", "доход")))
_ANY = lambda c, ws: "(" + " OR ".join(f"contains({c}, '{w}')" for w in ws) + ")"
_PAPERS_ASKED = f"""WITH cand AS (SELECT l_orderkey AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS place, CASE l_partkey % 9 {' '.join(f"WHEN {k} THEN '{t}'" for k, t in enumerate(_PAPER_NAMES))} END AS name, CASE WHEN l_suppkey % 3 = 0 THEN 'K' || (l_suppkey % 4) END AS category,
  CASE WHEN l_suppkey % 7 = 0 THEN 'deadlines' ELSE 'documents' END AS semantic, CASE l_orderkey % 3 WHEN 0 THEN CASE WHEN l_returnflag = 'R' THEN 'оригинал' ELSE 'копия' END WHEN 1 THEN CASE WHEN l_linestatus = 'O' THEN 'образ' END END AS note FROM lineitem),
why AS (SELECT *, lower(name) AS t, CASE WHEN semantic <> 'documents' THEN 'not_documents_table' WHEN name = '' THEN 'empty_document_name' WHEN lower(name) = 'наименование документа' THEN 'service_header_row' END AS why FROM cand),
kin AS (SELECT *, CASE {' '.join(f"WHEN {_ANY('t', ws)} THEN '{f}'" for f, ws in _KIN)} ELSE 'other' END AS family FROM why WHERE why IS NULL),
used AS (SELECT *, CASE WHEN contains(t, 'регистрац') OR contains(t, 'проживани') OR contains(t, 'подтверждающ') THEN 'conditional' WHEN family IN ('identity_document', 'application_request') THEN 'always' WHEN category IS NOT NULL THEN 'category_specific' ELSE 'always' END AS use FROM kin),
noted AS (SELECT q, family, use, note, min(place) AS p FROM used WHERE note IS NOT NULL GROUP BY ALL), notes AS (SELECT q, family, use, string_agg(note, '; ' ORDER BY p) AS note FROM noted GROUP BY ALL),
one AS (SELECT q, family, use, count(*) AS n, arg_min(name, place) AS first, arg_min(name, (length(name), lower(name), place)) AS shortest FROM used GROUP BY ALL),
named AS (SELECT q, family, use, CASE family WHEN 'identity_document' THEN 'Паспорт или иной документ, удостоверяющий личность' WHEN 'application_request' THEN CASE WHEN n > 1 THEN 'Заявление' ELSE first END ELSE trim(split_part(shortest, '(', 1)) END AS name, CASE WHEN family = 'authority_document' THEN 2 WHEN use = 'category_specific' THEN 3 WHEN use = 'always' THEN 0 ELSE 1 END AS part, note FROM one LEFT JOIN notes USING (q, family, use)),
placed AS (SELECT *, row_number() OVER (PARTITION BY q, part ORDER BY CASE WHEN part = 2 THEN 1 ELSE 0 END, CASE use WHEN 'always' THEN 0 WHEN 'conditional' THEN 1 ELSE 2 END, lower(name), family) AS nth, name || CASE WHEN q % 3 < 2 AND note IS NOT NULL THEN ' — ' || note ELSE '' END AS told FROM named),
parts AS (SELECT q, part, string_agg(CASE WHEN part = 0 THEN nth || '. ' ELSE '— ' END || told, chr(10) ORDER BY nth) AS lines FROM placed GROUP BY 1, 2),
texts AS (SELECT q, max(lines) FILTER (part = 0) AS p0, max(lines) FILTER (part = 1) AS p1, max(lines) FILTER (part = 2) AS p2, max(lines) FILTER (part = 3) AS p3 FROM parts GROUP BY q),
gone AS (SELECT q, string_agg(place || ':' || why, ',' ORDER BY place) AS dropped FROM why WHERE why IS NOT NULL GROUP BY q), counts AS (SELECT q, count(*) AS n_items FROM named GROUP BY q)
SELECT o_orderkey AS question_id, n_items IS NOT NULL AS can_answer, coalesce(n_items, 0) AS n_items, coalesce(dropped, '') AS dropped, CASE WHEN n_items IS NULL THEN 'no_documents_rows' END AS reason,
  CASE WHEN n_items IS NOT NULL THEN 'Для предоставления услуги ' || CASE o_orderkey % 3 WHEN 0 THEN 'при подаче лично ' WHEN 1 THEN 'при подаче через ЕПГУ ' ELSE '' END || 'обычно требуются следующие документы:' || coalesce(chr(10) || p0, '') || coalesce(chr(10) || chr(10) || '{required_documents.HEADINGS[0]}' || chr(10) || p1, '')
    || coalesce(chr(10) || chr(10) || '{required_documents.HEADINGS[1]}' || chr(10) || p2, '') || coalesce(chr(10) || chr(10) || '{required_documents.HEADINGS[2]}' || chr(10) || p3, '') || chr(10) || chr(10) || '{required_documents.ENDING}' END AS text
FROM orders LEFT JOIN texts ON texts.q = o_orderkey LEFT JOIN gone ON gone.q = o_orderkey LEFT JOIN counts ON counts.q = o_orderkey"""


@query("q73_documents_answers", _PAPERS_ASKED)
def q73(spark, d):
    """Orders as questions for documents, their lines as rows of documents tables."""
    l = V.table(spark, d, "lineitem")
    by = lambda c, values: F.get(F.array(*[F.lit(v) for v in values]), (c % len(values)).cast("int"))
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    cells = F.create_map(F.lit("document_name"), by(F.col("l_partkey"), _PAPER_NAMES), F.lit("applicant_category_id"), F.when(F.col("l_suppkey") % 3 == 0, F.concat(F.lit("K"), (F.col("l_suppkey") % 4).cast("string"))),
                         F.lit("in_person_submission"), F.when(F.col("l_returnflag") == "R", "оригинал").otherwise("копия"), F.lit("epgu_submission"), F.when(F.col("l_linestatus") == "O", "образ").otherwise(""))
    cand = l.select(F.col("l_orderkey").alias("question_id"), place.alias("place"), F.lit("table_row").alias("source_type"), F.concat_ws("-", "l_partkey", "l_suppkey").alias("source_id"), F.when(F.col("l_suppkey") % 7 == 0, "deadlines").otherwise("documents").alias("semantic"), cells.alias("cells"))
    asked = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("question_id"), by(F.col("o_orderkey"), _HANDED).alias("channel"))
    out = required_documents.answers(asked, cand)
    told = F.coalesce(F.array_join(F.transform("dropped", lambda x: F.concat_ws(":", x["place"].cast("string"), x["reason"])), ","), F.lit(""))
    return out.select("question_id", "can_answer", F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), told.alias("dropped"), "reason", "text")


_WARNED = r"""b AS (SELECT document_id, count(*) AS n_blocks, sum(length(content)) AS chars, arg_min(content, block_order) AS title FROM blocks GROUP BY 1),
tb AS (SELECT document_id, count(*) AS n_tables, count(*) FILTER (title LIKE '5%') AS n_untitled, count(*) FILTER (table_type = 'generic') AS n_untyped FROM tabs GROUP BY 1), fc AS (SELECT document_id, count(*) AS n_facts, count(DISTINCT measure_code) FILTER (measure_code <> 'Brand#1') AS n_measures FROM facts GROUP BY 1),
m AS (SELECT doc_id, length(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))) AS chars_, len(regexp_extract_all(coalesce(text, ''), '[A-Za-z]')) AS latin, CASE WHEN doc_id % 3 <> 0 THEN source END AS uid, doc_id % 4 <> 0 AS dated, coalesce(n_blocks, 0) AS nb, chars / n_blocks AS avg_, b.title, coalesce(n_tables, 0) AS nt, coalesce(n_untitled, 0) AS nu, coalesce(n_untyped, 0) AS ny, coalesce(n_facts, 0) AS nf, coalesce(n_measures, 0) AS nm
  FROM documents LEFT JOIN b ON b.document_id = doc_id LEFT JOIN tb ON tb.document_id = doc_id LEFT JOIN fc ON fc.document_id = doc_id)
SELECT doc_id AS document_id, array_to_string(list_filter([CASE WHEN chars_ > 0 AND latin = 0 THEN 'detected_language_code_missing' END, CASE WHEN title IS NULL THEN 'document_title_missing' END, CASE WHEN uid IS NULL THEN 'doc_uid_base_missing' END, CASE WHEN NOT dated THEN 'revision_date_missing' END, CASE WHEN nb = 0 THEN 'other_block_ratio_too_high' END,
  CASE WHEN round(avg_, 2) < 20 THEN 'avg_block_text_length_too_low' END, CASE WHEN nu > 0 THEN 'some_tables_without_title' END, CASE WHEN ny > 0 THEN 'some_tables_with_unknown_type' END, 'document_type_missing', 'source_authority_missing', CASE WHEN nf = 0 THEN 'legal_facts_missing' END, CASE WHEN nm = 0 THEN 'measure_codes_missing' END, CASE WHEN nb + nt + nf < 3 THEN 'retrievable_units_count_low' END], lambda x: x IS NOT NULL), ',') AS warnings FROM m"""


@query("q74_qc_warnings", with_views(_WARNED, "blocks", "tables", "facts"))
def q74(spark, d):
    """Documents with their tables and facts: every third has no uid, every fourth no date; low priorities are no titles."""
    docs = V.table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), "text", "source")
    i = F.col("document_id")
    blocks = V.blocks(spark, d)
    tabs = V.tables(spark, d).select("document_id", F.when(~F.col("title").startswith("5"), F.col("title")).alias("title"), F.when(F.col("table_type") != "generic", F.col("table_type")).alias("table_type"))
    facts = V.facts(spark, d).groupBy("document_id").agg(F.count("*").alias("n_facts"), F.count_distinct(F.when(F.col("measure_code") != "Brand#1", F.col("measure_code"))).alias("n_measures"))
    titles = blocks.groupBy("document_id").agg(F.min_by("content", "block_order").alias("title"))
    own = ingest.qc_metrics(docs.select("document_id", "text"), blocks).join(ingest.table_figures(docs, tabs), "document_id").join(facts, "document_id", "left").na.fill(0, ["n_facts", "n_measures"]).join(titles, "document_id", "left")
    told = docs.select("document_id", T.language(F.col("text")).alias("language"), F.when(i % 3 != 0, F.col("source")).alias("doc_uid_base"), F.when(i % 4 != 0, "d").alias("revision_date"), F.lit(None).cast("string").alias("document_type"), F.lit(None).cast("string").alias("authority"))
    own = own.join(told, "document_id").withColumn("n_units", F.col("n_meaningful") + F.col("n_tables") + F.col("n_facts"))
    return own.select("document_id", F.array_join(ingest.qc_warnings(own), ",").alias("warnings"))
