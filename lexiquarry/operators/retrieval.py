"""Lexical retrieval: question bundles, branch scores, merging, reranking, document statistics, selection.

Questions are rows.  Candidates have (question_id, source_type, source_id, document_id, score, rerank_score)
and descriptive columns that may be missing: title, snippet, blob (normalised text), table_semantic_type,
style_name, is_heading_style, has_deadline_value.  Ranks are columns; row order never carries meaning.
"""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans import config as C
from ..plans.config import Config

# ---------------------------------------------------------------- questions


def strategies(spark) -> DataFrame:
    """The strategies as a small table, to be joined on the intent."""
    rows = [(i, s.code, s.facts, s.tables, s.rows, s.blocks, s.documents) for i, s in C.STRATEGIES.items()]
    return spark.createDataFrame(rows, "intent string, strategy string, w_facts double, w_tables double, w_rows double, w_blocks double, max_documents int")


def channel(text: Column, cfg: Config) -> Column:
    """The first submission channel whose markers are there."""
    out = F.lit(None).cast("string")
    for name, markers in reversed(cfg.channels):
        out = F.when(T.contains_any(text, markers), name).otherwise(out)
    return out


def question_kind(text: Column, cfg: Config) -> Column:
    """The kind of deadline asked for: the first kind whose markers are there, else "other"."""
    out = F.lit("other")
    for name, markers in reversed(cfg.question_kinds):
        out = F.when(T.contains_any(text, markers), name).otherwise(out)
    return out


def candidate_kind(text: Column, cfg: Config) -> Column:
    """The kind with the most markers; ties go to the kind listed first; none: "other"."""
    counts = [(name, T.count_markers(text, markers)) for name, markers in cfg.candidate_kinds]
    most = F.greatest(F.lit(0), F.lit(0), *[c for _, c in counts])
    out = F.lit("other")
    for name, c in reversed(counts):
        out = F.when(c == most, name).otherwise(out)
    return F.when(most > 0, out).otherwise("other")


def profile(text: Column, intent: Column, cfg: Config) -> Column:
    asks = T.contains_any(text, cfg.profile_markers)
    by_channel = channel(text, cfg).isNotNull()
    return F.when(intent == "deadline", "deadline").when((intent == "documents") & asks, F.when(by_channel, "documents_by_submission_channel").otherwise("documents_base"))


def _words(words) -> Column:
    return F.array(*[F.lit(w) for w in words]).cast("array<string>")


def column_hints(prof: Column, chan: Column, kind: Column, cfg: Config) -> Column:
    out = _words(())
    base = cfg.column_hints.get("documents_base", ())
    for name in [n for n, _ in cfg.channels]:
        out = F.when((prof == "documents_by_submission_channel") & (chan == name), _words(cfg.column_hints.get(f"channel:{name}", base))).otherwise(out)
    for k in ("decision", "notification", "payment", "other"):
        own = cfg.column_hints.get("deadline", ()) + cfg.column_hints.get(f"deadline:{k}", ())
        out = F.when((prof == "deadline") & (kind == k), _words(own)).otherwise(out)
    return F.when(prof == "documents_base", _words(base)).otherwise(out)


def bundle(questions: DataFrame, cfg: Config, *, most_terms: int = 24) -> DataFrame:
    """(question_id, text, intent, measure_code?) with norm, channel, kind, profile, hints, scope_hints and terms."""
    norm = T.normalize(F.col("text"))
    q = questions.withColumn("norm", norm).withColumn("channel", channel(norm, cfg)).withColumn("kind", question_kind(norm, cfg))
    q = q.withColumn("profile", profile(F.col("norm"), F.col("intent"), cfg))
    q = q.withColumn("hints", column_hints(F.col("profile"), F.col("channel"), F.col("kind"), cfg))
    q = q.withColumn("scope_hints", F.when((F.col("intent") == "documents") & F.col("profile").isNotNull(), _words(("required_documents", "documents_for_service"))).otherwise(_words(())))
    parts = [T.terms(F.col("norm"), cfg.stop_words, cfg.short_words)]
    if "measure_code" in questions.columns:
        parts.append(F.array(T.normalize(F.col("measure_code"))))
    for key, words in cfg.expansion.items():
        intent, _, part = key.partition(":")
        if key in C.INTENTS or intent in C.INTENTS:
            applies = F.col("intent") == intent
            if part:
                applies = applies & ((F.col("kind") if intent == "deadline" else F.col("channel")) == part)
        else:
            applies = F.contains("norm", F.lit(key))
        parts.append(F.when(F.coalesce(applies, F.lit(False)), _words(words)).otherwise(_words(())))
    parts.append(F.col("hints"))
    every = F.transform(F.concat(*parts), T.normalize)
    return q.withColumn("terms", F.slice(F.array_distinct(F.filter(every, lambda t: t != "")), 1, most_terms))


# ---------------------------------------------------------------- branches


def term_score(terms: Column, weight: float, columns: list[Column], sql_terms: int = C.SQL_TERMS) -> Column:
    """``weight`` for each of the first terms that one of the columns has, as ILIKE '%term%' finds it.

    Terms aren't escaped: ``%`` and ``_`` in them stay wildcards.  Terms without them are looked up as plain
    substrings of the lower-cased columns, which needs no pattern.
    """
    lowered = F.array(*[F.lower(c.cast("string")) for c in columns])
    hit = lambda t: F.coalesce(F.exists(lowered, lambda c: F.when(t.rlike("[%_]"), F.like(c, F.concat(F.lit("%"), F.lower(t), F.lit("%")))).otherwise(F.contains(c, F.lower(t)))), F.lit(False))
    return F.aggregate(F.slice(terms, 1, sql_terms), F.lit(0.0), lambda s, t: s + F.when(hit(t), weight).otherwise(0.0))


def term_hits(terms: Column, columns: list[Column], wild: Column | None = None) -> Column:
    """Which of these lower-case terms a row has, as ILIKE '%term%' finds them (see ``term_score``).

    ``terms`` are looked up as substrings of the lower-cased columns, ``wild`` ones as patterns.  The text is lower-cased once
    a row: it is bound to a variable outside of the loop over terms.
    """
    one = F.lower(F.concat_ws("\x00", *[c.cast("string") for c in columns]))  # no term holds U+0000
    hits = F.get(F.transform(F.array(one), lambda c: F.filter(terms, lambda t: F.contains(c, t))), F.lit(0))
    if wild is None:
        return hits
    cells = F.array(*[F.lower(c.cast("string")) for c in columns])
    like = lambda t: F.coalesce(F.exists(cells, lambda c: F.like(c, F.concat(F.lit("%"), t, F.lit("%")))), F.lit(False))
    return F.concat(hits, F.filter(wild, like))


def hit_score(terms: Column, hits: Column, weight: float, sql_terms: int = C.SQL_TERMS) -> Column:
    """``weight`` for each of a question's first terms that is among the row's hits."""
    return weight * F.size(F.filter(F.slice(terms, 1, sql_terms), lambda t: F.array_contains(hits, t)))


def exact_or_null(c: Column, wanted: Column) -> Column:
    """True where nothing is wanted, the column is null, or they are equal."""
    return wanted.isNull() | c.isNull() | (c == wanted)


def json_exact_or_null(record: Column, path: str, wanted: Column) -> Column:
    """The value at a path of a JSON text is the one wanted, or is missing; all rows if none is wanted."""
    value = F.get_json_object(record, path)
    return wanted.isNull() | value.isNull() | (value == wanted)


def json_holds(record: Column, term: Column) -> Column:
    """The term stands anywhere in a JSON text, names included, in either case."""
    return F.contains(F.lower(F.coalesce(record, F.lit(""))), F.lower(term))


def fact_boost(intent: Column, fact_type: Column, measure: Column | None = None, wanted: Column | None = None, subject: Column | None = None, wanted_subject: Column | None = None) -> Column:
    out = F.lit(0.0)
    if measure is not None:
        out = out + F.when(measure == wanted, 1.0).otherwise(0.0)
    if subject is not None:
        out = out + F.when(subject == wanted_subject, 0.7).otherwise(0.0)
    for name, kinds in C.FACT_TYPES.items():
        out = out + F.when((intent == name) & fact_type.isin(*kinds), 0.9).otherwise(0.0)
    return out


def table_boost(table_type: Column, kinds=C.BOOSTED_TABLE_TYPES) -> Column:
    return F.when(table_type.isin(*kinds), 0.25).otherwise(0.0)


def block_boost(intent: Column, block_type: Column) -> Column:
    out = F.when(block_type.isin(*C.OTHER_BLOCK_TYPES[0]), C.OTHER_BLOCK_TYPES[1]).otherwise(0.0)
    for name, (kinds, w) in C.BLOCK_TYPES.items():
        out = F.when(intent == name, F.when(block_type.isin(*kinds), w).otherwise(0.0)).otherwise(out)
    return out


def strategy_weight(intent: Column, branch: str) -> Column:
    out = F.lit(C.STRATEGIES["other"].weight(branch))
    for name, s in C.STRATEGIES.items():
        out = F.when(intent == name, s.weight(branch)).otherwise(out)
    return out


def top_k(scored: DataFrame, k: int, *order) -> DataFrame:
    """The ``k`` first of each question; partial limits are kept in every task before the shuffle."""
    w = Window.partitionBy("question_id").orderBy(*(order or (F.desc("score"), F.asc("source_id"))))
    return scored.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def branch(questions: DataFrame, children: DataFrame, registry: DataFrame, kind: str, columns: list[str], *, weight: float | None = None, boost: Column | None = None, boost_keys: tuple[Column, Column] | None = None, k: int | None = None, keep: Column | None = None) -> DataFrame:
    """One branch: active documents' children scored for every question, the best ``k`` above zero.

    Rows and questions meet by equal keys, never all with all: the keys are the terms that a row has among all questions'
    distinct terms, and ``boost_keys``, arrays of strings of the row and of the question: a boost above zero needs a shared
    one, and what ``boost`` and ``keep`` see of a row is told by its keys.  So rows of the same keys and terms have the same
    score for a question, and the first ``k`` of them in order are enough, whatever the question: these limits are kept in
    every task before the one shuffle of rows.  Of the keys that a pair shares only the first leads to it, so it comes once.

    The questions' distinct terms travel as one row.  The limit comes before the test for positive scores.
    """
    k = k or C.TOP_K[kind]
    active = registry.filter(F.col("status") == "active").select("document_id")
    none = F.array().cast("array<string>")
    row_keys, question_keys = boost_keys or (none, none)
    named = lambda terms: F.transform(terms, lambda t: F.concat(F.lit("term:"), t))
    questions = questions.withColumn("first_terms", F.transform(F.slice("terms", 1, C.SQL_TERMS), F.lower))
    questions = questions.withColumn("question_keys", F.array_distinct(F.concat(named("first_terms"), question_keys)))
    term, wild = F.col("term"), F.contains("term", F.lit("%")) | F.contains("term", F.lit("_"))
    wanted = questions.select(F.explode("first_terms").alias("term")).agg(F.array_sort(F.collect_set(F.when(~wild, term))).alias("plain_terms"), F.array_sort(F.collect_set(F.when(wild, term))).alias("wild_terms"))
    rows = children.join(F.broadcast(wanted), F.lit(True)).withColumn("term_hits", term_hits(F.col("plain_terms"), [F.col(c) for c in columns], F.col("wild_terms"))).drop("plain_terms", "wild_terms")  # one row
    rows = rows.withColumn("row_keys", F.concat(named("term_hits"), row_keys)).filter(F.size("row_keys") > 0).join(active, "document_id", "left_semi")
    alike = Window.partitionBy(F.array_join("row_keys", "\x00")).orderBy("source_id")
    few = rows.withColumn("nth", F.row_number().over(alike)).filter(F.col("nth") <= k).drop("nth")
    pairs = few.withColumn("key", F.explode("row_keys")).join(questions.withColumn("key", F.explode("question_keys")), "key")
    pairs = pairs.filter((F.try_element_at(F.array_intersect("row_keys", "question_keys"), F.lit(1)) == F.col("key")) & (F.lit(True) if keep is None else keep))
    score = F.round(hit_score(F.col("first_terms"), F.col("term_hits"), C.TERM_WEIGHT[kind] if weight is None else weight) + (F.lit(0.0) if boost is None else boost), 6)
    found = top_k(pairs.withColumn("score", score * strategy_weight(F.col("intent"), kind)).drop("key", "row_keys", "question_keys", "term_hits", "first_terms"), k)
    return found.filter("score > 0").withColumn("source_type", F.lit(kind))


def keys_of(**parts: Column) -> Column:
    """Keys for ``boost_keys``: name:value of each part, a column or an array of values; nulls give none."""
    def named(name: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.concat(F.lit(f"{name}:"), v.cast("string")))

    one = [named(name, c) for name, c in parts.items()]
    return F.array_compact(F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in one]))


def fact_keys(fact_type: Column, measure: Column, intent: Column, wanted: Column, subject: Column | None = None, wanted_subject: Column | None = None) -> tuple[Column, Column]:
    """The keys of ``fact_boost``, rows' and questions'."""
    kinds = _words(())
    for name, own in C.FACT_TYPES.items():
        kinds = F.when(intent == name, _words(own)).otherwise(kinds)
    none = F.lit(None).cast("string")
    row = keys_of(measure=F.array(measure), type=F.array(fact_type), subject=F.array(none if subject is None else subject))
    return row, keys_of(measure=F.array(wanted), type=kinds, subject=F.array(none if wanted_subject is None else wanted_subject))


def table_keys(table_type: Column, kinds=C.BOOSTED_TABLE_TYPES) -> tuple[Column, Column]:
    return keys_of(type=F.array(F.when(table_type.isin(*kinds), table_type))), keys_of(type=_words(kinds))


def block_keys(intent: Column, block_type: Column) -> tuple[Column, Column]:
    kinds = _words(C.OTHER_BLOCK_TYPES[0])
    for name, (own, _) in C.BLOCK_TYPES.items():
        kinds = F.when(intent == name, _words(own)).otherwise(kinds)
    return keys_of(type=F.array(block_type)), keys_of(type=kinds)


# ---------------------------------------------------------------- merging and filters


def type_rank(c: Column) -> Column:
    return reduce(lambda out, kv: F.when(c == kv[0], kv[1]).otherwise(out), C.TYPE_RANK.items(), F.lit(0))


def merge(candidates: DataFrame) -> DataFrame:
    """The best of equal (type, id), ranked by score, then type, then id."""
    one = Window.partitionBy("question_id", "source_type", "source_id").orderBy(F.desc("score"))
    kept = candidates.withColumn("_n", F.row_number().over(one)).filter("_n = 1").drop("_n")
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), type_rank(F.col("source_type")).desc(), "source_id")
    return kept.withColumn("merge_rank", F.row_number().over(order))


def type_factor(source_type: Column) -> Column:
    return reduce(lambda out, kv: F.when(source_type == kv[0], kv[1]).otherwise(out), C.TYPE_FACTOR.items(), F.lit(1.0))


def header_noise(snippet: Column, blob: Column, cfg: Config, style: Column | None = None, heading: Column | None = None) -> Column:
    """Blocks that are headings, captions or front matter."""
    s = F.trim(F.coalesce(snippet, F.lit("")))
    n = F.char_length(s)
    out = (blob == "") | F.lower(s).isin(*cfg.header_exact) | (n <= 40)
    if heading is not None:
        out = out | F.coalesce(heading, F.lit(False))
    if style is not None:
        out = out | F.contains(F.lower(F.coalesce(style, F.lit(""))), F.lit("title"))
    return out | ((n <= 180) & (T.upper_ratio(s) >= 0.60)) | ((n <= 220) & T.contains_any(blob, cfg.header_words))


def documents_anchor(blob: Column, terms: Column, cfg: Config) -> Column:
    found = T.count_markers(blob, cfg.documents_anchor) + F.size(F.filter(terms, lambda t: (F.char_length(t) >= 4) & F.contains(blob, t))) + T.count_markers(blob, cfg.double_anchor)
    return found >= 2


def lexical_hits(blob: Column, terms: Column) -> Column:
    return F.size(F.filter(terms, lambda t: (F.char_length(t) >= 3) & F.contains(blob, t)))


def intent_filter(source_type: Column, intent: Column, blob: Column, terms: Column, cfg: Config) -> Column:
    """Only blocks are filtered: documents by anchors, deadlines and forms by one hit, refusals and eligibility by two."""
    hits = lexical_hits(blob, terms)
    passes = F.when(intent == "documents", documents_anchor(blob, terms, cfg)).when(intent.isin("deadline", "form"), hits >= 1).when(intent.isin("rejection", "eligibility"), hits >= 2).otherwise(True)
    return (source_type != "block") | passes


def temporal(blob: Column, cfg: Config) -> Column:
    return T.contains_any(blob, cfg.temporal) | (blob.rlike("[0-9]") & T.contains_any(blob, cfg.temporal_units))


def deadline_noise(blob: Column, semantic_type: Column, has_value: Column, cfg: Config) -> Column:
    wrong = F.coalesce(semantic_type.isin(*cfg.deadline_noise_types), F.lit(False)) & ~has_value if cfg.deadline_noise_types else F.lit(False)
    return wrong | T.contains_any(blob, cfg.abbreviations) | T.contains_any(blob, cfg.refusal_texts)


def service_row(blob: Column, cfg: Config) -> Column:
    return T.contains_any(blob, cfg.service_documents) & ~T.contains_any(blob, cfg.real_documents)


def service_deadline_row(cells: Column, blob: Column, cfg: Config) -> Column:
    words = F.array(*[F.lit(w) for w in cfg.service_deadlines]).cast("array<string>")
    in_cells = F.coalesce(F.exists(F.map_values(cells), lambda v: F.array_contains(words, T.normalize(v))), F.lit(False))
    return in_cells | (F.startswith(blob, F.lit("срок ")) & (F.size(F.split(blob, " ")) <= 4))


def required_documents(blob: Column, cfg: Config) -> Column:
    return T.count_markers(blob, cfg.required_documents) >= 2


def channel_match(blob: Column, chan: Column, cfg: Config) -> Column:
    out = F.lit(False)
    for name, markers in cfg.channel_matches.items():
        out = out | ((chan == name) & T.contains_any(blob, markers))
    return F.coalesce(out, F.lit(False))


def blob(*parts: Column) -> Column:
    """The normalised text of a candidate: strings, arrays and maps (keys and values) in order."""
    return T.normalize(F.concat_ws(" ", *parts))


# ---------------------------------------------------------------- reranking


def _by(source_type: Column, row: float, table: float, other: float = 0.0) -> Column:
    return F.when(source_type == "table_row", row).when(source_type == "table", table).otherwise(other)


def rerank_score(cfg: Config, *, kind: Column, intent: Column, text: Column, terms: Column, base: Column, semantic: Column, has_value: Column, chan: Column, hints: Column, asked: Column, service: Column | None = None) -> Column:
    """``base`` plus the increments of the intent, rounded to six digits.  ``kind`` is the source type."""
    when = lambda c, v: F.when(F.coalesce(c, F.lit(False)), v).otherwise(0.0)
    semantic = F.coalesce(semantic, F.lit(""))
    deadlines = semantic.isin("deadline", "deadlines")
    is_row, is_block = kind == "table_row", kind == "block"
    docs = (when(semantic == "documents", _by(kind, 0.65, 0.35)) + when(T.contains_any(text, cfg.abbreviations), _by(kind, -1.10, -0.90, -0.40))
            + when(service_row(text, cfg), _by(kind, -0.60, -0.30)) + when(required_documents(text, cfg), _by(kind, 0.45, 0.25))
            + when(documents_anchor(text, terms, cfg), 0.18) + when(channel_match(text, chan, cfg), 0.16)
            + when(F.exists(hints, lambda h: (h != "") & F.contains(text, h)), 0.08))
    dated, own = temporal(text, cfg), candidate_kind(text, cfg)
    undated = F.when(is_block, -0.90).when(is_row & ~has_value, -0.60).when((kind == "table") & ~deadlines, -0.60).otherwise(0.0)
    stem = F.contains(text, F.lit(cfg.notification_stem))
    due = (when(deadline_noise(text, semantic, has_value, cfg), -1.20) + when(deadlines, _by(kind, 0.45, 0.22)) + when(has_value, 0.30)
           + F.when(dated, F.when(is_block, 0.42).when(is_row, 0.22).otherwise(0.12)).otherwise(undated)
           + when(is_row & ~has_value & ~deadlines, -0.70) + (when(service, _by(kind, -0.55, -0.25, -0.10)) if service is not None else F.lit(0.0))
           + F.when((asked != "other") & (own == asked), 0.55).when((asked != "other") & (own != "other"), -0.30).otherwise(0.0)
           + when((asked == "notification") & stem, 0.16) + when((asked == "notification") & (own == "decision") & ~stem, -0.25)
           + when((asked == "payment") & T.contains_any(text, cfg.monthly), 0.24) + when((asked == "payment") & (own == "decision") & ~dated, -0.30)
           + when((asked == "decision") & F.contains(text, F.lit(cfg.decision_phrase)), 0.16))
    more = F.when(intent == "documents", docs).when(intent == "deadline", due).when(intent == "rejection", when(T.contains_any(text, cfg.rejection), 0.18)).when(intent == "eligibility", when(T.contains_any(text, cfg.eligibility), 0.18)).otherwise(0.0)
    return F.round(base + _by(kind, 0.05, 0.03) + more, 6)


def rerank(candidates: DataFrame, score: Column) -> DataFrame:
    """``rerank_score`` and the rank by it; ties keep the merged order behind the stated keys."""
    order = Window.partitionBy("question_id").orderBy(F.desc("rerank_score"), F.desc("score"), (F.col("source_type") == "block").cast("int").desc(), (F.col("source_type") == "table_row").cast("int").desc(), "merge_rank")
    return candidates.withColumn("rerank_score", score).withColumn("rank", F.row_number().over(order) - 1)


def reranked_by(candidates: DataFrame, plug_in, schema: str) -> DataFrame:
    """A reranker of one's own: a pandas function of one question's candidates."""
    return candidates.groupBy("question_id").applyInPandas(plug_in, schema)


def effective_score() -> Column:
    return F.coalesce("rerank_score", "score")


# ---------------------------------------------------------------- documents


def document_stats(candidates: DataFrame) -> DataFrame:
    s = effective_score()
    stats = candidates.groupBy("question_id", *[c for c in ("intent",) if c in candidates.columns], "document_id").agg(
        F.count("*").alias("n_candidates"), F.greatest(F.max(s), F.lit(0.0)).alias("best"), F.sum(s).alias("total"), F.sum(s / (1 + 0.15 * F.col("rank"))).alias("discounted"),
        F.array_sort(F.collect_set("source_type")).alias("types"), F.min("rank").alias("first_rank"))
    return stats.withColumn("doc_score", F.col("discounted") + 0.60 * F.col("best") + 0.12 * F.least(F.col("n_candidates"), F.lit(4)) + 0.08 * F.size("types"))


def document_limit(intent: Column) -> Column:
    """How many priority documents the intent's strategy allows."""
    out = F.lit(C.STRATEGIES["other"].documents)
    for name, s in C.STRATEGIES.items():
        out = F.when(intent == name, s.documents).otherwise(out)
    return out


def strategy_code(intent: Column) -> Column:
    out = F.lit(C.STRATEGIES["other"].code)
    for name, s in C.STRATEGIES.items():
        out = F.when(intent == name, s.code).otherwise(out)
    return out


def priority_documents(stats: DataFrame, *, max_documents: Column | int | None = None) -> DataFrame:
    """The first document, and the second if it scores enough beside it and the strategy allows: place 1 and maybe 2.

    ``stats`` has intent, by which the strategy's limit is known, unless ``max_documents`` says another.
    """
    max_documents = document_limit(F.col("intent")) if max_documents is None else max_documents
    order = Window.partitionBy("question_id").orderBy(F.desc("doc_score"), F.desc("best"), F.desc("n_candidates"), "first_rank", "document_id")
    ranked = stats.withColumn("place", F.row_number().over(order)).filter("place <= 2")
    first = F.max(F.when(F.col("place") == 1, F.col("doc_score"))).over(Window.partitionBy("question_id"))
    limit = max_documents if isinstance(max_documents, Column) else F.lit(max_documents)
    return ranked.withColumn("_first", first).filter((F.col("place") == 1) | ((limit >= 2) & (F.col("doc_score") >= F.greatest(F.lit(0.75), 0.62 * F.col("_first"))))).drop("_first")


def adaptive_threshold(intent: Column, best: Column) -> Column:
    """The intent's base, or less: 0.35 of the best score of the first document, 0.25 at least."""
    base = F.when(intent.isin("documents", "deadline", "form"), 0.45).when(intent.isin("eligibility", "rejection"), 0.40).otherwise(0.35)
    return F.when(best.isNull(), base).otherwise(F.least(base, F.greatest(F.lit(0.25), 0.35 * best)))


def type_cap(intent: str, source_type: str, k: int) -> int:
    caps = {
        "documents": {"legal_fact": 1, "table": min(2, k), "table_row": min(max(10, k), 14), "block": 1},
        "deadline": {"legal_fact": 1, "table": 1, "table_row": min(4, k), "block": min(6, k)},
    }
    other = {t: 4 if t == "table" else max(2, min(5, k)) for t in C.BRANCHES}
    return caps.get(intent, other)[source_type]


def document_caps(intent: str) -> tuple[int, int]:
    return {"documents": (12, 4), "deadline": (8, 3)}.get(intent, (6, 3))


def selection_bucket(intent: Column, source_type: Column, semantic: Column, priority: Column, dated: Column, kind: Column, asked: Column, noise: Column) -> Column:
    """The order of selection within a question, lower first; one bucket for intents that keep the ranks' order."""
    is_row, is_block, due = source_type == "table_row", source_type == "block", semantic == "deadlines"
    documents = F.when(priority & is_row & (semantic == "documents"), 0).when(priority & (source_type == "table") & (semantic == "documents"), 1).when(priority, 2).otherwise(3)
    match = (kind == asked) & (asked != "other")
    deadline = (F.when(noise, 9).when(priority & is_block & dated & match, 0).when(priority & is_row & due & match, 1).when(priority & is_block & dated, 2)
                .when(priority & is_row & due, 3).when(priority & dated, 4).when(is_block & dated, 5).when(is_row & due, 6).when(dated, 7).otherwise(8))
    return F.when(intent == "documents", documents).when(intent == "deadline", deadline).otherwise(0)


def selectable(intent: Column, source_type: Column, semantic: Column, dated: Column, noise: Column) -> Column:
    """What a deadline question may take at all: no noise, only dated blocks and rows, only deadline tables."""
    due = semantic.isin("deadline", "deadlines")
    fits = ~noise & F.when(source_type.isin("block", "table_row"), dated).when(source_type == "table", due).otherwise(True)
    return (intent != "deadline") | F.coalesce(fits, F.lit(False))


def select_capped(candidates: DataFrame, *, k: int = C.FINAL_TOP_K, backfill_below: int = 3) -> DataFrame:
    """Greedy selection under caps for type, document and total.

    Needs question_id, intent, threshold, bucket, selectable (bool), priority (bool), source_type, source_id,
    document_id, score, rerank_score and rank.  Documents and deadline questions are taken by bucket and score,
    others by rank.  A question has few candidates (the branches' limits), so they are folded in order in one
    array; counters count accepted ones only.  With fewer than ``backfill_below`` accepted, the rest that is
    selectable fills up to ``k`` in the same order, whatever caps and threshold say.
    """
    sorted_by_score = F.col("intent").isin("documents", "deadline")
    item = F.struct(F.col("bucket"), F.when(sorted_by_score, -effective_score()).otherwise(0.0).alias("less"), F.col("rank"), F.col("source_type"), F.col("source_id").cast("string").alias("source_id"), F.col("document_id"), F.col("priority"), effective_score().alias("final_score"))
    one = candidates.filter("selectable").groupBy("question_id", "intent", "threshold").agg(F.array_sort(F.collect_list(item)).alias("items"))
    none = F.slice(F.col("items"), 1, 0)

    def cap_of(x: Column) -> Column:
        out = F.lit(0)
        for t in C.BRANCHES:
            cap = F.lit(type_cap("other", t, k))
            for intent in ("documents", "deadline"):
                cap = F.when(F.col("intent") == intent, type_cap(intent, t, k)).otherwise(cap)
            out = F.when(x["source_type"] == t, cap).otherwise(out)
        return out

    def document_cap(x: Column) -> Column:
        out = F.when(x["priority"], document_caps("other")[0]).otherwise(document_caps("other")[1])
        for intent in ("documents", "deadline"):
            a, b = document_caps(intent)
            out = F.when(F.col("intent") == intent, F.when(x["priority"], a).otherwise(b)).otherwise(out)
        return out

    def step(acc: Column, x: Column) -> Column:
        fits = ((F.size(acc) < k) & (x["final_score"] >= F.col("threshold")) & (F.size(F.filter(acc, lambda y: y["source_type"] == x["source_type"])) < cap_of(x))
                & (F.size(F.filter(acc, lambda y: y["document_id"] == x["document_id"])) < document_cap(x)))
        return F.when(fits, F.concat(acc, F.array(x))).otherwise(acc)

    one = one.withColumn("chosen", F.aggregate("items", none, step))
    rest = F.filter("items", lambda x: ~F.exists("chosen", lambda y: y["rank"] == x["rank"]))
    full = F.when(F.size("chosen") < min(backfill_below, k), F.concat("chosen", F.slice(rest, F.lit(1), F.lit(k) - F.size("chosen")))).otherwise(F.col("chosen"))
    out = one.select("question_id", "intent", F.posexplode(full).alias("place", "x"))
    return out.select("question_id", "intent", F.col("place").cast("int").alias("place"), "x.source_type", "x.source_id", "x.document_id", "x.final_score", "x.priority", "x.rank")


def evidence_quality(questions: DataFrame, selected: DataFrame, priority: DataFrame, stats: DataFrame) -> DataFrame:
    """question_id, n_items, n_documents, top_share, n_strong, top_score, quality, reason; rules in order.

    ``selected`` has place, document_id and final_score; ``priority`` and ``stats`` (doc_score) are over all
    candidates.  A question without candidates has a row too.
    """
    first = F.min_by(F.struct("document_id", "final_score"), "place")
    per = selected.groupBy("question_id").agg(F.count("*").alias("n_items"), F.count_distinct("document_id").alias("n_documents"), F.count_if(F.col("final_score") >= 0.75).alias("n_strong"), first.alias("first"), F.collect_list("document_id").alias("documents"))
    per = per.withColumn("top_score", F.col("first.final_score")).withColumn("top_share", F.size(F.filter("documents", lambda d: d == F.col("first.document_id"))) / F.col("n_items"))
    leaders = stats.groupBy("question_id").agg(F.slice(F.sort_array(F.collect_list("doc_score"), False), 1, 2).alias("leaders"))
    listed = priority.groupBy("question_id").agg(F.count("*").alias("n_priority"))
    q = questions.select("question_id").join(per, "question_id", "left").join(leaders, "question_id", "left").join(listed, "question_id", "left")
    q = q.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_items", "n_documents", "n_strong", "n_priority")})
    many = F.col("n_documents") > 2
    close = F.coalesce(F.try_element_at("leaders", F.lit(2)) > F.try_element_at("leaders", F.lit(1)) * 0.95, F.lit(False))
    rules = [
        (F.col("n_items") == 0, "insufficient", "no_candidates"), (F.col("top_score") < 0.25, "insufficient", "top_score_too_low"), (F.col("n_items") == 1, "weak", "single_candidate_only"),
        (many & (F.col("n_priority") <= 1), "weak", "document_spread_too_wide"), ((F.col("top_share") < 0.40) & many, "weak", "low_document_concentration"),
        ((F.col("n_strong") == 0) & (F.col("top_score") < 0.55), "weak", "no_strong_candidates"), (close & many, "weak", "no_clear_document_leader"),
    ]
    quality, reason = F.lit("strong"), F.lit("ok")
    for cond, what, why in reversed(rules):
        quality, reason = F.when(cond, what).otherwise(quality), F.when(cond, why).otherwise(reason)
    return q.select("question_id", "n_items", "n_documents", "top_share", "n_strong", "top_score", quality.alias("quality"), reason.alias("reason"))


def settled_for_selection(ranked: DataFrame, stats: DataFrame, priority: DataFrame, cfg: Config, *, semantic: Column, has_value: Column) -> DataFrame:
    """Ranked candidates with priority, threshold, bucket and selectable, as ``select_capped`` takes them."""
    top = priority.filter("place = 1").select("question_id", F.col("best").alias("best_of_first"))
    rows = ranked.join(priority.select("question_id", "document_id", F.lit(True).alias("priority")), ["question_id", "document_id"], "left").withColumn("priority", F.coalesce("priority", F.lit(False))).join(top, "question_id")
    b, kind = F.col("blob"), F.col("source_type")
    dated, noise = temporal(b, cfg), deadline_noise(b, semantic, has_value, cfg)
    rows = rows.withColumn("threshold", adaptive_threshold(F.col("intent"), F.col("best_of_first")))
    rows = rows.withColumn("bucket", selection_bucket(F.col("intent"), kind, semantic, F.col("priority"), dated, candidate_kind(b, cfg), F.col("asked"), noise))
    return rows.withColumn("selectable", selectable(F.col("intent"), kind, semantic, dated, noise))


class Retrieval:
    """The whole way from the branches' candidates to evidence, a DataFrame for each step, built when it is asked for.

    ``candidates``: question_id, intent, source_type, source_id, document_id, score, snippet, blob, terms, asked,
    channel, hints; ``questions``: question_id, intent.  Steps: merge, type factor, header noise, intent filters, rerank,
    document statistics, priority documents, selection under caps, quality, package with metrics.
    """

    def __init__(self, questions: DataFrame, candidates: DataFrame, cfg: Config, *, semantic: Column | None = None, has_value: Column | None = None, k: int = C.FINAL_TOP_K):
        self.questions, self.candidates, self.cfg, self.k = questions, candidates, cfg, k
        self.semantic = F.lit("") if semantic is None else F.coalesce(semantic, F.lit(""))
        self.has_value = F.lit(False) if has_value is None else F.coalesce(has_value, F.lit(False))

    @cached_property
    def merged(self) -> DataFrame:
        return merge(self.candidates).withColumn("score", F.col("score") * type_factor(F.col("source_type")))

    @cached_property
    def ranked(self) -> DataFrame:
        """Kept until the session clears its cache, as several steps read it; a question has 44 candidates at most."""
        b, kind, intent, terms, cfg = F.col("blob"), F.col("source_type"), F.col("intent"), F.col("terms"), self.cfg
        kept = self.merged.filter(~((kind == "block") & header_noise(F.col("snippet"), b, cfg)) & intent_filter(kind, intent, b, terms, cfg))
        score = rerank_score(cfg, kind=kind, intent=intent, text=b, terms=terms, base=F.col("score"), semantic=self.semantic, has_value=self.has_value, chan=F.col("channel"), hints=F.col("hints"), asked=F.col("asked"))
        return rerank(kept, score).persist()

    @cached_property
    def stats(self) -> DataFrame:
        return document_stats(self.ranked).withColumn("doc_score", F.round("doc_score", 6))

    @cached_property
    def priority(self) -> DataFrame:
        return priority_documents(self.stats)

    @cached_property
    def selected(self) -> DataFrame:
        return select_capped(settled_for_selection(self.ranked, self.stats, self.priority, self.cfg, semantic=self.semantic, has_value=self.has_value), k=self.k)

    @cached_property
    def quality(self) -> DataFrame:
        return evidence_quality(self.questions, self.selected, self.priority, self.stats)

    @cached_property
    def package(self) -> DataFrame:
        return evidence_package(self.selected)

    @cached_property
    def metrics(self) -> DataFrame:
        return package_metrics(self.questions, self.candidates, self.merged, self.ranked, self.stats, self.priority, self.selected, self.quality)


def package_metrics(questions: DataFrame, raw: DataFrame, merged: DataFrame, ranked: DataFrame, stats: DataFrame, priority: DataFrame, selected: DataFrame, quality: DataFrame) -> DataFrame:
    """The package's metrics and debug figures, a row a question (question_id, intent): counts by step, leading scores and
    documents, strategy, quality and guard reason.  ``top_document_share`` is the share of the leading document by its
    statistics among the selected."""
    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("question_id").agg(F.count("*").alias(name))

    by_type = [F.count_if(F.col("source_type") == t).alias(f"n_{t}") for t in C.BRANCHES]
    leads = lambda c, n: F.coalesce(F.round(F.try_element_at(F.col(c), F.lit(n)), 4), F.lit(0.0))
    chosen = selected.groupBy("question_id").agg(F.count("*").alias("n_final"), *by_type, F.count_distinct("document_id").alias("n_documents"), F.transform(F.array_sort(F.collect_list(F.struct("place", "final_score"))), lambda x: x["final_score"]).alias("scores"))
    leaders = stats.groupBy("question_id").agg(F.count("*").alias("n_documents_before"), F.slice(F.sort_array(F.collect_list("doc_score"), False), 1, 2).alias("leaders"))
    first = priority.filter("place = 1").select("question_id", F.col("document_id").alias("top_document"))
    share = selected.join(first, "question_id").groupBy("question_id").agg(F.count_if(F.col("document_id") == F.col("top_document")).alias("n_of_top"))
    listed = priority.groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "document_id"))), lambda x: x["document_id"]).alias("priority_document_ids"))
    out = questions.select("question_id", "intent").join(quality.select("question_id", "quality", "reason", "n_strong"), "question_id")
    for part in (counted(raw, "n_raw"), counted(merged, "n_merged"), counted(ranked, "n_reranked"), chosen, leaders, share, listed):
        out = out.join(part, "question_id", "left")
    counts = ["n_raw", "n_merged", "n_reranked", "n_final", *[f"n_{t}" for t in C.BRANCHES], "n_documents", "n_documents_before", "n_strong"]
    return out.select(
        "question_id", strategy_code(F.col("intent")).alias("strategy_code"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts],
        F.coalesce(F.size("priority_document_ids"), F.lit(0)).cast("long").alias("n_priority"), leads("scores", 1).alias("top_candidate_score"), leads("scores", 2).alias("second_candidate_score"),
        leads("leaders", 1).alias("top_document_score"), leads("leaders", 2).alias("second_document_score"), F.coalesce(F.round(F.col("n_of_top") / F.col("n_final"), 4), F.lit(0.0)).alias("top_document_share"),
        "priority_document_ids", F.col("quality").alias("evidence_quality"), F.col("reason").alias("guard_reason"),
    )


def evidence_package(selected: DataFrame) -> DataFrame:
    """Ids by type in order of place, and the documents in the order they come first."""
    item = F.struct("place", "source_type", "source_id", "document_id")
    one = selected.groupBy("question_id").agg(F.array_sort(F.collect_list(item)).alias("items"))

    def ids_of(kind: str) -> Column:
        return F.transform(F.filter("items", lambda x: x["source_type"] == kind), lambda x: x["source_id"]).alias(f"{kind}_ids")

    ids = [ids_of(t) for t in C.BRANCHES]
    return one.select("question_id", F.size("items").alias("n_items"), *ids, F.array_distinct(F.transform("items", lambda x: x["document_id"])).alias("document_ids"))
