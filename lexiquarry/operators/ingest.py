"""From extracted items to blocks, tables, rows, chunks, quality control and publication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Quality thresholds; fixed values.
QC = {"text": 200, "blocks": 3, "meaningful": 2, "empty_ratio": 0.30, "other_ratio": 0.60, "tables_without_rows": 0.20, "unbound_rows": 0.10, "avg_block": 20}
QC_ORDER = ("normalized_text_empty", "normalized_text_too_short", "document_identity_missing", "blocks_missing", "blocks_count_too_low", "meaningful_blocks_count_too_low", "empty_block_ratio_too_high",
            "declared_tables_not_extracted", "table_rows_present_without_tables", "tables_without_rows_ratio_too_high", "rows_without_table_binding_ratio_too_high", "all_table_rows_empty", "no_retrievable_units", "block_order_duplicates_detected")
#: Table types by markers of headers and title, in order, with how many must be there; fixed values.
TABLE_TYPES = (
    ("documents", 2, ("наименование документа", "документы", "перечень документов", "представляемые документы", "способ подачи", "епгу", "личной подаче", "почтовым отправлением", "оригинал", "копия")),
    ("refusal_reasons", 1, ("основания отказа", "отказ", "причины отказа")),
    ("deadlines", 1, ("срок", "рабочих дней", "календарных дней")),
    ("identifiers", 1, ("идентификатор", "условных обозначений", "сокращений")),
    ("form_fields", 1, ("поле формы", "наименование поля")),
)


def blocks(documents: DataFrame, *, key: str = "document_id", text: str = "text") -> DataFrame:
    """Non-empty lines as blocks in order, with the kind that their form tells."""
    rows = documents.select(F.col(key).alias("document_id"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("pos", "raw"))
    rows = rows.withColumn("content", F.trim("raw")).filter("content <> ''")
    return rows.select("document_id", (F.col("pos") + 1).alias("block_order"), "content", block_type(F.col("content")).alias("block_type"), T.clause_number(F.col("content")).alias("clause_number"))


def block_type(c: Column) -> Column:
    return (F.when(c.rlike(r"(?iu)^(таблица|table)\s*(№|n)?\s*\d"), "table_caption").when(c.rlike(r"^([-•*–]|\d+[.)]|[a-zа-я]\))\s"), "list_item")
            .when((F.char_length(c) <= 80) & ~c.rlike(r"[.,;:]$"), "heading").otherwise("paragraph"))


def context_before(items: DataFrame, n: int = 5) -> DataFrame:
    """Items (document_id, item_order, kind, text) with the ``n`` meaningful paragraphs before each, oldest first.

    Paragraphs are numbered; an item meets only the ``n`` last ones before it (a join on document and number),
    so no row carries all that came before.
    """
    good = F.coalesce((F.col("kind") == "paragraph") & (F.char_length(F.trim("text")) >= 2), F.lit(False))
    w = Window.partitionBy("document_id").orderBy("item_order").rowsBetween(Window.unboundedPreceding, -1)
    rows = items.withColumn("_seen", F.coalesce(F.count_if(good).over(w), F.lit(0)))
    paragraphs = rows.filter(good).select("document_id", F.col("_seen").alias("_k"), F.explode(F.sequence(F.lit(1), F.lit(n))).alias("_d"), F.col("text").alias("_t"))
    # the paragraph number k is among the last n of every item that has seen k + 1 to k + n of them
    near = paragraphs.groupBy("document_id", (F.col("_k") + F.col("_d")).alias("_seen")).agg(F.array_sort(F.collect_list(F.struct("_k", "_t"))).alias("_near"))
    out = rows.join(near, ["document_id", "_seen"], "left")
    context = F.coalesce(F.transform("_near", lambda x: x["_t"]), F.array().cast("array<string>"))
    return out.withColumn("context", context).select(*items.columns, "context")


def carry_forward(rows: DataFrame, label: Column, *, table: str = "table_id", order: str = "row_order", default: str = "unknown") -> DataFrame:
    """The last section label above each row of its table."""
    w = Window.partitionBy(table).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("section", F.coalesce(F.last(label, ignorenulls=True).over(w), F.lit(default)))


def unique_keys(headers: DataFrame) -> DataFrame:
    """(table_id, idx, key) → key, key_2, key_3 for repeats."""
    w = Window.partitionBy("table_id", "key").orderBy("idx")
    n = F.row_number().over(w)
    return headers.withColumn("_n", n).withColumn("key", F.when(F.col("_n") > 1, F.concat_ws("_", "key", "_n")).otherwise(F.col("key"))).drop("_n")


def section_group(c: Column) -> Column:
    text = T.normalize(c)
    return F.when(T.contains_any(text, ("обязан представить", "обязательные", "заявитель представляет")), "required").when(T.contains_any(text, ("вправе представить", "по собственной инициативе")), "optional")


def table_type(headers: Column, title: Column) -> Column:
    text = T.normalize(F.concat_ws(" ", title, headers))
    out = F.lit("generic")
    for name, least, markers in reversed(TABLE_TYPES):
        out = F.when(T.count_markers(text, markers) >= least, name).otherwise(out)
    return out


def broken_headers(headers: Column) -> Column:
    return F.exists(headers, lambda h: F.char_length(h) > 80) | (F.size(headers) - F.size(F.array_distinct(headers)) >= 2)


def header_names(headers: Column) -> Column:
    """Keys of headers; generic names where they are broken or empty."""
    named = lambda h, k: F.when(T.token_key(h) == "", F.concat(F.lit("column_"), (k + 1).cast("string"))).otherwise(T.token_key(h))
    generic = F.transform(headers, lambda h, k: F.concat(F.lit("column_"), (k + 1).cast("string")))
    return F.when(broken_headers(headers), generic).otherwise(F.transform(headers, named))


def cell_map(keys: Column, cells: Column) -> Column:
    """A map of the row; of equal keys the last counts, missing cells are empty, surplus ones get column_n."""
    n = F.greatest(F.size(keys), F.size(cells))
    pairs = F.transform(F.sequence(F.lit(1), n), lambda k: F.struct(F.coalesce(F.try_element_at(keys, k), F.concat(F.lit("column_"), k.cast("string"))).alias("key"), T.clean_cell(F.try_element_at(cells, k)).alias("value")))
    last = F.filter(pairs, lambda p, k: ~F.exists(F.slice(pairs, k + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def meaningful_row(cells: Column) -> Column:
    return F.exists(cells, lambda c: ~T.clean_cell(c).rlike(r"^[\s\d.\-–—]*$"))


def row_summary(cells: Column) -> Column:
    return F.array_join(F.filter(F.transform(cells, T.clean_cell), lambda c: c != ""), " | ")


def markdown_preview(headers: Column, rows: Column, n: int = 8) -> Column:
    line = lambda cells: F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda c: F.replace(T.collapse(c), F.lit("|"), F.lit("\\|"))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(headers, lambda h: F.lit("---")), " | "), F.lit(" |"))
    return F.array_join(F.concat(F.array(line(headers), rule), F.transform(F.slice(rows, 1, n), line)), "\n")


def table_title(context: Column) -> Column:
    """The newest line of the context that names a table, else the newest that looks like a caption."""
    newest = F.filter(F.reverse(context), lambda c: F.char_length(c) <= 300)
    named = F.filter(newest, lambda c: c.rlike("(?iu)(таблица|перечень|приложение|table|list)"))
    caption = F.filter(newest, lambda c: ~c.rlike("[.;]$"))
    return F.coalesce(F.try_element_at(named, F.lit(1)), F.try_element_at(caption, F.lit(1)))


def document_uid(title: Column, number: Column) -> Column:
    return F.when(number.isNotNull(), F.concat_ws("__", F.substring(T.token_key(title), 1, 80), T.token_key(number)))


def enrich(c: Column) -> Column:
    """(authority, document_type, language) by patterns over the title and the first 5000 characters."""
    head = F.substring(c, 1, 5000)
    authority = F.when(head.rlike(r"(?iuU)\bминистерств"), "ministry").when(head.rlike(r"(?iuU)\bправительств"), "government")
    kind = F.when(head.rlike(r"(?iuU)\bадминистративн\w+ регламент"), "regulation").when(head.rlike(r"(?iuU)\bприказ\b"), "order").when(head.rlike(r"(?iuU)\bпостановлени"), "resolution")
    return F.struct(authority.alias("authority"), kind.alias("document_type"), T.language(c).alias("language"))


def chunks(documents: DataFrame, *, key: str = "document_id", text: str = "text", most: int = 1200, overlap: int = 200, as_written: bool = False) -> DataFrame:
    """Paragraphs folded to chunks: (document_id, chunk_index, content).

    A paragraph that would take an open chunk above ``most`` characters closes it, and the last ``overlap`` characters of the
    closed chunk open the next one, with a line of their own.  Characters are those of paragraphs and overlap, without the
    line ends between them; a paragraph is never split, so one that is longer than ``most`` stays whole.  Null and
    empty texts have no chunks.  ``as_written``: white space is collapsed first, which leaves one chunk for each document.
    """
    if overlap >= most:
        raise ValueError("the overlap must be smaller than a chunk")
    body = F.coalesce(F.col(text), F.lit(""))
    if as_written:
        cs = F.filter(F.array(T.collapse(body)), lambda c: c != "")
    else:
        paragraphs = F.filter(F.transform(F.split(body, r"\n+"), T.collapse), lambda p: p != "")
        state = lambda done, open_, n: F.struct(done.alias("done"), open_.alias("open"), n.alias("n"))

        def step(acc: Column, p: Column) -> Column:
            line, size = F.concat(F.lit("\n"), p), F.char_length(p)
            tail = F.right(acc["open"], F.lit(overlap))
            return (F.when(acc["open"] == "", state(acc["done"], p, size))
                    .when(acc["n"] + size > most, state(F.concat(acc["done"], F.array(acc["open"])), F.concat(tail, line), F.char_length(tail) + size))
                    .otherwise(state(acc["done"], F.concat(acc["open"], line), acc["n"] + size)))

        cs = F.aggregate(paragraphs, state(F.array().cast("array<string>"), F.lit(""), F.lit(0)), step, lambda acc: F.when(acc["open"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))))
    return documents.select(F.col(key).alias("document_id"), F.posexplode(cs).alias("chunk_index", "content"))


def chunk_rows(documents: DataFrame, **kw) -> DataFrame:
    """``chunks`` with the hash of their text and an id from document and place: the same for every run."""
    own = chunks(documents, **kw)
    return own.withColumn("chunk_hash", F.sha2("content", 256)).withColumn("block_id", F.sha2(F.concat_ws("|", F.col("document_id").cast("string"), "chunk_index", "chunk_hash"), 256))


def ingest_chunks(documents: DataFrame, folder: str, provider=None, *, model: str = "hashed", dimension: int | None = None, **kw) -> DataFrame:
    """Documents to stored chunks and their embeddings; what is there already, by (document, place, hash), is left out.

    Only absent chunks are embedded, in batches, and both tables are one commit (``store``), so a run that is cut off leaves
    nothing half done, and a rerun adds nothing.  Documents whose text has changed get their new chunks beside the old
    ones.  Returns (document_id, chunks_created) of what was added.
    """
    from ..sources import embedding
    from . import store

    spark = documents.sparkSession
    new = chunk_rows(documents, **kw)
    known = store.read(spark, folder, "document_block")
    if known is not None:
        new = new.join(known.select("block_id"), "block_id", "left_anti")
    batch = store.new_batch()
    with store.commit(spark, folder, batch) as add:
        blocks_ = add("document_block", new)
        vector = embedding.embed(spark, F.col("content"), provider or embedding.hashed, dimension=dimension or embedding.DIMENSION)
        add("document_block_embedding", blocks_.select("block_id", "document_id", vector.alias("embedding"), F.lit(model).alias("embedding_model")))
    return blocks_.groupBy("document_id").agg(F.count("*").alias("chunks_created"))


def qc_metrics(documents: DataFrame, block_rows: DataFrame, table_rows: DataFrame | None = None, tables: DataFrame | None = None) -> DataFrame:
    """Figures of each document; ``block_rows`` has document_id, block_order, content, block_type."""
    b = block_rows.withColumn("_t", F.trim(F.coalesce("content", F.lit("")))).groupBy("document_id").agg(
        F.count("*").alias("n_blocks"), F.count_if(F.col("_t") == "").alias("n_empty"), F.count_if(F.lower(F.coalesce("block_type", F.lit(""))).isin("other", "unknown", "")).alias("n_other"),
        F.sum(F.char_length("_t")).alias("chars"), (F.count("block_order") != F.count_distinct("block_order")).alias("duplicate_order"))
    out = documents.select("document_id", F.char_length(T.collapse(F.coalesce("text", F.lit("")))).alias("text_chars")).join(b, "document_id", "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_blocks", "n_empty", "n_other", "chars")}).withColumn("duplicate_order", F.coalesce("duplicate_order", F.lit(False)))
    out = out.withColumn("n_meaningful", F.col("n_blocks") - F.col("n_empty"))
    ratio = lambda c: F.when(F.col("n_blocks") > 0, F.col(c) / F.col("n_blocks")).otherwise(1.0)
    out = out.withColumn("empty_ratio", F.round(ratio("n_empty"), 4)).withColumn("other_ratio", F.round(ratio("n_other"), 4))
    out = out.withColumn("avg_block", F.when(F.col("n_meaningful") > 0, F.round(F.col("chars") / F.col("n_meaningful"), 2)).otherwise(0.0))
    if tables is not None and table_rows is not None:
        per_table = tables.join(table_rows.groupBy("table_id").agg(F.count("*").alias("n")), "table_id", "left").groupBy("document_id").agg(F.count("*").alias("n_tables"), F.count_if(F.col("n").isNull()).alias("n_without_rows"))
        empty = F.coalesce(F.trim("row_text"), F.lit("")) == "" if "row_text" in table_rows.columns else F.lit(False)
        per_row = table_rows.join(tables.select("table_id").withColumn("_known", F.lit(True)), "table_id", "left").groupBy("document_id").agg(F.count("*").alias("n_rows"), F.count_if(F.col("_known").isNull()).alias("n_unbound"), F.count_if(empty).alias("n_empty_rows"))
        out = out.join(per_table, "document_id", "left").join(per_row, "document_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_tables", "n_without_rows", "n_rows", "n_unbound", "n_empty_rows")})
    return out


def qc_verdict(metrics: DataFrame, *, has_identity: Column | None = None, limits: dict = QC) -> DataFrame:
    """errors, warnings (arrays), passed and error_code: the first error by priority."""
    c = {m: F.col(m) for m in metrics.columns}
    found = {
        "normalized_text_empty": c["text_chars"] == 0, "normalized_text_too_short": c["text_chars"] < limits["text"], "document_identity_missing": ~has_identity if has_identity is not None else F.lit(False),
        "blocks_missing": c["n_blocks"] == 0, "blocks_count_too_low": c["n_blocks"] < limits["blocks"], "meaningful_blocks_count_too_low": c["n_meaningful"] < limits["meaningful"],
        "empty_block_ratio_too_high": c["empty_ratio"] > limits["empty_ratio"], "block_order_duplicates_detected": c["duplicate_order"],
    }
    if "n_tables" in c:
        found |= {
            "table_rows_present_without_tables": (c["n_tables"] == 0) & (c["n_rows"] > 0), "tables_without_rows_ratio_too_high": F.when(c["n_tables"] > 0, c["n_without_rows"] / c["n_tables"]).otherwise(0.0) > limits["tables_without_rows"],
            "rows_without_table_binding_ratio_too_high": F.when(c["n_rows"] > 0, c["n_unbound"] / c["n_rows"]).otherwise(0.0) > limits["unbound_rows"],
            "all_table_rows_empty": (c["n_rows"] > 0) & (c["n_empty_rows"] == c["n_rows"]),
            "no_retrievable_units": c["n_meaningful"] + c["n_tables"] + c["n_rows"] + (c["n_facts"] if "n_facts" in c else F.lit(0)) == 0,
        }
        if "declared_tables" in c:
            found["declared_tables_not_extracted"] = (c["declared_tables"] > 0) & (c["n_tables"] == 0)
    errors = F.array_compact(F.array(*[F.when(found[code], code) for code in QC_ORDER if code in found]))
    warnings = F.array_compact(F.array(F.when(c["other_ratio"] > limits["other_ratio"], "other_block_ratio_too_high"), F.when((c["n_meaningful"] > 0) & (c["avg_block"] < limits["avg_block"]), "avg_block_text_length_too_low")))
    out = metrics.withColumn("errors", errors).withColumn("warnings", warnings)
    return out.withColumn("passed", F.size("errors") == 0).withColumn("error_code", F.try_element_at("errors", F.lit(1)))


#: Fewer units than this that can be found, and a document is poor; fixed value.
FEW_UNITS = 3


def table_figures(documents: DataFrame, tables: DataFrame) -> DataFrame:
    """document_id, n_tables, n_untitled, n_untyped of every document; ``tables``: document_id, title, table_type."""
    untyped = F.lower(F.trim(F.coalesce("table_type", F.lit("")))).isin("", "other", "unknown")
    per = tables.groupBy("document_id").agg(F.count("*").alias("n_tables"), F.count_if(F.trim(F.coalesce("title", F.lit(""))) == "").alias("n_untitled"), F.count_if(untyped).alias("n_untyped"))
    return documents.select("document_id").join(per, "document_id", "left").na.fill(0, ["n_tables", "n_untitled", "n_untyped"])


def qc_warnings(facts: DataFrame, limits: dict = QC) -> Column:
    """All warnings of a document, in order; ``facts`` has what they are told by, and a warning whose columns are missing isn't given.

    Columns: text_chars, language, title, doc_uid_base, revision_date, other_ratio, n_meaningful, avg_block, n_blocks, n_ordered (blocks with a number),
    is_monotonic, n_untitled, n_untyped, document_type, authority, n_facts, n_measures, n_units (blocks, tables, rows and facts).
    """
    c = {x: F.col(x) for x in facts.columns}
    empty = lambda x: T.first_filled(c[x]).isNull()
    told = (
        ("detected_language_code_missing", ("text_chars", "language"), lambda: (c["text_chars"] > 0) & empty("language")), ("document_title_missing", ("title",), lambda: empty("title")),
        ("doc_uid_base_missing", ("doc_uid_base",), lambda: empty("doc_uid_base")), ("revision_date_missing", ("revision_date",), lambda: c["revision_date"].isNull()),
        ("other_block_ratio_too_high", ("other_ratio",), lambda: c["other_ratio"] > limits["other_ratio"]), ("avg_block_text_length_too_low", ("n_meaningful", "avg_block"), lambda: (c["n_meaningful"] > 0) & (c["avg_block"] < limits["avg_block"])),
        ("all_block_order_values_missing", ("n_blocks", "n_ordered"), lambda: (c["n_blocks"] > 0) & (c["n_ordered"] == 0)), ("block_order_not_monotonic", ("is_monotonic",), lambda: ~c["is_monotonic"]),
        ("some_tables_without_title", ("n_untitled",), lambda: c["n_untitled"] > 0), ("some_tables_with_unknown_type", ("n_untyped",), lambda: c["n_untyped"] > 0),
        ("document_type_missing", ("document_type",), lambda: empty("document_type")), ("source_authority_missing", ("authority",), lambda: empty("authority")),
        ("legal_facts_missing", ("n_facts",), lambda: c["n_facts"] == 0), ("measure_codes_missing", ("n_measures",), lambda: c["n_measures"] == 0), ("retrievable_units_count_low", ("n_units",), lambda: c["n_units"] < FEW_UNITS),
    )
    return F.array_compact(F.array(*[F.when(F.coalesce(holds(), F.lit(False)), name) for name, needs, holds in told if set(needs) <= set(c)]).cast("array<string>"))


def order_checks(block_rows: DataFrame) -> DataFrame:
    """Whether block numbers repeat, and whether they rise in the order of arrival (``ordinal``)."""
    w = Window.partitionBy("document_id").orderBy("ordinal")
    rows = block_rows.withColumn("_down", F.col("block_order") < F.lag("block_order").over(w))
    return rows.groupBy("document_id").agg((F.count("block_order") != F.count_distinct("block_order")).alias("has_duplicates"), (~F.coalesce(F.max("_down"), F.lit(False))).alias("is_monotonic"))


def new_files(files: DataFrame, registry: DataFrame, *, force: bool = False) -> DataFrame:
    """Files whose hash no active document has."""
    return files if force else files.join(registry.filter(F.col("status") == "active").select("file_hash"), "file_hash", "left_anti")


def duplicate_files(files: DataFrame, registry: DataFrame) -> DataFrame:
    return files.join(registry.filter(F.col("status") == "active").select("file_hash"), "file_hash", "left_semi")


#: Headings that stand above many documents and aren't their titles.
NO_TITLES = ("министерство социальной политики", "министерство социальной политики красноярского края")


def document_titles(documents: DataFrame, blocks: DataFrame, *, skipped=NO_TITLES, looked_at: int = 20) -> DataFrame:
    """document_id, title: the first of a document's first blocks that can be one, else the file's name.

    ``documents``: document_id, file_name; ``blocks``: document_id, block_order, content.
    """
    w = Window.partitionBy("document_id").orderBy("block_order")
    first = blocks.select("document_id", "block_order", T.collapse(F.col("content")).alias("_t")).withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= looked_at)
    first = first.filter((F.char_length("_t") >= 4) & ~F.lower("_t").isin(*skipped)).groupBy("document_id").agg(F.min_by("_t", "block_order").alias("_t"))
    stem = F.regexp_replace(F.regexp_extract("file_name", r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    return documents.select("document_id", "file_name").join(first, "document_id", "left").select("document_id", F.coalesce("_t", stem).alias("title"))


def extraction_counters(documents: DataFrame, tables: DataFrame, rows: DataFrame) -> DataFrame:
    """document_id, declared, skipped (tables without rows), meaningful tables, table_rows of every document."""
    n = rows.groupBy("table_id").agg(F.count("*").alias("_n"))
    per = tables.select("document_id", "table_id").join(n, "table_id", "left").groupBy("document_id")
    per = per.agg(F.count("*").alias("declared"), F.count_if(F.col("_n").isNull()).alias("skipped"), F.count("_n").alias("meaningful"), F.sum(F.coalesce("_n", F.lit(0))).alias("table_rows"))
    return documents.select("document_id").join(per, "document_id", "left").na.fill(0, ["declared", "skipped", "meaningful", "table_rows"])
