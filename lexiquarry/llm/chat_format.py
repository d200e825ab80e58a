"""Chat formatting by schema fingerprints.

Chat data comes in many layouts: a row per turn, a list of messages, an instruction with its answer, a
prompt with a completion.  A record's layout is told by its schema alone: the nested paths of its fields
(``messages[].role``) at any depth, without types and without paths that no layout knows, sorted and hashed.
A mapping is declarative data: which paths it needs, which it may have, and where turns, roles and texts are.
The registry holds a fingerprint for each layout that a mapping takes: its needs with every choice of what it may
have.  A record's layout is hashed for each mapping over the paths that this mapping knows, and these hashes are looked up
in the registry; of the mappings found the first is selected.

Records may be columns or JSON.  The schema of columns is known when the query is planned, so their
fingerprint is taken once.  JSON records are made into variants, whose schema Spark gives row by row; each
different schema is fingerprinted once and joined with the registry on its hashes, and records find their mapping by a
join on the schema.

Mappings give canonical turns, a row each (conv_id, record, turn, role, text); ``record`` numbers the records
that hold a conversation each and is null where turns are rows of their own.  The template makes one string
for each conversation:

    <|im_start|>role<|im_sep|>text<|im_end|>        for each turn

Control strings inside roles and texts are escaped: a backslash becomes two, and one is put behind the first
character of a control string, so none is left whole; taking the backslashes out again gives the text
exactly.  Loss spans are the places (code points) of the assistants' escaped texts in the string.  Places are
running sums over a conversation's turns, so long conversations cost no more a turn than short ones.  All
steps are built-in functions.

Defined results: a null or missing role or text counts as empty; turns stand by their number, null last, then
by role, then by text; repeated rows are repeated turns; conv_id may be of any type (a string, from JSON), and
rows of a null conv_id make one conversation; records that hold a conversation each stay apart, whatever their
conv_id; a text given as a list of parts is the parts' texts joined; records that no mapping fits are an
error, or are counted by ``unmapped`` and left out with ``strict=False``; extra fields, whatever their names,
don't count; texts of any length are kept whole; an empty table gives no conversations.
"""

from __future__ import annotations

import hashlib
import itertools
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import join_keyed, read_table, settle


@dataclass(frozen=True)
class Mapping:
    """One layout: the paths it ``needs`` and those it ``may`` have.

    ``turns``: path of a list of messages with ``role`` and ``text``.  Without it, ``role`` set means that the
    record itself is one turn, numbered by ``order``.  ``before`` and ``fields`` are (role, path) pairs, each a
    turn if present: ``before`` come first, ``fields`` are all the turns there are.
    """

    name: str
    needs: tuple[str, ...]
    may: tuple[str, ...] = ("conv_id",)
    turns: str | None = None
    role: str | None = None
    text: str | None = None
    order: str | None = None
    before: tuple[tuple[str, str], ...] = ()
    fields: tuple[tuple[str, str], ...] = ()


SYSTEM = (("system", "system"),)
MAPPINGS = (
    Mapping("turn_rows", ("conv_id", "role", "text", "turn"), (), role="role", text="text", order="turn"),
    Mapping("turn_rows_content", ("content", "conv_id", "role", "turn"), (), role="role", text="content", order="turn"),
    Mapping("messages", ("messages[].content", "messages[].role"), ("conv_id", "system"), turns="messages", role="role", text="content", before=SYSTEM),
    Mapping("conversations", ("conversations[].from", "conversations[].value"), ("conv_id", "system"), turns="conversations", role="from", text="value", before=SYSTEM),
    Mapping("prompt_completion", ("completion", "prompt"), ("conv_id", "system"), fields=(*SYSTEM, ("user", "prompt"), ("assistant", "completion"))),
    Mapping("prompt_response", ("prompt", "response"), ("conv_id", "system"), fields=(*SYSTEM, ("user", "prompt"), ("assistant", "response"))),
    Mapping("instruction", ("instruction", "output"), ("conv_id", "input", "system"), fields=(*SYSTEM, ("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Mapping("question_answer", ("answer", "question"), ("conv_id", "system"), fields=(*SYSTEM, ("user", "question"), ("assistant", "answer"))),
)

#: Other names of roles in lists whose role field is "from"; fixed values.
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant"}

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Strings that may not stand in a text, as a pattern of the first character with what follows it.
CONTROL = r"<(?=\|im_(?:start|sep|end)\|>|\|(?:endoftext|startoftext|system|user|assistant)\|>|/?s>|</?SYS>>)|\[(?=/?INST\])"
#: Pieces of a variant's schema: names, brackets, and what parts fields.
SCHEMA_TOKEN = r"`(?:[^`]|``)+`(?=: )|\w+(?=: )|ARRAY<|OBJECT<|>|, "
ROWS = "turn bigint, role string, text string"


def escaped(text: Column) -> Column:
    """``text`` with every backslash doubled and every control string broken."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), f"({CONTROL})", r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


# ---------------------------------------------------------------- fingerprints


def known_paths(mappings: tuple[Mapping, ...]) -> set[str]:
    return {p for m in mappings for p in (*m.needs, *m.may)}


def layout_text(paths, mappings: tuple[Mapping, ...]) -> str:
    return ",".join(sorted(known_paths(mappings).intersection(paths)))


def fingerprint(layout: str) -> str:
    return hashlib.sha256(layout.encode()).hexdigest()


def own_layout(m: Mapping, paths) -> str:
    """The layout as this mapping sees it."""
    return f"{m.name}:{layout_text(paths, (m,))}"


def registry(mappings: tuple[Mapping, ...]) -> dict[str, tuple[int, str]]:
    """fingerprint → (rank, name) of every layout that a mapping takes: as many as it has choices of what it may have."""
    choices = lambda m: (c for n in range(len(m.may) + 1) for c in itertools.combinations(m.may, n))
    return {fingerprint(own_layout(m, (*m.needs, *c))): (rank, m.name) for rank, m in enumerate(mappings) for c in choices(m)}


def select_mapping(paths, mappings: tuple[Mapping, ...]) -> Mapping | None:
    """The first mapping that the registry has under the hash of what it sees of these paths."""
    known = registry(mappings)
    return next((m for m in mappings if fingerprint(own_layout(m, paths)) in known), None)


def column_paths(kind: T.DataType, at: str = "") -> list[str]:
    """The nested paths of columns."""
    if isinstance(kind, T.ArrayType):
        return column_paths(kind.elementType, f"{at}[]")
    if not isinstance(kind, T.StructType):
        return []
    out = []
    for f in kind.fields:
        path = f"{at}.{f.name}" if at else f.name
        out += [path, *column_paths(f.dataType, path)]
    return out


def schema_paths(schema: Column) -> Column:
    """The nested paths in a variant's schema, e.g. OBJECT<conv_id: BIGINT, messages: ARRAY<OBJECT<role: STRING>>>.

    The tokens are read with a stack of open names and brackets; a name's path is the stack with it on top.
    """
    tokens = F.regexp_extract_all(schema, F.lit(SCHEMA_TOKEN), F.lit(0))
    less = lambda a, n: F.slice(a, F.lit(1), F.greatest(F.size(a) - n, F.lit(0)))
    named = lambda a: ~F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit("{")).isin("{", "[]")
    path = lambda a: F.replace(F.array_join(F.filter(a, lambda x: x != "{"), "."), F.lit(".[]"), F.lit("[]"))

    def step(acc: Column, t: Column) -> Column:
        stack, found = acc["stack"], acc["found"]
        name = F.replace(F.when(F.startswith(t, F.lit("`")), F.substring(t, F.lit(2), F.char_length(t) - 2)).otherwise(t), F.lit("``"), F.lit("`"))
        grown = F.concat(stack, F.array(name))
        keep = lambda s: F.struct(s.alias("stack"), found.alias("found"))
        return (F.when(t == "OBJECT<", keep(F.concat(stack, F.array(F.lit("{"))))).when(t == "ARRAY<", keep(F.concat(stack, F.array(F.lit("[]")))))
                .when(t == ", ", keep(less(stack, 1))).when(t == ">", keep(F.when(named(stack), less(stack, 2)).otherwise(less(stack, 1))))
                .otherwise(F.struct(grown.alias("stack"), F.concat(found, F.array(path(grown))).alias("found"))))

    none = F.array().cast("array<string>")
    return F.aggregate(tokens, F.struct(none.alias("stack"), none.alias("found")), step, lambda acc: acc["found"])


def fingerprinted(schemas: DataFrame, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """schema → schema, layout, fingerprint and the mapping's name (null if none fits); one row for each schema."""
    paths = schemas.select("schema", schema_paths(F.col("schema")).alias("paths"))

    def seen(some: tuple[Mapping, ...]) -> Column:
        return F.array_join(F.array_sort(F.array_intersect("paths", F.array(*[F.lit(p) for p in sorted(known_paths(some))]))), ",")

    told = paths.select("schema", seen(mappings).alias("layout"), F.sha2(seen(mappings), 256).alias("fingerprint"))
    hashes = F.array(*[F.sha2(F.concat(F.lit(f"{m.name}:"), seen((m,))), 256) for m in mappings])
    rows = [(h, rank, name) for h, (rank, name) in registry(mappings).items()]
    known = schemas.sparkSession.createDataFrame(rows, "hash string, rank int, mapping string")
    found = paths.select("schema", F.explode(hashes).alias("hash")).join(F.broadcast(known), "hash")  # as many rows as the mappings have layouts
    return told.join(found.groupBy("schema").agg(F.min_by("mapping", "rank").alias("mapping")), "schema", "left")


# ---------------------------------------------------------------- turns


def _whole(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def _renamed(role: Column, m: Mapping) -> Column:
    if m.role != "from":
        return role
    return reduce(lambda out, kv: F.when(role == kv[0], kv[1]).otherwise(out), ROLE_NAMES.items(), role)


def _listed(before: list[Column], turns: Column | None, fields: list[Column]) -> Column:
    """One list of (turn, role, text): the numbers are the places in the list."""
    made = [F.array_compact(F.array(*part)) for part in (before, fields) if part]
    if turns is not None:
        made.append(turns)
    pair = "array<struct<role:string,text:string>>"
    every = F.concat(*[p.cast(pair) for p in made])
    return F.transform(every, lambda x, k: F.struct(k.cast("long").alias("turn"), x["role"].alias("role"), x["text"].alias("text")))


def _pair(role: Column, text: Column) -> Column:
    return F.struct(_whole(role).alias("role"), _whole(text).alias("text"))


def _variant_text(v: Column, path: str) -> Column:
    """A string, or the texts of a list of parts (strings, or objects with a text)."""
    parts = F.try_variant_get(v, f"{path}", "array<variant>")
    own = F.transform(parts, lambda x: F.coalesce(F.try_variant_get(x, "$.text", "string"), F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")), F.lit("")))
    return F.when(parts.isNotNull(), F.array_join(own, "")).otherwise(F.try_variant_get(v, path, "string"))


def _variant_turns(record: Column, m: Mapping) -> Column:
    field = lambda role, path: F.when(_variant_text(record, f"$.{path}").isNotNull(), _pair(F.lit(role), _variant_text(record, f"$.{path}")))
    if m.turns:
        items = F.transform(F.try_variant_get(record, f"$.{m.turns}", "array<variant>"), lambda x: _pair(_renamed(F.try_variant_get(x, f"$.{m.role}", "string"), m), _variant_text(x, f"$.{m.text}")))
        return _listed([field(*p) for p in m.before], items, [])
    if m.role:
        turn = F.try_variant_get(record, f"$.{m.order}", "bigint")
        return F.array(F.struct(turn.alias("turn"), _whole(F.try_variant_get(record, f"$.{m.role}", "string")).alias("role"), _whole(_variant_text(record, f"$.{m.text}")).alias("text")))
    return _listed([], None, [field(*p) for p in m.fields])


def mapped(records: DataFrame, record: Column, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """conv_id, record, mapping, layout, fingerprint and turns of each JSON record (a variant); turns is null where no mapping fits."""
    rows = records.select(record.alias("v"), F.monotonically_increasing_id().alias("record")).withColumn("schema", F.schema_of_variant("v"))
    schemas = settle(fingerprinted(rows.select("schema").filter("schema IS NOT NULL").distinct(), mappings), "schemas")
    rows = join_keyed(rows, schemas, "schema", "left")
    turns, grouped = F.lit(None).cast(f"array<struct<{ROWS.replace(' ', ':').replace(',:', ',')}>>"), F.lit(False)
    for m in mappings:
        hit = F.col("mapping") == m.name
        turns = F.when(hit, _variant_turns(F.col("v"), m)).otherwise(turns)
        grouped = grouped | hit if m.role and not m.turns else grouped
    return rows.select(F.try_variant_get("v", "$.conv_id", "string").alias("conv_id"), F.when(~F.coalesce(grouped, F.lit(False)), F.col("record")).alias("record"), "mapping", "layout", "fingerprint", turns.alias("turns"))


def unmapped(done: DataFrame) -> DataFrame:
    """Layouts that no mapping fits, and how many records have them."""
    return done.filter(F.col("turns").isNull()).groupBy("layout", "fingerprint").agg(F.count("*").alias("records"))


def turns_of(done: DataFrame, *, strict: bool = True) -> DataFrame:
    """The canonical turns of what ``mapped`` gives."""
    turns = F.col("turns")
    if strict:
        turns = F.coalesce(turns, F.raise_error(F.concat(F.lit("no mapping for the layout "), F.coalesce("layout", F.lit("of a record that is no object")))).cast(done.schema["turns"].dataType))
    return done.select("conv_id", "record", F.explode(turns).alias("t")).select("conv_id", "record", "t.*")


def column_turns(records: DataFrame, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """The canonical turns of records given as columns; their layout is told by the schema, once."""
    paths = column_paths(records.schema)
    m = select_mapping(paths, mappings)
    if m is None:
        raise ValueError(f"no mapping for the layout {layout_text(paths, mappings)!r}")
    conv = F.col("conv_id") if "conv_id" in paths else F.lit(None).cast("string")
    text = lambda c: c.cast("string")
    if m.role and not m.turns:
        return records.select(conv.alias("conv_id"), F.lit(None).cast("long").alias("record"), F.col(m.order).cast("long").alias("turn"), _whole(text(F.col(m.role))).alias("role"), _whole(text(F.col(m.text))).alias("text"))
    field = lambda role, path: F.when(F.col(path).isNotNull(), _pair(F.lit(role), text(F.col(path))))
    before, fields = ([field(*p) for p in some if p[1] in paths] for some in (m.before, m.fields))
    items = F.transform(F.col(m.turns), lambda x: _pair(_renamed(text(x[m.role]), m), text(x[m.text]))) if m.turns else None
    one = records.select(conv.alias("conv_id"), F.monotonically_increasing_id().alias("record"), _listed(before, items, fields).alias("turns"))
    return one.select("conv_id", "record", F.explode("turns").alias("t")).select("conv_id", "record", "t.*")


# ---------------------------------------------------------------- the template


def formatted(turns: DataFrame) -> DataFrame:
    """conv_id, record, formatted and loss_spans (start from 0, length; code points) of each conversation."""
    head = F.concat(F.lit(START), escaped(F.col("role")), F.lit(SEP))
    own = turns.select("conv_id", "record", "turn", "role", "text", head.alias("head"), escaped(F.col("text")).alias("body"))
    n = F.char_length("head") + F.char_length("body") + len(END)
    order = Window.partitionBy("conv_id", "record").orderBy(F.col("turn").asc_nulls_last(), "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    placed = own.withColumn("at", F.coalesce(F.sum(n).over(order), F.lit(0)).cast("long"))
    span = F.struct((F.col("at") + F.char_length("head")).cast("long").alias("start"), F.char_length("body").cast("long").alias("length"))
    item = F.struct("at", F.concat("head", "body", F.lit(END)).alias("piece"), F.when(F.col("role") == "assistant", span).alias("span"))
    one = placed.groupBy("conv_id", "record").agg(F.array_sort(F.collect_list(item)).alias("items"))
    return one.select("conv_id", "record", F.array_join(F.transform("items", lambda x: x["piece"]), "").alias("formatted"), F.array_compact(F.transform("items", lambda x: x["span"])).alias("loss_spans"))


def read_back(made: DataFrame) -> DataFrame:
    """conv_id, record, turns (role, text), loss_text and formatted_chars, from the formatted string and its spans."""
    pieces = F.filter(F.split("formatted", r"<\|im_end\|>", -1), lambda p: p != "")
    body = lambda p: F.substring_index(p, SEP, -1)  # noqa: E731  an escaped text holds no SEP
    head = lambda p: F.replace(F.substring_index(p, SEP, 1), F.lit(START), F.lit(""))
    turns = F.transform(pieces, lambda p: F.struct(unescaped(head(p)).alias("role"), unescaped(body(p)).alias("text")))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescaped(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    return made.select("conv_id", "record", turns.alias("turns"), loss.alias("loss_text"), F.char_length("formatted").cast("long").alias("formatted_chars"))


def format_chats(records: DataFrame, record: Column | None = None, mappings: tuple[Mapping, ...] = MAPPINGS, *, strict: bool = True) -> DataFrame:
    """Records as columns, or with ``record`` as variants, formatted."""
    turns = column_turns(records, mappings) if record is None else turns_of(mapped(records, record, mappings), strict=strict)
    return formatted(turns)


PROBE = "SELECT -7L AS conv_id, t AS turn, r AS role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS v(t, r)"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(spark.sql(PROBE))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read_back(format_chats(rows)).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars")


OP1_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, length(role) + length(text)
    + len(regexp_extract_all(role, '\\|<\|im_(start|sep|end)\|>|<\|(endoftext|startoftext|system|user|assistant)\|>|</?s>|<</?SYS>>|\[/?INST\]'))
    + len(regexp_extract_all(text, '\\|<\|im_(start|sep|end)\|>|<\|(endoftext|startoftext|system|user|assistant)\|>|</?s>|<</?SYS>>|\[/?INST\]')) AS n
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS LAST, role, text), '')) AS loss_sha256,
  CAST(sum(n + 12 + 10 + 10) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
