"""Text functions as Column expressions.  Each takes Columns and returns one; null counts as stated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: All white space, with the no-break space and the separators U+001C to U+001F.
WS = r"(?U)[\s\x1c-\x1f]+"


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def collapse(c: Column) -> Column:
    """One space for each run of white space, none at the ends; case is kept.  Null stays null."""
    return F.trim(F.regexp_replace(c, WS, " "))


def normalize(c: Column) -> Column:
    """``collapse`` in lower case; null is empty."""
    return F.lower(collapse(_text(c)))


def normalize_for_documents(c: Column, signs: str = ",.;:()\"«»-") -> Column:
    """``normalize`` with ten signs as spaces."""
    return collapse(F.translate(normalize(c), signs, " " * len(signs)))


def normalize_for_deadlines(c: Column) -> Column:
    """``normalize`` with ё as е."""
    return F.translate(normalize(c), "ё", "е")


def clean_cell(c: Column) -> Column:
    """No-break spaces and runs of blanks become one blank; blanks around line ends go; lines are kept."""
    c = F.regexp_replace(F.translate(_text(c), " ", " "), r"[ \t]+", " ")
    return F.trim(F.regexp_replace(c, r" *\n *", "\n"))


def token_key(c: Column) -> Column:
    """A name of Latin and Cyrillic letters and digits joined by underscores."""
    return clean_key(clean_cell(c))


def clean_key(c: Column) -> Column:
    """``token_key`` of what ``clean_cell`` made."""
    c = F.translate(F.lower(c), "№", "n")
    return F.trim(F.regexp_replace(c, "(?u)[^0-9a-zа-я]+", "_"), F.lit("_"))


def normalize_document(c: Column) -> Column:
    """Line ends as LF, tabs as blanks, at most one empty line in a row."""
    c = F.regexp_replace(F.regexp_replace(_text(c), r"\r\n?", "\n"), r"\t", " ")
    return F.trim(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def shorten(c: Column, n: int, *, collapsed: bool = False, room_for_dots: bool = True) -> Column:
    """At most ``n`` characters, the last three as dots if something is cut off."""
    c = collapse(_text(c)) if collapsed else F.trim(_text(c))
    keep = n - 3 if room_for_dots else n
    return F.when(F.char_length(c) <= n, c).otherwise(F.concat(F.rtrim(F.substring(c, 1, keep)), F.lit("...")))


def sentence(c: Column) -> Column:
    """``collapse`` with a full stop unless it ends in one of .!?; empty gives null."""
    c = collapse(_text(c))
    return F.when(c == "", None).when(F.right(c, F.lit(1)).isin(".", "!", "?"), c).otherwise(F.concat(c, F.lit(".")))


def compact_map(entries: Column, n: int = 4) -> Column:
    """The first ``n`` non-empty "key: value" of a map, joined by "; "."""
    filled = F.filter(F.map_entries(entries), lambda e: F.trim(_text(e["value"])) != "")
    return F.array_join(F.slice(F.transform(filled, lambda e: F.concat_ws(": ", e["key"], e["value"])), 1, n), "; ")


def language(c: Column) -> Column:
    """"ru" with more Cyrillic letters than Latin ones, "en" with more Latin ones, null without letters or on a tie."""
    cyrillic, latin = F.regexp_count(_text(c), F.lit(r"\p{IsCyrillic}")), F.regexp_count(_text(c), F.lit("[A-Za-z]"))
    return F.when(cyrillic > latin, "ru").when(latin > cyrillic, "en")


def text_hash(c: Column) -> Column:
    return F.sha2(collapse(_text(c)), 256)


def content_hash(c: Column) -> Column:
    return F.sha2(_text(c), 256)


def canonical_hash(**fields: Column) -> Column:
    """SHA-256 of the JSON object of the fields in alphabetical order, nulls written out."""
    record = F.struct(*[fields[k].alias(k) for k in sorted(fields)])
    return F.sha2(F.to_json(record, {"ignoreNullFields": "false"}), 256)


def set_hash(hashes: Column) -> Column:
    """Of the sorted distinct non-empty members of an array."""
    own = F.array_sort(F.array_distinct(F.filter(hashes, lambda h: h.isNotNull() & (h != ""))))
    return F.sha2(F.to_json(own), 256)


def decimal4(c: Column) -> Column:
    return F.round(c, 4).cast("decimal(5,4)")


def iso_time(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")


def terms(c: Column, stop_words: tuple[str, ...], keep: tuple[str, ...] = (), n: int = 8) -> Column:
    """The first ``n`` words of three or more letters that aren't stop words; quotes and brackets are blanks."""
    words = F.split(normalize(F.translate(_text(c), "\"()", "   ")), " ")
    stop = F.array(*[F.lit(w) for w in stop_words])
    good = F.filter(words, lambda w: ~F.array_contains(stop, w) & ((F.char_length(w) >= 3) | w.isin(*keep)))
    return F.slice(good, 1, n)


def upper_ratio(c: Column) -> Column:
    letters = F.regexp_count(_text(c), F.lit(r"\p{L}"))
    return F.when(letters == 0, 0.0).otherwise(F.regexp_count(_text(c), F.lit(r"\p{Lu}")) / letters)


def contains_any(c: Column, markers) -> Column:
    out = F.lit(False)
    for m in markers:
        out = out | F.contains(c, F.lit(m))
    return out


def count_markers(c: Column, markers) -> Column:
    out = F.lit(0)
    for m in markers:
        out = out + F.contains(c, F.lit(m)).cast("int")
    return out


def weigh_markers(c: Column, weights: dict[str, float]) -> Column:
    out = F.lit(0.0)
    for m, w in weights.items():
        out = out + F.when(F.contains(c, F.lit(m)), w).otherwise(0.0)
    return out


def first_match(c: Column, patterns) -> Column:
    """What the first pattern that matches at all finds: patterns have priority, not places."""
    return F.coalesce(*[F.nullif(F.regexp_extract(_text(c), p, 0), F.lit("")) for p in patterns])


def found_date(c: Column) -> Column:
    return F.try_to_timestamp(F.regexp_extract(_text(c), r"(?iu)\b(\d{2}\.\d{2}\.\d{4})\b", 1), F.lit("dd.MM.yyyy"))


def found_number(c: Column) -> Column:
    return F.nullif(F.regexp_extract(_text(c), r"(?iu)(?:№|N)\s*([0-9A-Za-zА-Яа-я/-]+)", 1), F.lit(""))


def numbered(c: Column, word: str) -> Column:
    """The number behind a word such as "appendix"."""
    return F.nullif(F.regexp_extract(_text(c), rf"(?iu){word}\s*(?:№|N)?\s*(\d+(?:\.\d+)*)", 1), F.lit(""))


def clause_number(c: Column) -> Column:
    return F.nullif(F.regexp_extract(F.trim(_text(c)), r"^(\d+(?:\.\d+)*)[.)]?\s", 1), F.lit(""))


def escape_markdown(c: Column) -> Column:
    return F.regexp_replace(_text(c), r"([_*\[\]()~`>#+=|{}.!-])", r"\\$1")


def bold(c: Column, mode: Column) -> Column:
    return F.when(mode == "markdown", F.concat(F.lit("*"), escape_markdown(c), F.lit("*"))).when(mode == "html", F.concat(F.lit("<b>"), c, F.lit("</b>"))).otherwise(c)


def first_filled(*cs: Column) -> Column:
    return F.coalesce(*[F.nullif(F.trim(c.cast("string")), F.lit("")) for c in cs])


def callback(c: Column) -> Column:
    """"fb:<answer>:<1 to 5>" or "fb_comment:<answer>" as (kind, answer_id, score); null if malformed."""
    parts = F.split(_text(c), ":", -1)
    score = F.try_element_at(parts, F.lit(3)).try_cast("int")
    vote = (F.size(parts) == 3) & (parts[0] == "fb") & (F.try_element_at(parts, F.lit(2)) != "") & score.between(1, 5)
    note = (F.size(parts) == 2) & (parts[0] == "fb_comment") & (F.try_element_at(parts, F.lit(2)) != "")
    record = lambda kind, s: F.struct(F.lit(kind).alias("kind"), F.try_element_at(parts, F.lit(2)).alias("answer_id"), s.alias("score"))
    return F.when(vote, record("vote", score)).when(note, record("comment", F.lit(None).cast("int")))
