"""Fill-in-middle transformation, with big integers as bit vectors over a text's code points.

A text is a row of units, each a run of ASCII letters or one other character.  Per text:

* ``bytes.translate`` maps every character to the digit 1 (letter) or 0, and the digits are read as one big
  integer, character 0 being the lowest bit;
* a unit starts at each character that is not a letter following a letter: one shift and three boolean
  operations on the whole integer mark all starts;
* ``bit_count`` of the starts is the number of units, n;
* the character at which unit p starts is the place of the bit of rank p, found by halving: the lower half's
  ``bit_count`` tells in which half it lies, so all halves together cost as much as one pass.

Hashes of the id decide where a text is cut and in which order prefix, middle and suffix are written:
``psm``, ``spm``, or ``plain``, the text as it is.  The marks are never in a text that is cut, so
``restored`` gets the exact text back.

Rows are independent: nothing is shuffled, and what a lost executor has done is done again.

Defined results: a null text counts as empty; empty texts and texts with a mark in them are plain; texts are
cut whole, whatever their length, and long ones take memory in proportion to one text; the hashes of a null id
are those of ``1:`` alone; repeated rows are each done, all alike; cuts that tie give an empty middle; an empty
table gives no rows; other columns are carried along, whatever their names: the result is one struct column, whose
name gets underscores in front where it is taken.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shipping import ship
from .shared import bound_batches, free_name, read_table, release

MARKS = ("<P>", "<S>", "<M>")
PLAIN_FROM = 90
SPM_BELOW = 20
SCHEMA = "struct<n: bigint, form: string, prefix_chars: bigint, middle_chars: bigint, output: string>"

#: The class of each byte as a binary digit: 1 for an ASCII letter, else 0.
_CLASSES = bytes(ord("1") if chr(b).isascii() and chr(b).isalpha() else ord("0") for b in range(256))


def letters(text: str) -> int:
    """The letters of ``text`` as bits; a character beyond Latin-1 becomes ``?``, which is none."""
    digits = text.encode("latin-1", "replace").translate(_CLASSES)
    return int(digits[::-1], 2) if digits else 0


def starts(text: str) -> int:
    """The characters at which a unit starts, as bits."""
    letter = letters(text)
    return ((1 << len(text)) - 1) & ~(letter & letter << 1)


def place_of(bits: int, rank: int) -> int:
    """The place of the set bit before which ``rank`` others are set."""
    width, place = bits.bit_length(), 0
    while width > 1:
        half = width >> 1
        low = bits & ((1 << half) - 1)
        below = low.bit_count()
        if rank < below:
            bits, width = low, half
        else:
            bits, rank, place, width = bits >> half, rank - below, place + half, width - half
    return place


def draws(key: int | None) -> list[int]:
    digest = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]


def transform(key: int | None, text: str | None) -> tuple[int, str, int | None, int | None, str]:
    """(n, form, characters of the prefix, of the middle, output)."""
    text = text or ""
    begins = starts(text)
    n = begins.bit_count()
    h1, h2, h3, h4 = draws(key)
    if not text or any(m in text for m in MARKS) or h3 % 100 >= PLAIN_FROM:
        return n, "plain", None, None, text
    first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (place_of(begins, k) if k < n else len(text) for k in (first, last))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < SPM_BELOW:
        return n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


def fill_in_middle(docs: DataFrame, *, key: str = "doc_id", text: str = "text", into: str = "fim") -> DataFrame:
    """``docs`` with a struct column: n, form, prefix_chars, middle_chars and the output text."""
    ship(docs.sparkSession)
    bound_batches(docs.sparkSession)

    @F.arrow_udf(SCHEMA)
    def transformed(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
        names = ("n", "form", "prefix_chars", "middle_chars", "output")
        try:
            for keys, texts in batches:
                rows = [transform(k, t) for k, t in zip(keys.to_pylist(), texts.to_pylist())]
                columns = [pa.array(c, kind) for c, kind in zip(zip(*rows) if rows else [()] * 5, kinds)]
                yield pa.StructArray.from_arrays(columns, names)
        finally:
            release()

    return docs.withColumn(free_name(docs, into), transformed(F.col(key), F.col(text)))


def restored(output: Column, form: Column) -> Column:
    """The text that was cut, from the output and its form alone."""
    parts = F.split(output, "<[PSM]>")
    part = lambda k: F.get(parts, F.lit(k))
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    done = fill_in_middle(docs).select("doc_id", "fim.*")
    hexed = lambda c: F.sha2(c.cast("binary"), 256)
    return done.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", hexed(F.col("output")).alias("output_sha256"),
        hexed(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


OP11_SQL = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest FROM documents
), drawn AS (
  SELECT doc_id, text, units, CAST(len(units) AS BIGINT) AS n, list_transform([1, 9, 17, 25], lambda k: CAST('0x' || substr(digest, k, 8) AS UBIGINT)) AS h FROM cut
), placed AS (
  SELECT doc_id, text, n, units,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
    CAST(least(h[1] % (n + 1), h[2] % (n + 1)) AS BIGINT) AS a, CAST(greatest(h[1] % (n + 1), h[2] % (n + 1)) AS BIGINT) AS b FROM drawn
), parts AS (
  SELECT doc_id, text, n, form, array_to_string(units[:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix FROM placed
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
FROM parts
"""
