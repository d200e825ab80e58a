"""Canonical JSON of nested values, for hashes: the same text whatever the order of fields or the session's time zone.

Objects have their keys in order at every level, nulls are written out, nothing stands between tokens, letters are not
escaped, numbers are written in the shortest form that reads back, times as ISO in UTC.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as Y

_ESCAPES = {c: json.dumps(chr(c))[1:-1] for c in [*range(32), ord('"')]}


def quoted(c: Column) -> Column:
    """A JSON string; only the backslash, quotes and control characters are escaped."""
    out = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for code, escape in _ESCAPES.items():
        out = F.replace(out, F.lit(chr(code)), F.lit(escape))
    return F.concat(F.lit('"'), F.when(c.rlike(r'[\x00-\x1f"\\]'), out).otherwise(c), F.lit('"'))


def number(c: Column) -> Column:
    """A double: plain from 1e-4 to 1e16, else with an exponent of a sign and two digits or more.

    Java before version 19 writes a digit too many for some values: where sixteen or seventeen read back as the same value, they are
    taken.  (The least subnormals may still differ.)"""
    c = c.cast("double")
    java, few, more = c.cast("string"), F.format_string("%.15e", c), F.format_string("%.16e", c)
    digits = F.length(F.regexp_replace(F.regexp_replace(java, "E.*", ""), r"\D|^[-0.]+", ""))
    s = F.when(digits < 17, java).when(few.try_cast("double") == c, few).when(more.try_cast("double") == c, more).otherwise(java)
    part = lambda k: F.regexp_extract(s, r"^(-?)(\d)\.(\d+)[Ee]\+?(-?\d+)$", k)
    sign, first, rest, power = part(1), part(2), F.regexp_replace(part(3), "0+$", ""), part(4).try_cast("int")
    whole = F.concat(sign, first, F.rpad(F.substring(rest, F.lit(1), power), power, F.lit("0")), F.lit("."), F.coalesce(F.nullif(F.substring(rest, power + 1, F.lit(400)), F.lit("")), F.lit("0")))
    small = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -power - 1), first, rest)
    told = F.concat(sign, first, F.when(rest == "", "").otherwise(F.concat(F.lit("."), rest)), F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), F.greatest(F.lit(2), F.length(F.abs(power).cast("string"))), F.lit("0")))
    return F.when(~s.rlike("[Ee]"), s).when(power.between(0, 15), whole).when(power.between(-4, -1), small).otherwise(told)


def utc_time(c: Column) -> Column:
    """ISO 8601 with the offset of UTC; microseconds only if there are some."""
    at = F.to_utc_timestamp(c, F.current_timezone())
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.unix_micros(c) % 1_000_000 != 0, F.date_format(at, ".SSSSSS")).otherwise(""), F.lit("+00:00"))


def canonical(c: Column, kind: Y.DataType) -> Column:
    """The canonical JSON of a column of this type, of any depth; null is ``null``.

    Variants are written by Spark's own rule, which has the keys in order too but other forms of numbers.
    """
    if isinstance(kind, Y.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        parts = [x for k, f in enumerate(fields) for x in (F.lit(("," if k else "") + json.dumps(f.name, ensure_ascii=False) + ":"), canonical(c[f.name], f.dataType))]
        out = F.when(c.isNotNull(), F.concat(F.lit("{"), *parts, F.lit("}")))
    elif isinstance(kind, Y.ArrayType):
        out = F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: canonical(x, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, Y.MapType):
        entry = lambda e: F.concat(quoted(e["key"].cast("string")), F.lit(":"), canonical(e["value"], kind.valueType))
        named = F.transform(F.map_entries(c), lambda e: F.struct(e["key"].cast("string").alias("key"), e.alias("e")))
        ordered = F.array_sort(named, lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
        out = F.concat(F.lit("{"), F.array_join(F.transform(ordered, lambda x: entry(x["e"])), ","), F.lit("}"))
    elif isinstance(kind, (Y.DoubleType, Y.FloatType)):
        out = number(c)
    elif isinstance(kind, Y.TimestampType):
        out = F.concat(F.lit('"'), utc_time(c), F.lit('"'))
    elif isinstance(kind, Y.TimestampNTZType):  # without a zone: taken as UTC
        out = F.concat(F.lit('"'), F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.date_format(c, "SSSSSS") != "000000", F.date_format(c, ".SSSSSS")).otherwise(""), F.lit('+00:00"'))
    elif isinstance(kind, Y.VariantType):
        out = F.to_json(c)
    elif isinstance(kind, (Y.StringType, Y.DateType)):
        out = quoted(c.cast("string"))
    else:  # whole numbers, decimals, booleans
        out = c.cast("string")
    return F.coalesce(out, F.lit("null"))


def canonical_hash(c: Column, kind: Y.DataType) -> Column:
    return F.sha2(canonical(c, kind), 256)
