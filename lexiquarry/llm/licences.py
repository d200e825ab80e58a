"""Licence scans: normalised text against licence templates by Dice's coefficient over word bigrams.

A text's units are its lines, and its paragraphs of several lines.  Unit and template are lower-cased, all
but letters and digits become spaces, and their sets of neighbouring words are compared:

    dice = 2 |A and B| / (|A| + |B|)

Two exact prunings come before that.  With threshold t a pair can only match if t / (2 - t) |B| <= |A| <=
(2 - t) / t |B|, so a unit meets only templates of about its size.  A match also shares at least t / (2 - t)
|B| bigrams with B, so it has one of any |B| - that + 1 bigrams of B: a text that has none of these
bigrams, of no template, has no unit to compare.

Defined results: null and empty texts and one-word units match nothing; ties between templates go to the
first name; repeated rows and null ids are scanned each; other columns play no part; an empty table gives no
rows.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import read_table

#: Notices and characteristic paragraphs of public licences; fixed values.
TEMPLATES = {
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BSD-3-Clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
THRESHOLD = 0.8
#: Splits words; ASCII besides letters and digits of any script.
NOT_WORD = r"[^\p{L}\p{N}]+"
PARAGRAPH = r"\n[ \t\r]*\n"


def bigrams_of(template: str) -> list[str]:
    words = re.sub(r"[\W_]+", " ", template.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def needed(size: int, threshold: float) -> int:
    """Bigrams of a template of that many which any match shares."""
    return math.ceil(threshold / (2 - threshold) * size - 1e-9)


def signs(templates: dict[str, str], threshold: float) -> list[str]:
    """Bigrams of which every match has one; those that fewest templates share first."""
    own = {name: bigrams_of(t) for name, t in templates.items()}
    shared = lambda b: (sum(b in x for x in own.values()), b)
    return sorted({b for x in own.values() for b in sorted(x, key=shared)[: len(x) - needed(len(x), threshold) + 1]})


def bigrams(text: Column) -> Column:
    """The neighbouring words of a text, repeats too."""
    words = F.filter(F.split(F.lower(text), NOT_WORD), lambda w: w != "")
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b))


def units(text: Column) -> Column:
    paragraphs = F.filter(F.split(text, PARAGRAPH), lambda p: F.contains(p, F.lit("\n")))
    return F.concat(F.split(text, "\n"), paragraphs)


def scan(docs: DataFrame, *, key: str = "doc_id", text: str = "text", templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and hits: (dice, licence, unit) of every unit and template that match, best first."""
    whole = F.coalesce(F.col(text), F.lit(""))
    some = F.array(*[F.lit(b) for b in signs(templates, threshold)])
    own = {name: bigrams_of(t) for name, t in sorted(templates.items())}

    def compared(u: Column) -> Column:
        """u: struct of a unit's text and its set of bigrams."""
        found = []
        for name, grams in own.items():
            low, high = needed(len(grams), threshold), math.floor((2 - threshold) / threshold * len(grams) + 1e-9)
            dice = 2.0 * F.size(F.array_intersect(u["grams"], F.array(*[F.lit(g) for g in grams]))) / (F.size(u["grams"]) + len(grams))
            found.append(F.when(F.size(u["grams"]).between(low, high), F.struct((-dice).alias("less"), F.lit(name).alias("licence"), u["unit"].alias("unit"))))
        return F.filter(F.array_compact(F.array(*found)), lambda x: -x["less"] >= threshold)

    cut = F.transform(units(whole), lambda u: F.struct(u.alias("unit"), F.array_distinct(bigrams(u)).alias("grams")))
    small = F.filter(cut, lambda u: F.arrays_overlap(u["grams"], some))
    hits = F.array_sort(F.flatten(F.transform(small, compared)))
    none = F.array().cast("array<struct<less:double,licence:string,unit:string>>")
    hits = F.when(F.arrays_overlap(bigrams(whole), some), hits).otherwise(none)
    return docs.select(F.col(key).alias("doc_id"), F.transform(hits, lambda h: F.struct((-h["less"]).alias("dice"), h["licence"].alias("licence"), h["unit"].alias("unit"))).alias("hits"))


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read_table(spark, sf_dir, "documents"))
    first = F.try_element_at("hits", F.lit(1))
    return found.select(
        "doc_id", F.size("hits").cast("long").alias("n_hits"), first["licence"].alias("best_licence"), first["dice"].alias("best_dice"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["licence"]))), ",").alias("licences"))


def _sql() -> str:
    quoted = lambda b: "'" + b.replace("'", "''") + "'"
    rows = ", ".join(f"({quoted(n)}, [{', '.join(quoted(b) for b in bigrams_of(t))}])" for n, t in sorted(TEMPLATES.items()))
    return rf"""
WITH templates(licence, grams) AS (VALUES {rows}),
docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
cut AS (
  SELECT r, unnest(string_split(text, chr(10))) AS unit FROM docs
  UNION ALL
  SELECT r, unit FROM (SELECT r, unnest(regexp_split_to_array(text, '\n[ \t\r]*\n')) AS unit FROM docs) WHERE contains(unit, chr(10))
), worded AS (
  SELECT r, unit, list_filter(regexp_split_to_array(lower(unit), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '') AS w FROM cut
), grammed AS (
  SELECT r, unit, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM worded WHERE len(w) > 1
), compared AS (
  SELECT r, licence, 2.0::DOUBLE * len(list_intersect(g, grams)) / (len(g) + len(grams)) AS dice
  FROM grammed, templates WHERE len(g) BETWEEN ceil({THRESHOLD} / (2 - {THRESHOLD}) * len(grams) - 1e-9) AND floor((2 - {THRESHOLD}) / {THRESHOLD} * len(grams) + 1e-9)
), hit AS (
  SELECT r, count(*) AS n, arg_min(licence, (-dice, licence)) AS best, max(dice) AS top, string_agg(DISTINCT licence, ',' ORDER BY licence) AS names
  FROM compared WHERE dice >= {THRESHOLD} GROUP BY r
)
SELECT doc_id, coalesce(n, 0) AS n_hits, best AS best_licence, top AS best_dice, coalesce(names, '') AS licences FROM docs LEFT JOIN hit USING (r)
"""


OP8_SQL = _sql()
