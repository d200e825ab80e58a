"""Similarities as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


#: Levels of the proxy: (least Jaccard, similarity); fixed values.
LEVELS = ((0.8, 0.95), (0.7, 0.92), (0.6, 0.90))
CONTAINED = 0.97


def least_jaccard(threshold: float) -> float:
    """The Jaccard similarity below which no text similarity reaches the threshold."""
    return min([least for least, value in LEVELS if value >= threshold] + [max(0.0, threshold - 0.00005)])


def text_similarity(a: Column, b: Column, words_a: Column | None = None, words_b: Column | None = None, threshold: float = 0.0) -> Column:
    """Of normalised texts: 1 if equal, CONTAINED if one holds the other, else by levels of the words' Jaccard.

    Given the distinct words, pairs whose numbers of words rule the threshold out aren't compared (0).
    """
    words_a, words_b = (F.array_distinct(F.split(x, " ")) if w is None else w for x, w in ((a, words_a), (b, words_b)))
    need = least_jaccard(threshold)
    possible = F.least(F.size(words_a), F.size(words_b)) >= need * F.greatest(F.size(words_a), F.size(words_b))
    j = F.when(possible, jaccard(words_a, words_b)).otherwise(0.0)
    out = F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).when(F.contains(a, b) | F.contains(b, a), CONTAINED)
    for least, value in LEVELS:
        out = out.when(j >= least, value)
    return out.otherwise(F.round(j, 4))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms)
