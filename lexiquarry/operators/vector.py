"""Exact vector search for a stated set of queries, and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import cosine


def vector_top_k(vectors: DataFrame, queries: DataFrame, *, k: int = 20, key: str = "vec_id", vector: str = "embedding", digits: int = 6) -> DataFrame:
    """query_id, vec_id, similarity, rank for the rows of ``queries`` (query_id, query) against all vectors.

    The queries are a stated set, broadcast behind a check of its size; each task keeps its own best k.
    """
    few = queries.limit(10_001).count() <= 10_000
    pairs = vectors.crossJoin(F.broadcast(queries) if few else queries)
    scored = pairs.select("query_id", F.col(key).alias("vec_id"), F.round(cosine(F.col(vector), F.col("query")), digits).alias("similarity"))
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
