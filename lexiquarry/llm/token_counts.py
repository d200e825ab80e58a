"""Token counts of whole texts (see ``tokenizing`` for the whole-token shortcut).

Defined results: null and empty texts have 0 tokens; long texts are counted whole, in batches bounded by
bytes; special strings inside a text count as the library's
default has them; repeated rows and rows of a null id are counted each; other columns, whatever their names,
play no part; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shipping import ship
from .shared import bound_batches, read_table, release
from .tokenizing import encoder, vocabulary_path


def n_tokens(text: Column, path: str) -> Column:
    @F.arrow_udf("long")
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        count = encoder(path, True)
        try:
            for batch in batches:
                yield pa.array(count.texts(batch.to_pylist()), pa.int64())
        finally:
            count.done()
            release()

    return counted(text)


def op2_token_counts(spark: SparkSession, sf_dir: str, limit: int = 2048) -> DataFrame:
    ship(spark)
    bound_batches(spark)
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), n_tokens(text, vocabulary_path()).alias("n_tokens"))
    return docs.withColumn("over_limit", F.col("n_tokens") > limit)
