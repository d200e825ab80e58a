"""The training-data pipeline: from documents to packed sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``docs``.  A stage works on all that its predecessor kept, written as Parquet and read again in between.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiquarry.llm import exact_dedup, jaccard_join, mixing, packing, toxicity
from lexiquarry.llm.shared import read_table, settle

#: Scores from which a document is rejected.
TOXIC_FROM = 0.3


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below TOXIC_FROM.

    The score is learned from the labels and reads whole texts; null and empty texts stay, repeated rows are
    scored each, and without labels the listed words decide.  An empty table stays empty.
    """
    model = toxicity.learn(docs, read_table(spark, sf_dir, "labels"))
    return docs.filter(model.score(F.col("text")) < TOXIC_FROM)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows whose texts are equal but for white space one: the longest, then that of the smallest id.

    Rows that share an id but not a text all stay; null and empty texts are one group.
    """
    return exact_dedup.deduplicated(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row, that of the smallest id (null last).  Rows are told apart, not ids."""
    return jaccard_join.one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix of sources takes them; a null source is a source, null texts have no words."""
    return mixing.repeated(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens in sequences; a repeated document is packed as often as it is there."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("exact_dedup", without_copies),
    ("jaccard_join", without_near_copies),
    ("mixing", mixed),
    ("packing", packed),
]

#: Learned scores and a genetic algorithm can't be said in SQL; the tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; a stage's input is deleted once its output is written."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name, (docs,))
    return docs
