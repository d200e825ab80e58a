"""Quality by nearest-neighbour voting in a latent-semantic space.

* Terms: a text is a bag of three kinds of hashed terms, in blocks of one vector: its words (lower case), the
  shapes of neighbouring words (case, length, what follows the letters), and how words come again (the same
  word again, a word that was there before, a new one).  In each block a term's weight is the square root of
  its share of the block's terms, so that every block has length 1 and long texts weigh as short ones.
* Latent space: the vectors of a bounded sample of labelled rows are decomposed (the singular vectors of their
  largest singular values, from the sums of products of terms that Spark adds up over the sample); a text's
  vector is projected on them and scaled to length 1.
* Vote: the labelled vectors are broadcast; their size is bounded by ``sample_rows`` x ``dimensions``.  For
  every text its cosines with all of them are computed, block by block, and its ``neighbours`` nearest vote
  with their label, weighted by similarity (a power, ``sharpness``, of the cosine); what ties with the last of
  them votes too.  ``prior`` votes of the sample's mean label are added, so sparse votes lead nowhere far.

What is learned comes from labelled rows outside the held-out fold only, at most ``sample_rows`` of them, by the
least hashes of their ids.  A text's words are the only input of its score.  Rows are scored one by one, with
no shuffle but the sample's, so a lost executor costs its own tasks.

Defined results: null and empty texts have no neighbours and score the sample's mean label; long texts are read
whole; a null id is outside the fold; an id that several labels have counts as good only if all say so; texts
that several rows of the sample have are learned once, as the row of the smallest id; repeated rows are scored
each; ties vote together; without labels every score is 0.5; an empty table gives no rows; other columns,
whatever their names, play no part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shipping import ship
from .shared import bound_batches, freeing, read_table, release, settle

#: Places of the three blocks of a term vector.
WORDS, SHAPES, REPEATS = 1280, 253, 3
TERMS = WORDS + SHAPES + REPEATS
#: Texts whose cosines are computed at once.
BLOCK = 256
#: Cosines are rounded to so many digits, so that the order of summation doesn't choose neighbours.
DIGITS = 5


def shape_of(word: str) -> str:
    """The word's case, length class and last characters that are no letters or digits, at most three."""
    core = word.rstrip("".join({c for c in word if not c.isalnum()}))
    case = "0" if not core else "A" if core.isupper() and len(core) > 1 else "a" if core.islower() else "Aa" if core[0].isupper() else "x"
    return f"{case}{min(len(core), 12) // 4}{word[len(core) :][:3]}"


class Terms(dict):
    """Word → its number; numbers index arrays of word places and shapes.  Emptied when its strings exceed FULL bytes."""

    FULL = 8_000_000

    def __init__(self):
        super().__init__()
        self.places, self.shapes, self.held = [], [], 0

    def __missing__(self, word: str) -> int:
        self.held += len(word) + 60
        self.places.append(zlib.crc32(word.lower().encode("utf-8", "replace")) % WORDS)
        self.shapes.append(zlib.crc32(shape_of(word).encode("utf-8", "replace")))
        self[word] = number = len(self.places) - 1
        return number

    def vector(self, text: str | None) -> np.ndarray:
        words = (text or "").split()
        out = np.zeros(TERMS, np.float32)
        if not words:
            return out
        if self.held > self.FULL:
            self.clear()
            self.places, self.shapes, self.held = [], [], 0
        numbers = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        distinct, place_in = np.unique(numbers, return_inverse=True)
        places = np.array([self.places[k] for k in distinct])
        shapes = np.array([self.shapes[k] for k in distinct], np.uint64)[place_in]
        pairs = (shapes[:-1] * np.uint64(31) + shapes[1:]) % np.uint64(SHAPES) if len(words) > 1 else shapes % np.uint64(SHAPES)
        again = sum(map(eq, words, words[1:]))
        before = len(words) - len(distinct) - again
        out[:WORDS] = np.bincount(places[place_in], minlength=WORDS)
        out[WORDS : WORDS + SHAPES] = np.bincount(pairs.astype(np.int64), minlength=SHAPES)
        out[WORDS + SHAPES :] = again, before, len(distinct)
        for a, b in ((0, WORDS), (WORDS, WORDS + SHAPES), (WORDS + SHAPES, TERMS)):
            out[a:b] = np.sqrt(out[a:b] / out[a:b].sum())
        return out


class Voters:
    """The labelled latent vectors and the projection that leads to them."""

    def __init__(self, projection: np.ndarray, vectors: np.ndarray, good: np.ndarray, *, neighbours: int, sharpness: float, prior: float):
        self.projection, self.vectors, self.good = projection, vectors, good
        self.neighbours, self.sharpness, self.prior = neighbours, sharpness, prior
        self.mean = float(good.mean()) if len(good) else 0.5

    def latent(self, terms: np.ndarray) -> np.ndarray:
        out = terms @ self.projection
        size = np.sqrt((out * out).sum(1, keepdims=True))
        return np.divide(out, size, out=np.zeros_like(out), where=size > 0)

    def vote(self, terms: np.ndarray) -> np.ndarray:
        """The scores of a block of term vectors."""
        if not len(self.good):
            return np.full(len(terms), self.mean)
        near = np.round(self.latent(terms) @ self.vectors.T, DIGITS)
        k = min(self.neighbours, len(self.good))
        last = np.partition(near, -k, axis=1)[:, -k]
        weight = np.where((near >= last[:, None]) & (near > 0), near.astype(np.float64), 0.0) ** self.sharpness
        return np.round((weight @ self.good + self.prior * self.mean) / (weight.sum(1) + self.prior), 6)


def fold(key: Column) -> Column:
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(3))


def sample_of(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, rows: int) -> DataFrame:
    """(id, text, y) of at most ``rows`` labelled rows that are not held out, one a text."""
    own = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.min(label).alias("y"))
    own = own.filter(fold(F.col("id")) != 1).orderBy(F.xxhash64("id"), "id").limit(rows)
    found = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(F.broadcast(own), "id")  # of ``rows`` at most
    return found.groupBy(F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest")).agg(F.min(F.struct("id", "text", "y")).alias("r")).select("r.*")


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the task's sum of products of term vectors (its upper triangle)."""
    terms, total = Terms(), np.zeros((TERMS, TERMS), np.float32)
    for batch in batches:
        texts = batch.column("text")
        for k in range(0, len(texts), BLOCK):
            x = np.array([terms.vector(t) for t in texts.slice(k, BLOCK).to_pylist()])
            total += x.T @ x
    for k in range(0, TERMS, 128):
        rows = [total[i, i:] for i in range(k, min(k + 128, TERMS))]
        flat = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(r) for r in rows])], pa.int32()), pa.array(np.concatenate(rows), pa.float32()))
        yield pa.RecordBatch.from_arrays([pa.array(range(k, k + len(rows)), pa.int32()), flat], names=["term", "products"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tasks' rows of the terms of this task, added up in the order of their tasks' numbers."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for term, row in zip(batch.column("term").to_pylist(), batch.column("products")):
            row = row.values.to_numpy()
            total[term] = total[term] + row if term in total else row.astype(np.float64)
    for term, row in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([term], pa.int32()), pa.array([row], pa.list_(pa.float64()))], names=["term", "products"])


def latent_basis(rows: DataFrame, dimensions: int, tasks: int) -> np.ndarray:
    """The projection on the sample's leading singular vectors; their number is at most ``dimensions``.

    Every task sums the products over its share of the sample; the sums, TERMS x TERMS each whatever the
    sample's size, are added by term and come to the driver as one such square.
    """
    parts = rows.select("id", "text").repartitionByRange(tasks, "id").sortWithinPartitions("id").select("text").mapInArrow(freeing(_sums), "term int, products array<float>")
    found = parts.withColumn("task", F.spark_partition_id()).repartition(tasks, "term").sortWithinPartitions("term", "task").select("term", "products").mapInArrow(freeing(_added), "term int, products array<double>")
    square = np.zeros((TERMS, TERMS))
    for row in found.toArrow().to_batches():
        for term, products in zip(row.column("term").to_pylist(), row.column("products")):
            square[term, term:] = products.values.to_numpy()
    square += np.triu(square, 1).T
    size, vectors = np.linalg.eigh(square)
    vectors = vectors[:, ::-1][:, :dimensions][:, size[::-1][:dimensions] > 1e-6]
    flip = np.where(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])] < 0, -1.0, 1.0)
    return np.ascontiguousarray(vectors * flip, np.float32)


class Model:
    def __init__(self, spark: SparkSession, voters: Voters):
        self.voters = voters
        self._sent = spark.sparkContext.broadcast(voters)

    def score(self, text: Column) -> Column:
        sent = self._sent

        @F.arrow_udf("double")
        def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            terms, voters = Terms(), sent.value
            try:
                for batch in batches:
                    blocks = (batch.slice(k, BLOCK).to_pylist() for k in range(0, len(batch), BLOCK))
                    found = [voters.vote(np.array([terms.vector(t) for t in block])) for block in blocks]
                    yield pa.array(np.concatenate(found) if found else [], pa.float64())
            finally:
                del terms
                release()

        return scored(text)


def learn(
    docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality",
    sample_rows: int = 6_000, dimensions: int = 64, neighbours: int = 15, sharpness: float = 8.0, prior: float = 0.5,
) -> Model:
    """The model, from at most ``sample_rows`` labelled rows that are not held out."""
    spark = docs.sparkSession
    ship(spark)
    bound_batches(spark)
    rows = settle(sample_of(docs, labels, key, text, label, sample_rows), "quality-sample")
    n = rows.count()
    basis = latent_basis(rows, dimensions, max(1, min(8, n // 500))) if n else np.zeros((TERMS, 1), np.float32)
    maker = Voters(basis, np.zeros((0, basis.shape[1]), np.float32), np.zeros(0), neighbours=neighbours, sharpness=sharpness, prior=prior)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for batch in batches:
            texts = batch.column("text")
            for k in range(0, len(texts), BLOCK):
                x = maker.latent(np.array([terms.vector(t) for t in texts.slice(k, BLOCK).to_pylist()]))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(k, BLOCK), batch.column("y").slice(k, BLOCK).cast(pa.float64()), pa.array(list(x), pa.list_(pa.float32()))], names=["id", "y", "x"])

    id_type = rows.schema["id"].dataType.simpleString()
    seen = rows.select("id", "text", "y").mapInArrow(freeing(project), f"id {id_type}, y double, x array<float>").orderBy("id").toArrow() if n else None
    vectors = np.array(seen["x"].to_pylist(), np.float32) if n else maker.vectors
    good = (seen["y"].to_numpy() > 0).astype(np.float64) if n else maker.good
    return Model(spark, Voters(basis, vectors, good, neighbours=neighbours, sharpness=sharpness, prior=prior))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, read_table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", (F.coalesce(fold(F.col("doc_id")), F.lit(-1)) == 1).alias("held_out"), model.score(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
