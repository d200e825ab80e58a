"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of five-word shingles; two are linked if their Jaccard similarity is 0.8 or more.

1. Every document becomes a set of 64-bit shingle digests and 128 MinHash values.  Documents with equal sets
   are one class; only classes go on, so copies are never paired.
2. Candidates: 32 bands of 4 values.  Classes that share a band meet in a bucket.  Buckets with the same
   members count once.  A large bucket is cut into blocks, and pairs of blocks are the tasks.
3. Bayesian pruning: values are compared 16 at a time.  With m of n equal and a flat prior, the similarity is
   Beta(m + 1, n - m + 1) distributed; a pair is dropped once the probability of 0.8 or more falls below
   ``tolerance``.  What survives in a block is told by a spanning forest, not pair by pair.
4. The components of these forests hold all pairs that can be linked.  Within a component, again in blocks
   (bounded by classes and by shingles), every pair is pruned as before over all 128 values and the rest verified exactly on their shingle sets.
   Each pair is met in one block only; a block gives its members' numbers of links and a spanning forest.
5. The components of the verified links are the groups.

Words are the pieces between white space, in lower case, without leading and trailing punctuation.

Defined results: texts with one to four words are one shingle; null and empty texts and texts without words
have the empty set, which is one class and linked to nothing; ties go to the smallest id, null last, then to
the smaller number of the row; ids may repeat and be of any type that can be ordered: rows are told apart by
numbers that are written beside them; long texts are cut into shingles whole; other columns, whatever their
names, play no part and are carried along by ``one_of_each``; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shipping import ship
from .components import components
from .shared import BROADCAST_KEYS, bound_batches, freeing, in_groups, join_keyed, partitions_for, read_table, settle, whole_groups, with_uid, without_rows

N_GRAM, THRESHOLD, HASHES, BANDS, STEP = 5, 0.8, 128, 32, 16
TOLERANCE = 1e-6
#: Values that step 3 compares at most; classes in a block of either step, and shingles in a block of step 4.
FIRST, BLOCK, BLOCK_GRAMS = 64, 1024, 1_000_000
PUNCTUATION = ".,;:!?\"'()[]{}<>«»…-–—*_#|"
#: Bytes of pieces of text that a task remembers the digests of.
WORD_BYTES = 8_000_000

_rng = np.random.default_rng(20240501)
_A = _rng.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads its input."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


class Words(dict):
    """Piece of lower-case text → 64-bit digest of its word, 0 if it has none.  Emptied when its strings exceed WORD_BYTES."""

    held = 0

    def __missing__(self, piece: str) -> int:
        self.held += len(piece)
        if self.held > WORD_BYTES:
            self.clear()
            self.held = len(piece)
        word = piece.strip(PUNCTUATION)
        found = self[piece] = int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") | 1 if word else 0
        return found


def shingles(text: str | None, words: Words, n: int = N_GRAM) -> np.ndarray:
    """The sorted distinct shingle digests of a text."""
    pieces = (text or "").lower().split()
    w = np.fromiter(map(words.__getitem__, pieces), np.uint64, len(pieces))
    w = w[w != 0]
    if not len(w):
        return w
    k = min(n, len(w))
    at = len(w) - k + 1
    s = w[:at].copy()
    for i in range(1, k):
        s = mixed(s * _M1 + w[i : i + at])
    return np.unique(mixed(s))


def min_hashes(s: np.ndarray) -> np.ndarray:
    x = (s >> np.uint64(32)).astype(np.uint32)
    if not len(x):
        return np.full(HASHES, 0xFFFFFFFF, np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 4096):
        out = np.minimum(out, (_A[:, None] * x[None, k : k + 4096] + _B[:, None]).min(1))
    return out


def bands_of(sig: np.ndarray) -> np.ndarray:
    """n x HASHES values → n x BANDS keys."""
    rows = HASHES // BANDS
    v = sig.reshape(len(sig), BANDS, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _M1, v.shape[:2]).copy()
    for r in range(rows):
        key = mixed(key ^ v[:, :, r] * _M1)
    return key.astype(np.int64)


@lru_cache(None)
def least_matches(n: int, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> int:
    """The least m for which P(similarity >= threshold | m of n equal) >= tolerance, with a flat prior.

    P(Beta(m + 1, n - m + 1) >= t) is P(Binomial(n + 1, t) <= m).
    """
    total = 0.0
    for m in range(n + 1):
        total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if total >= tolerance:
            return m
    return n


def plausible(sig: np.ndarray, upto: int, cross: int | None = None) -> np.ndarray:
    """Boolean matrix of the pairs that pruning leaves; with ``cross`` only those over that row."""
    n = len(sig)
    same = np.zeros((n, n), np.uint8)
    for k in range(STEP):
        same += sig[:, k, None] == sig[None, :, k]
    alive = np.triu(same >= least_matches(STEP), 1)
    if cross is not None:
        alive[:cross, :cross] = alive[cross:, cross:] = False
    i, j = np.nonzero(alive)
    m = same[i, j].astype(np.int32)
    for at in range(STEP, upto, STEP):
        if not len(i):
            break
        for k in range(0, len(i), 200_000):
            part = slice(k, k + 200_000)
            m[part] += (sig[i[part], at : at + STEP] == sig[j[part], at : at + STEP]).sum(1)
        left = m >= least_matches(at + STEP)
        i, j, m = i[left], j[left], m[left]
    out = np.zeros((n, n), bool)
    out[i, j] = out[j, i] = True
    return out


def roots(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric boolean matrix, the first row of its component."""
    root = np.full(len(linked), -1)
    for s in range(len(linked)):
        if root[s] < 0:
            edge = np.array([s])
            while len(edge):
                root[edge] = s
                edge = np.flatnonzero(linked[edge].any(0) & (root < 0))
    return root


def verified(sets: list[np.ndarray], maybe: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """The pairs of ``maybe`` (symmetric) whose exact similarity is the threshold or more."""
    i, j = np.nonzero(np.triu(maybe, 1))
    sizes = np.array([len(s) for s in sets])
    if len(i) > 16 * len(sets):  # many pairs: counts of common shingles by matrix products
        ids, of = np.unique(np.concatenate(sets), return_inverse=True)
        row = np.repeat(np.arange(len(sets)), sizes)
        shared = np.bincount(of) > 1
        col = (np.cumsum(shared) - 1)[of]
        keep = shared[of]
        row, col = row[keep], col[keep]
        common = np.zeros((len(sets), len(sets)), np.float32)
        order = np.argsort(col, kind="stable")
        row, col = row[order], col[order]
        for low in range(0, int(shared.sum()), 4096):
            a, b = np.searchsorted(col, [low, low + 4096])
            block = np.zeros((len(sets), 4096), np.float32)
            block[row[a:b], col[a:b] - low] = 1
            common += block @ block.T
        both = common[i, j].astype(np.int64)
    else:
        both = np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(i, j)], np.int64)
    good = both >= threshold * (sizes[i] + sizes[j] - both) - 1e-9
    out = np.zeros_like(maybe)
    out[i[good], j[good]] = out[j[good], i[good]] = True
    return out


def _binary(rows: list[np.ndarray]) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def sketch(docs: DataFrame) -> DataFrame:
    """uid, id, text → uid, id, k1, k2 (digest of the set), n, sig."""

    def do(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = [shingles(t, words) for t in part.column(2).to_pylist()]
                keys = np.array([np.frombuffer(blake2b(s.tobytes(), digest_size=16).digest(), "<i8") for s in sets])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array([len(s) for s in sets], pa.int64()), _binary([min_hashes(s) for s in sets])],
                    names=["uid", "id", "k1", "k2", "n", "sig"])

    return docs.select("uid", "id", "text").mapInArrow(freeing(do), f"uid long, id {docs.schema['id'].dataType.simpleString()}, k1 long, k2 long, n long, sig binary")


def reshingled(docs: DataFrame) -> DataFrame:
    """uid, text → cid, grams."""

    def do(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), _binary([shingles(t, words) for t in part.column(1).to_pylist()])], names=["cid", "grams"])

    return docs.select("uid", "text").mapInArrow(freeing(do), "cid long, grams binary")


def banded(classes: DataFrame) -> DataFrame:
    """cid, sig → bucket, cid."""

    def do(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                sig = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint32).reshape(-1, HASHES)
                yield pa.RecordBatch.from_arrays([pa.array(bands_of(sig).ravel()), pa.array(np.repeat(part.column(0).to_numpy(), BANDS))], names=["bucket", "cid"])

    return classes.select("cid", "sig").mapInArrow(freeing(do), "bucket long, cid long")


def dealt_in_blocks(rows: DataFrame, blocks: str) -> DataFrame:
    """Each row to every pair of blocks that its block is in, of ``blocks`` in its group: columns p, q (p <= q) and own."""
    size, blocks = blocks, F.col(blocks)
    rows = rows.withColumn("own", F.pmod(F.xxhash64("cid", F.lit(7)), blocks).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return rows.withColumn("p", F.least("own", "other")).withColumn("q", F.greatest("own", "other")).drop("other", size)


def _pairs_of_blocks(table: pa.Table, bounds: np.ndarray):
    """For each group: its slice with the rows of block p first, and where those of q begin (None: one block).

    Within a block rows stand by class, so forests of the same classes from other bands have the same roots.
    """
    p, q, own, cid = (table[c].to_numpy() for c in ("p", "q", "own", "cid"))
    for a, b in zip(bounds, bounds[1:]):
        order = a + np.lexsort((cid[a:b], own[a:b]))
        yield order, None if p[a] == q[a] else int((own[order] == p[a]).sum())


def forest(buckets: DataFrame, key: str, partitions: int) -> DataFrame:
    """Step 3: (a, b) of spanning forests over what pruning leaves of each pair of blocks."""

    def do(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, [key, "p", "q"]):
            cid = table["cid"].to_numpy()
            sig = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint32).reshape(-1, FIRST)
            a, b = [], []
            for order, cut in _pairs_of_blocks(table, bounds):
                if len(order) > 1:
                    root = roots(plausible(sig[order], FIRST, cut))
                    far = np.flatnonzero(root != np.arange(len(root)))
                    a.append(cid[order][far])
                    b.append(cid[order][root[far]])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return in_groups(buckets, [key, "p", "q"], partitions, do, "a long, b long")


def exact_links(rows: DataFrame, partitions: int) -> DataFrame:
    """Step 4: (cid, links, root) for members with links, of each pair of blocks of each component."""

    def do(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, ["label", "p", "q"]):
            cid = table["cid"].to_numpy()
            sig = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint32).reshape(-1, HASHES)
            grams = table["grams"]
            out: list[tuple] = []
            for order, cut in _pairs_of_blocks(table, bounds):
                if len(order) < 2:
                    continue
                sets = [np.frombuffer(grams[int(k)].as_py(), np.uint64) for k in order]
                linked = verified(sets, plausible(sig[order], HASHES, cut))
                count, root = linked.sum(1), roots(linked)
                far = np.flatnonzero(count)
                out.append((cid[order][far], count[far], cid[order][root[far]]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[k] for x in out]).astype(np.int64)) for k in range(3)], names=["cid", "links", "root"])

    return in_groups(rows, ["label", "p", "q"], partitions, do, "cid long, links long, root long")


def join_documents(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id, class_id (least id of its group), set_id (least id with an equal set), copies, n_links: a row for each row."""
    table, uid = with_uid(docs.select(key, text), "jaccard-docs")
    return _joined(table, uid, key, text).select("id", "class_id", "set_id", "copies", "n_links")


def _blocks(*ratios: Column) -> Column:
    return F.greatest(F.lit(1), *[F.ceil(r) for r in ratios]).cast("int")


def _joined(table: DataFrame, uid: str, key: str, text: str) -> DataFrame:
    """uid, id, class_id, class_uid (number of the row of class_id), set_id, copies, n_links."""
    bound_batches(table.sparkSession)
    ship(table.sparkSession)
    partitions = partitions_for(table.sparkSession)
    plain = table.select(F.col(uid).alias("uid"), F.col(key).alias("id"), F.col(text).alias("text"))
    seen = settle(sketch(plain), "sketches").withColumn("slot", F.pmod(F.xxhash64("uid"), F.lit(64)).cast("int"))
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "uid")).alias("first")
    slots = settle(seen.groupBy("k1", "k2", "slot").agg(F.min("uid").alias("cid"), first, F.count("*").alias("copies"), F.max("n").alias("n"), F.max("sig").alias("sig")), "slots")
    classes = slots.groupBy("k1", "k2").agg(F.min("cid").alias("cid"), F.min("first").alias("first"), F.sum("copies").alias("copies"), F.max("n").alias("n"), F.max("sig").alias("sig"))
    classes = settle(classes, "classes")

    buckets = banded(classes.filter("n > 0"))
    sizes = buckets.groupBy("bucket").agg(F.count("*").alias("members"), F.bit_xor(F.xxhash64("cid")).alias("mark"), F.min("cid").alias("head")).filter("members > 1")
    distinct = settle(sizes.groupBy("members", "mark", "head").agg(F.min("bucket").alias("bucket")).select("bucket", _blocks(F.col("members") / BLOCK).alias("blocks")), "buckets")
    met = join_keyed(buckets, distinct, "bucket").join(classes.select("cid", F.substring("sig", 1, 4 * FIRST).alias("sig")), "cid")
    links = settle(forest(dealt_in_blocks(met, "blocks"), "bucket", partitions), "near", (distinct,))
    near = components(links)

    wanted = near.withColumnRenamed("node", "cid").join(classes.select("cid", "n", "sig"), "cid")
    groups = wanted.groupBy("label").agg(_blocks(F.count("*") / BLOCK, F.sum("n") / BLOCK_GRAMS).alias("blocks"))
    wanted = settle(wanted.join(groups, "label").select("cid", "label", "blocks", "sig"), "wanted", (links, near))
    asked = wanted.select(F.col("cid").alias("uid"))
    texts = plain.select("uid", "text").join(F.broadcast(asked) if asked.count() <= BROADCAST_KEYS else asked, "uid", "left_semi")
    grams = reshingled(texts).join(wanted, "cid")
    links = settle(exact_links(dealt_in_blocks(grams, "blocks"), partitions), "exact", (wanted,))

    group_of = components(links.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    counted = links.groupBy("cid").agg(F.sum("links").alias("n_links"))
    told = classes.select("k1", "k2", "cid", "first", "copies").join(counted, "cid", "left").join(group_of.withColumnRenamed("node", "cid"), "cid", "left")
    told = settle(told.withColumn("label", F.coalesce("label", "cid")), "told", (links, group_of))
    least = told.groupBy("label").agg(F.min("first").alias("least"))
    told = told.join(least, "label").select("k1", "k2", F.col("least.id").alias("class_id"), F.col("least.uid").alias("class_uid"), F.col("first.id").alias("set_id"), "copies", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    by_slot = slots.select("k1", "k2", "slot").join(told, ["k1", "k2"])
    return seen.select("uid", "id", "k1", "k2", "slot").join(by_slot, ["k1", "k2", "slot"]).select("uid", "id", "class_id", "class_uid", "set_id", "copies", "n_links")


def one_of_each(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The row of the smallest id of each group, with all the columns of ``docs``."""
    table, uid = with_uid(docs, "jaccard-docs")
    gone = settle(_joined(table, uid, key, text).filter("uid <> class_uid").select(F.col("uid").alias(uid)), "gone")
    return without_rows(table, uid, gone)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_documents(read_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
