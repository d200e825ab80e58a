"""Best-fit packing by a grouping genetic algorithm, on islands with elite migration.

Documents become pieces of at most ``limit`` tokens.  Full pieces are sequences of their own.  The others
are dealt by a digest to shards of about ``shard_items`` pieces; each shard is a bin packing problem that
several islands work on, each from its own seed:

* The first members of an island's population are packed by best fit in falling order of length, and in
  orders disturbed by noise.
* Crossover injects whole bins of one parent that are well filled into the other, removes the bins that hold
  a piece twice, and lets best fit place the displaced pieces.  The fitness is the mean square of the fills.
* After an epoch the elite of each island moves to the next island of its shard (a join on shard and
  island), and another epoch follows.  The shard's best plan wins.

Pieces from bins that are left with much room are then packed once more, dealt to new shards; the new plan
of a shard is taken if it has fewer bins.  All randomness is seeded by shard and island, and pieces are
written before they are dealt, so a task that runs again does the same.

Defined results: a null text counts as empty; an empty text still has its end token; rows that repeat a
doc_id are documents of their own; other columns play no part; an empty table gives no pieces.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shipping import ship
from .shared import bound_batches, discard, read_table, release, settle
from .tokenizing import encoder, vocabulary_path

LIMIT = 2048
#: The id that ends each document.
END_ID = b"\x00\x00\x00\x00"
PIECES = "piece int, start long, length long, ids_crc32 long, uid long"
ELITE = "shard long, island int, bins long, fitness double, plan binary"
PACKED = "uid long, bin long, offset long, bins long, room long"


def pieces_of(docs: DataFrame, path: str, limit: int = LIMIT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces of each document; uid tells rows apart and is fixed once the table is written."""
    ship(docs.sparkSession)
    bound_batches(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ids, uid = encoder(path, False), TaskContext.get().partitionId() << 36
        try:
            for batch in batches:
                rows: list[tuple] = []
                for doc, all_ids in enumerate(ids.texts(batch.column(1).to_pylist())):
                    all_ids += END_ID
                    for k, at in enumerate(range(0, len(all_ids), 4 * limit)):
                        part = all_ids[at : at + 4 * limit]
                        rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part), uid))
                        uid += 1
                cols = list(zip(*rows)) if rows else [()] * 6
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
                own = batch.column(0).take(pa.array(cols[0], pa.int64()))
                yield pa.RecordBatch.from_arrays([own, *[pa.array(c, t) for c, t in zip(cols[1:], kinds)]], names=["doc_id", "piece", "start", "length", "ids_crc32", "uid"])
        finally:
            ids.done()
            release()

    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(cut, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {PIECES}")


class Bins:
    """Open bins by room; finds the tightest bin for a length at once by a mask of the rooms there are."""

    def __init__(self, limit: int, room: np.ndarray | None = None):
        self.limit, self.by_room, self.mask, self.n = limit, [[] for _ in range(limit + 1)], 0, 0
        if room is not None:
            self.n = len(room)
            for k, r in enumerate(room.tolist()):
                if r > 0:
                    self.by_room[r].append(k)
                    self.mask |= 1 << r

    def place(self, lengths: list[int]) -> list[int]:
        out, by_room, mask = [], self.by_room, self.mask
        for size in lengths:
            fits = mask >> size
            if fits:
                room = size + (fits & -fits).bit_length() - 1
                at = by_room[room]
                k = at.pop()
                if not at:
                    mask ^= 1 << room
            else:
                room, k = self.limit, self.n
                self.n += 1
            out.append(k)
            if room := room - size:
                if not by_room[room]:
                    mask |= 1 << room
                by_room[room].append(k)
        self.mask = mask
        return out


def best_fit(lengths: np.ndarray, order: np.ndarray, limit: int) -> np.ndarray:
    plan = np.empty(len(lengths), np.int32)
    plan[order] = Bins(limit).place(lengths[order].tolist())
    return plan


def fitness(plan: np.ndarray, lengths: np.ndarray, limit: int) -> tuple[int, float]:
    """Bins, and the mean square of their fills: fewer bins, then more uneven ones, are better."""
    fill = np.bincount(plan, lengths) / limit
    return len(fill), float((fill**2).mean()) if len(fill) else 0.0


def compacted(plan: np.ndarray) -> np.ndarray:
    """Bins numbered without gaps."""
    return np.unique(plan, return_inverse=True)[1].astype(np.int32)


def crossover(into: np.ndarray, donor: np.ndarray, lengths: np.ndarray, limit: int, rng: np.random.Generator) -> np.ndarray:
    fill = np.bincount(donor, lengths)
    good = (fill >= np.quantile(fill, 0.5)) & (rng.random(len(fill)) < 0.5)  # whole well-filled bins
    moved = good[donor]
    hit = np.zeros(into.max() + 1, bool)
    hit[into[moved]] = True  # bins with a piece that is now there twice
    displaced = np.flatnonzero(hit[into] & ~moved)
    child = np.where(moved, donor, into + len(fill))
    child[displaced] = -1
    rest = np.flatnonzero(child >= 0)
    child[rest] = compacted(child[rest])
    room = limit - np.bincount(child[rest], lengths[rest]).astype(np.int64)
    order = displaced[np.argsort(-lengths[displaced], kind="stable")]
    child[order] = Bins(limit, room).place(lengths[order].tolist())
    return compacted(child)


def evolve(lengths: np.ndarray, limit: int, seed: list[int], elites: list[np.ndarray], members: int, births: int) -> np.ndarray:
    """The best plan of an island after an epoch."""
    rng = np.random.default_rng(seed)
    falling = np.argsort(-lengths, kind="stable")
    herd = [*elites] or [best_fit(lengths, falling, limit)]
    while len(herd) < members:
        noise = lengths * (1 + 0.2 * rng.random(len(lengths)))
        herd.append(best_fit(lengths, np.argsort(-noise, kind="stable"), limit))
    key = lambda p: (fitness(p, lengths, limit)[0], -fitness(p, lengths, limit)[1])
    ranked = sorted(((key(p), k, p) for k, p in enumerate(herd)), key=lambda x: x[:2])
    at_best = math.ceil(lengths.sum() / limit)
    for k in range(births):
        if ranked[0][0][0] <= at_best:
            break
        a, b = sorted(rng.choice(len(ranked), 2, replace=False))
        child = crossover(ranked[b][2], ranked[a][2], lengths, limit, rng)
        ranked.append((key(child), members + k, child))
        ranked.sort(key=lambda x: x[:2])
        ranked.pop()
    return ranked[0][2]


def offsets(plan: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    order = np.argsort(plan, kind="stable")
    run = np.cumsum(lengths[order]) - lengths[order]
    first = np.r_[True, plan[order][1:] != plan[order][:-1]] if len(plan) else np.zeros(0, bool)
    out = np.empty(len(plan), np.int64)
    out[order] = run - np.repeat(run[first], np.diff(np.r_[np.flatnonzero(first), len(plan)]))
    return out


def pack_items(items: DataFrame, limit: int, *, shards: int, islands: int, epochs: int, members: int, births: int, salt: int) -> DataFrame:
    """``items`` with bin, offset, and the bins of the shard and the bin's room."""
    ship(items.sparkSession)
    dealt = items.withColumn("shard", F.pmod(F.xxhash64("uid", F.lit(salt)), F.lit(shards)))
    work = dealt.select("uid", "length", "shard", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"))

    def epoch(key, rows: pd.DataFrame, came: pd.DataFrame) -> pd.DataFrame:
        shard, island = int(key[0]), int(key[1])
        if rows.empty:
            return pd.DataFrame({"shard": [], "island": [], "bins": [], "fitness": [], "plan": []})
        lengths = rows.sort_values("uid")["length"].to_numpy(np.int64)
        elites = [np.frombuffer(p, "<i4") for p in came.sort_values("island")["plan"]]
        plan = evolve(lengths, limit, [salt, shard, island, len(elites)], elites, members, births)
        bins, fit = fitness(plan, lengths, limit)
        return pd.DataFrame({"shard": [shard], "island": [island], "bins": [bins], "fitness": [fit], "plan": [plan.astype("<i4").tobytes()]})

    keys = ["shard", "island"]
    elites = dealt.sparkSession.createDataFrame([], ELITE + ", to_island int")
    for k in range(epochs):
        found = work.groupBy(*keys).cogroup(elites.withColumnRenamed("island", "from_island").withColumnRenamed("to_island", "island").groupBy(*keys)).applyInPandas(
            lambda key, a, b: epoch(key, a, b.assign(island=b["from_island"])), ELITE)
        found = settle(found, f"elites-{salt}-{k}")
        stay = found.withColumn("to_island", F.col("island"))
        elites = stay.unionByName(found.withColumn("to_island", (F.col("island") + 1) % islands)) if islands > 1 else stay
    best = found.groupBy("shard").agg(F.min_by("plan", F.struct("bins", -F.col("fitness"), "island")).alias("plan"))

    def settled(key, rows: pd.DataFrame, won: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("uid").reset_index(drop=True)
        lengths = rows["length"].to_numpy(np.int64)
        plan = np.frombuffer(won["plan"].iloc[0], "<i4").astype(np.int64)
        fill = np.bincount(plan, lengths).astype(np.int64)
        return pd.DataFrame({"uid": rows["uid"], "bin": plan + (int(key[0]) << 32), "offset": offsets(plan, lengths), "bins": len(fill), "room": limit - fill[plan]})

    # ids and digests don't pass through pandas: they may be null or of any type
    placed = dealt.select("uid", "length", "shard").groupBy("shard").cogroup(best.groupBy("shard")).applyInPandas(settled, PACKED)
    return items.join(placed, "uid")


def pack(pieces: DataFrame, *, limit: int = LIMIT, shard_items: int = 8192, islands: int = 2, epochs: int = 2, members: int = 4, births: int = 6, loose: float = 0.02) -> DataFrame:
    """PIECES with sequence_id and offset.  ``pieces`` must be a written table."""
    own = ["doc_id", "piece", "start", "length", "ids_crc32"]
    ga = {"islands": islands, "epochs": epochs, "members": members, "births": births}
    full = pieces.filter(F.col("length") >= limit).select(*own, (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    items = pieces.filter(F.col("length") < limit)
    first = settle(pack_items(items, limit, shards=max(1, -(-items.count() // shard_items)), salt=1, **ga), "packed")
    slack = first.filter(F.col("room") > loose * limit)
    tight = first.filter(F.col("room") <= loose * limit).select(*own, F.col("bin").alias("sequence_id"), "offset")
    left = slack.select(F.count("*"), F.count_distinct("bin")).first()
    if not left[0]:
        return full.unionByName(tight)
    again = settle(pack_items(slack.select(*own, "uid"), limit, shards=max(1, -(-left[0] // shard_items)), salt=2, **ga), "packed-again")
    n_again = again.select(F.count_distinct("bin")).first()[0]
    last, top = (again, 1 << 62) if n_again < left[1] else (slack, 0)
    return full.unionByName(tight).unionByName(last.select(*own, (F.col("bin") + F.lit(top)).alias("sequence_id"), "offset"))


def pack_documents(docs: DataFrame, path: str | None = None, **kw) -> DataFrame:
    return pack(settle(pieces_of(docs, path or vocabulary_path(), kw.get("limit", LIMIT)), "pieces"), **kw)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
