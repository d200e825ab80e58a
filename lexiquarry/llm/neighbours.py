"""Approximate nearest neighbours by inner product: NN-descent and greedy graph search.

Vectors with equal components are one node, so copies don't fill each other's lists; a node keeps its smallest
ids, as many as an answer can hold.  For the graph a vector x becomes (x / M, sqrt(1 - |x|^2 / M^2)) with M the
largest norm: all have length one, and their order by inner product with (q, 0) is the order asked for.  Tasks
get them in 8-bit form; answers are scored on the originals in double precision.

* The first lists: nodes are put in order of their projection on a few random lines, and within blocks of
  ``block`` nodes along a line the nearest are found directly.  This is only a start: a block is 256 nodes
  whatever the table's size.
* NN-descent: in each round a node's neighbours, those it is a neighbour of, and the vectors of a sample of
  both meet in one group (a join on the node); they are compared with each other, new ones with new and old
  ones, and what is nearer than the last in someone's list goes to that node's list.  Rounds go on until fewer
  than ``settled`` of the lists' places change, ``rounds`` at most.
* Search: a query starts at its own node.  In each round the best nodes of its list not yet looked at are
  joined with the graph; their neighbours, both ways, are scored where they are, and only those that beat the last of
  a full list travel to it.  A query rests once its best ``steady`` nodes stay as they are for a round; rounds go on until
  all rest, ``hops`` at most.

Every row is indexed; nothing is sampled but the pairs that are compared.  ``tests/llm/recall.py`` measures
recall against brute force and the share of the table that a query is compared with (see README).

Defined results: null ids and vectors, zero vectors, those with null or non-finite components, and those of
another length than most take no part; a row that repeats id and vector counts once; an id with several
vectors is as many queries and candidates, each row for itself; ties go to the smaller id; with fewer
candidates than asked for all that are found are returned; an empty table gives no rows; other columns,
whatever their names, play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..plans.shipping import ship
from .shared import bound_batches, freeing, in_groups, partitions_for, read_table, settle, whole_groups

NONE = -(1 << 63)


def packed8(x: np.ndarray) -> list[bytes]:
    """Rows of floats as a 4-byte scale and signed bytes."""
    scale = np.maximum(np.abs(x).max(1), 1e-30).astype(np.float32) / 127
    q = np.rint(x / scale[:, None]).astype(np.int8)
    return [s.tobytes() + r.tobytes() for s, r in zip(scale, q)]


def unpacked8(rows: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(rows, np.uint8).reshape(n, -1)
    return raw[:, 4:].view(np.int8).astype(np.float32) * raw[:, :4].copy().view(np.float32)


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """id, v (array of double), k1, k2 (digest of v); ids of any type that can be ordered."""
    v = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(key).alias("id"), v.alias("v")).filter("id IS NOT NULL AND v IS NOT NULL")
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.filter(whole & F.exists("v", lambda x: x != 0))
    return rows.withColumn("k1", F.xxhash64("v")).withColumn("k2", F.xxhash64("v", F.lit(1)))


LISTS = "node long, ids binary, sims binary, fresh binary, v8 binary, moved int"


def _lists(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *[pa.array(c, pa.binary()) for c in cols[1:5]], pa.array(cols[5], pa.int32())], names=["node", "ids", "sims", "fresh", "v8", "moved"])


def first_lists(nodes: DataFrame, width: int, k: int, lines: int, block: int, partitions: int) -> DataFrame:
    """node, other, sim from direct comparison within blocks along random lines."""

    def do(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            while held.num_rows >= 2 * block:
                yield compared(held.slice(0, block))
                held = held.slice(block)
        if held is not None and held.num_rows:
            yield compared(held)

    def compared(table: pa.Table) -> pa.RecordBatch:
        n = table.num_rows
        ids = table["node"].to_numpy()
        x = unpacked8(b"".join(table["v8"].to_pylist()), n)
        most, found = min(k, n - 1), []
        for at in range(0, n, 512):
            sims = x[at : at + 512] @ x.T
            rows = np.arange(len(sims))
            sims[rows, at + rows] = -2
            near = np.argpartition(sims, n - most - 1, 1)[:, n - most :] if most else np.zeros((len(sims), 0), np.int64)
            found.append((np.repeat(at + rows, most), near.ravel(), sims[np.repeat(rows, most), near.ravel()]))
        row, near, sims = (np.concatenate([f[c] for f in found]) for c in range(3))
        return pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(ids[near]), pa.array(sims)], names=["target", "other", "sim"])

    found = None
    for line in range(lines):
        axis = np.random.default_rng(line + 1).normal(size=width)
        along = F.aggregate(F.zip_with("v", F.array(*[F.lit(float(a)) for a in axis]), lambda a, b: a * b), F.lit(0.0), lambda acc, y: acc + y)
        placed = nodes.select("node", "v8", along.alias("at")).repartitionByRange(partitions, "at").sortWithinPartitions("at", "node").select("node", "v8")
        part = placed.mapInArrow(do, "target long, other long, sim float")
        found = part if found is None else found.union(part)
    return found


def merged(lists: DataFrame, found: DataFrame, k: int, partitions: int) -> DataFrame:
    """The lists (node, ids, sims, fresh: not yet joined, v8, moved: places that changed) with what was found (target, other, sim).

    Without a sim, a row of ``found`` tells that the place of ``other`` in the list is joined, no longer fresh.
    """
    nothing = F.lit(None).cast("binary")
    rows = found.select(F.col("target").alias("node"), "other", "sim", *[nothing.alias(c) for c in ("ids", "sims", "fresh", "v8")])
    rows = rows.unionByName(lists.drop("moved").withColumn("other", F.lit(NONE)).withColumn("sim", F.lit(0.0).cast("float")))

    def do(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, ["node"]):
            node, other, sim = (table[c].to_numpy() for c in ("node", "other", "sim"))
            old = {c: table[c] for c in ("ids", "sims", "fresh", "v8")}
            out = []
            for a, b in zip(bounds, bounds[1:]):
                held = int(a + np.flatnonzero(other[a:b] == NONE)[0])
                joined = np.isnan(sim[a:b])
                new = ~joined
                new[held - a] = False
                ids = np.frombuffer(old["ids"][held].as_py(), np.int64)
                had = len(ids)
                fresh = np.frombuffer(old["fresh"][held].as_py(), np.int8) * ~np.isin(ids, other[a:b][joined])
                ids = np.r_[ids, other[a:b][new]]
                sims = np.r_[np.frombuffer(old["sims"][held].as_py(), np.float32), sim[a:b][new]]
                fresh = np.r_[fresh, np.ones(int(new.sum()), np.int8)]
                # what is held stands first and stays as it is
                _, first = np.unique(ids, return_index=True)
                ids, sims, fresh = ids[first], sims[first], fresh[first]
                best = np.lexsort((ids, -sims))[:k]
                moved = int((first[best] >= had).sum())
                out.append((int(node[a]), ids[best].tobytes(), sims[best].tobytes(), fresh[best].astype(np.int8).tobytes(), old["v8"][held].as_py(), moved))
            yield _lists(out)

    return in_groups(rows, ["node"], partitions, do, LISTS)


def exploded(lists: DataFrame) -> DataFrame:
    """node, other, fresh of each place in each list, and least: the last similarity of the list."""

    def do(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(x, np.int64) for x in batch.column(1).to_pylist()]
            last = np.array([np.frombuffer(x, np.float32)[-1] if x else -2 for x in batch.column(2).to_pylist()], np.float32)
            n = [len(x) for x in ids]
            fresh = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.int8)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(batch.column(0).to_numpy(), n)), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int64)), pa.array(fresh.astype(np.int32)), pa.array(np.repeat(last, n))],
                names=["node", "other", "fresh", "least"])

    return lists.select("node", "ids", "sims", "fresh").mapInArrow(do, "node long, other long, fresh int, least float")


def descended(lists: DataFrame, k: int, sample: int, turn: int, partitions: int) -> DataFrame:
    """One round of NN-descent."""
    flat = exploded(lists)
    ways = flat.select("node", "other", "fresh", F.lit(0).alias("way")).union(flat.select(F.col("other").alias("node"), F.col("node").alias("other"), "fresh", F.lit(1).alias("way")))
    order = Window.partitionBy("node", "fresh", "way").orderBy(F.xxhash64("node", "other", F.lit(turn)))
    some = settle(ways.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= sample).select("node", "other", "fresh", "way"), "sampled")
    last = F.when(F.octet_length("sims") >= 4 * k, F.substring("sims", -4, 4))  # of a full list
    met = some.join(lists.select(F.col("node").alias("other"), last.alias("last"), "v8"), "other")

    def do(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, ["node"]):
            other, fresh = table["other"].to_numpy(), table["fresh"].to_numpy() > 0
            last = np.array([np.frombuffer(s, np.float32)[0] if s else -2.0 for s in table["last"].to_pylist()], np.float32)
            x = unpacked8(b"".join(table["v8"].to_pylist()), table.num_rows)
            out = []
            for a, b in zip(bounds, bounds[1:]):
                at = a + np.lexsort((~fresh[a:b], other[a:b]))
                at = at[np.r_[True, other[at][1:] != other[at][:-1]]]  # one that is met both ways counts once, as new if either is
                new = fresh[at]
                if len(at) < 2 or not new.any():
                    continue
                sims = x[at] @ x[at].T
                pairs = new[:, None] | new[None, :]
                np.fill_diagonal(pairs, False)
                i, j = np.nonzero(pairs & (sims > last[at, None]))
                if len(i):
                    out.append((other[at[i]], other[at[j]], sims[i, j]))
            if out:
                target, found, sim = (np.concatenate([o[c] for o in out]) for c in range(3))
                order = np.lexsort((found, target))
                keep = np.r_[True, (target[order][1:] != target[order][:-1]) | (found[order][1:] != found[order][:-1])]
                order = order[keep]
                yield pa.RecordBatch.from_arrays([pa.array(target[order]), pa.array(found[order]), pa.array(sim[order])], names=["target", "other", "sim"])

    found = in_groups(met.select("node", "other", "fresh", "v8", "last"), ["node"], partitions, do, "target long, other long, sim float")
    joined = some.filter("way = 0 AND fresh = 1").select(F.col("node").alias("target"), "other", F.lit(None).cast("float").alias("sim"))
    return merged(lists, found.union(joined), k, partitions)


def nodes_of(rows: DataFrame) -> tuple[DataFrame, int]:
    """node, v (original), v8 (lifted, 8 bits) of each different vector; and the number of components."""
    sizes = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("m")).orderBy(F.desc("m"), "n").first()
    if sizes is None:
        return rows.select(F.lit(0).alias("node"), "v", F.lit(b"").alias("v8")), 0
    own = settle(rows.filter(F.size("v") == sizes.n).groupBy("k1", "k2").agg(F.min("v").alias("v")).select("k1", "k2", F.monotonically_increasing_id().alias("node"), "v"), "nodes")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    most = own.select(F.max(norm)).first()[0] or 1.0

    def do(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(3).to_pylist()).reshape(batch.num_rows, -1) / most
            lifted = np.c_[x, np.sqrt(np.maximum(0, 1 - (x**2).sum(1)))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(packed8(lifted), pa.binary())], names=["k1", "k2", "node", "v", "v8"])

    return settle(own.mapInArrow(do, "k1 long, k2 long, node long, v array<double>, v8 binary"), "lifted"), sizes.n


def graph(nodes: DataFrame, width: int, *, k: int = 32, rounds: int = 12, settled: float = 0.06, sample: int = 10, lines: int = 6, block: int = 256) -> DataFrame:
    partitions = partitions_for(nodes.sparkSession)
    along = max(1, min(partitions, nodes.count() // (2 * block)))  # no partition of a line without company
    empty = nodes.select("node", *[F.lit(b"").alias(c) for c in ("ids", "sims", "fresh")], "v8", F.lit(0).alias("moved"))
    lists = settle(merged(empty, first_lists(nodes, width, k, lines, block, along), k, partitions), "lists")
    for turn in range(rounds):
        lists = settle(descended(lists, k, sample, turn, partitions), "lists", (lists,))
        changed = lists.select(F.sum("moved") / F.greatest(F.sum(F.octet_length("ids") / 8), F.lit(1))).first()[0]
        if not changed or changed < settled:
            break
    return lists


def adjacency(lists: DataFrame, nodes: DataFrame, both: int) -> DataFrame:
    """node, others (ids) and their vectors: its list, and at most ``both`` of the nodes that list it."""
    flat = exploded(lists).select("node", "other")
    back = flat.select(F.col("other").alias("node"), F.col("node").alias("other"))
    order = Window.partitionBy("node").orderBy(F.xxhash64("node", "other"))
    back = back.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= both).select("node", "other")
    ways = flat.union(back).distinct().join(nodes.select(F.col("node").alias("other"), "v8"), "other")
    return ways.groupBy("node").agg(F.collect_list(F.struct("other", "v8")).alias("near"))  # k + both at most


STATE = "query long, ids binary, sims binary, done binary, v binary, next array<long>, scored long"


def search(queries: DataFrame, links: DataFrame, *, width: int, beam: int = 200, step: int = 48, hops: int = 7, steady: int = 40) -> DataFrame:
    """query, other, scored: the best ``beam`` nodes found for each query (query, node, v), and how many were scored for it."""
    spark = queries.sparkSession
    partitions = partitions_for(spark)
    links = links.repartition(partitions, "node").persist()

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = [np.array(x, np.float32).tobytes() for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(v, pa.binary())], names=["query", "node", "v"])

    def with_least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = np.array([np.frombuffer(x, np.float32)[0] if x else -np.inf for x in batch.column(3).to_pylist()], np.float32)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(least)], names=["query", "v", "node", "least"])

    started = settle(queries.select("query", "node", "v").mapInArrow(single, "query long, node long, v binary"), "started")
    frontier = started.select("query", "v", "node", F.lit(float("-inf")).cast("float").alias("least"))
    state = started.select("query", *[F.lit(b"").alias(c) for c in ("ids", "sims", "done")], "v", F.lit(0).cast("long").alias("scored"))
    for turn in range(hops):

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                query = batch.column(0).to_pylist()
                v = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float32).reshape(len(query), -1)
                near, least = batch.column(3), batch.column(4).to_numpy()
                ids, sims, count = [], [], []
                for r in range(len(query)):
                    own = near[r].values if near[r].is_valid else None
                    count.append(0 if own is None else len(own))
                    if not count[-1]:
                        ids.append(b"")
                        sims.append(b"")
                        continue
                    x = unpacked8(b"".join(own.field("v8").to_pylist()), len(own))
                    found = (x[:, :width] @ v[r]).astype(np.float32)
                    better = found > least[r]
                    ids.append(own.field("other").to_numpy()[better].tobytes())
                    sims.append(found[better].tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(ids, pa.binary()), pa.array(sims, pa.binary()), pa.array(count, pa.float64())], names=["query", "node", "ids", "sims", "scored"])

        found = frontier.repartition(partitions, "node").join(links, "node", "left").select("query", "v", "node", "near", "least").mapInArrow(scored, "query long, node long, ids binary, sims binary, scored double")
        nothing = F.lit(None).cast("binary")
        rows = found.withColumn("done", nothing).withColumn("v", nothing).unionByName(state.select("query", F.lit(NONE).alias("node"), "ids", "sims", "done", "v", F.col("scored").cast("double").alias("scored")))

        def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table, bounds in whole_groups(batches, ["query"]):
                query, node = table["query"].to_numpy(), table["node"].to_numpy()
                count = table["scored"].to_numpy()
                raw_ids, raw_sims, raw_done, raw_v = (table[c].to_pylist() for c in ("ids", "sims", "done", "v"))
                out = []
                for a, b in zip(bounds, bounds[1:]):
                    ids = np.concatenate([np.frombuffer(raw_ids[r], np.int64) for r in range(a, b)])
                    sims = np.concatenate([np.frombuffer(raw_sims[r], np.float32) for r in range(a, b)])
                    seen = [np.frombuffer(raw_done[r], np.int64) for r in range(a, b) if raw_done[r]]
                    seen = np.union1d(np.concatenate(seen) if seen else np.zeros(0, np.int64), node[a:b][node[a:b] != NONE])
                    ids, first = np.unique(ids, return_index=True)
                    sims = sims[first]
                    best = np.lexsort((ids, -sims))[:beam]
                    ids, sims = ids[best], sims[best]
                    held = int(a + np.flatnonzero(node[a:b] == NONE)[0])
                    before = np.frombuffer(raw_ids[held], np.int64)[:steady]
                    rests = len(before) and np.array_equal(before, ids[:steady])
                    todo = ids[:0] if rests else ids[~np.isin(ids, seen)][:step]
                    out.append((int(query[a]), ids.tobytes(), sims.tobytes(), seen.tobytes(), raw_v[held], todo.tolist(), int(count[a:b].sum())))
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0]), *[pa.array(c, pa.binary()) for c in cols[1:5]], pa.array(cols[5], pa.list_(pa.int64())), pa.array(cols[6], pa.int64())], names=["query", "ids", "sims", "done", "v", "next", "scored"])

        state = settle(in_groups(rows, ["query"], partitions, kept, STATE), "search")
        worst = F.when(F.octet_length("ids") >= 8 * beam, F.substring("sims", -4, 4))
        frontier = state.filter(F.size("next") > 0).select("query", "v", F.explode("next").alias("node"), worst.alias("worst")).mapInArrow(with_least, "query long, v binary, node long, least float")
        if turn + 1 < hops and state.filter(F.size("next") > 0).isEmpty():
            break
    links.unpersist()

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(x, np.int64) for x in batch.column(1).to_pylist()]
            n = [len(x) for x in ids]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), n)), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int64)), pa.array(np.repeat(batch.column(2).to_numpy(), n))], names=["query", "other", "scored"])

    return state.select("query", "ids", "scored").mapInArrow(freeing(told), "query long, other long, scored long")


def nearest(vectors: DataFrame, is_query, *, top_k: int = 20, key: str = "vec_id", vector: str = "embedding", rescore: int = 40, searching: dict | None = None, with_scored: bool = False, **kw) -> DataFrame:
    """query_id, rank, vec_id, score for the rows that ``is_query`` (a condition on ``id``) holds for.

    ``kw`` goes to ``graph``, ``searching`` to ``search``; ``with_scored`` adds how many nodes a query was compared with.
    """
    ship(vectors.sparkSession)
    bound_batches(vectors.sparkSession)
    rows = settle(usable(vectors, key, vector).dropDuplicates(["id", "k1", "k2"]), "vectors")
    nodes, width = nodes_of(rows)
    if not width:
        kind = rows.schema["id"].dataType.simpleString()
        return vectors.sparkSession.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double" + ", scored long" * with_scored)
    lists = graph(nodes, width, **kw)
    links = adjacency(lists, nodes, 24)

    copies = Window.partitionBy("k1", "k2").orderBy("id")
    members = rows.select("id", "k1", "k2").withColumn("place", F.row_number().over(copies)).filter(F.col("place") <= top_k + 1)
    members = members.join(nodes.select("k1", "k2", "node"), ["k1", "k2"]).select("node", "id")  # top_k + 1 at most for each node
    asking = rows.filter(is_query).join(nodes.select("k1", "k2", "node"), ["k1", "k2"])
    asking = settle(asking.select(F.monotonically_increasing_id().alias("query"), F.col("id").alias("query_id"), "v", "node"), "queries")

    found = settle(search(asking, links, width=width, **(searching or {})), "found", (lists,))
    own = asking.select("query", F.col("node").alias("other"))
    dot = F.aggregate(F.zip_with("v", "w", lambda a, b: a * b), F.lit(0.0), lambda acc, y: acc + y)
    pairs = found.select("query", "other").union(own).distinct().join(nodes.select(F.col("node").alias("other"), F.col("v").alias("w")), "other")
    pairs = pairs.join(asking.select("query", "query_id", "v", F.col("node").alias("own")), "query").select("query", "query_id", "own", F.col("other").alias("node"), dot.alias("score"))
    few = Window.partitionBy("query").orderBy(F.desc("score"), "node")
    pairs = pairs.withColumn("place", F.row_number().over(few)).filter(F.col("place") <= rescore)
    best = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    out = pairs.join(members, "node").filter("NOT (id = query_id AND node = own)").withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top_k)
    told = ["query_id", "rank", F.col("id").alias("vec_id"), "score"]
    if with_scored:
        out = out.join(found.groupBy("query").agg(F.max("scored").alias("scored")), "query")
        told.append("scored")
    return out.select(*told)


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read_table(spark, sf_dir, "embeddings"), F.pmod("id", F.lit(20)) == 0)
