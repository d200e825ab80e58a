"""Conversation prefix trie by partition refinement.

Conversations with the same first turns share a path from the root.  The trie is built from classes of conversations
that agree so far:

* Turns are told apart by digests, so texts are read once and not shuffled.
* Conversations that are equal throughout are one sequence with a number of copies, found by grouping; so a
  conversation with any number of copies is one member from then on.
* It starts with one class, the root's, of all sequences.  In each round every active class looks for the first
  turn on which its members differ.  The turns before are nodes that all share, a unary chain; at that turn
  the class splits by digest, one new class and node a digest.
* A class with one member is retired at once: the rest of its turns is emitted as a unary chain.  Rows of retired
  members and turns that are passed leave the table of live turns, so later rounds are small.
* Rounds go with the number of branchings on a path, not with the length of conversations.
* Fold back: from the last round to the first the classes' leaves, children and saved characters are added to the
  class they came from; within a chain the sums run from its end.

All this is joins and groupings on (class, turn); a class's label is its smallest member.  A conversation or class of
any size is spread: ranks and sums within chains are running sums over slices (``running``), the ids of a
node's copies are written in pieces by slices, and one digest reads the pieces as they come.

Defined results: a null role or text counts as empty; a null turn comes first; turns of a conversation that tie
go by their digests; rows that repeat are turns each; rows of a null conv_id belong to no conversation and are left
out; texts of any length count; c-c%100 and crc32 are as in SQL (c%100 has the sign of c); a conversation without
turns after rebuilding ends at the root; an empty table has no conversations and no nodes, the root included;
other columns, whatever their names, play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shipping import ship
from .running import running_sum
from .shared import bound_batches, discard, freeing, join_keyed, partitions_for, read_table, settle

#: Rebuilding: conversations of one hundred share up to HEAD - 1 first turns.
FAMILY, HEAD = 100, 6


def digest_of(role: Column, text: Column) -> Column:
    """The 32 bytes that stand for a turn."""
    return F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, k, digest, chars): the turns of each conversation in order, k from 1."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.filter("conv_id IS NOT NULL").select("conv_id", "turn", digest_of(role, text).alias("digest"), F.char_length(text).cast("long").alias("chars"), F.monotonically_increasing_id().alias("row"))
    order = [F.col("turn").asc_nulls_first(), F.col("digest"), F.col("row")]
    return running_sum(turns, ["conv_id"], order, F.lit(1).cast("long"), "k").select("conv_id", "k", "digest", "chars")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations with the first turns of their family's first one: (conv_id, depth, digest, chars), (conv_id)."""
    c = F.col("conv_id")
    heads = turns.filter((c % FAMILY == 0) & (F.col("k") < HEAD)).groupBy(c.alias("base")).agg(F.sort_array(F.collect_list(F.struct("k", "digest", "chars"))).alias("head"))
    convs = turns.filter("k = 1").select("conv_id", (c - c % FAMILY).alias("base"), (F.crc32(c.cast("string").cast("binary")) % HEAD).cast("int").alias("h"))
    own = convs.join(heads, "base", "left").select("conv_id", "h", F.when(F.col("h") > 0, F.slice("head", 1, F.greatest("h", F.lit(1)))).alias("head"))
    own = settle(own.withColumn("m", F.coalesce(F.size("head"), F.lit(0)).cast("long")).withColumn("m", F.greatest("m", F.lit(0))), "trie-heads")
    tails = join_keyed(turns, own.select("conv_id", "h", "m"), "conv_id").filter("k > h").select("conv_id", (F.col("m") + F.col("k") - F.col("h")).alias("depth"), "digest", "chars")
    firsts = own.filter("m > 0").select("conv_id", F.explode("head").alias("t")).select("conv_id", F.col("t.k").alias("depth"), "t.digest", "t.chars")
    return settle(firsts.unionByName(tails), "trie-turns"), settle(own.select("conv_id"), "trie-convs", (own,))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (rep, conv_id) in order: the ids of a stretch of one rep, joined by commas."""
    for batch in batches:
        if not batch.num_rows:
            continue
        rep, conv = batch.column("rep").to_numpy(), batch.column("conv_id").to_numpy()
        at = np.r_[0, np.flatnonzero(rep[1:] != rep[:-1]) + 1]
        ids = [",".join(map(str, part)) for part in np.split(conv, at[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(rep[at]), pa.array(conv[at]), pa.array(ids)], names=["rep", "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From pieces in order: the digest of each rep's ids."""
    now, state = None, None
    out = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([state.hexdigest()])], names=["rep", "ends_sha256"])
    for batch in batches:
        for rep, ids in zip(batch.column("rep").to_pylist(), batch.column("ids")):
            if rep != now:
                if state:
                    yield out()
                now, state = rep, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.as_py().encode())
    if state:
        yield out()


def id_digests(copies: DataFrame) -> DataFrame:
    """(rep, ends_sha256) from (rep, conv_id): the ids of a rep, ascending, joined by commas and hashed.

    A hash reads its input in order, so one task hashes the ids of a rep; but they are sorted and joined in
    slices, by all tasks, and it gets them as pieces, holding one at a time.
    """
    tasks = partitions_for(copies.sparkSession)
    long_ids = copies.select(F.col("rep").cast("long"), F.col("conv_id").cast("long"))
    pieces = long_ids.repartitionByRange(tasks, "rep", "conv_id").sortWithinPartitions("rep", "conv_id").mapInArrow(freeing(_pieces), "rep long, first long, ids string")
    return pieces.repartition(tasks, "rep").sortWithinPartitions("rep", "first").mapInArrow(freeing(_digests), "rep long, ends_sha256 string")


def sequences(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Equal conversations grouped: (rep, n, mult), and (rep, ends_sha256) of their ids; rep is the smallest."""
    lanes = [F.bit_xor(F.xxhash64(F.lit(k), "depth", "digest")).alias(f"x{k}") for k in range(3)]
    own = convs.join(turns.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"), *lanes), "conv_id", "left")
    key = ["n", "chars", "x0", "x1", "x2"]
    own = settle(own.select("conv_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in key]), "trie-keys")
    groups = settle(own.groupBy(*key).agg(F.min("conv_id").alias("rep"), F.count("*").alias("mult")), "trie-groups")
    copies = join_keyed(own, settle(groups.filter("mult > 1").select(*key, "rep"), "trie-copied"), key).select("rep", "conv_id")
    ends = id_digests(copies).unionByName(groups.filter("mult = 1").select("rep", F.sha2(F.col("rep").cast("string"), 256).alias("ends_sha256")))
    return settle(groups.select("rep", "n", "mult"), "trie-reps"), settle(ends, "trie-ends", (own, groups))


NODE = ["label", "at", "depth", "parent", "n_convs", "digest", "chars"]


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of the trie of settled ``turns`` (conv_id, depth from 1, digest, chars) of all ``convs`` (conv_id).

    A row a node: conv_id (smallest member), depth, parent_conv_id, digest (of its last turn; see ``with_texts``),
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    spark = turns.sparkSession
    ship(spark)
    bound_batches(spark)
    reps, end_digests = sequences(turns, convs)
    first = reps.agg(F.min("rep"), F.count("*"), F.sum("mult")).first()
    if not first[1]:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, digest binary, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    live = settle(join_keyed(turns.withColumnRenamed("conv_id", "rep"), reps.select("rep"), "rep"), "trie-live")

    root = reps.select(F.lit(first[0]).cast("long").alias("label"), F.lit(0).cast("long").alias("at"), F.lit(None).cast("long").alias("parent"), F.lit(first[2]).cast("long").alias("n_convs"), F.lit(first[1]).cast("long").alias("n_seqs")).limit(1)
    classes = settle(root, "trie-class")
    moved = settle(reps.select("rep", "n", "mult", F.lit(first[0]).cast("long").alias("label"), F.lit(0).cast("long").alias("at"), F.lit(first[1]).cast("long").alias("n_seqs")), "trie-moved")
    rounds, ends, scrap = [classes], [], [moved]
    nodes = [classes.select("label", "at", F.col("at").alias("depth"), "parent", "n_convs", F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("chars"))]
    passed, level = None, None
    while True:
        single = moved.filter("n_seqs = 1")
        ends.append(single.select("rep", "label", F.col("n").alias("depth")))
        left = live.select("rep", "depth", "digest", "chars")
        tails = join_keyed(left, single.select("rep", "label", "at", "mult"), "rep").filter("depth > at").select("label", "at", "depth", F.col("label").alias("parent"), F.col("mult").alias("n_convs"), "digest", "chars")
        nodes.append(settle(passed.unionByName(tails) if passed else tails, "trie-nodes", (level,)))
        active = moved.filter("n_seqs > 1")
        if active.isEmpty():
            break
        live = settle(join_keyed(left, active.drop("n_seqs"), "rep").filter("depth > at"), "trie-live", (live,))
        level = live.groupBy("label", "depth").agg(F.count("*").alias("c"), F.min("digest").alias("digest"), F.max("digest").alias("other"), F.min("chars").alias("chars"))
        level = settle(join_keyed(level, classes.filter("n_seqs > 1"), "label").withColumn("agree", (F.col("c") == F.col("n_seqs")) & (F.col("digest") == F.col("other"))), "trie-level")
        split = settle(level.filter("NOT agree").groupBy("label").agg(F.min("depth").alias("s")), "trie-split")
        ends.append(join_keyed(active, split, "label").filter("n < s").select("rep", "label", F.col("n").alias("depth")))
        chain = join_keyed(level, split, "label").filter("depth < s").select("label", "at", "depth", F.col("label").alias("parent"), "n_convs", "digest", "chars")
        at_split = join_keyed(live.drop("at"), split, "label").filter("depth = s")
        new = settle(at_split.groupBy("label", "digest").agg(F.min("rep").alias("to"), F.min("s").alias("at"), F.sum("mult").alias("n_convs"), F.count("*").alias("n_seqs"), F.min("chars").alias("chars")), "trie-new")
        moved = settle(join_keyed(at_split.select("rep", "n", "mult", "label", "digest"), new.select("label", "digest", "to", "at", "n_seqs"), ["label", "digest"]).select("rep", "n", "mult", F.col("to").alias("label"), "at", "n_seqs"), "trie-moved")
        classes = new.select(F.col("to").alias("label"), "at", F.col("label").alias("parent"), "n_convs", "n_seqs")
        passed = chain.unionByName(new.select(F.col("to").alias("label"), "at", F.col("at").alias("depth"), F.col("label").alias("parent"), "n_convs", "digest", "chars"))
        rounds.append(classes)
        scrap += [split, new, moved]
    every = settle(reduce(DataFrame.unionByName, [n.select(*NODE) for n in nodes]), "trie-all", tuple(nodes[1:]) + (live,))
    every = running_sum(every, ["label", "at"], [F.desc("depth")], (F.col("n_convs") - 1) * F.col("chars"), "own")
    folded = _folded(every, rounds)
    ended = settle(join_keyed(reduce(DataFrame.unionByName, ends), end_digests, "rep").select("label", "depth", "ends_sha256"), "trie-ended", (reps, end_digests, *rounds[:1], *scrap))
    out = join_keyed(every, folded, ["label", "at"]).join(ended, ["label", "depth"], "left")
    return out.select(
        F.col("label").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "digest", "n_convs",
        F.when(F.col("depth") < F.col("last"), 1).otherwise(F.col("kids")).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("own") + F.col("below")).alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def _folded(nodes: DataFrame, rounds: list[DataFrame]) -> DataFrame:
    """(label, at, last, kids, leaves, below) of each class: its chain's last depth, and what its children's subtrees hold."""
    chains = settle(nodes.groupBy("label", "at").agg(F.max("depth").alias("last"), F.max("own").alias("total")), "trie-chains")
    done, below = [], None
    for classes in reversed(rounds):
        found = classes.select("label", "at", "parent").join(chains, ["label", "at"])
        if below is None:
            found = found.select("*", F.lit(0).cast("long").alias("kids"), F.lit(1).cast("long").alias("leaves"), F.lit(0).cast("long").alias("below"))
        else:
            sums = below.groupBy(F.col("parent").alias("label")).agg(F.count("*").alias("kids"), F.sum("leaves").alias("leaves"), F.sum(F.col("total") + F.col("below")).alias("below"))
            found = found.join(sums, "label", "left").select("label", "at", "parent", "last", "total", *[F.coalesce(c, F.lit(v).cast("long")).alias(c) for c, v in (("kids", 0), ("leaves", 1), ("below", 0))])
        below = settle(found, "trie-folded")
        done.append(below)
    return settle(reduce(DataFrame.unionByName, done).drop("parent", "total"), "trie-fold", (chains, *done))


def with_texts(nodes: DataFrame, conversations: DataFrame) -> DataFrame:
    """``nodes`` with role and text of their last turns (null at the root), from the table that they came from."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    texts = conversations.select(digest_of(role, text).alias("digest"), F.struct(role.alias("role"), text.alias("text")).alias("t")).groupBy("digest").agg(F.min("t").alias("t"))
    return nodes.join(texts, "digest", "left").select(*nodes.columns, "t.role", "t.text")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbers = numbered(read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    turns, convs = rebuilt(numbers)
    discard(numbers)
    return prefix_trie(turns, convs).drop("digest")


#: CRC-32 of the decimal id, bit by bit.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda acc, x: list_reduce(list_prepend(xor(acc, x), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda a, z: xor(a >> 1, 3988292384 * (a & 1)))), 4294967295) % 6"""

OP12_SQL = f"""
WITH t AS (
  SELECT conv_id, length(coalesce(text, '')) AS chars, turn, sha256(CAST(octet_length(encode(coalesce(role, ''))) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest FROM conversations WHERE conv_id IS NOT NULL
), k AS (
  SELECT conv_id, chars, digest, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS k FROM t
), c AS (
  SELECT DISTINCT conv_id, conv_id - conv_id % 100 AS base, {_CRC} AS h FROM k
), b AS (
  SELECT c.conv_id, k.k AS depth, k.digest, k.chars FROM c JOIN k ON k.conv_id = c.base AND k.k <= c.h
), m AS (
  SELECT c.conv_id, c.h, (SELECT count(*) FROM b WHERE b.conv_id = c.conv_id) AS m FROM c
), r AS (
  SELECT conv_id, depth, digest, chars FROM b
  UNION ALL SELECT k.conv_id, m.m + k.k - m.h, k.digest, k.chars FROM k JOIN m ON m.conv_id = k.conv_id AND k.k > m.h
  UNION ALL SELECT conv_id, 0, '', 0 FROM c
), p AS (
  SELECT conv_id, depth, chars, sha256(string_agg(digest, ',') OVER (PARTITION BY conv_id ORDER BY depth)) AS path, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM r
), q AS (
  SELECT *, lag(path) OVER (PARTITION BY conv_id ORDER BY depth) AS above FROM p
), n AS (
  SELECT depth, path, min(conv_id) AS conv_id, any_value(above) AS above, count(*) AS n_convs, (count(*) - 1) * any_value(chars) AS saved,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM q GROUP BY depth, path
), kids AS (
  SELECT depth - 1 AS depth, above AS path, count(*) AS n FROM n WHERE depth > 0 GROUP BY ALL
), full_nodes AS (
  SELECT n.*, coalesce(kids.n, 0) AS n_children, par.conv_id AS parent_conv_id FROM n LEFT JOIN kids USING (depth, path) LEFT JOIN n AS par ON par.depth = n.depth - 1 AND par.path = n.above
), sub AS (
  SELECT q.depth, q.path, sum(f.saved) AS saved_tokens, count(*) FILTER (f.n_children = 0) AS n_leaves FROM full_nodes f JOIN q ON q.conv_id = f.conv_id AND q.depth <= f.depth GROUP BY q.depth, q.path
)
SELECT f.conv_id, CAST(f.depth AS BIGINT) AS depth, f.parent_conv_id, f.n_convs, f.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, f.ends_sha256 FROM full_nodes f JOIN sub USING (depth, path)
"""
