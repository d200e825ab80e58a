"""Exact dedup by a log-structured merge index of text digests.

Two texts are equal when they are identical after white space (space, U+0009 to U+000D) is deleted.

* The log: each row of the documents gets a number; number, id, digest of the normalised text and length are
  written beside it.
* Memtables: the rows of one input split are a memtable, so its size is bounded by the split's.  It keeps one
  entry for a digest, the best row and how many there were, and is flushed to a run of level 0: entries
  ordered by digest.
* The filter: hashes of the entries' digests are counted in slots, and a bitmap tells the slots that more than
  one entry has.  It is asked before runs are merged: an entry alone in its slot is in no other run and stays
  where it is.  False positives are merged for nothing, but nothing is missed.
* Compaction: level by level ``fanout`` runs become one, digest by digest; of the entries the best row stays
  (most code points, then smallest id, then smallest number) and counts add up.
* Byte verification: a second bitmap, of the digests with more than one row, is asked before texts are read,
  so only texts of hits are shuffled; they are grouped by digest and bytes.  If a digest has two texts, its
  rows are resolved by the bytes instead.
* A row finds its entry by (digest, run), so the copies of one text, however many, are spread over all runs.

``LsmIndex`` is the same index for documents that come batch by batch.

Defined results: a null text counts as empty, and all empty or blank texts are equal; a null id comes last
among equals; ids may repeat and be of any type that can be ordered: rows are told apart by their numbers,
and exactly one row of each group is kept, also of rows that are the same throughout; texts of any length are
hashed and compared whole; an empty table gives an empty result; other columns, whatever their names, play no
part and are carried along by ``deduplicated``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import BROADCAST_ROWS, discard, free_name, read_table, settle, with_uid, without_blanks, without_rows

#: Runs of level 0, and how many runs become one of the next level.
RUNS, FANOUT = 64, 8
#: Slots of a filter for each entry, and the buckets (of 4 KB) up to which a filter is broadcast.
SLOTS, FILTER_BUCKETS = 16, 8_192


def sha256(norm: Column) -> Column:
    return F.unhex(F.sha2(norm, 256))


class Filter:
    """A bitmap of hash slots, cut into buckets of 32,768 bits."""

    def __init__(self, hashes: DataFrame, entries: int, *, shared: bool = False):
        """Of the column ``hash``; with ``shared`` only of slots that more than one row has."""
        self.slots = 1 << max(15, (SLOTS * entries - 1).bit_length())
        slots = hashes.select(self._slot(F.col("hash")).alias("slot"))
        if shared:
            slots = slots.groupBy("slot").agg(F.count("*").alias("n")).filter("n > 1")
        bits = slots.groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
        self.bits = settle(bits, "filter")
        self.small = self.slots >> 15 <= FILTER_BUCKETS

    def _slot(self, hashed: Column) -> Column:
        return F.pmod(hashed, F.lit(self.slots))

    def asked(self, rows: DataFrame, hashed: Column, name: str) -> DataFrame:
        """``rows`` with the boolean ``name``: whether the filter may hold a row's hash."""
        rows = rows.withColumn("slot", self._slot(hashed)).withColumn("bucket", F.bitmap_bucket_number("slot"))
        at = F.bitmap_bit_position("slot").cast("int")
        byte = F.conv(F.hex(F.substring("bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        held = F.call_function("shiftright", byte, F.pmod(at, F.lit(8)).cast("int")).bitwiseAND(F.lit(1))
        joined = rows.join(F.broadcast(self.bits) if self.small else self.bits, "bucket", "left")
        return joined.withColumn(name, F.coalesce(held == 1, F.lit(False))).drop("slot", "bucket", "bits")


def best_row() -> Column:
    """The row that stays, as the least struct: most code points, then the smallest id (null last), then number."""
    return F.min(F.struct((-F.col("chars")).alias("less"), F.col("id").isNull().alias("no_id"), F.col("id").alias("id"), F.col("uid").alias("uid")))


def flushed(log: DataFrame) -> DataFrame:
    """The entries of each run: run, digest, best, n; ordered by digest."""
    return log.groupBy("run", "digest").agg(best_row().alias("best"), F.count("*").alias("n")).sortWithinPartitions("run", "digest")


def compacted(entries: DataFrame, runs: int) -> DataFrame:
    """The entries of so many runs, from those of more."""
    return entries.groupBy(F.pmod("run", F.lit(runs)).alias("run"), "digest").agg(F.min("best").alias("best"), F.sum("n").alias("n")).sortWithinPartitions("run", "digest")


def digest_hash() -> Column:
    return F.xxhash64("digest")


def merged(entries: DataFrame, runs: int = RUNS, fanout: int = FANOUT) -> DataFrame:
    """digest, best, n of the digests that more than one row has, settled; from settled entries of ``runs`` runs."""
    count = entries.count()
    shared = Filter(entries.select(digest_hash().alias("hash")), count, shared=True)
    level = shared.asked(entries, digest_hash(), "shared").filter("shared OR n > 1").drop("shared")
    while runs > 1:
        runs = max(1, runs // fanout)
        level = compacted(level, runs)
    return settle(level.filter("n > 1").select("digest", "best", "n"), "hits", (shared.bits,))


class Log:
    """``docs`` as a settled table with a number, digest and length for each row."""

    def __init__(self, docs: DataFrame, key: str, text: str, digest):
        self.key, self.text = key, text
        self.digest, self.chars = free_name(docs, "norm_digest"), free_name(docs, "text_chars")
        self.columns = docs.columns
        whole = F.coalesce(F.col(text), F.lit(""))
        self.table, self.uid = with_uid(docs, "log", digest(without_blanks(F.col(text))).alias(self.digest), F.char_length(whole).cast("long").alias(self.chars))

    def rows(self, *more: Column) -> DataFrame:
        uid = F.col(self.uid)
        return self.table.select(uid.alias("uid"), F.col(self.key).alias("id"), F.col(self.digest).alias("digest"), F.col(self.chars).alias("chars"), F.pmod(F.shiftright(uid, 33), F.lit(RUNS)).cast("int").alias("run"), *more)


def _resolved(log: Log) -> DataFrame:
    """uid, id, keep_id, kept, group_size and digest of each row of the log."""
    entries = settle(flushed(log.rows()), "runs")
    hits = merged(entries)
    many = hits.count()
    asked = Filter(hits.select(digest_hash().alias("hash")), many)

    texts = asked.asked(log.rows(F.col(log.text).alias("text")), digest_hash(), "hit").filter("hit").select("uid", "id", "digest", "chars", without_blanks(F.col("text")).alias("norm"))
    few = many <= BROADCAST_ROWS
    texts = texts.join(F.broadcast(hits.select("digest")) if few else hits.select("digest"), "digest", "left_semi")
    sorts = texts.groupBy("digest", "norm").agg(F.count("*").alias("n"))
    clashes = settle(sorts.groupBy("digest").agg(F.count("*").alias("texts")).filter("texts > 1").select("digest"), "clashes")

    slots = asked.asked(entries.select("digest", "run"), digest_hash(), "hit").filter("hit").select("digest", "run")
    slots = slots.join(F.broadcast(hits) if few else hits, "digest")
    rows = asked.asked(log.rows(), digest_hash(), "hit")
    alone = rows.filter("NOT hit").select("uid", "id", F.col("id").alias("keep_id"), F.lit(True).alias("kept"), F.lit(1).cast("long").alias("group_size"), "digest")
    found = rows.filter("hit").join(slots, ["digest", "run"], "left")
    told = ["uid", "id", F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("best.id")).alias("keep_id"), (F.coalesce("best.uid", "uid") == F.col("uid")).alias("kept"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), "digest"]
    if clashes.isEmpty():
        return alone.unionByName(found.select(*told))
    # digests that stand for several texts: by the bytes
    own = texts.join(clashes, "digest", "left_semi")
    by_bytes = own.groupBy("digest", "norm").agg(best_row().alias("best"), F.count("*").alias("n"))
    return alone.unionByName(found.join(clashes, "digest", "left_anti").select(*told)).unionByName(own.join(by_bytes, ["digest", "norm"]).select(*told))


def resolve(docs: DataFrame, *, key: str = "doc_id", text: str = "text", digest=sha256) -> DataFrame:
    """uid, id, keep_id, kept, group_size and digest, a row for each row of ``docs``."""
    return _resolved(Log(docs.select(key, text), key, text, digest))


def deduplicated(docs: DataFrame, *, key: str = "doc_id", text: str = "text", digest=sha256) -> DataFrame:
    """The rows of ``docs`` that stay, one of each group, with all their columns."""
    log = Log(docs, key, text, digest)
    gone = settle(_resolved(log).filter("NOT kept").select(F.col("uid").alias(log.uid)), "gone")
    return without_rows(log.table, log.uid, gone).select(*[F.col(f"`{c}`") for c in log.columns])


class LsmIndex:
    """An index that grows batch by batch.  Runs are settled tables; a full level is merged into one run of the next."""

    def __init__(self, spark: SparkSession, *, fanout: int = 4, digest=sha256):
        self.spark, self.fanout, self.digest, self.made = spark, fanout, digest, 0
        self.levels: list[list[tuple[DataFrame, Filter]]] = [[]]

    def _put(self, entries: DataFrame, level: int) -> None:
        run = settle(entries, f"run-level-{level}")
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append((run, Filter(run.select(digest_hash().alias("hash")), run.count())))

    def add(self, docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> None:
        """Flush a batch as a run of level 0, and merge the levels that are full.  Ids must be of one type."""
        log = Log(docs.select(key, text), key, text, self.digest)
        self.made += 1
        rows = log.rows().withColumn("run", F.lit(0)).withColumn("uid", F.concat_ws("-", F.lpad(F.lit(str(self.made)), 9, "0"), F.lpad(F.col("uid").cast("string"), 20, "0")))
        self._put(flushed(rows), 0)
        discard(log.table)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            self._put(compacted(self._union([run for run, _ in old]), 1), level + 1)
            for run, bits in old:
                discard(run, bits.bits)
            level += 1

    @staticmethod
    def _union(runs: list[DataFrame]) -> DataFrame:
        out = runs[0]
        for run in runs[1:]:
            out = out.unionByName(run)
        return out

    @property
    def runs(self) -> list[tuple[DataFrame, Filter]]:
        return [run for level in self.levels for run in level]

    def entries(self) -> DataFrame:
        """digest, best, n over all that was added; needs one ``add`` at least."""
        return compacted(self._union([run for run, _ in self.runs]), 1).select("digest", "best", "n")

    def seen(self, docs: DataFrame, known: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
        """``key``, keep_id of the rows of ``docs`` whose text is in the index.

        Each run's filter is asked before the run is joined, and hits are compared by their bytes with the texts
        of ``known``, the documents that were added.
        """
        probe = docs.select(F.col(key).alias("probe"), without_blanks(F.col(text)).alias("norm")).withColumn("digest", self.digest(F.col("norm")))
        met = [bits.asked(probe, digest_hash(), "hit").filter("hit").drop("hit").join(run.select("digest", "best"), "digest") for run, bits in self.runs]
        best = self._union(met).groupBy("probe", "digest", "norm").agg(F.min("best").alias("best")).select("probe", "norm", F.col("best.id").alias("keep_id"))
        texts = known.select(F.col(key).alias("keep_id"), without_blanks(F.col(text)).alias("norm"))
        return best.join(texts, ["keep_id", "norm"], "left_semi").select(F.col("probe").alias(key), "keep_id")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve(read_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP3_SQL = r"""
WITH norm AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t, length(coalesce(text, '')) AS chars FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, CAST(count(*) OVER (PARTITION BY t) AS BIGINT) AS group_size, row_number() OVER w = 1 AS kept, sha256(t) AS text_sha256
FROM norm WINDOW w AS (PARTITION BY t ORDER BY chars DESC, doc_id NULLS LAST)
"""
