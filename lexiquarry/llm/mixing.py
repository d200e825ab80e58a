"""Mixing sources to target weights by capped water-filling.

Every source has a weight.  The words to hand out are a share of all words; a source gets words in
proportion to its weight but never more than ``cap`` times its own, and what it can't take goes to the
others by weight.  The level of the water is found on the table of sources: with sources ordered by the
level at which they fill up, the sums over those that are full and the weights of those that aren't give
the level for each place in that order; the first place whose source isn't full at its level has the
answer, which is where repeated clamping and sharing out ends too.

A source's target is then sampled: whole repetitions of each row, and one more for some.  Rows of a source
stand in the order of a seeded digest of id and text, then of a number that tells rows apart; those up to
the cut, which is where the missing words end, get one more, and so do ``fills`` rows behind the cut, each
the one whose size is nearest to what is left then.

The cut is found by digits: words are summed by (source, next digits of the digest), the group in which the
missing words end is found, and the next digits count within that group only; after the digest come the
input split and the number, for rows that are equal.  No source's rows meet in one task, and what decides
for a row (the cut and the numbers of the few behind it) is one narrow line for each source.  The rows behind
the cut are found among the first few of each size, so a source's list is as long as it has different sizes.

Defined results: a null text has size 0; a null source is a source of its own, last in order; ids may be
null, repeat and be of any type: each row is a document of its own, and rows equal in id and text are taken
in any order, as none can tell; ties in size go to the smaller digest; long texts are counted whole; an
empty table gives an empty result; other columns, whatever their names, are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import BROADCAST_ROWS, free_name, join_keyed, read_table, settle, with_uid

#: Words are the runs of other characters than white space (space, U+0009 to U+000D).
WORD = r"[^\x20\x09-\x0D]+"
#: Hex digits of the digest that are looked at in one step.
DIGITS = 3


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cycled(sources: DataFrame, cycle: int = 3) -> DataFrame:
    """The default weights: 1 to ``cycle``, repeating, by source in code point order, null last."""
    place = F.row_number().over(Window.orderBy(F.col("of").asc_nulls_last()))
    return sources.withColumn("weight", ((place - 1) % cycle + 1).cast("double"))


def water_fill(sources: DataFrame, cap: float = 3.0, share: float = 1.0) -> DataFrame:
    """(of, words, weight) with the column target added.  One narrow row per source."""
    room = F.col("words") * F.lit(float(cap))
    order = Window.orderBy(room / F.col("weight"), F.col("of").asc_nulls_last())
    total = F.sum("words").over(Window.partitionBy()) * F.lit(float(share))
    full = F.coalesce(F.sum(room).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    laid = sources.withColumn("room", room).withColumn("at", (total - full) / rest).withColumn("place", F.row_number().over(order))
    fits = F.when(F.col("room") >= F.col("at") * F.col("weight"), F.struct("place", "at"))
    level = F.min(fits).over(Window.partitionBy())["at"]
    return laid.withColumn("target", F.least("room", F.coalesce(level * F.col("weight"), F.col("room")))).drop("room", "at", "place")


def digest(key: Column, text: Column, seed: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(key.cast("string"), F.lit("null")), F.md5(F.coalesce(text, F.lit("")))))


def _same_source(left: DataFrame, right: DataFrame, more: Column | None = None, how: str = "inner") -> DataFrame:
    """Joined on ``of``, null with null; ``more`` may name columns of both sides."""
    same = F.col("of").eqNullSafe(F.col("right_of"))
    return left.join(right.withColumnRenamed("of", "right_of"), same if more is None else same & more, how).drop("right_of")


def _ends(sums: DataFrame) -> DataFrame:
    """(of, part, own, left) → of, cut: the part in which the missing words end, and still: those missing then."""
    upto = Window.partitionBy("of").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    over = sums.withColumn("sum", F.sum("own").over(upto)).filter(F.col("sum") > F.col("left"))
    return over.groupBy("of").agg(F.min(F.struct("part", (F.col("left") - F.col("sum") + F.col("own")).alias("still"))).alias("end")).select("of", F.col("end.part").alias("cut"), F.col("end.still").alias("still"))


def _picked(left: Column, spare: Column, fills: int) -> Column:
    """Numbers of at most ``fills`` rows of ``spare`` (size, rows: digest, uid), each the nearest to what is left then."""
    none = F.struct(left.alias("left"), F.array().cast("array<long>").alias("uids"))

    def step(acc: Column, _: Column) -> Column:
        fits = F.filter(F.transform(spare, lambda x: F.struct(F.abs(x["size"] - acc["left"]).alias("off"), x["digest"].alias("digest"), x["uid"].alias("uid"), x["size"].alias("size"))), lambda x: (x["off"] < acc["left"]) & ~F.array_contains(acc["uids"], x["uid"]))
        best = F.array_min(fits)
        return F.when(best.isNull(), acc).otherwise(F.struct((acc["left"] - best["size"]).alias("left"), F.array_append(acc["uids"], best["uid"]).alias("uids")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(fills)), none, step, lambda acc: acc["uids"])


def planned(rows: DataFrame, weigh=cycled, cap: float = 3.0, share: float = 1.0, fills: int = 3) -> DataFrame:
    """One line for each source (of), settled: words, target, whole, cut_digest, cut_uid and more.

    ``rows`` is a settled table of source, uid, size and digest.  A row is taken ``whole`` times, and once more
    if (digest, uid) is before the cut or uid is in ``more``.
    """
    first = F.substring("digest", 1, DIGITS)
    buckets = settle(rows.groupBy(F.col("source").alias("of"), first.alias("part")).agg(F.sum("size").alias("own")), "mix-buckets")
    sources = water_fill(weigh(buckets.groupBy("of").agg(F.sum("own").alias("words"))), cap, share)
    whole = F.when(F.col("words") > 0, F.floor(F.col("target") / F.col("words"))).otherwise(F.lit(0)).cast("long")
    plan = settle(sources.withColumn("whole", whole).withColumn("left", F.col("target") - F.col("whole") * F.col("words")), "mix-plan")
    hint = F.broadcast if plan.count() <= BROADCAST_ROWS else lambda df: df

    asking = plan.filter("left > 0").select("of", "left")
    ends = _ends(_same_source(buckets, hint(asking)))
    near = rows.select(F.col("source").alias("of"), "uid", "size", "digest", first.alias("part"))
    near = settle(_same_source(near, hint(ends), F.col("part") == F.col("cut")).drop("part", "cut").withColumnRenamed("still", "left"), "mix-near")
    split, number = (F.lpad(c.cast("string"), 20, "0") for c in (F.shiftright("uid", 33), F.col("uid")))
    for part in (F.substring("digest", 1 + DIGITS, DIGITS), F.substring("digest", 1 + 2 * DIGITS, DIGITS), F.concat_ws(":", "digest", split), number):
        near = near.withColumn("part", part)
        ends = _ends(near.groupBy("of", "part", "left").agg(F.sum("size").alias("own")))
        near = _same_source(near.drop("left"), hint(ends), F.col("part") == F.col("cut")).drop("part", "cut").withColumnRenamed("still", "left")
    cuts = settle(near.select("of", "left", F.col("digest").alias("cut_digest"), F.col("uid").alias("cut_uid")), "mix-cuts", (buckets,))  # one row a source

    behind = _same_source(rows.filter("size > 0").select(F.col("source").alias("of"), "uid", "size", "digest"), hint(cuts.filter("left > 0"))).filter(~before_cut())
    few = Window.partitionBy("of", "size").orderBy("digest", "uid")
    spare = behind.filter(F.abs(F.col("size") - F.col("left")) < F.col("left")).withColumn("place", F.row_number().over(few)).filter(F.col("place") <= fills)
    lists = spare.groupBy("of").agg(F.collect_list(F.struct("size", "digest", "uid")).alias("spare"), F.min("left").alias("left"))
    picks = lists.select("of", _picked(F.col("left"), F.col("spare"), fills).alias("more"))
    told = _same_source(plan.drop("left", "weight"), hint(cuts.drop("left")), how="left")
    return settle(_same_source(told, picks, how="left"), "mix-told", (plan, cuts))


def before_cut() -> Column:
    return F.coalesce((F.col("digest") < F.col("cut_digest")) | ((F.col("digest") == F.col("cut_digest")) & (F.col("uid") < F.col("cut_uid"))), F.lit(False))


def mix(docs: DataFrame, *, size: Column | None = None, source: str = "source", key: str = "doc_id", text: str = "text", seed: str = "mix-1", name: str = "mix", **kw) -> tuple[DataFrame, str]:
    """``docs`` and a struct column of size, source_size, target, epochs and taken; and that column's name.

    ``size`` is an expression on ``docs``, words of the text by default.  The name is ``name``, with underscores
    in front if ``docs`` has it.
    """
    size = words(F.col(text)) if size is None else size
    n, h = free_name(docs, "row_size"), free_name(docs, "row_digest")
    table, uid = with_uid(docs, "mix-docs", size.alias(n), digest(F.col(key), F.col(text), seed).alias(h))
    rows = table.select(F.col(source).alias("source"), F.col(uid).alias("uid"), F.col(n).alias("size"), F.col(h).alias("digest"))
    plan = planned(settle(rows, "mix-rows"), **kw)
    marked = table.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(source).alias("source"), F.col(uid).alias("uid"), F.col(n).alias("size"), F.col(h).alias("digest"))
    told = join_keyed(marked, plan, F.col("source").eqNullSafe(F.col("of")))
    one_more = before_cut() | F.coalesce(F.array_contains("more", F.col("uid")), F.lit(False))
    told = told.withColumn("epochs", F.col("whole") + one_more.cast("long"))
    own = free_name(docs, name)
    return told.select("doc.*", F.struct("size", F.col("words").alias("source_size"), "target", "epochs", (F.col("size") * F.col("epochs")).alias("taken")).alias(own)), own


def repeated(docs: DataFrame, **kw) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken, with the columns of ``docs``."""
    out, own = mix(docs, **kw)
    copy = free_name(out, "copy")
    return out.withColumn(copy, F.explode(F.array_repeat(F.lit(1), F.col(own)["epochs"].cast("int")))).drop(copy, own)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    table, uid = with_uid(docs.select("doc_id", "source", words(F.col("text")).alias("size"), digest(F.col("doc_id"), F.col("text"), "mix-1").alias("digest")), "mix-rows")
    rows = table.withColumnRenamed(uid, "uid")
    told = join_keyed(rows, planned(rows), F.col("source").eqNullSafe(F.col("of")))
    one_more = before_cut() | F.coalesce(F.array_contains("more", F.col("uid")), F.lit(False))
    return told.select("doc_id", "size", F.col("words").alias("source_size"), "target", (F.col("size") * (F.col("whole") + one_more.cast("long"))).alias("taken"))


OP9_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))) AS h,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS words,
         CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS w
  FROM sized GROUP BY source
), laid AS (
  SELECT *, 3.0::DOUBLE * words AS room,
    (CAST(sum(words) OVER () AS DOUBLE)
      - coalesce(sum(3.0::DOUBLE * words) OVER (ORDER BY 3.0::DOUBLE * words / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY 3.0::DOUBLE * words / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl,
    row_number() OVER (ORDER BY 3.0::DOUBLE * words / w, source NULLS LAST) AS place
  FROM sources
), filled AS (
  SELECT source, words, least(room, coalesce((SELECT arg_min(lvl, place) FROM laid WHERE room >= lvl * w) * w, room)) AS target FROM laid
), planned AS (
  SELECT *, CASE WHEN words > 0 THEN CAST(floor(target / words) AS BIGINT) ELSE 0 END AS whole FROM filled
), summed AS (
  SELECT d.doc_id, d.source, d.size, d.h, p.words, p.target, p.whole, p.target - p.whole * p.words AS extra,
    row_number() OVER w AS r, CAST(sum(d.size) OVER w AS BIGINT) AS upto
  FROM sized d JOIN planned p ON d.source IS NOT DISTINCT FROM p.source WINDOW w AS (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size ROWS UNBOUNDED PRECEDING)
), s0 AS (
  SELECT *, CASE WHEN upto <= extra THEN 1 ELSE 0 END AS more, extra - coalesce(max(CASE WHEN upto <= extra THEN upto END) OVER (PARTITION BY source), 0) AS rest FROM summed
FILLS)
SELECT doc_id, size, words AS source_size, target, CAST(size * (whole + more) AS BIGINT) AS taken FROM s3
""".replace("FILLS", "".join(f"""
), f{k} AS (
  SELECT *, arg_min(r, (abs(size - rest), h, r)) FILTER (WHERE more = 0 AND size > 0 AND abs(size - rest) < rest) OVER (PARTITION BY source) AS pick,
    coalesce(arg_min(size, (abs(size - rest), h, r)) FILTER (WHERE more = 0 AND size > 0 AND abs(size - rest) < rest) OVER (PARTITION BY source), 0) AS got FROM s{k}
), s{k + 1} AS (
  SELECT * EXCLUDE (more, rest, pick, got), CASE WHEN r = pick THEN 1 ELSE more END AS more, rest - got AS rest FROM f{k}""" for k in range(3)) + "\n")
