"""Running sums over groups of any size: a group's rows are cut into slices by range, so none has to fit one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import partitions_for, settle


def running_sum(df: DataFrame, group: list[str], order: list[Column], value: Column, into: str) -> DataFrame:
    """``df`` with the sum of ``value`` over the group's rows up to each row in ``order``, as a settled table.

    Group columns must not be null and ``slice`` must be free.  Rows are dealt by ranges of (group, order); sums run
    within slices, and what the slices before add up to is added.  A range border cuts at most one group, so
    there are no more such offsets than tasks, and they are broadcast.
    """
    tasks = partitions_for(df.sparkSession)
    dealt = df.repartitionByRange(tasks, *[F.col(c) for c in group], *order).withColumn("slice", F.spark_partition_id())
    within = Window.partitionBy(*group, "slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = settle(dealt.withColumn(into, F.sum(value).over(within)), "running-cut")
    sums = cut.groupBy(*group, "slice").agg(F.sum(value).alias("held"))
    before = Window.partitionBy(*group).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = settle(sums.withColumn("before", F.sum("held").over(before)).filter("before IS NOT NULL").drop("held"), "running-offsets")
    out = cut.join(F.broadcast(offsets), [*group, "slice"], "left")  # at most one row a task
    return settle(out.withColumn(into, F.col(into) + F.coalesce("before", F.lit(0))).drop("before", "slice"), "running", (cut, offsets))
