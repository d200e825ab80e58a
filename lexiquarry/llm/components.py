"""Connected components by contraction, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import settle


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label): the least node of its component, for every end of ``links`` (a, b).

    In each round a node hooks to the least of itself and its neighbours (partial minima, no join), and the
    links are rewritten between these labels; doubles and loops go.  A component's labels at least halve in
    number, so the rounds go with the logarithm of the nodes, and most links are gone after the first.  What a
    node's label became is followed round by round.  Tables are written in between; a hub's rows in a join
    can be split.
    """
    edges = settle(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    found = None
    for _ in range(rounds):
        ends = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
        hooks = settle(ends.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("label")), "hooks")
        first = found is None
        if first:
            found = hooks
        else:
            step = hooks.select(F.col("node").alias("label"), F.col("label").alias("next"))
            found = settle(found.join(step, "label", "left").select("node", F.coalesce("next", "label").alias("label")), "labels", (found,))
        a = hooks.select(F.col("node").alias("a"), F.col("label").alias("la"))
        b = hooks.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        moved = edges.join(a, "a").join(b, "b").filter("la <> lb")
        edges = settle(moved.select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct(), "links", (edges,) if first else (edges, hooks))
        if edges.isEmpty():
            return found
    raise RuntimeError(f"links are left after {rounds} rounds")
