"""Connected components of a link table, by randomised contraction on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gustline.llm.common import cut, stored


def connected_components(edges: DataFrame) -> DataFrame:
    """(a long, b long) links -> (node long, label long), label the smallest node reachable.

    Every round ranks the nodes anew by a hash, each node adopts the first of itself and its neighbours, links are rewritten to the adopted
    nodes, and loops and repeats go. A constant share of the nodes is expected to go in each round, whatever their order, so long chains
    take rounds that grow with the logarithm of their length. Only aggregates with a map-side combine and joins of stored tables, which AQE can split, are
    used, so that a node with very many links is no one task's burden; nothing reaches the driver but whether links remain.
    Self links and nulls count as no links; nodes without links are not returned; an empty table gives an empty table.
    """
    pair = F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")
    live = edges.select(*pair).where("a <> b")
    live = cut(live.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    rounds: list[DataFrame] = []
    while not live.isEmpty():
        rank = lambda c: F.xxhash64(c, F.lit(len(rounds)))
        both = live.select(F.col("a").alias("node"), F.col("b").alias("other")).unionAll(live.select("b", "a"))
        first = both.groupBy("node").agg(F.min(F.struct(rank("other").alias("rank"), "other")).alias("first"))
        parent = cut(first.select("node", F.when(F.col("first.rank") < rank("node"), F.col("first.other")).otherwise(F.col("node")).alias("parent")))
        to_a, to_b = (parent.select(F.col("node").alias(c), F.col("parent").alias(f"p{c}")) for c in "ab")
        moved = live.join(to_a, "a").join(to_b, "b").where("pa <> pb")
        live = cut(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
        rounds.append(parent)
    if not rounds:
        return live.select(F.col("a").alias("node"), F.col("b").alias("label"))
    labels = rounds[0].select("node", F.col("parent").alias("label"))
    for parent in rounds[1:]:
        hop = parent.select(F.col("node").alias("label"), "parent")
        labels = labels.join(hop, "label", "left").select("node", F.coalesce("parent", "label").alias("label"))
    labels = cut(labels)
    least = stored(labels.groupBy("label").agg(F.min("node").alias("least")), "least")
    return cut(labels.join(least, "label").select("node", F.col("least").alias("label")))
