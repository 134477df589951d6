"""Connected components of a link table, in a few joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemodels.llm.common import saved

MOST_ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of (a, b) links; the root is the component's smallest node.

    Every round ties each node to the smallest node it knows of (large star,
    then small star), so a component of n nodes is settled in about log n
    rounds. Sums of a node's neighbours are pre-aggregated minima, and each
    round's links are written to the shared folder.
    """
    a, b = F.col("a"), F.col("b")
    # Each link points from the larger to the smaller node.
    down = saved(
        links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter(a != b).distinct(), "links"
    )
    for _ in range(MOST_ROUNDS):
        both = down.union(down.select(b.alias("a"), a.alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        # Large star: larger neighbours move to the smallest neighbour.
        large = down.select(b.alias("k"), a.alias("v")).join(least.withColumnRenamed("a", "k"), "k")
        large = large.select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: a node and its smaller neighbours move to the smallest of these.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).filter(a != b)
        new = saved(small.union(low.select("a", F.col("m").alias("b"))).distinct(), "links")
        settled = new.join(down, ["a", "b"], "left_anti").isEmpty() and down.join(new, ["a", "b"], "left_anti").isEmpty()
        down = new
        if settled:
            break
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    return down.select(a.alias("node"), b.alias("root"))
