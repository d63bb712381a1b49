"""Connected components of a table of links, by alternating star contraction.

Each round joins every node to the smallest neighbour, first from its larger neighbours, then from its smaller ones;
the number of rounds grows with the logarithm of the longest chain. Hub nodes with very many links are no single
task's work: every step is a grouped minimum (with partial sums) and a join that adaptive execution may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import save


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One half round on links (u, v) with u > v."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = save(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
    near = both.join(least, "u")
    if large:
        moved = near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        kept = least.where("m < u").select("u", F.col("m").alias("v"))
        return moved.union(kept).where("u > v").distinct()
    moved = near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u > v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every node of ``edges`` (two id columns); root is the smallest id of the component."""
    a, b = edges.columns
    links = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    links = save(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    while True:
        state = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if not state.n:
            break
        # Done once every node has one link and roots have none of their own.
        links = save(_star(save(_star(links, True)), False))
        after = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if after == state:
            break
    roots = links.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()
    return links.select(F.col("u").alias("id"), F.col("v").alias("root")).union(roots)
