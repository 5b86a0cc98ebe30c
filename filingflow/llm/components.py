"""Connected components of a table of links, by alternating star steps.

Each step is a grouped minimum and a join: the large-star step hangs every
larger neighbour of a vertex on its least neighbour, the small-star step does
the same for the smaller ones.  The number of links never grows, and about
log(vertices) rounds end with every vertex linked to the least of its
component.  Tables are written between rounds, so lost executors cost a reread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingflow.llm.store import Scratch


def _star(links: DataFrame, smaller: bool) -> DataFrame:
    """links: (u, v) with u > v."""
    if smaller:
        near = links
    else:
        near = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = near.join(least, "u")
    if smaller:
        moved = joined.select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
                                                F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
    else:
        moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.where("u > v").distinct()


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(u, v) for every linked vertex u but the least v of its component."""
    both = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()
    table, label, state = scratch.put(both, "links0"), "links0", None
    for step in range(200):
        new = f"links{step + 1}"
        table = scratch.put(_star(_star(table, False), True), new)
        scratch.drop(label)
        label = new
        was, state = state, table.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if was == state:
            return table
    raise RuntimeError("components did not settle")
