"""Connected components by alternating large-star and small-star steps, all as joins and aggregates.

Each step takes the minimum of a node's neighbours by a pre-aggregated groupBy and sends it to them by a join that
adaptive execution may split, so a hub with a third of all edges is never one task. Every round is checkpointed to the
shared folder; nothing but two counts comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _util as u


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long, in any direction). Returns (node, root) for all nodes with an edge; root is the smallest node
    reachable, also for the root itself."""
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, state = u.materialise(e, "edges"), None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(u.unkeyed(least, "u"), "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(u.unkeyed(least, "u"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = u.materialise(least.withColumnRenamed("m", "v").unionByName(moved).distinct(), "edges")
        found = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        u.drop_files(e)
        e = after
        if found == state:
            break
        state = found
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
