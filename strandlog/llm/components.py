"""Connected components of a distributed edge list, by alternating large-star and small-star steps.

Every step is a shuffle with map-side combining; tables are written to the shared folder, so a lost executor costs
a step at most. A vertex with very many neighbours is handled by minimum aggregates and joins, never as one group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlog.llm.shared import forget, written

MOST_STEPS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """large: link each vertex's greater neighbours to its least one. small: link the lesser ones, and itself."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    linked = both.join(least, "u")
    if large:
        return linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.where("m != u").select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v): one row (id, root) for every vertex of an edge, as a written table; root is the least id of its component."""
    now = written(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for _ in range(MOST_STEPS):
        if now.isEmpty():
            break
        nxt = written(_star(_star(now, True), False).where("u != v").distinct(), "edges")
        # done when every vertex hangs on a root, which itself hangs on nothing, and nothing hangs on two
        deep = nxt.join(nxt.select(F.col("u").alias("v")).distinct(), "v", "left_semi").isEmpty()
        forget(now)
        now = nxt
        if deep and nxt.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
            break
    else:
        raise RuntimeError(f"components not found in {MOST_STEPS} steps")
    out = written(now.select(F.col("u").alias("id"), F.col("v").alias("root")).union(now.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()), "roots")
    forget(now)
    return out
