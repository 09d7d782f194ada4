"""Connected components by alternating large-star and small-star steps; nothing is collected to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's neighbours to the smallest node among them and itself: the greater ones (large) or the smaller."""
    both = edges.select(F.col("a").alias("x"), F.col("b").alias("y")).unionAll(edges.select(F.col("b").alias("x"), F.col("a").alias("y")))
    if not large:
        both = both.where("y < x")
    low = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
    far = both.where("y > x") if large else both.unionAll(low.select("x", F.col("x").alias("y")))
    return far.join(low, "x").where("y <> m").select(F.col("m").alias("a"), F.col("y").alias("b")).distinct()


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(id, component): component is the smallest id that can be reached. edges: (a, b). Nodes without edge are not listed."""
    e = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    for _ in range(max_rounds):
        new = cut(_star(_star(e, True), False))
        moved = new.exceptAll(e).limit(1).count() or e.exceptAll(new).limit(1).count()
        e = new
        if not moved:
            break
    else:
        raise RuntimeError(f"components didn't settle in {max_rounds} rounds")
    return e.select(F.col("b").alias("id"), F.col("a").alias("component")).unionAll(e.select("a", "a").distinct().toDF("id", "component"))
