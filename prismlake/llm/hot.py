"""Equi-joins in which one key may hold a large part of all rows.

Both sides are counted by hash bucket of the key (summed on the map side, so a hot key costs one row per task). The few
buckets that hold far more rows than their share are split into a grid: each side's rows go to one of its own cells by
a hash of the row's id and are repeated for every cell of the other side, so no task gets more than about CELL x CELL
pairs of a hot key and no pair is lost. What is broadcast is bounded: at most BUCKETS rows of three numbers.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

BUCKETS = 1 << 12
CELL = 2000


def hot_buckets(joins: list[tuple[DataFrame, DataFrame]], cell: int = CELL, buckets: int = BUCKETS) -> list[DataFrame | None]:
    """For each join (left, right), both with (key LONG): (_bucket, _lc, _rc), the cells of the left and the right rows of
    the buckets in which a side holds more than `cell` rows above four times a bucket's mean; None if there is no such
    bucket. All joins are counted in one job."""
    rows = []
    for g, (left, right) in enumerate(joins):
        rows += [left.select(F.lit(g).alias("g"), "key", F.lit(1).alias("l"), F.lit(0).alias("r")), right.select(F.lit(g).alias("g"), "key", F.lit(0).alias("l"), F.lit(1).alias("r"))]
    n = reduce(DataFrame.unionAll, rows).groupBy("g", F.pmod("key", F.lit(buckets)).cast("int").alias("_bucket")).agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    mean = n.groupBy("g").agg((F.sum("l") / buckets).alias("ml"), (F.sum("r") / buckets).alias("mr"))
    most = n.where((F.col("l") > cell) | (F.col("r") > cell)).join(mean, "g")  # few unless there are buckets x cell rows
    cells = lambda c: F.when(F.col(c) > cell + 4 * F.col(f"m{c}"), F.ceil(F.col(c) / cell)).otherwise(1).cast("int")
    hot = cut(most.select("g", "_bucket", cells("l").alias("_lc"), cells("r").alias("_rc")).where("_lc > 1 OR _rc > 1"))
    some = {r[0] for r in hot.select("g").distinct().collect()}
    return [hot.where(F.col("g") == g).drop("g") if g in some else None for g in range(len(joins))]


def split_join(left: DataFrame, right: DataFrame, left_id: str, right_id: str, hot: DataFrame | None, buckets: int = BUCKETS) -> DataFrame:
    """left JOIN right USING (key LONG) without the key; the buckets in hot are split into cells, which become part of
    the key. The other columns of the sides must differ in name."""
    if hot is None:
        return left.join(right, "key").drop("key")
    hot = F.broadcast(hot)
    bucket = F.pmod("key", F.lit(buckets)).cast("int")

    def side(rows: DataFrame, own_id: str, own: str, other: str, names: tuple[str, str]) -> DataFrame:
        out = rows.withColumn("_bucket", bucket).join(hot, "_bucket", "left")
        out = out.withColumn(names[0], F.pmod(F.xxhash64(own_id), F.coalesce(own, F.lit(1))).cast("short"))
        out = out.withColumn(names[1], F.explode(F.sequence(F.lit(0).cast("short"), (F.coalesce(other, F.lit(1)) - 1).cast("short"))))
        place = F.when(F.col("_lc").isNull(), F.col("key")).otherwise(F.xxhash64("key", "_i", "_j"))
        return out.withColumn("key", place).drop("_bucket", "_lc", "_rc", "_i", "_j")

    l, r = side(left, left_id, "_lc", "_rc", ("_i", "_j")), side(right, right_id, "_rc", "_lc", ("_j", "_i"))
    return l.join(r, "key").drop("key")
