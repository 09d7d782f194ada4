"""Splits and samples by hash order: equal in every rerun, partitioning and engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def place(key: Column, seed: str | int) -> Column:
    """Hexadecimal digest to order by; its first 16 digits sort as the unsigned number they are."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)


def first_by_hash(rows: DataFrame, key: str, seed, n: int) -> DataFrame:
    """n rows without replacement."""
    return rows.withColumn("_h", place(F.col(key), seed)).orderBy("_h", key).limit(n).drop("_h")


def split(rows: DataFrame, key: str, seed, parts: list[tuple[str, int]]) -> DataFrame:
    """(key, part): consecutive runs of the hash order; what is left over is in none. Only the runs are ranked."""
    total = sum(n for _, n in parts)
    picked = rows.select(key).withColumn("_h", place(F.col(key), seed)).orderBy("_h", key).limit(total)
    picked = picked.withColumn("_i", F.row_number().over(Window.orderBy("_h", key)))
    part, upto = F.lit(None).cast("string"), 0
    edges = []
    for name, n in parts:
        upto += n
        edges.append((upto, name))
    for edge, name in reversed(edges):
        part = F.when(F.col("_i") <= edge, name).otherwise(part)
    return picked.select(key, part.alias("part"))


def fraction_split(rows: DataFrame, key: str, seed, shares: list[tuple[str, float]]) -> DataFrame:
    """(key, part) by the hash's value, without any ordering: shares hold in expectation at any size."""
    x = F.conv(F.substring(place(F.col(key), seed), 1, 13), 16, 10).cast("long").cast("double") / float(1 << 52)
    part, edge = F.lit(shares[-1][0]), 1.0
    for name, share in reversed(shares):
        part = F.when(x < edge, name).otherwise(part)
        edge -= share
    return rows.select(key, part.alias("part"))


def stratified(rows: DataFrame, strata: list[str], key: str, seed, n: int) -> DataFrame:
    """At most n rows of each stratum."""
    w = Window.partitionBy(*strata).orderBy(place(F.col(key), seed), key)
    return rows.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= n).drop("_i")


def random_pairs(spark, n: int, keys: int, seed) -> DataFrame:
    """(i, left, right): n pairs of different row numbers below `keys`, with replacement."""
    side = lambda s: F.pmod(F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:{s}:"), F.col("id").cast("string")), 256), 1, 13), 16, 10).cast("long"), F.lit(keys))
    return spark.range(n).select(F.col("id").alias("i"), side("l").alias("left"), side("r").alias("right")).where("left <> right")
