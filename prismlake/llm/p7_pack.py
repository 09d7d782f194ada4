"""Problem 7: texts into containers of fixed capacity, measured in tokens, cut only where one text exceeds a container.

A text longer than the capacity fills whole containers; its rest and every shorter text are items. Items are packed in
shards of about SHARD_ITEMS, chosen by a hash of the key, so that no task grows with the collection (only the number
of shards does; a shard wastes at most a few containers). Within a shard the number of sequences is the one best-fit
decreasing needs; then the items, in descending length, go to the sequence of lowest estimated cost (linear plus
quadratic in the length, as attention costs) that has room left, or open another one.

Defined results: null and empty texts have no tokens and no container; ties are broken by key; capacities that are
null or below 1 are left out; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut
from ..tables import table
from .tokens import VOCABULARY, with_tokens

SHARD_ITEMS = 4000
LINEAR, QUADRATIC = 1.0, 1.0 / 2048


def pack(sizes, capacity: int, linear: float = LINEAR, quadratic: float = QUADRATIC):
    """Sequence number of each size (descending). Lowest cost with room first; ties go to the lowest number."""
    from bisect import bisect_left, insort

    import numpy as np

    room: list[int] = []
    full = 0
    for n in sizes:  # how many sequences best fit needs
        at = bisect_left(room, n)
        left = (room.pop(at) if at < len(room) else capacity) - n
        if left:
            insort(room, left)
        else:
            full += 1
    m = max(1, len(room) + full)
    free = np.full(m + 64, capacity, dtype=np.int64)
    cost = np.zeros(m + 64)
    out = np.empty(len(sizes), dtype=np.int64)
    for i, n in enumerate(sizes):
        fits = np.where(free[:m] >= n, cost[:m], np.inf)
        k = int(fits.argmin())
        if fits[k] == np.inf:
            if m == len(free):
                free, cost = np.concatenate([free, np.full(m, capacity)]), np.concatenate([cost, np.zeros(m)])
            k, m = m, m + 1
        free[k] -= n
        cost[k] += linear * n + quadratic * n * n
        out[i] = k
    return out


def pieces(sized: DataFrame, capacities: DataFrame, key: str) -> DataFrame:
    """(size_name, capacity, key, part, first_token, n_tokens) for each text under each capacity."""
    caps = capacities.where("capacity_tokens >= 1").groupBy("size_name").agg(F.max("capacity_tokens").cast("long").alias("capacity"))
    each = sized.where("n_tokens > 0").select(F.col(key).alias("key"), F.col("n_tokens").alias("total")).crossJoin(F.broadcast(caps))
    parts = F.sequence(F.lit(0).cast("long"), F.ceil(F.col("total") / F.col("capacity")) - 1)
    return each.withColumn("part", F.explode(parts)).select(
        "size_name", "capacity", "key", F.col("part").cast("int").alias("part"),
        (F.col("part") * F.col("capacity")).alias("first_token"),
        F.least(F.col("capacity"), F.col("total") - F.col("part") * F.col("capacity")).alias("n_tokens"),
    )


def containers(sized: DataFrame, capacities: DataFrame, key: str, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """Every piece with its container; `capacities` is a small configuration table, one row per container size."""
    per_doc = pieces(sized, capacities, key)
    whole = per_doc.where("n_tokens = capacity").withColumn("container", F.concat(F.lit("w-"), F.col("key").cast("string"), F.lit("-"), F.col("part").cast("string")))
    items = per_doc.where("n_tokens < capacity")
    counted = items.groupBy("size_name").agg(F.count("*").alias("items"))
    shards = F.greatest(F.lit(1), F.ceil(F.col("items") / shard_items)).cast("int")
    placed = items.join(F.broadcast(counted), "size_name").withColumn("shard", F.pmod(F.xxhash64("key"), shards).cast("int")).drop("items")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "key", "part"], ascending=[False, True, True], kind="stable")
        numbers = pack(pdf["n_tokens"].to_numpy(), int(pdf["capacity"].iloc[0]))
        return pdf.drop(columns="shard").assign(container=[f"{pdf['shard'].iloc[0]}-{k}" for k in numbers])

    packed = placed.groupBy("size_name", "shard").applyInPandas(one, whole.schema)
    return whole.unionByName(packed)


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(with_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary=VOCABULARY))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = containers(_sized(spark, sf_dir), table(spark, sf_dir, "container_sizes").select("size_name", "capacity_tokens"), "doc_id")
    return out.withColumnRenamed("key", "doc_id")


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, tokens and share of used room by container size."""
    return (
        p7_containers(spark, sf_dir).groupBy("size_name", "capacity", "container").agg(F.sum("n_tokens").alias("used"))
        .groupBy("size_name", "capacity").agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"))
        .withColumn("fill", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 6))
    )


QUERIES = {"p7_containers": p7_containers, "p7_fill": p7_fill}
SQL = {}
