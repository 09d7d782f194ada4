"""Comparison of partitions: Jaccard matching, Rand, mutual information, one-to-one mapping, stability, consensus.

Everything starts from a contingency table (a, b, observed), whose size is labels x labels; -1 is noise.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import stability_band

NOISE = -1


def jaccard(counts: DataFrame) -> DataFrame:
    """(a, b, observed, size_a, size_b, jaccard) of all overlapping clusters, noise left out of pairs but not of sizes."""
    rows = counts.groupBy("a").agg(F.sum("observed").alias("size_a"))
    cols = counts.groupBy("b").agg(F.sum("observed").alias("size_b"))
    both = counts.where(f"a <> {NOISE} AND b <> {NOISE}").join(rows, "a").join(cols, "b")
    return both.withColumn("jaccard", F.col("observed") / (F.col("size_a") + F.col("size_b") - F.col("observed")))


def best_match(counts: DataFrame) -> DataFrame:
    """(a, b, jaccard, recall): for each cluster of a the most similar of b; ties and no overlap: the lowest b."""
    j = jaccard(counts)
    rows = counts.where(f"a <> {NOISE}").groupBy("a").agg(F.sum("observed").alias("size_a"))
    lowest = counts.where(f"b <> {NOISE}").agg(F.min("b").alias("lowest"))
    best = j.withColumn("place", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("jaccard"), "b"))).where("place = 1")
    return (
        rows.crossJoin(lowest).join(best.select("a", "b", "observed", "jaccard"), "a", "left")
        .select("a", F.coalesce("b", "lowest").alias("b"), F.coalesce("jaccard", F.lit(0.0)).alias("jaccard"), F.coalesce(F.col("observed") / F.col("size_a"), F.lit(0.0)).alias("recall"), "size_a")
    )


def cluster_stability(runs: DataFrame) -> DataFrame:
    """(a, runs, size, jaccard_mean, jaccard_median, jaccard_min, low, high, band) of each cluster of a reference over
    other runs: its best Jaccard in each, the 95 % interval of those and the band of their mean. runs: (run, a, b,
    observed), one contingency table per run, a being the reference; noise has no row."""
    rows = runs.groupBy("run", "a").agg(F.sum("observed").alias("size_a"))
    cols = runs.groupBy("run", "b").agg(F.sum("observed").alias("size_b"))
    j = F.col("observed") / (F.col("size_a") + F.col("size_b") - F.col("observed"))
    best = runs.where(f"a <> {NOISE} AND b <> {NOISE}").join(rows, ["run", "a"]).join(cols, ["run", "b"]).groupBy("run", "a").agg(F.max(j).alias("j"))
    each = rows.where(f"a <> {NOISE}").join(best, ["run", "a"], "left").withColumn("j", F.coalesce("j", F.lit(0.0)))
    stats = each.groupBy("a").agg(
        F.count("*").alias("runs"), F.max("size_a").alias("size"), F.avg("j").alias("jaccard_mean"), F.percentile("j", 0.5).alias("jaccard_median"), F.min("j").alias("jaccard_min"),
        F.percentile("j", 0.025).alias("low"), F.percentile("j", 0.975).alias("high"),
    )
    return stats.withColumn("band", stability_band(F.col("jaccard_mean")))


def overlap_edges(counts: DataFrame, least: float = 0.70) -> DataFrame:
    return jaccard(counts).where(F.col("jaccard") >= least).select("a", "b", "jaccard")


def modal_overlap(counts: DataFrame) -> DataFrame:
    """(a, b, n, jaccard): for each cluster of a the cluster of b with most common members; NOISE and 0 if there is none."""
    j = jaccard(counts)
    best = j.withColumn("place", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("observed"), "b"))).where("place = 1")
    every = counts.where(f"a <> {NOISE}").select("a").distinct()
    return every.join(best, "a", "left").select("a", F.coalesce("b", F.lit(NOISE)).alias("b"), F.coalesce("observed", F.lit(0)).alias("n"), F.coalesce("jaccard", F.lit(0.0)).alias("jaccard"))


def _pairs(n: Column) -> Column:
    return n.cast("double") * (n - 1) / 2


def rand_index(counts: DataFrame) -> DataFrame:
    """(ari, papers): adjusted Rand index; 1 where both partitions are trivial."""
    rows = counts.groupBy("a").agg(F.sum("observed").alias("s")).agg(F.sum(_pairs(F.col("s"))).alias("pa"))
    cols = counts.groupBy("b").agg(F.sum("observed").alias("s")).agg(F.sum(_pairs(F.col("s"))).alias("pb"))
    both = counts.agg(F.sum(_pairs(F.col("observed"))).alias("pab"), F.sum("observed").alias("papers"))
    chance = F.try_divide(F.col("pa") * F.col("pb"), _pairs(F.col("papers")))
    ari = F.coalesce(F.try_divide(F.col("pab") - chance, (F.col("pa") + F.col("pb")) / 2 - chance), F.lit(1.0))
    return both.crossJoin(rows).crossJoin(cols).select(ari.alias("ari"), "papers")


def mutual_information(counts: DataFrame) -> float:
    """Adjusted mutual information (arithmetic mean). The table is labels x labels, so it comes to the driver."""
    t = counts.toPandas().pivot_table(index="a", columns="b", values="observed", fill_value=0).to_numpy()
    if t.shape[0] == t.shape[1] == 1 or t.shape[0] == t.shape[1] == t.sum():
        return 1.0
    n, ra, cb = int(t.sum()), t.sum(axis=1), t.sum(axis=0)
    nz = t > 0
    mi = float((t[nz] / n * np.log(t[nz] * n / np.outer(ra, cb)[nz])).sum())
    entropy = lambda s: float(-(s / n * np.log(s / n)).sum())
    lg = lambda x: math.lgamma(x + 1)
    expected = 0.0
    for x in map(int, ra):
        for y in map(int, cb):
            k = np.arange(max(1, x + y - n), min(x, y) + 1, dtype=float)
            fixed = lg(x) + lg(y) + lg(n - x) + lg(n - y) - lg(n)
            logs = np.array([fixed - lg(i) - lg(x - i) - lg(y - i) - lg(n - x - y + i) for i in k])
            expected += float((k / n * np.log(n * k / (x * y)) * np.exp(logs)).sum())
    mean = (entropy(ra) + entropy(cb)) / 2
    bottom = mean - expected
    return (mi - expected) / (bottom if abs(bottom) > 1e-15 else math.copysign(1e-15, bottom or 1))


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Minimum-cost one-to-one assignment by shortest augmenting paths; rows may be fewer or more than columns."""
    flipped = cost.shape[0] > cost.shape[1]
    c = (cost.T if flipped else cost).astype(float)
    n, m = c.shape
    u, v, match, way = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j = i, 0
        low, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while match[j]:
            used[j] = True
            slack = c[match[j] - 1] - u[match[j]] - v[1:]
            free = ~used[1:]
            better = free & (slack < low[1:])
            low[1:][better], way[1:][better] = slack[better], j
            k = int(np.where(free, low[1:], np.inf).argmin()) + 1
            delta = low[k]
            u[match[used]] += delta
            v[used] -= delta
            low[~used] -= delta
            j = k
        while j:
            match[j] = match[way[j]]
            j = way[j]
    pairs = [(int(match[j]) - 1, j - 1) for j in range(1, m + 1) if match[j]]
    return sorted((b, a) for a, b in pairs) if flipped else sorted(pairs)


def optimal_mapping(counts: DataFrame) -> dict[int, int]:
    """b -> a, one to one, with the most common members; pairs without any are left out."""
    t = counts.where(f"a <> {NOISE} AND b <> {NOISE}").toPandas()
    if t.empty:
        return {}
    p = t.pivot_table(index="a", columns="b", values="observed", fill_value=0)
    return {int(p.columns[j]): int(p.index[i]) for i, j in assign(-p.to_numpy()) if p.iat[i, j] > 0}


def mapped_agreement(counts: DataFrame) -> DataFrame:
    """(mapped_agreement, noise_agreement): share of rows that agree once b's labels are mapped; noise agrees with noise."""
    m = optimal_mapping(counts)
    mapped = F.create_map(*[F.lit(x) for kv in m.items() for x in kv])[F.col("b").cast("int")] if m else F.lit(None).cast("int")
    same = F.when((F.col("a") == NOISE) & (F.col("b") == NOISE), True).otherwise(F.coalesce(mapped == F.col("a"), F.lit(False)))
    noise = (F.col("a") == NOISE) == (F.col("b") == NOISE)
    n = F.sum("observed")
    return counts.agg((F.sum(F.when(same, F.col("observed")).otherwise(0)) / n).alias("mapped_agreement"), (F.sum(F.when(noise, F.col("observed")).otherwise(0)) / n).alias("noise_agreement"))


def jaccard_summary(counts: DataFrame) -> DataFrame:
    b = best_match(counts)
    return b.agg(F.avg("jaccard").alias("jaccard_mean"), F.percentile("jaccard", 0.5).alias("jaccard_median"), (F.sum(F.col("jaccard") * F.col("size_a")) / F.sum("size_a")).alias("jaccard_weighted"))


def cluster_summary(labels: DataFrame) -> DataFrame:
    """One row: papers, clusters, noise, sizes and their Gini coefficient. labels: (label).

    Gini over sorted sizes, sum((2 i - k - 1) s) / (k sum s), equals the mean absolute difference of all pairs without
    making them.
    """
    sizes = labels.groupBy("label").agg(F.count("*").alias("s"))
    ranked = sizes.where(f"label <> {NOISE}").withColumn("i", F.row_number().over(Window.orderBy("s", "label")))
    k = F.count("*")
    inner = ranked.agg(
        k.alias("cluster_count"), F.coalesce(F.min("s"), F.lit(0)).alias("size_min"), F.coalesce(F.percentile("s", 0.5), F.lit(0.0)).alias("size_median"), F.coalesce(F.max("s"), F.lit(0)).alias("size_max"),
        F.coalesce(F.try_divide(2.0 * F.sum(F.col("i") * F.col("s")) - (k + 1) * F.sum("s"), k * F.sum("s")), F.lit(0.0)).alias("size_gini"),
    )
    total = sizes.agg(F.sum("s").alias("papers"), F.sum(F.when(F.col("label") == NOISE, F.col("s")).otherwise(0)).alias("noise_count"))
    return total.crossJoin(inner).withColumn("noise_pct", 100.0 * F.col("noise_count") / F.col("papers")).withColumn("coverage", 1.0 - F.col("noise_count") / F.col("papers"))


def membership_summary(members: DataFrame, persistence: DataFrame) -> DataFrame:
    """One row: mean and median membership of the assigned rows, and mean, median and size-weighted persistence of the
    clusters; 0 where nothing is assigned. members: (label, membership); persistence: (label, persistence)."""
    own = members.where(f"label <> {NOISE}")
    m = own.agg(F.coalesce(F.avg("membership"), F.lit(0.0)).alias("membership_mean"), F.coalesce(F.percentile("membership", 0.5), F.lit(0.0)).alias("membership_median"))
    sizes = own.groupBy("label").agg(F.count("*").alias("s")).join(persistence, "label")
    p = sizes.agg(
        F.coalesce(F.avg("persistence"), F.lit(0.0)).alias("persistence_mean"), F.coalesce(F.percentile("persistence", 0.5), F.lit(0.0)).alias("persistence_median"),
        F.coalesce(F.try_divide(F.sum(F.col("s") * F.col("persistence")), F.sum("s")), F.lit(0.0)).alias("persistence_weighted"),
    )
    return m.crossJoin(p)


def _front(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows (k, o) that no other row seen here beats: as good in every objective and better in one."""
    kept = pd.DataFrame({"k": [], "o": []})
    for pdf in batches:
        both = pd.concat([kept, pdf], ignore_index=True) if len(kept) else pdf
        x = np.array([[np.nan if v is None else v for v in o] for o in both["o"]], dtype=float)
        beaten = lambda i, by: ((x[by] >= x[i]).all(axis=1) & (x[by] > x[i]).any(axis=1)).any()
        stay: list[int] = []
        for i in np.argsort(-np.nan_to_num(x).sum(axis=1), kind="stable"):  # who beats a row comes before it, or with an equal sum
            if not stay or not beaten(i, stay):
                stay.append(int(i))
        stay = [i for i in stay if not beaten(i, stay)]
        kept = both.iloc[sorted(stay)]
    if len(kept):
        yield kept


def pareto(rows: DataFrame, key: str, maximise: list[str], minimise: list[str] = ()) -> DataFrame:
    """rows with `front`: no other row is at least as good in every objective and better in one. A null or NaN beats nobody
    and is never beaten.

    Each partition keeps its own front, which holds the whole front's share; only those rows meet in one task.
    """
    signed = F.array(*[F.col(c).cast("double") for c in maximise], *[-F.col(c).cast("double") for c in minimise])
    own = rows.select(F.col(key).alias("k"), signed.alias("o"))
    schema = own.schema
    front = own.mapInPandas(_front, schema).repartition(1).mapInPandas(_front, schema).select(F.col("k").alias(key), F.lit(True).alias("front")).distinct()
    return rows.join(front, key, "left").withColumn("front", F.coalesce("front", F.lit(False)))


def medoid(pairs: DataFrame) -> DataFrame:
    """(run, mean_ari): the run with the highest mean over its pairs (left_run, right_run, ari); the first on ties."""
    ends = pairs.select(F.explode(F.array("left_run", "right_run")).alias("run"), "ari")
    mean = ends.groupBy("run").agg(F.avg("ari").alias("mean_ari"))
    return mean.withColumn("place", F.row_number().over(Window.orderBy(F.desc("mean_ari"), "run"))).where("place = 1").drop("place")


def consensus(votes: DataFrame) -> DataFrame:
    """(cluster, papers, consistency, low_pct, p10) from votes (paper, cluster, correct)."""
    per = votes.groupBy("paper", "cluster").agg(F.avg(F.col("correct").cast("double")).alias("c"))
    return per.groupBy("cluster").agg(F.count("*").alias("papers"), F.avg("c").alias("consistency"), (100.0 * F.count_if(F.col("c") < 0.5) / F.count("*")).alias("low_pct"), F.percentile("c", 0.1).alias("p10"))


def components_small(edges: pd.DataFrame) -> dict:
    """Connected components of a small edge list (nodes: categories of lenses), with the smallest node as name."""
    parent: dict = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges.itertuples(index=False):
        x, y = find(a), find(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(parent)}
